"""Search legs, fusion and reranking against hand-computed and brute-force results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan
from paperloom import kernels
from paperloom.functions import vectors as vx
from paperloom.operators import fusion, rerank, search
from paperloom.operators.ranking import global_rank, ranked_top_k, top_k_per_group


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_cosine_guards(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in df.select(vx.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / math.sqrt(2)) and got[1:] == [0.0, 0.0, None]


def test_dense_search_handles_zero_null_and_wrong_size(spark):
    data = [("z", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("n", None), ("x", [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(data, "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(1, [3.0, 0.0])], "query_id int, query_vector array<double>")
    hits = search.dense_search(vectors, queries, 5, 2)
    assert sorted(rows(hits, "rank", "chunk_id", "score")) == [(1, "a", 1.0), (2, "b", 0.0), (3, "z", 0.0)]
    strict = search.dense_search(vectors, queries, 5, 2, threshold=0.0)
    assert rows(strict, "chunk_id") == [("a",)]


def test_dense_blocks_give_the_same_answer(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "chunk_id int, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "query_id int, query_vector array<double>")
    whole = set(rows(search.dense_search(vectors, queries, 3, 4), "query_id", "chunk_id", "rank"))
    monkeypatch.setattr(search, "DEFAULTS", type("D", (), {"search": type("S", (), {"query_block_bytes": 4 * 8 * 4})})())
    blocks = set(rows(search.dense_search(vectors, queries, 3, 4), "query_id", "chunk_id", "rank"))
    assert len(whole) == 60 and whole == blocks


def test_best_rows_keep_ties_by_id():
    best = kernels.BestRows(1, 2)
    best.push(np.array([5, 9]), np.array([[1.0], [1.0]]))
    best.push(np.array([3, 1]), np.array([[1.0], [0.5]]))
    assert best.ids[0].tolist() == [3, 5]


def test_sparse_search_brute_force(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 25))]) for i in range(80)]
    asks = [(q, [rnd.choice(words) for _ in range(4)]) for q in range(6)]
    d = spark.createDataFrame(docs, "chunk_id int, terms array<string>")
    q = spark.createDataFrame([(i, t, [1.0] * len(t)) for i, t in asks], "query_id int, terms array<string>, weights array<double>")
    for keep_zero in (False, True):
        want = set()
        for qid, terms in asks:
            scored = [(-sum(t.count(x) for x in terms), i) for i, t in docs if t]
            ranked = sorted(s for s in scored if keep_zero or s[0] < 0)[:70]
            want |= {(qid, i, float(-s), n + 1) for n, (s, i) in enumerate(ranked)}
        got = set(rows(search.sparse_search(d, q, 70, keep_zero=keep_zero), "query_id", "chunk_id", "score", "rank"))
        assert got == want


def test_text_search_needs_every_term(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"]), (3, ["b", "a"]), (4, [])], "chunk_id int, terms array<string>")
    q = spark.createDataFrame([(7, ["a", "b", "a"]), (8, [])], "query_id int, terms array<string>")
    assert sorted(rows(search.text_search(d, q, 5), "query_id", "chunk_id", "rank")) == [(7, 1, 1), (7, 3, 2)]


def test_maxsim_clamps_negative_matches(spark):
    docs = spark.createDataFrame([("d", [[1.0, 0.0], [0.0, 1.0]]), ("e", [[-1.0, 0.0]])], "chunk_id string, token_embeddings array<array<double>>")
    tokens = [[1.0, 0.0], [0.0, 1.0]]
    assert rows(search.maxsim_nested(docs, tokens, 2), "chunk_id", "score") == [("d", 2.0), ("e", 0.0)]
    longs = docs.select("chunk_id", F.explode("token_embeddings").alias("v"))
    assert rows(search.maxsim_long(longs, tokens, 2, doc_col="chunk_id", vector_col="v", dim=2), "chunk_id", "score") == [("d", 2.0), ("e", 0.0)]
    q = F.array(*[vx.vector_literal(t) for t in tokens])
    assert [r[0] for r in docs.select(vx.max_similarity(q, F.col("token_embeddings"))).collect()] == [2.0, 0.0]


def legs(spark):
    dense = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (1, "c", 0.7, 3)], "query_id int, chunk_id string, score double, rank int")
    sparse = spark.createDataFrame([(1, "c", 9.0, 1), (1, "d", 8.0, 2)], "query_id int, chunk_id string, score double, rank int")
    return dense, sparse


def test_rrf_scores_and_tie_order(spark):
    dense, sparse = legs(spark)
    fused = {r["chunk_id"]: r for r in fusion.rrf({"dense": (dense, 1.0), "sparse": (sparse, 1.0)}, 10).collect()}
    assert fused["c"]["score"] == pytest.approx(1 / 63 + 1 / 61) and fused["c"]["rank"] == 1
    # b and d tie at 1/62: the dense hit comes first.
    assert [c for c, r in sorted(fused.items(), key=lambda x: x[1]["rank"])] == ["c", "a", "b", "d"]
    assert fused["d"]["dense_score"] is None and fused["d"]["sparse_rank"] == 2


def test_rrf_union_equals_outer_join_and_ignores_leg_order(spark):
    dense, sparse = legs(spark)
    a = fusion.rrf({"dense": (dense, 0.4), "sparse": (sparse, 0.3)}, 10)
    b = fusion.outer_join_rrf(dense, sparse, 10, (0.4, 0.3))
    c = fusion.rrf({"sparse": (sparse, 0.3), "dense": (dense, 0.4)}, 10)
    assert rows(a.orderBy("rank"), "chunk_id", "score") == rows(b.orderBy("rank"), "chunk_id", "score")
    assert set(rows(a, "chunk_id", "score")) == set(rows(c, "chunk_id", "score"))


def test_rrf_with_empty_leg(spark):
    dense, sparse = legs(spark)
    fused = fusion.rrf({"dense": (dense, 1.0), "sparse": (sparse.where("false"), 1.0)}, 2)
    assert rows(fused.orderBy("rank"), "chunk_id") == [("a",), ("b",)]


def test_rerank_skips_short_lists(spark):
    data = [(1, f"c{i}", float(10 - i), i, "red fox", t) for i, t in enumerate(["none", "red", "the red fox"], 1)]
    hits = spark.createDataFrame(data, "query_id int, chunk_id string, score double, rank int, query string, content string")
    best = rerank.rerank(hits, 2).orderBy("rank")
    assert rows(best, "chunk_id", "reranker_score") == [("c3", 1.0), ("c2", 0.5)]
    kept = rerank.rerank(hits, 3).orderBy("rank")
    assert rows(kept, "chunk_id", "reranker_score", "score") == [("c1", None, 9.0), ("c2", None, 8.0), ("c3", None, 7.0)]
    with pytest.raises(ValueError):
        rerank.rerank(hits, 1, by="missing")


def test_failing_model_scores_zero(spark):
    def load():
        def score(queries, contents):
            raise RuntimeError("out of memory")

        return score

    rerank.register_model("broken", load)
    df = spark.createDataFrame([("a", "b")], "q string, c string")
    assert df.select(rerank.scorer("broken")(F.col("q"), F.col("c"))).first()[0] == 0.0


def test_sparse_encoding_truncates_by_weight_then_first_use(spark):
    df = spark.createDataFrame([(1, "b a a c b d"), (2, "")], "id int, text string")
    got = {r["id"]: (r["terms"], r["weights"]) for r in search.encode_sparse(df, 3, id_col="id", text_col="text").collect()}
    assert got[1] == (["b", "a", "c"], [2.0, 2.0, 1.0]) and got[2] == ([], [])
    m = spark.createDataFrame([({1: 0.5, 2: 0.8, 3: 0.3, 4: 0.9},)], "w map<int,double>")
    assert m.select(vx.top_weights(F.col("w"), 3)).first()[0] == {4: 0.9, 2: 0.8, 1: 0.5}
    assert m.select(vx.sparse_dot(F.col("w"), F.create_map(F.lit(2), F.lit(2.0), F.lit(9), F.lit(1.0)))).first()[0] == 1.6


def test_top_k_plans(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    assert "TakeOrderedAndProject" in plan(ranked_top_k(df, 5, [F.desc("id")]))
    assert "WindowGroupLimit" in plan(top_k_per_group(df, ["g"], 3, [F.desc("id")]))


def test_global_rank_is_total(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("v"))
    got = {r["id"]: r["rank"] for r in global_rank(df, [F.desc("v"), F.asc("id")]).collect()}
    want = {i: n + 1 for n, i in enumerate(sorted(range(500), key=lambda i: (-(i % 3), i)))}
    assert got == want


def test_kernels_work_on_pieces_of_a_batch():
    """A batch of any size is worked on some terms at a time; the rows are those of one piece."""
    import pyarrow as pa

    rows = [[f"w{i % 7}"] * (i % 5) + [f"v{i % 3}"] for i in range(400)] + [None, ["long"] * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["id", "terms"])
    sparse = pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))])
    dense = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    for make in (lambda: kernels.term_weights(3, sparse), lambda: kernels.hashed_embedding(8, dense)):
        want = list(make()(iter([batch])))
        before, kernels.PIECE_TERMS = kernels.PIECE_TERMS, 100
        try:
            got = list(make()(iter([batch])))
        finally:
            kernels.PIECE_TERMS = before
        assert len(want) == 1 and len(got) > 10 and pa.Table.from_batches(got).to_pylist() == want[0].to_pylist()


def test_best_rows_equal_a_sort_of_everything():
    rng = np.random.default_rng(5)
    best, every = kernels.BestRows(3, 4), [[] for _ in range(3)]
    for start in range(0, 300, 30):
        scores = np.round(rng.random((30, 3)), 1)
        scores[rng.random((30, 3)) < 0.2] = -np.inf
        scores[rng.random((30, 3)) < 0.1] = np.nan
        best.push(np.arange(start, start + 30)[::-1], scores)
        for j in range(3):
            every[j] += [(-s, i) for s, i in zip(scores[:, j], range(start + 29, start - 1, -1)) if s > -np.inf]
    assert [ids.tolist() for ids in best.ids] == [[i for _, i in sorted(e)[:4]] for e in every]


def test_postings_are_scored_where_their_rows_meet(spark, tmp_path):
    """A term that all queries ask for costs one row a posting, not one for each query."""
    from paperloom.sources.store import search_postings, write_postings

    docs = spark.createDataFrame([(i, ["the", f"w{i % 7}", f"x{i}"], [float(1 + i % 5), 2.0, 1.0]) for i in range(80)], "chunk_id long, terms array<string>, weights array<double>")
    asked = [(f"q{j}", ["the", f"w{j % 7}", "the", "gone"], [1.0, 0.5, 1.0, 1.0]) for j in range(30)] + [("none", None, None), ("empty", [], [])]
    queries = spark.createDataFrame(asked, "query_id string, terms array<string>, weights array<double>")
    write_postings(docs, str(tmp_path / "index"), buckets=4)
    hits = search_postings(spark, str(tmp_path / "index"), queries, 6, buckets=4)
    want = search.sparse_search(docs, queries.where("terms IS NOT NULL"), 6)
    assert {tuple(r) for r in hits.collect()} == {tuple(r) for r in want.collect()} and hits.count() == 180
    assert "Aggregate(keys=[query_id" not in plan(hits)
