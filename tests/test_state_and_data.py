"""Limiters, metrics, sampling, keyed changes, windows, store and request API."""

import datetime as dt
import math
import random

import pytest
from conftest import plan
from pyspark.sql import functions as F

from paperloom.api import Library, SearchRequest
from paperloom.operators import changes, chat, curation, dashboard, evaluation, listing, slices
from paperloom.sources import metadata
from paperloom.sources.store import Store
from paperloom.streaming.limiter import fixed_window_stream


def sequential(events, limit, window):
    state, out = {}, {}
    for key, order, t in sorted(events, key=lambda e: (e[2], e[1])):
        log = [x for x in state.get(key, []) if x > t - window]
        out[order] = len(log) < limit
        if out[order]:
            log.append(t)
        state[key] = log
    return out


@pytest.mark.parametrize("rate", [5.0, 0.5])
def test_sliding_log_matches_sequential_fold(spark, rate):
    """A hot key with two thirds of the rows, paced and saturated."""
    rnd, t, events = random.Random(2), 0.0, []
    for i in range(600):
        t += rnd.expovariate(1 / rate)
        events.append((rnd.choice(["hot", "hot", "cold"]), i, round(t, 3)))
    df = spark.createDataFrame(events, "k string, i int, t double")
    flagged = slices.sliding_log(df, 3, 20.0, key="k", order="i", clock="t", slice_width=60.0)
    assert {r["i"]: r["admitted"] for r in flagged.collect()} == sequential(events, 3, 20.0)


def test_fixed_window_resets_strictly_after_expiry(spark, tmp_path):
    clocks = [0.0, 10.0, 60.0, 60.001, 61.0, 62.0]
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(clocks)], "k string, i int, t double")
    want = [True, True, False, True, True, False]
    flagged = slices.fixed_window(df, 2, 60.0, key="k", order="i", clock="t", slice_width=30.0)
    assert [r["admitted"] for r in flagged.orderBy("i").collect()] == want
    df.write.parquet(str(tmp_path / "in"))
    stream = fixed_window_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 60.0, key="k", order="i", clock="t")
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("i").collect()] == want


def test_slices_of_many_keys_stream_through_tasks(spark):
    """Slices end inside a batch, at its border and over several; a float key meets NaN. No group is handed over by itself."""
    rnd = random.Random(5)
    events = [(rnd.choice([0.5, 1.5, 2.5, float("nan"), *([7.0] * 4)]), i, rnd.uniform(0, 900)) for i in range(800)]
    df = spark.createDataFrame(events, "k double, i int, t double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        flagged = slices.sliding_log(df, 3, 20.0, key="k", order="i", clock="t", slice_width=60.0)
        assert "FlatMapGroupsInPandas" not in plan(flagged)
        got = {r["i"]: r["admitted"] for r in flagged.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == sequential([("nan" if math.isnan(k) else k, i, t) for k, i, t in events], 3, 20.0)


def test_window_counts_over_hot_key(spark):
    data = [("k", i, float(i * 7 % 100)) for i in range(50)]
    df = spark.createDataFrame(data, "k string, i int, t double")
    got = {r["i"]: r["recent"] for r in slices.window_counts(df, key="k", clock="t", window=20).collect()}
    assert got == {i: sum(1 for _, _, u in data if t - 20 <= u <= t) for _, i, t in data}


def test_metrics_by_hand(spark):
    hits = [("m", 1, f"c{i}", "p", i) for i in range(1, 11)] + [("m", 2, "x1", "p", 1), ("m", 2, "x2", "p", 2)]
    judged = spark.createDataFrame(hits, "mode string, query_id int, chunk_id string, paper_id string, rank int")
    qrels = spark.createDataFrame([(1, None, "c2"), (1, None, "c7"), (2, None, "x2"), (2, None, "zz")], "query_id int, paper_id string, chunk_id string")
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    got = {r["query_id"]: r for r in evaluation.query_metrics(evaluation.judge(judged, qrels), ["mode", "query_id"], totals).collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(8)
    assert got[1]["ndcg_10"] == pytest.approx(dcg / (1 + 1 / math.log2(3)))
    assert got[1]["ndcg_5"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (got[1]["mrr"], got[1]["precision_5"], got[1]["precision_10"], got[1]["recall_10"]) == (0.5, 0.2, 0.2, 1.0)
    # Fewer than k results: judged on their own number.
    assert (got[2]["precision_10"], got[2]["recall_10"], got[2]["hit_rate_10"]) == (0.5, 0.5, 1.0)


def test_two_chunks_of_a_relevant_paper_both_count(spark):
    hits = spark.createDataFrame([(1, "a", "p", 1), (1, "b", "p", 2)], "query_id int, chunk_id string, paper_id string, rank int")
    qrels = spark.createDataFrame([(1, "p", None)], "query_id int, paper_id string, chunk_id string")
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    assert evaluation.query_metrics(evaluation.judge(hits, qrels), ["query_id"], totals).first()["recall_10"] == 2.0


def test_weight_grid_size(spark):
    assert evaluation.weight_grid(spark).count() == 169


def test_dashboard_scalars(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (2.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(dashboard.delta_percent(F.col("a"), F.col("b"))).collect()] == [0.0, -50.0, 50.0]
    assert [r[0] for r in df.select(dashboard.efficiency(F.col("b"), F.col("a"))).collect()] == [float("inf"), 500.0, 1500.0]
    assert [r[0] for r in df.select(dashboard.signed_percent(F.col("b") - F.col("a"))).collect()] == ["+1.0%", "-1.0%", "+1.0%"]


def test_evaluation_json(spark):
    text = '{"dense": {"avg_mrr": 0.5, "avg_ndcg@10": 0.4, "avg_search_time_ms": 10.0, "num_queries": 2}, "dense+rerank": {"avg_mrr": 0.6, "avg_ndcg@10": 0.5, "avg_search_time_ms": 110.0, "num_queries": 2}}'
    table = dashboard.unpack_results(spark.createDataFrame([(text,)], "value string"), "value")
    row = dashboard.rerank_impact(table, ["ndcg_10", "mrr"]).first()
    assert row["delta_ndcg_10"] == pytest.approx(25.0) and row["efficiency"] == pytest.approx(1.0)


def test_quota_and_sample(spark):
    assert sum(curation.quotas(1000).values()) == 1000 and curation.quotas(1000)["other"] == 0
    data = [(i, "a" if i < 50 else "b" if i < 55 else "zz", float(i)) for i in range(60)]
    df = spark.createDataFrame(data, "paper_id int, topic string, final_score double")
    got = curation.stratified_sample(df, 20, distribution={"a": 0.5, "b": 0.5}).orderBy("final_rank").collect()
    # 10 of a, the 5 there are of b, then the best of the rest whatever their topic.
    ids = [r["paper_id"] for r in got]
    assert len(ids) == 20 and ids == sorted(ids, reverse=True) and {50, 51, 52, 53, 54} <= set(ids) and {55, 56, 57, 58, 59} <= set(ids)


def test_diversity_gate_cannot_pass_with_few_topics(spark):
    df = spark.createDataFrame([(str(i % 8), dt.date(2024, 1 + i % 3, 1)) for i in range(240)], "topic string, d date")
    row = curation.diversity(df, "topic", "d").first()
    assert row["topic_entropy"] == 3.0 and not row["passed"] and row["temporal_cv"] == 0.0


def test_keyed_changes(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, n int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, n int")
    pick = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    assert pick(changes.upsert(target, new, ["id"], "n")) == [(1, "a"), (2, "y"), (3, "z")]
    assert pick(changes.delete(target, new, ["id"])) == [(1, "a")]
    assert [r[0] for r in changes.insert_ignore(target, new, ["id"]).orderBy("id").select("v").collect()][:2] == ["a", "b"]
    assert pick(changes.update(target, spark.createDataFrame([(1, None), (2, "q")], "id int, v string"), ["id"])) == [(1, "a"), (2, "q")]
    raw = spark.createDataFrame([('{"indices":[1,2],"values":[0.5,1.0]}',), ('{"7":0.25}',)], "s string")
    assert [r[0] for r in raw.select(changes.parse_sparse(F.col("s"))).collect()] == [{1: 0.5, 2: 1.0}, {7: 0.25}]


def test_vector_rows_skip_empty(spark):
    df = spark.createDataFrame([("a", "p", [1.0], None), ("b", "p", [], {1: 0.5}), ("c", "p", [], {}), ("d", "p", None, None)], "chunk_id string, paper_id string, dense array<double>, sparse map<int,double>")
    got = {r["chunk_id"]: (r["dense"], r["sparse"]) for r in changes.vector_rows(df).collect()}
    assert got == {"a": ([1.0], None), "b": (None, {1: 0.5})}


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    store.create("t", rows)
    store.create("t", rows.where("false"))  # already there: nothing happens
    store.upsert("t", spark.createDataFrame([(2, "c")], "id int, v string"), ["id"])
    assert sorted((r["id"], r["v"]) for r in store.read("t").collect()) == [(1, "a"), (2, "c")]
    (tmp_path / "t" / "v=9").mkdir()  # a job that died before its success mark
    assert store.read("t").count() == 2


def test_metadata_query_string():
    what = metadata.Search(("cs.CL", "cs.LG"), ('a "b"',), dt.date(2024, 1, 2), None)
    assert what.query_string() == '(cat:cs.CL OR cat:cs.LG) AND (ti:"a \\"b\\"" OR abs:"a \\"b\\"") AND submittedDate:[202401020000 TO *]'
    assert metadata.Search(()).query_string() == "cat:cs.CL"


def test_page_arguments(spark):
    df = spark.createDataFrame([("a", 1)], "paper_id string, citation_count int")
    for wrong in ({"number": 0}, {"size": 101}, {"sort_by": "secret"}):
        with pytest.raises(ValueError):
            listing.page(df, **wrong)


def test_budget_is_a_prefix(spark):
    hits = spark.createDataFrame([(1, i, "x" * 40) for i in range(1, 6)], "query_id int, rank int, content string")
    assert [r["rank"] for r in chat.within_budget(hits, budget=25).orderBy("rank").collect()] == [1, 2]


def library(spark):
    texts = ["red fox jumps over", "blue fox sleeps", "green tree grows", "red tree stands", "a fox and a red tree"]
    chunks = spark.createDataFrame([(f"c{i}", f"p{i % 3}", t, "Intro") for i, t in enumerate(texts)], "chunk_id string, paper_id string, content string, section_title string")
    papers = spark.createDataFrame([("p0", "Zero", 5, "parsed"), ("p1", "One", 9, "pending")], "paper_id string, title string, citation_count int, parse_status string")
    return Library(spark, chunks, papers, dim=16)


def test_library_modes(spark):
    lib = library(spark)
    queries = spark.createDataFrame([(1, "red fox")], "query_id int, query string")
    for mode in ("dense", "sparse", "text", "hybrid", "hybrid_full"):
        hits = lib.search(SearchRequest(queries, mode, 3)).orderBy("rank").collect()
        assert hits[0]["chunk_id"] in ("c0", "c4") and len(hits) <= 3
    # Scores of every leg are kept, none is replaced by zero.
    assert all(r["score"] > 0 for r in lib.search(SearchRequest(queries, "dense", 2)).collect())
    reranked = lib.search(SearchRequest(queries, "hybrid", 2, rerank=True)).collect()
    assert {r["chunk_id"] for r in reranked} == {"c0", "c4"} and all(r["reranker_score"] == 1.0 for r in reranked)
    only = lib.search(SearchRequest(queries, "sparse", 5, paper_id="p0")).collect()
    assert {r["paper_id"] for r in only} == {"p0"}
    with pytest.raises(ValueError):
        lib.search(SearchRequest(queries, "nope"))


def test_library_chat(spark):
    lib = library(spark)
    queries = spark.createDataFrame([(1, "red fox")], "query_id int, query string")
    history = spark.createDataFrame([(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)], "conv_id int, turn int, role string, text string")
    sources, prompts = lib.chat_context(queries, top_k=2, history=history)
    got = sources.collect()
    assert len({r["paper_id"] for r in got}) == len(got) == 2 and {r["title"] for r in got} <= {"Zero", "One", "p2"}
    text = prompts.first()["prompt"]
    assert "Question: red fox" in text and "Assistant: m3" in text and "m2\n" not in text and "[1] Paper: " in text
