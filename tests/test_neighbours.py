"""All-vectors neighbours by blocks, against the scan."""

import random

import numpy as np
import pyarrow as pa
from conftest import plan

from paperloom import kernels
from paperloom.operators import search, vector_index


def table(spark, n, dim, seed):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, None), (n + 1, [1.0])], "chunk_id long, embedding array<float>")


def test_blocks_equal_the_scan(spark, monkeypatch):
    monkeypatch.setattr(search, "JOIN_BLOCK_ROWS", 16)
    rows = table(spark, 150, 4, 3)  # many ties
    queries = table(spark, 70, 4, 4).selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    asked = queries.where("size(query_vector) = 4")
    for options in ({}, {"threshold": 0.6}):
        want = {tuple(r) for r in search.dense_search(rows, asked, 7, 4, **options).collect()}
        got = search.dense_join(rows, queries, 7, 4, **options).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert search.dense_join(rows, queries.limit(0), 7, 4).isEmpty() and search.dense_join(rows.limit(0), queries, 7, 4).isEmpty()


def test_a_third_of_all_rows_may_be_one_vector(spark, monkeypatch):
    monkeypatch.setattr(search, "JOIN_BLOCK_ROWS", 16)
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(120)], "chunk_id long, embedding array<float>")
    got = search.dense_join(rows, rows.selectExpr("chunk_id AS query_id", "embedding AS query_vector"), 2, 2).where("query_id = 3").collect()
    assert sorted(r["chunk_id"] for r in got) == [0, 3]


def test_index_recall_pruned_files_and_exact_probing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "FILED_ROWS", 20)
    rnd = random.Random(8)
    centres = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + rnd.gauss(0, 0.15) for c in centres[i % 12 if i % 3 else 0]]) for i in range(600)]  # a third in one cluster
    vectors = spark.createDataFrame([*rows, (900, None), (901, [1.0]), (902, [0.0] * 8)], "chunk_id long, embedding array<double>")
    cells = vector_index.train_cells(vectors, 12, 8, sample_rows=300)
    assert cells.shape[1] == 8 and 1 < len(cells) <= 12
    path = str(tmp_path / "index")
    vector_index.write_index(vectors, cells, path)
    index = vector_index.read_index(spark, path)
    filed = index.selectExpr("explode(ids) AS id").toPandas()["id"]
    assert sorted(filed) == sorted([*range(600), 902]) and index.selectExpr("max(size(ids)) AS n").first()["n"] < 60
    queries = vectors.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    exact = search.dense_search(vectors, queries.where("size(query_vector) = 8"), 5, 8)
    every = vector_index.search_index(index, cells, queries, 5, len(cells))
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in exact.collect()}
    probes, measured = vector_index.calibrate(index, cells, vectors, queries.where("size(query_vector) = 8"), 5, target=0.9)
    assert probes < len(cells) and measured >= 0.9
    few = vector_index.search_index(index, cells, queries, 5, probes)
    assert vector_index.recall(few, exact) >= 0.9
    assert "PartitionFilters: [isnotnull(cell" in plan(few) or "cell#" in plan(few).split("PartitionFilters: [")[1][:80]


def test_tasks_hand_on_k_rows_for_each_query_not_for_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "JOIN_BLOCK_ROWS", 8)
    monkeypatch.setattr(search, "JOIN_QUERY_BLOCKS", 2, raising=False)
    monkeypatch.setattr(search, "JOIN_WAVES", 1, raising=False)
    handed = []
    finish = search._finish
    monkeypatch.setattr(search, "_finish", lambda parts, k: handed.extend(p.count() for p in parts) or finish(parts, k))
    rows = table(spark, 160, 4, 5)
    queries = table(spark, 64, 4, 6).selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    got = search.dense_join(rows, queries, 3, 4).collect()
    want = search.dense_search(rows, queries.where("size(query_vector) = 4"), 3, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and handed[0] <= 64 * 3  # 5 blocks of queries fill 4 slots: one part


def test_scores_closer_than_single_precision_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(search, "JOIN_BLOCK_ROWS", 16)
    rnd = random.Random(9)
    base = [rnd.gauss(0, 1) for _ in range(16)]
    rows = spark.createDataFrame([(i, [x + rnd.gauss(0, 3e-5) for x in base]) for i in range(200)], "chunk_id long, embedding array<double>")
    queries = rows.where("chunk_id % 3 = 0").selectExpr("chunk_id AS query_id", "embedding AS query_vector")
    for options in ({}, {"threshold": 0.9999999985}):
        want = {tuple(r) for r in search.dense_search(rows, queries, 5, 16, **options).collect()}
        assert {tuple(r) for r in search.dense_join(rows, queries, 5, 16, **options).collect()} == want
        assert len({score for _, _, score, _ in want}) > 3


def test_what_a_task_holds_does_not_grow_with_the_probes():
    rnd = np.random.default_rng(3)
    centres, rows = kernels.unit_rows(rnd.normal(size=(64, 32))), rnd.normal(size=(3000, 32))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(rows.tolist())], names=["id", "v"])
    for probes in (1, 5, 64):
        pieces = list(kernels.nearest_cells(centres, 32, probes)([batch]))
        assert max(p.num_rows for p in pieces) * 32 <= 1 << 18
        got = pa.Table.from_batches(pieces)
        want = np.argsort(-np.round(kernels.unit_rows(rows) @ centres.T, 10), axis=1, kind="stable")[:, :probes]
        assert got["cell"].to_pylist() == want.ravel().tolist() and got["id"].to_pylist() == np.repeat(np.arange(3000), probes).tolist()
