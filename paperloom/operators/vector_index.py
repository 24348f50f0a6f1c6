"""Approximate vector search: coarse cells, cell-partitioned files, pruned probing.

Cells are the spherical k-means of a bounded sample; every vector is filed under its nearest
one.  A search reads only the partitions its queries probe, and a calibration picks the number
of probes from measured recall.  Probing all cells is the exact search.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import kernels
from paperloom.functions import vectors as vx
from paperloom.operators import search
from paperloom.operators.ranking import top_k
from paperloom.session import cut_lineage

SAMPLE_ROWS = 65_536
ROUNDS = 8
SAMPLE_TASKS = 16
FILED_ROWS = 4096  # vectors in one row of the files; a fuller cell has several


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return vectors.where(vx.has_dimension(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), vx.as_doubles(F.col(vector_col)).alias("v"))


def train_cells(
    vectors: DataFrame, cells: int, dim: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS
) -> np.ndarray:
    """Unit centroids, ``cells`` at most, of the ``sample_rows`` vectors with the smallest id hash.

    Each round is one pass over the sample; a task returns one sum per cell, so the driver
    sees ``SAMPLE_TASKS * cells`` vectors.  A cell that loses all its vectors keeps its centroid.
    """
    drawn = top_k(_usable(vectors, id_col, vector_col, dim), sample_rows, F.xxhash64("id"), F.asc("id"))
    sample = cut_lineage(drawn.repartition(SAMPLE_TASKS, F.xxhash64("id")))
    first = [r["v"] for r in top_k(sample, cells, F.xxhash64("id", F.lit(1)), F.asc("id")).collect()]
    centres = kernels.unit_rows(np.unique(np.array(first, dtype="float64").reshape(-1, dim), axis=0))
    for _ in range(rounds if len(centres) > 1 else 0):
        sums, counts = np.zeros_like(centres), np.zeros(len(centres))
        for row in sample.mapInArrow(kernels.cell_sums(centres, dim), "cell int, n long, total array<double>").collect():
            sums[row["cell"]] += row["total"]
            counts[row["cell"]] += row["n"]
        centres = kernels.unit_rows(np.where(counts[:, None] > 0, sums, centres))
    return centres


def write_index(vectors: DataFrame, centres: np.ndarray, path: str, *, id_col: str = "chunk_id", vector_col: str = "embedding") -> None:
    """Every vector under its cell: files partitioned by ``cell``, rows of up to about ``FILED_ROWS`` vectors.

    Cells are counted first, so one that holds a third of all vectors is many rows and tasks.
    """
    dim = centres.shape[1]
    rows = _usable(vectors, id_col, vector_col, dim)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    placed = cut_lineage(rows.mapInArrow(kernels.nearest_cells(centres, dim, 1), schema))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILED_ROWS)).cast("int").alias("parts"))  # a row per cell
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    filed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    filed.select("cell", "part", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values")).write.partitionBy("cell").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def search_index(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, *, threshold: float | None = None) -> DataFrame:
    """Best ``k`` rows of the ``probes`` nearest cells of every query: ``query_id, chunk_id, score, rank``.

    Queries are packed by cell, so a filed row meets all queries that probe its cell in one
    matrix product; only probed partitions are read.
    """
    dim = centres.shape[1]
    rows = _usable(queries, "query_id", "query_vector", dim)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    asked = cut_lineage(rows.mapInArrow(kernels.nearest_cells(centres, dim, probes), schema))
    parts = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(FILED_ROWS)).cast("int").alias("parts"))
    dealt = asked.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    packed = packed.select("cell", F.col("rows.id").alias("query_ids"), F.flatten("rows.v").alias("query_values"))
    probed = [r["cell"] for r in parts.select("cell").collect()]  # cells at most
    found = index.where(F.col("cell").isin(probed)).join(packed, "cell").select("query_ids", "query_values", "ids", "values")
    leg = search._leg_schema(queries.schema["query_id"].dataType, index.schema["ids"].dataType.elementType)
    return search._finish([found.mapInArrow(kernels.block_pairs(dim, k, threshold, search._arrow(leg)), leg)], k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found."""
    pairs = exact.select("query_id", "chunk_id")
    total = pairs.count()
    return pairs.join(found.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").count() / total if total else 1.0


def calibrate(
    index: DataFrame, centres: np.ndarray, vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.95, *, sample: int = 200,
    id_col: str = "chunk_id", vector_col: str = "embedding",
) -> tuple[int, float]:
    """The least number of probes, in steps of an eighth of all cells, whose recall on ``sample`` queries reaches the target."""
    tried = cut_lineage(top_k(queries, sample, F.xxhash64("query_id"), F.asc("query_id")))
    exact = cut_lineage(search.dense_search(vectors, tried, k, centres.shape[1], id_col=id_col, vector_col=vector_col))
    got = 0.0
    for step in range(1, 9):
        probes = max(1, -(-len(centres) * step // 8))
        got = recall(search_index(index, centres, tried, k, probes), exact)
        if got >= target:
            break
    return probes, got
