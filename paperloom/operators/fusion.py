"""Reciprocal-rank fusion of any number of ranked legs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import top_k_per_group


def rrf(legs: Mapping[str, tuple[DataFrame, float]], k: int, rrf_k: int = 60) -> DataFrame:
    """Fuse legs ``{name: (hits, weight)}`` into ``(query_id, chunk_id, score, rank, <name>_score, <name>_rank…)``.

    A union and one aggregation replace the outer joins a pairwise merge needs,
    and the leg depth bounds what reaches the shuffle.  Ties keep the order in
    which legs were listed, by rank inside the leg.
    """
    parts = [
        hits.select("query_id", "chunk_id", F.lit(name).alias("leg"), F.col("score"), F.col("rank"), F.lit(float(weight)).alias("weight"))
        for name, (hits, weight) in legs.items()
    ]
    rows = reduce(DataFrame.unionByName, parts)
    per_leg = [
        column
        for name in legs
        for column in (
            F.max(F.when(F.col("leg") == name, F.col("score"))).alias(f"{name}_score"),
            F.min(F.when(F.col("leg") == name, F.col("rank"))).alias(f"{name}_rank"),
        )
    ]
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("weight") / (rrf_k + F.col("rank"))), 12).alias("score"), *per_leg
    )
    order = [F.desc("score"), *[F.asc_nulls_last(f"{name}_rank") for name in legs], F.asc("chunk_id")]
    return top_k_per_group(fused, ["query_id"], k, order)


def outer_join_rrf(dense: DataFrame, sparse: DataFrame, k: int, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = 60) -> DataFrame:
    """Two-leg fusion in its relational form: full outer join on the hit, missing legs add 0."""
    left = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    right = sparse.select("query_id", "chunk_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    joined = left.join(right, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(weights[0] / (rrf_k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(
        weights[1] / (rrf_k + F.col("sparse_rank")), F.lit(0.0)
    )
    fused = joined.withColumn("score", F.round(score, 12))
    order = [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("chunk_id")]
    return top_k_per_group(fused, ["query_id"], k, order)
