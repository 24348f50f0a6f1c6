"""Batch computation of retrieval metrics over ranked hits and relevance judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("mrr", "ndcg_5", "ndcg_10", "precision_5", "precision_10", "recall_10", "hit_rate_10")


def judge(hits: DataFrame, qrels: DataFrame, *, query_col: str = "query_id", paper_col: str = "paper_id", chunk_col: str = "chunk_id") -> DataFrame:
    """Binary relevance of every hit: its paper or its chunk is listed for the query.

    ``qrels`` is long form ``(query_id, paper_id, chunk_id)`` with one of the two
    set.  Two semi-matched joins on equality instead of list lookups per row.
    """
    papers = qrels.where(F.col(paper_col).isNotNull()).select(query_col, paper_col).distinct().withColumn("__p", F.lit(True))
    chunks = qrels.where(F.col(chunk_col).isNotNull()).select(query_col, chunk_col).distinct().withColumn("__c", F.lit(True))
    joined = hits.join(papers, [query_col, paper_col], "left").join(chunks, [query_col, chunk_col], "left")
    rel = F.when(F.col("__p").isNotNull() | F.col("__c").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    return joined.withColumn("rel", rel).drop("__p", "__c")


def _gain(rel: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, rel / F.log2(rank + 1)).otherwise(F.lit(0.0)))


def _ideal(n_relevant: Column, k: int) -> Column:
    """DCG of a list that starts with all its relevant hits (binary relevance)."""
    depth = F.least(n_relevant, F.lit(k)).cast("int")
    ranks = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1)))


def _precision(hits_in_k: Column, all_hits: Column, n: Column, k: int) -> Column:
    """Hits over ``k``; a list shorter than ``k`` is judged on its own length."""
    return F.when(n >= k, hits_in_k / F.lit(k)).otherwise(all_hits / F.greatest(n, F.lit(1)))


def query_metrics(judged: DataFrame, keys: Sequence[str], totals: DataFrame | None = None) -> DataFrame:
    """Metrics of one ranked list per ``keys`` group, from rows with ``rank`` and ``rel``.

    The ideal list re-sorts what was retrieved, as the metric is defined here, so
    it follows from the number of relevant hits and needs no second sort.
    ``totals`` ``(query key…, n_relevant)`` feeds recall; without it recall is 0.
    """
    rank, rel = F.col("rank"), F.col("rel")
    grouped = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("rel").alias("n_rel"),
        F.sum(F.when(rank <= 5, rel).otherwise(0)).alias("rel_5"),
        F.sum(F.when(rank <= 10, rel).otherwise(0)).alias("rel_10"),
        F.min(F.when(rel > 0, rank)).alias("first_rel"),
        _gain(rel, rank, 5).alias("dcg_5"),
        _gain(rel, rank, 10).alias("dcg_10"),
    )
    if totals is not None:
        grouped = grouped.join(totals, [c for c in totals.columns if c != "n_relevant"], "left")
    else:
        grouped = grouped.withColumn("n_relevant", F.lit(0).cast("bigint"))
    relevant = F.coalesce(F.col("n_relevant"), F.lit(0))
    return grouped.select(
        *keys,
        F.coalesce(1 / F.col("first_rel"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.try_divide("dcg_5", _ideal(F.col("n_rel"), 5)), F.lit(0.0)).alias("ndcg_5"),
        F.coalesce(F.try_divide("dcg_10", _ideal(F.col("n_rel"), 10)), F.lit(0.0)).alias("ndcg_10"),
        _precision(F.col("rel_5"), F.col("n_rel"), F.col("n"), 5).alias("precision_5"),
        _precision(F.col("rel_10"), F.col("n_rel"), F.col("n"), 10).alias("precision_10"),
        F.when(relevant > 0, F.col("rel_10") / relevant).otherwise(F.lit(0.0)).alias("recall_10"),
        F.when(F.col("rel_10") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("hit_rate_10"),
        F.col("n").alias("num_results"),
    )


def complete(metrics: DataFrame, queries: DataFrame, modes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Queries without a single hit count as zeros instead of vanishing from the means.

    The mode list is a handful of names, so the grid of modes and queries is the
    query table repeated by an explode.
    """
    grid = queries.select(*[k for k in keys if k != "mode"]).withColumn("mode", F.explode(F.array(*[F.lit(m) for m in modes])))
    filled = grid.join(metrics, list(keys), "left")
    return filled.na.fill(0.0, list(METRICS)).na.fill(0, ["num_results"])


def mean_metrics(metrics: DataFrame, keys: Sequence[str], digits: int = 8) -> DataFrame:
    return metrics.groupBy(*keys).agg(
        *[F.round(F.avg(m), digits).alias(f"avg_{m}") for m in METRICS], F.count(F.lit(1)).alias("num_queries")
    )


def grouped_means(metrics: DataFrame, mode: str, groups: Sequence[str], digits: int = 8) -> DataFrame:
    """Means per mode and per mode x group for every group column, in one pass over the metrics.

    ``grouping`` names the column a row belongs to, ``value`` its value.
    """
    kinds = F.array(
        F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")),
        *[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in groups],
    )
    exploded = metrics.withColumn("__g", F.explode(kinds)).select(mode, "__g.grouping", "__g.value", *METRICS)
    return mean_metrics(exploded, [mode, "grouping", "value"], digits)


def weight_grid(spark, step: float = 0.1, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Normalised weight triples whose raw sum lies in ``[low, high]``, each once.

    Always eleven values per weight: at most 1331 candidate rows, built by
    sequence and explode.
    """
    values = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.round(i * F.lit(float(step)), 1))
    grid = spark.range(1).select(F.explode(values).alias("d"))
    grid = grid.select("d", F.explode(values).alias("s")).select("d", "s", F.explode(values).alias("c"))
    total = F.col("d") + F.col("s") + F.col("c")
    kept = grid.withColumn("t", total).where((F.col("t") >= low) & (F.col("t") <= high) & (F.col("t") > 0))
    unit = kept.select(*[F.round(F.col(w) / F.col("t"), 12).alias(n) for w, n in (("d", "dense_weight"), ("s", "sparse_weight"), ("c", "third_weight"))])
    return unit.distinct()


def grid_search(legs: DataFrame, grid: DataFrame, qrels_rel: DataFrame, k: int = 10, rrf_k: int = 60) -> DataFrame:
    """Metrics of every weight triple.

    ``legs`` is one row per query and candidate with the three ranks (null where a
    leg missed it): bounded by the leg depth, not by the corpus.  The grid is
    attached to each row, scores are fused per triple and cut to ``k`` before any
    metric is computed.
    """
    weights = ["dense_weight", "sparse_weight", "third_weight"]
    score = sum(
        (F.coalesce(F.col(w) / (rrf_k + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ["dense_rank", "sparse_rank", "third_rank"])),
        F.lit(0.0),
    )
    triples = [tuple(r) for r in grid.select(*weights).orderBy(*weights).collect()]  # at most 1331 rows by construction
    options = F.array(*[F.struct(*[F.lit(v).alias(w) for v, w in zip(t, weights)]) for t in triples])
    rows = legs.withColumn("__w", F.explode(options)).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "third_rank", "__w.*")
    rows = rows.withColumn("score", F.round(score, 12))
    order = Window.partitionBy(*weights, "query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc_nulls_last("third_rank"), F.asc("chunk_id")
    )
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    judged = top.join(qrels_rel.withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left").na.fill(0, ["rel"])
    per_query = query_metrics(judged, [*weights, "query_id"])
    return per_query.groupBy(*weights).agg(
        F.round(F.avg("mrr"), 8).alias("avg_mrr"),
        F.round(F.avg("ndcg_10"), 8).alias("avg_ndcg_10"),
        F.round(F.avg("precision_5"), 8).alias("avg_precision_5"),
        F.count(F.lit(1)).alias("num_queries"),
    )
