"""Which benchmark queries the corpus can answer at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded_papers(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct papers having a vector in any of the ``(table, id column, vector column)`` stores."""
    ids = None
    for table, id_col, vector_col in tables:
        part = table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("paper_id")).distinct()
        ids = part if ids is None else ids.union(part)
    return ids.distinct()


def split_queries(judgements: DataFrame, present: DataFrame) -> DataFrame:
    """Per query: the relevant papers that exist, those that do not, and whether it stays.

    ``judgements`` is long form ``(query_id, paper_id, pos)``; a query's own list is
    short, so packing it back into an array is bounded by the query, not the corpus.
    """
    known = present.select("paper_id").distinct().withColumn("__known", F.lit(True))
    joined = judgements.join(known, "paper_id", "left")
    entry = F.struct("pos", "paper_id")
    found = F.sort_array(F.collect_list(F.when(F.col("__known").isNotNull(), entry)))
    missing = F.sort_array(F.collect_list(F.when(F.col("__known").isNull(), entry)))
    packed = joined.groupBy("query_id").agg(
        F.transform(found, lambda e: e["paper_id"]).alias("relevant_papers"),
        F.transform(missing, lambda e: e["paper_id"]).alias("missing_papers"),
        F.count(F.lit(1)).alias("original_relevant_count"),
    )
    return packed.withColumn("valid", F.size("relevant_papers") > 0)


def coverage_stats(split: DataFrame, judgements: DataFrame, present: DataFrame) -> DataFrame:
    """One row of totals: valid and invalid queries, covered and missing papers."""
    counts = split.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if("valid").alias("valid_queries"),
        F.count_if(~F.col("valid")).alias("invalid_queries"),
    ).withColumn("coverage_percent", F.round(F.coalesce(100 * F.try_divide("valid_queries", "total_queries"), F.lit(0.0)), 6))
    wanted = judgements.select("paper_id").distinct()
    covered = wanted.join(present, "paper_id", "left_semi").agg(F.count(F.lit(1)).alias("papers_in_db"))
    missing = wanted.join(present, "paper_id", "left_anti").agg(F.count(F.lit(1)).alias("papers_missing"))
    one = F.lit(1).alias("__one")
    return (
        counts.withColumn("__one", F.lit(1))
        .join(covered.select("*", one), "__one")
        .join(missing.select("*", one), "__one")
        .withColumn("total_relevant_papers", F.col("papers_in_db") + F.col("papers_missing"))
        .drop("__one")
    )
