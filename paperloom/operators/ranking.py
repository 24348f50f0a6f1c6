"""Top-k, ranks and first-per-group, written so that no task sees a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.session import cut_lineage


def top_k(df: DataFrame, k: int, *order: Column, offset: int = 0) -> DataFrame:
    """Global top-k: planned as one bounded heap per task."""
    ranked = df.orderBy(*order)
    if offset:
        ranked = ranked.offset(offset)
    return ranked.limit(k)


def top_k_per_group(df: DataFrame, group: Sequence[str], k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per group with their 1-based rank.

    ``row_number() <= k`` lets Spark cut every group to ``k`` rows before the
    shuffle, so a group holding a third of the table costs no more than any other.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ranked_top_k(df: DataFrame, k: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Global top-k with its rank: only the ``k`` survivors meet in one task."""
    best = top_k(df, k, *order)
    return best.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per group; the rest of each group is dropped before the shuffle."""
    return top_k_per_group(df, group, 1, order, rank="__first").drop("__first")


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Rank every row of an unbounded table without a single-task sort.

    Rows are range-partitioned on the order (which must be total, i.e. end in a
    unique key), sorted inside their partitions and numbered there; a row's rank
    is its place in the partition plus the sizes of the partitions before it.
    The numbered rows are checkpointed because range bounds come from a sample
    and must not be drawn again between the two passes.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__slot", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__slot", 33))
        .withColumn("__pos", F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("__slot")
    )
    numbered = cut_lineage(numbered)
    # One row per partition: its size is the partition count, not the data.
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (
        numbered.join(F.broadcast(offsets), "__part")
        .withColumn(rank, F.col("__offset") + F.col("__pos") + 1)
        .drop("__part", "__pos", "__offset")
    )
