"""Listings and lookups over papers and chunks: pages, counts, keyed reads, parent-child joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import first_per_group, top_k
from paperloom.session import broadcast_if_small

STATUSES = ("pending", "collected", "parsed", "embedded", "failed")
SORTABLE = ("citation_count", "published_date", "title", "paper_id")


def page(
    df: DataFrame, *, number: int = 1, size: int = 20, status: str | None = None, sort_by: str = "citation_count",
    order: str = "desc", id_col: str = "paper_id", status_col: str = "parse_status", columns: Sequence[str] | None = None,
    sortable: Sequence[str] = SORTABLE,
) -> DataFrame:
    """One page of papers; anything but ``desc`` sorts upwards, unknown sort columns are refused."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page must be positive and page size between 1 and 100")
    if sort_by not in sortable:
        raise ValueError(f"cannot sort by {sort_by!r}; choose from {sorted(sortable)}")
    rows = df if status is None else df.where(F.col(status_col) == status)
    if columns is not None:
        rows = rows.select(*columns)
    key = F.desc_nulls_last(sort_by) if order.lower() == "desc" else F.asc_nulls_last(sort_by)
    return top_k(rows, size, key, F.asc(id_col), offset=(number - 1) * size)


def total(df: DataFrame, condition: Column | None = None) -> DataFrame:
    return (df if condition is None else df.where(condition)).agg(F.count(F.lit(1)).alias("total"))


def by_status(df: DataFrame, status: str, n: int, *, offset: int = 0, order: Sequence[Column], status_col: str = "parse_status") -> DataFrame:
    return top_k(df.where(F.col(status_col) == status), n, *order, offset=offset)


def status_counts(df: DataFrame, status_col: str = "parse_status", statuses: Sequence[str] = STATUSES) -> DataFrame:
    """All counts in one pass, without the row caps a listing call has."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(status_col) == s).alias(s) for s in statuses],
    )


def ready_for_parsing(df: DataFrame, n: int, *, order: Sequence[Column], status_col: str = "parse_status") -> DataFrame:
    usable = (F.col(status_col) == "pending") & (F.col("pdf_path").isNotNull() | F.col("latex_path").isNotNull())
    return top_k(df.where(usable), n, *order)


def with_abstract(df: DataFrame, *, abstract_col: str = "abstract", min_chars: int = 50) -> DataFrame:
    """Papers whose abstract is there and long enough to ask questions about."""
    return df.where(F.length(F.trim(abstract_col)) >= min_chars)


def lacking(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents without a single child row (anti join)."""
    return parents.join(children.select(F.col(child_key).alias(parent_key)), parent_key, "left_anti")


def by_ids(df: DataFrame, ids: Sequence, id_col: str) -> DataFrame:
    return df.where(F.col(id_col).isin(list(ids)))


def by_ids_in_order(df: DataFrame, ordered: DataFrame, id_col: str, pos_col: str = "pos") -> DataFrame:
    """Rows for a ranked id list: missing ids are skipped, the list's order is kept as a column."""
    return df.join(ordered.select(id_col, pos_col), id_col, "inner")


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Left outer: a parent without children stays, with null child columns."""
    return parents.join(children, key, "left")


def with_titles(hits: DataFrame, papers: DataFrame, *, default: Column, key: str = "paper_id", title: str = "title") -> DataFrame:
    """Attach titles, falling back to ``default`` where the paper or its title is missing.

    The few papers that were hit are picked from the table first, by a broadcast
    of the hit ids; the table is not shuffled for an outer join, and the hits' texts
    are not written anywhere.
    """
    wanted = broadcast_if_small(hits.select(key).distinct())
    known = papers.select(key, F.col(title).alias("__title")).join(wanted, key, "left_semi")
    return hits.join(known, key, "left").withColumn("title", F.coalesce("__title", default)).drop("__title")


def with_citations(papers: DataFrame, counts: DataFrame, *, key: str = "paper_id", count: str = "citation_count") -> DataFrame:
    """Attach looked-up citation counts; papers unknown to the source get 0."""
    known = counts.select(key, F.col(count).alias("__count"))
    return papers.join(known, key, "left").withColumn(count, F.coalesce("__count", F.lit(0))).drop("__count")


def citation_stats(df: DataFrame, count: str = "citation_count") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("papers"),
        F.count_if(F.col(count) > 0).alias("with_citations"),
        F.coalesce(F.sum(count), F.lit(0)).alias("total_citations"),
    )


def dedup_first(df: DataFrame, key: str, arrival: Sequence[Column]) -> DataFrame:
    """First row per key in arrival order; duplicates go before the shuffle."""
    return first_per_group(df, [key], arrival)
