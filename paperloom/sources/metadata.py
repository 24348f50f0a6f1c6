"""Paper metadata search: the remote search call as a predicate on a metadata table.

Without network access the "remote" side is a table ``(paper_id, title, abstract,
categories, published)``; the predicate reaches its scan where Spark can push it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators.ranking import first_per_group, top_k
from paperloom.operators.windows import window_scan

# Categories searched when none are named.
DEFAULT_CATEGORIES = ("cs.CL", "cs.LG", "cs.AI", "stat.ML")


@dataclass(frozen=True)
class Search:
    categories: Sequence[str] = DEFAULT_CATEGORIES
    keywords: Sequence[str] = ()
    start: dt.date | None = None
    end: dt.date | None = None

    def query_string(self, with_dates: bool = True) -> str:
        """The text form a remote search service understands."""
        parts = []
        if self.categories:
            parts.append("(" + " OR ".join(f"cat:{c}" for c in self.categories) + ")")
        if self.keywords:
            quoted = [k.replace('"', '\\"') for k in self.keywords]
            parts.append("(" + " OR ".join(f'ti:"{k}" OR abs:"{k}"' for k in quoted) + ")")
        if with_dates and (self.start or self.end):
            low = f"{self.start:%Y%m%d}0000" if self.start else "*"
            high = f"{self.end:%Y%m%d}2359" if self.end else "*"
            parts.append(f"submittedDate:[{low} TO {high}]")
        return " AND ".join(parts) if parts else "cat:cs.CL"

    def predicate(self) -> Column:
        """Any category, any keyword in title or abstract, dates inclusive."""
        conditions = []
        if self.categories:
            conditions.append(F.arrays_overlap(F.col("categories"), tx.string_array(list(self.categories))))
        if self.keywords:
            wanted = [k.lower() for k in self.keywords]
            conditions.append(tx.contains_any(F.lower("title"), wanted) | tx.contains_any(F.lower("abstract"), wanted))
        conditions += self.date_conditions()
        return reduce(lambda a, b: a & b, conditions, F.lit(True))

    @property
    def order(self) -> list[Column]:
        """Newest first."""
        return [F.desc("published"), F.asc("paper_id")]

    def date_conditions(self) -> list[Column]:
        out = []
        if self.start:
            out.append(F.col("published") >= F.lit(self.start))
        if self.end:
            out.append(F.col("published") <= F.lit(self.end))
        return out


def normalised(df: DataFrame) -> DataFrame:
    """Titles and abstracts on one line, ids without scheme prefix or URL."""
    out = df.withColumn("title", tx.one_line(F.col("title"))).withColumn("abstract", tx.one_line(F.col("abstract")))
    return out.withColumn("paper_id", tx.paper_id(tx.last_path_segment(F.col("paper_id").cast("string"))))


def search(df: DataFrame, what: Search, max_results: int) -> DataFrame:
    """Newest ``max_results`` of the matches within the dates."""
    return top_k(df.where(what.predicate()), max_results, *what.order)


def search_batch(df: DataFrame, what: Search, n: int) -> DataFrame:
    """One batch of ``n`` results; a page size is the remote service's business and limits nothing here."""
    return search(df, what, n)


def search_first_page(df: DataFrame, what: Search, max_results: int) -> DataFrame:
    """First occurrence of each id, then the newest ``max_results``: all pages that many results take."""
    return top_k(first_per_group(df.where(what.predicate()), ["paper_id"], what.order), max_results, *what.order)


def search_windows(df: DataFrame, what: Search, bounds: DataFrame, days: int, *, completed: DataFrame | None = None) -> DataFrame:
    """Windowed search over ``bounds (start, end)`` with resume; every match of every open window."""
    hits = df.where(Search(what.categories, what.keywords).predicate())
    return window_scan(hits, bounds, days, day_col="published", id_col="paper_id", completed=completed)


def search_raw(df: DataFrame, condition: str, max_results: int) -> DataFrame:
    """Ad-hoc search by a condition of the caller's own over the metadata columns."""
    return top_k(df.where(condition), max_results, *Search().order)


def fetch_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("paper_id"), "paper_id", "left_semi")


def citations_for(papers: DataFrame, source: DataFrame) -> DataFrame:
    """Citation counts by id without its version suffix; unknown papers get null."""
    known = source.select(F.col("paper_id").alias("__bare"), "citation_count")
    return papers.withColumn("__bare", tx.without_version(F.col("paper_id"))).join(known, "__bare", "left").drop("__bare")
