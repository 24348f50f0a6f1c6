"""Second-stage ranking of a bounded candidate pool with a pluggable pair scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import text as tx
from paperloom.operators.ranking import top_k_per_group
from paperloom.settings import DEFAULTS

PairScorer = Callable[[Column, Column], Column]

_SCORERS: dict[str, PairScorer] = {}


def register_scorer(name: str, scorer: PairScorer) -> None:
    """Add a scorer: a function of (query text, content) columns giving a score in [0, 1]."""
    _SCORERS[name] = scorer


def register_model(name: str, load: Callable[[], Callable[[list[str], list[str]], list[float]]], failures: Accumulator | None = None) -> None:
    """Add a model: ``load`` runs once per task and returns a batch scoring function.

    A batch the model fails on scores 0, so one bad batch cannot fail the job; its rows
    are added to ``failures``, which the caller reads when the job is done.
    """

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, content in batches:
            try:
                yield pd.Series(model(query.tolist(), content.tolist()), dtype="float64")
            except Exception:
                if failures is not None:
                    failures.add(len(query))
                yield pd.Series([0.0] * len(query), dtype="float64")

    udf = F.pandas_udf(score, T.DoubleType())
    register_scorer(name, lambda query, content: udf(query, content))


def scorer(name: str) -> PairScorer:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; known: {sorted(_SCORERS)}")
    return _SCORERS[name]


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's distinct terms that the content holds."""
    asked = F.array_distinct(tx.tokens(query))
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(asked, tx.tokens(content))).cast("double"), F.size(asked)), F.lit(0.0)
    )


def length_normalised_overlap(query: Column, content: Column) -> Column:
    """Cheaper-model stand-in: overlap damped by the length of the content."""
    return overlap_score(query, content) / (1 + F.log10(1 + F.size(tx.tokens(content))))


register_scorer("overlap", overlap_score)
register_scorer("light", length_normalised_overlap)


def pool_size(k: int) -> int:
    """How many candidates a reranked search fetches."""
    return max(DEFAULTS.search.rerank_pool_factor * k, DEFAULTS.search.rerank_pool_floor)


def rerank(hits: DataFrame, k: int, *, query_col: str = "query", content_col: str = "content", by: str = "overlap") -> DataFrame:
    """Best ``k`` hits per query by pair score.

    ``hits`` carries ``query_id, chunk_id, score, rank`` plus both texts.  A query
    with no more than ``k`` hits is returned untouched, without a new score.
    """
    per_query = Window.partitionBy("query_id")
    sized = hits.withColumn("__n", F.count(F.lit(1)).over(per_query))
    skipped = F.col("__n") <= k
    pair = F.round(scorer(by)(F.col(query_col), F.col(content_col)), 10)
    scored = (
        sized.withColumn("original_score", F.col("score"))
        .withColumn("original_rank", F.col("rank"))
        .withColumn("reranker_score", F.when(~skipped, pair))
        .withColumn("score", F.coalesce("reranker_score", "original_score"))
        .drop("rank", "__n")
    )
    order = [F.desc_nulls_last("reranker_score"), F.asc("original_rank")]
    return top_k_per_group(scored, ["query_id"], k, order)
