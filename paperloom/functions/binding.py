"""Evaluate a column once and use it many times inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda re-evaluates every outer expression it mentions for each element;
    bound to a lambda variable instead, an expensive list is computed one time.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, keep: list, values: Column, name: str = "item", pos: str = "pos") -> DataFrame:
    """One row per element of a computed list, with its 0-based place.

    A plain explode makes the planner add a filter on the size of the list, which
    computes an expensive list a second and a third time; the outer form does not.
    """
    rows = df.select(*keep, F.posexplode_outer(values).alias(pos, name))
    return rows.where(F.col(pos).isNotNull())
