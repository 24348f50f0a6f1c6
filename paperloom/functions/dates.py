"""Calendar columns: tumbling windows, months and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_day(text: Column) -> Column:
    """ISO date or date-time text to a date; anything unreadable becomes null."""
    return F.to_date(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 1, 10))))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def stamp(day: Column, end: bool) -> Column:
    """Minute stamp used by the remote search range: start or end of the day."""
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("2359" if end else "0000"))


def window_count(start: Column, end: Column, days: int) -> Column:
    return F.ceil(F.datediff(end, start) / F.lit(days)).cast("int")


def date_windows(bounds: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Closed tumbling windows of ``days`` days over ``[start, end]``; the last is cut at the end."""
    firsts = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {int(days)} days"))).alias("window_start")
    return bounds.select(F.col(end).alias("__end"), firsts).select(
        "window_start", F.least(F.date_add("window_start", days - 1), F.col("__end")).alias("window_end")
    )


def month_windows(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Calendar months touching ``[start, end]``: whole first month, last month cut at the end."""
    firsts = F.explode(F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("interval 1 month"))).alias("month_start")
    return bounds.select(F.col(end).alias("__end"), firsts).select(
        month_key(F.col("month_start")).alias("month"),
        "month_start",
        F.least(F.last_day("month_start"), F.col("__end")).alias("month_end"),
    )


def window_of(day: Column, start: Column, days: int) -> Column:
    """Number of the window a day falls in: equality instead of a range join."""
    return F.floor(F.datediff(day, start) / F.lit(days)).cast("int")
