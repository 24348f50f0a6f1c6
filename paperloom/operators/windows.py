"""Windowed scans: rows to tumbling date windows, with resume and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.dates import date_windows, window_of
from paperloom.operators.ranking import first_per_group, top_k_per_group
from paperloom.session import broadcast_if_small


def window_scan(
    rows: DataFrame, bounds: DataFrame, days: int, *, day_col: str, id_col: str, per_window: int | None = None,
    completed: DataFrame | None = None,
) -> DataFrame:
    """Rows of every open window, at most ``per_window`` newest each, first window wins per id.

    The window number is computed from the day, so the range join is an equality
    join against the window list; ``completed`` windows are skipped by anti join.
    """
    windows = date_windows(bounds, days)
    if completed is not None:
        windows = windows.join(completed.select("window_start"), "window_start", "left_anti")
    span = bounds.select(F.col("start").alias("__start"), F.col("end").alias("__end"))
    numbered = windows.withColumn("__one", F.lit(1)).join(span.withColumn("__one", F.lit(1)), "__one")
    numbered = numbered.withColumn("__no", window_of(F.col("window_start"), F.col("__start"), days)).select(
        "__no", "window_start", "window_end"
    )
    start = bounds.select("start").first()["start"]  # one-row parameter table
    tagged = rows.withColumn("__no", window_of(F.col(day_col), F.lit(start), days))
    # One row per window of the range: counted, then broadcast, so rows stay where they are.
    hits = tagged.join(broadcast_if_small(numbered), "__no").where(F.col(day_col).between(F.col("window_start"), F.col("window_end"))).drop("__no")
    if per_window is not None:
        hits = top_k_per_group(hits, ["window_start"], per_window, [F.desc(day_col), F.asc(id_col)], rank="__r").drop("__r")
    return first_per_group(hits, [id_col], [F.asc("window_start")])
