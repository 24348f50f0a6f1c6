"""Progress of windowed collection: which windows or months are done, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import changes
from paperloom.sources.store import Store

TABLE = "collection_state"
SCHEMA = "window_start date, collected bigint, filtered bigint"


class Progress:
    def __init__(self, store: Store):
        self.store = store

    def start(self, fresh: bool = False) -> None:
        """Create the state table; ``fresh`` forgets earlier progress."""
        self.store.create(TABLE, self.store.spark.createDataFrame([], SCHEMA), recreate=fresh)

    def completed(self) -> DataFrame:
        return self.store.read(TABLE).select("window_start")

    def mark(self, hits: DataFrame, stage_col: str, searched: DataFrame | None = None) -> None:
        """Record the windows of a finished scan; repeating it changes nothing.

        ``searched`` lists the windows (``window_start``) that were looked through: those
        without any hit count as done as well, and are not searched again.
        """
        done = hits.groupBy("window_start").agg(
            F.count(F.lit(1)).alias("collected"), F.count_if(F.col(stage_col) == "drop").alias("filtered")
        )
        if searched is not None:
            done = searched.select("window_start").distinct().join(done, "window_start", "left").fillna(0, ["collected", "filtered"])
        self.store.change(TABLE, lambda state: changes.upsert(state, done, ["window_start"]))

    def totals(self) -> DataFrame:
        return self.store.read(TABLE).agg(
            F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum("collected"), F.lit(0)).alias("total_collected"),
            F.coalesce(F.sum("filtered"), F.lit(0)).alias("total_filtered"),
        )
