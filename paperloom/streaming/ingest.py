"""Resumable ingest: a file stream that takes what is new, window by window.

Two checkpoints remember what is done: the source's log which files were read, the state
store which ids were seen.  A run that was cut off goes on where it stopped, and no batch
reads rows of an earlier one.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.dates import window_of

# Most bytes of the source that one task reads.  Its rows are sorted by id in memory, and narrow
# columns of a Parquet file take some fifty times their size there.
SPLIT_BYTES = 8 * 1024 * 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def hash_of(rows: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])


def first_seen(stream: DataFrame, *, id_col: str, day_col: str) -> DataFrame:
    """Per id of a file stream its first batch, its last batch and the place of its earliest row.

    A keyed aggregation whose state is a few dozen bytes per id: the batch is told by its
    time stamp, which a retry finds again in the source's log, and the row by day, hash and
    file.  Rows of an id are combined in the tasks that read them, so a hot id costs the
    reducer one row per task.
    """
    place = F.struct(F.col(day_col).alias("day"), hash_of(stream).alias("hash"), F.col("_metadata.file_path").alias("file"))
    now = F.current_timestamp()
    rows = stream.select(F.col(id_col).alias("id"), place.alias("place"), now.alias("now"))
    return rows.groupBy("id").agg(F.min("place").alias("place"), F.min("now").alias("first"), F.max("now").alias("last"))


def ingest(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, *, id_col: str, day_col: str,
    start, days: int, files_per_batch: int = 16,
) -> None:
    """Append rows with new ids to ``target``, tagged with their date window.

    Of a new id the row of the earliest day is taken (no day first, then the smallest row
    hash), of equal rows one; a null id is an id like any other.  What an id brings after
    its first batch is left out, whatever its day.
    """
    # Seen ids grow with the source, so their state belongs on disk, not on the heap.
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def add(batch: DataFrame, batch_id: int) -> None:
        new = batch.where(F.col("first") == F.col("last")).select(F.col("id").alias("__id"), "place.hash", "place.file").persist()
        files = [r["file"] for r in new.select("file").distinct().collect()]  # at most files_per_batch
        if files:
            rows = batch.sparkSession.read.schema(schema).parquet(*map(unquote, files))
            rows = rows.select("*", hash_of(rows).alias("__hash"), F.col("_metadata.file_path").alias("__file"))
            same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("hash")) & (F.col("__file") == F.col("file"))
            fresh = rows.join(new, same, "left_semi").drop("__hash", "__file").dropDuplicates([id_col])
            tagged = fresh.withColumn("window_no", window_of(F.col(day_col), F.lit(start), days))
            tagged.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")  # same folder on a retry of the same batch
        new.unpersist()

    try:
        seen = first_seen(stream, id_col=id_col, day_col=day_col)
        query = (
            seen.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def windowed_counts(stream: DataFrame, *, time_col: str, group: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Event counts per time window with late data dropped after ``late``."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    return stream.withWatermark(time_col, late).groupBy(window, group).agg(F.count(F.lit(1)).alias("n"))
