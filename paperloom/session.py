"""Session construction and the shared-folder checkpoint helper."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on for speed.

    No query depends on these for its result: the driver contract hands in a
    session of its own.  ``master`` stays unset on a cluster so that the submit
    command decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; pick a folder only where none is named.

    The fallback is a local folder and therefore only taken on a local master.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-checkpoint-"))


# A side of a join up to this many narrow rows is shipped whole to every executor.
BROADCAST_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a side that ought to be small, count it, and broadcast it only then.

    The planner cannot know the size of a top-k or a histogram beforehand and would
    shuffle the large side first; a side that turns out large is joined by shuffle.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
