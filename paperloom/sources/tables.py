"""Named parquet tables below one folder, and how to spread small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all task slots for CPU-heavy work on an input of few, small splits.

    A table with enough files or bytes is left as it is: at scale its splits
    already outnumber the slots and a shuffle would only cost.
    """
    spark = df.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split_bytes = int(str(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= split_bytes * slots or len(df.inputFiles()) >= slots:
        return df
    return df.repartition(slots)
