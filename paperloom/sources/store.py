"""A folder of parquet tables that are changed as a whole.

Every change writes a new version folder and only counts once Spark has put its
success mark there, so a failed or repeated job leaves the last version intact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import changes


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = []
        for status in fs.listStatus(path):
            folder = status.getPath()
            mark = self.spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")
            if folder.getName().startswith("v=") and fs.exists(mark):
                done.append(int(folder.getName()[2:]))
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise LookupError(f"no table {name!r} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={versions[-1]}")

    def write(self, name: str, df: DataFrame, sort_by: str | None = None) -> None:
        """New version of a table; sorting inside files lets scans skip row groups by key."""
        version = (self._versions(name) or [0])[-1] + 1
        out = df if sort_by is None else df.sortWithinPartitions(sort_by)
        out.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")

    def change(self, name: str, how: Callable[[DataFrame], DataFrame]) -> None:
        self.write(name, how(self.read(name)))

    def create(self, name: str, empty: DataFrame, recreate: bool = False) -> None:
        """Idempotent creation; ``recreate`` starts over with an empty version."""
        if recreate or not self.exists(name):
            self.write(name, empty)

    def upsert(self, name: str, incoming: DataFrame, key: list[str], version: str | None = None) -> None:
        self.change(name, lambda table: changes.upsert(table, incoming, key, version))

    def insert_ignore(self, name: str, incoming: DataFrame, key: list[str]) -> None:
        self.change(name, lambda table: changes.insert_ignore(table, incoming, key))

    def update(self, name: str, rows: DataFrame, key: list[str], touched: str | None = None) -> None:
        self.change(name, lambda table: changes.update(table, rows, key, touched=touched))

    def delete(self, name: str, keys: DataFrame, key: list[str]) -> None:
        self.change(name, lambda table: changes.delete(table, keys, key))


def write_postings(docs: DataFrame, path: str, buckets: int = 256) -> None:
    """Inverted index ``(bucket, term, chunk_id, weight)`` from encoded rows.

    Files are grouped by term bucket and sorted by term, so a search opens the
    buckets of its terms and skips row groups inside them.  A term found in a
    third of all rows is spread over many files by a salt from the row id.
    """
    from pyspark.sql import functions as F

    pairs = docs.select("chunk_id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    rows = pairs.select(
        F.pmod(F.xxhash64("e.terms"), F.lit(buckets)).cast("int").alias("bucket"),
        F.col("e.terms").alias("term"), "chunk_id", F.col("e.weights").alias("weight"),
        F.pmod(F.xxhash64("chunk_id"), F.lit(16)).cast("int").alias("__salt"),
    )
    spread = rows.repartition("bucket", "__salt").sortWithinPartitions("bucket", "term").drop("__salt")
    spread.write.mode("overwrite").partitionBy("bucket").parquet(path)


def search_postings(spark: SparkSession, path: str, queries: DataFrame, k: int, buckets: int = 256) -> DataFrame:
    """Sparse top-k from the inverted index: postings of asked terms meet by row, then each task scores its rows.

    The asked terms are narrow; they are broadcast once they are known to be few, which prunes the
    buckets no term falls into.  A posting moves once, however many queries ask for its term, and a
    task hands on ``k`` rows per query.
    """
    from pyspark.sql import functions as F

    from paperloom.operators.search import sparse_search
    from paperloom.session import broadcast_if_small

    asked = queries.where(F.col("terms").isNotNull())
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    terms = broadcast_if_small(terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")))
    found = spark.read.parquet(path).join(terms, ["bucket", "term"])
    rows = found.groupBy("chunk_id").agg(F.collect_list(F.struct("term", "weight")).alias("found"))
    return sparse_search(rows.select("chunk_id", F.col("found.term").alias("terms"), F.col("found.weight").alias("weights")), asked, k)
