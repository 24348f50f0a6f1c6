"""A paged metadata service as a data source: one or more tasks per date window, pages fetched in turn.

The service is reached through a client with two calls, ``windows`` and ``page``.  Without
network ``FolderPages`` serves pages that Spark wrote to a shared folder; a client of a
real service goes in by ``PagedMetadata.client`` in a subclass.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from paperloom.session import broadcast_if_small
from paperloom.sources.remote import file_system, retried

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "paper_id string, title string, abstract string, categories array<string>, published date"
DAY = "published"
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
VECTOR = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass(frozen=True)
class Window:
    number: int
    first: dt.date
    last: dt.date
    pages: int


class FolderPages:
    """Pages that ``write_pages`` laid down; a page is a folder, its files are read with the wanted columns alone.

    Rows are dealt by hash, so a page may have got none; it has no folder then.
    """

    def __init__(self, root: str):
        self.root = root

    def windows(self) -> list[Window]:
        disk, root = file_system(self.root)
        with disk.open_input_stream(f"{root}/windows.json") as file:
            return [Window(w["number"], dt.date.fromisoformat(w["first"]), dt.date.fromisoformat(w["last"]), w["pages"]) for w in json.loads(file.read())]

    def page(self, window: int, page: int, columns: list[str]) -> pa.Table:
        disk, root = file_system(self.root)
        folder = f"{root}/pages/window={window}/page={page}"
        if disk.get_file_info(folder).type == fs.FileType.NotFound:
            return to_arrow_schema(StructType.fromDDL(SCHEMA)).empty_table().select(columns)
        return pq.read_table(folder, columns=columns, filesystem=disk, partitioning=None)


@dataclass
class Pages(InputPartition):
    """A run of pages of one window, some of which a lost task fetches again."""

    window: int
    first: int
    last: int

    def __post_init__(self):
        super().__init__((self.window, self.first))


class PagedReader(DataSourceReader):
    """Date comparisons choose the windows and are applied to the pages; all else is left to Spark."""

    def __init__(self, client, schema: StructType, pages_per_task: int, attempts: int, delay: float):
        self.client, self.schema = client, schema
        self.pages_per_task, self.attempts, self.delay = pages_per_task, attempts, delay
        self.dates: list[tuple[type, dt.date]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in COMPARED and f.attribute == (DAY,) and isinstance(f.value, dt.date):
                self.dates.append((type(f), f.value))
            else:
                yield f

    def holds(self, window: Window) -> bool:
        """Whether some day of the window may meet every comparison."""
        for kind, value in self.dates:
            nearest = min(max(value, window.first), window.last) if kind is EqualTo else window.last if kind in (GreaterThan, GreaterThanOrEqual) else window.first
            if not COMPARED[kind](nearest, value):
                return False
        return True

    def partitions(self) -> list[Pages]:
        """A window with a third of all rows is many tasks, a quiet one is one."""
        windows = retried(self.client.windows, self.attempts, self.delay)
        runs = [Pages(w.number, a, min(a + self.pages_per_task, w.pages)) for w in windows if self.holds(w) for a in range(0, w.pages, self.pages_per_task)]
        return runs or [Pages(0, 0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        wanted = names + [DAY] * (bool(self.dates) and DAY not in names)
        layout = to_arrow_schema(self.schema)
        for page in range(partition.first, partition.last):
            rows = retried(lambda p=page: self.client.page(partition.window, p, wanted), self.attempts, self.delay)
            for kind, value in self.dates:
                rows = rows.filter(VECTOR[kind](rows.column(DAY), pa.scalar(value, pa.date32())))
            yield from rows.select(names).cast(layout).to_batches()


class PagedMetadata(DataSource):
    """``spark.read.format("paged_metadata").option("path", root)``; a shorter ``.schema`` fetches fewer columns.

    Options: ``pages_per_task`` (8), ``attempts`` (4) and ``delay`` in seconds (3.0) before
    a failed call is tried again, doubled each time.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_metadata"

    def schema(self) -> str:
        return SCHEMA

    def client(self):
        return FolderPages(self.options["path"])

    def reader(self, schema: StructType) -> PagedReader:
        option = self.options.get
        return PagedReader(self.client(), schema, int(option("pages_per_task", "8")), int(option("attempts", "4")), float(option("delay", "3.0")))


def read_pages(spark: SparkSession, path: str, source: type[PagedMetadata] = PagedMetadata, schema: str = SCHEMA, **options: object) -> DataFrame:
    """The service's metadata as a table; its pages are fetched when Spark asks for them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else Spark refuses readers that take filters
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).schema(schema).option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()


def write_pages(papers: DataFrame, path: str, *, days: int = 30, page_rows: int = 2000) -> None:
    """Lay ``papers`` (``paper_id, title, abstract, categories, published``) down as pages of a service.

    Windows of ``days`` are counted from 1970-01-01; a page holds ``page_rows`` on the
    average, dealt by a hash of the whole row, so equal rows share a page.  Rows without a
    date are in no window.  One row per window comes to the driver, nothing else.
    """
    dated = papers.select("paper_id", "title", "abstract", "categories", DAY).where(F.col(DAY).isNotNull())
    dated = dated.withColumn("window", F.floor(F.datediff(DAY, F.lit(dt.date(1970, 1, 1))) / F.lit(days)).cast("int"))
    sizes = dated.groupBy("window").agg(F.min(DAY).alias("first"), F.max(DAY).alias("last"), F.ceil(F.count(F.lit(1)) / F.lit(page_rows)).cast("int").alias("pages"))
    sizes = broadcast_if_small(sizes)
    placed = dated.join(sizes.select("window", "pages"), "window").withColumn("page", F.pmod(F.xxhash64("paper_id", "title", "abstract", "categories", DAY), F.col("pages").cast("long")).cast("int"))
    placed.drop("pages").repartition("window", "page").write.partitionBy("window", "page").mode("overwrite").parquet(f"{path}/pages")
    disk, root = file_system(path)
    with disk.open_output_stream(f"{root}/windows.json") as out:
        out.write(json.dumps([
            {"number": r["window"], "first": r["first"].isoformat(), "last": r["last"].isoformat(), "pages": r["pages"]} for r in sizes.orderBy("window").collect()
        ]).encode())
