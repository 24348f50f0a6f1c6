"""Figure images as files, one per figure, written by tasks through a data source writer.

A file's place hangs on paper and figure alone.  A task writes it under a name of its
own attempt and moves it there, so a retried or doubled task leaves the same one file.
"""

from __future__ import annotations

import datetime as dt
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from paperloom.session import broadcast_if_small
from paperloom.sources.files import image_format
from paperloom.sources.remote import file_system

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTENSIONS = (".png", ".jpg", ".gif", ".webp", ".pdf")
STAGING = "_attempts"
INDEX = "_index"
BATCH_BYTES = 16 << 20
LISTED = pa.schema([("folder", pa.string()), ("figure", pa.string()), ("ext", pa.string()), ("length", pa.int64()), ("run", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    figures: int
    size: int


class FigureWriter(DataSourceArrowWriter):
    """Rows ``(folder, figure, ext, content)`` to files; the driver gets one name and two numbers of a task."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        disk, root = file_system(self.root)
        attempt = uuid.uuid4().hex
        own = f"{root}/{STAGING}-{self.run}/{attempt}"
        disk.create_dir(own)
        figures = size = 0
        made: set[str] = set()
        with pq.ParquetWriter(f"{own}/list.parquet", LISTED, filesystem=disk) as index:
            for batch in iterator:
                listed = []
                for folder, figure, ext, content in zip(*(batch.column(c) for c in ("folder", "figure", "ext", "content"))):
                    folder, figure, ext, content = folder.as_py(), figure.as_py(), ext.as_py(), content.as_buffer()
                    place = f"{root}/{folder}"
                    if place not in made:
                        disk.create_dir(place)
                        made = made | {place} if len(made) < 1000 else {place}
                    with disk.open_output_stream(f"{own}/file") as out:
                        out.write(content)
                    disk.move(f"{own}/file", f"{place}/{figure}{ext}")
                    # The image of an earlier run may have had another format.
                    for old in disk.get_file_info([f"{place}/{figure}{e}" for e in EXTENSIONS if e != ext]):
                        if old.type == fs.FileType.File:
                            disk.delete_file(old.path)
                    listed.append((folder, figure, ext, content.size, self.run))
                    figures, size = figures + 1, size + content.size
                index.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*listed) if listed else [[]] * 5, LISTED.types)], schema=LISTED))
        return Written(attempt, figures, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the lists of the attempts that count, drop what others left behind."""
        disk, root = file_system(self.root)
        done = [m for m in messages if m is not None]
        disk.create_dir(f"{root}/{INDEX}")
        for m in done:
            if m.figures:
                disk.move(f"{root}/{STAGING}-{self.run}/{m.attempt}/list.parquet", f"{root}/{INDEX}/{self.run}-{m.attempt}.parquet")
        self.abort(messages)
        with disk.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(f'{{"figures": {sum(m.figures for m in done)}, "bytes": {sum(m.size for m in done)}}}\n'.encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Finished files stay, unlisted: each is whole, and the next run writes them again."""
        disk, root = file_system(self.root)
        if disk.get_file_info(f"{root}/{STAGING}-{self.run}").type == fs.FileType.Directory:
            disk.delete_dir(f"{root}/{STAGING}-{self.run}")


class FigureFiles(DataSource):
    """``df.write.format("figure_files").option("path", root).mode("append").save()``."""

    @classmethod
    def name(cls) -> str:
        return "figure_files"

    def writer(self, schema: StructType, overwrite: bool) -> FigureWriter:
        if overwrite:
            raise ValueError("figures are replaced one by one: write them in append mode")
        missing = {"folder", "figure", "ext", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"no column {sorted(missing)}")
        return FigureWriter(self.options["path"], f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S%f}")


def safe_name(name: Column) -> Column:
    """A file name: slashes and colons become ``_``; empty names and those of hidden files get ``p_`` in front."""
    clean = F.regexp_replace(name.cast("string"), r"[/\\:]", "_")
    return F.regexp_replace(clean, r"^(?=[._]|$)", "p_")


def image_path(paper: Column, figure: Column, content: Column) -> Column:
    """Where the image of a figure lies below the root; null without an image."""
    return F.concat(safe_name(paper), F.lit("/"), safe_name(figure), F.when(F.length(content) > 0, image_format(content)))


def write_figures(figures: DataFrame, path: str, *, paper: str = "paper_id", figure: str = "figure_id", content: str = "content") -> None:
    """Write each figure's image to ``path/paper/figure.ext``, the format told by its first bytes.

    Figures of earlier runs are replaced, others stay.  Rows without paper, figure or
    image (null or no bytes) leave no file.  Of a figure that comes with several images the one of smallest
    hash is written; only names and hashes are shuffled to find these, images stay where
    they are.  ``path`` must be a folder that all executors share.
    """
    spark = figures.sparkSession
    image = figures[f"`{content}`"]
    rows = figures.select(
        safe_name(figures[f"`{paper}`"]).alias("folder"), safe_name(figures[f"`{figure}`"]).alias("figure"), image_format(image).alias("ext"), image.alias("content"),
    ).where("folder IS NOT NULL AND figure IS NOT NULL AND length(content) > 0")
    hashed = rows.withColumn("hash", F.sha2("content", 256))
    several = hashed.groupBy("folder", "figure").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least < most").drop("most")
    chosen = hashed.join(broadcast_if_small(several), ["folder", "figure"], "left").where("least IS NULL OR hash = least")
    spark.dataSource.register(FigureFiles)
    chosen.select("folder", "figure", "ext", "content").write.format("figure_files").option("path", path).mode("append").save()


def list_figures(spark: SparkSession, path: str) -> DataFrame:
    """``(path, folder, figure, ext, length)`` of every written figure as its last run left it; from the tasks' lists."""
    schema = "folder string, figure string, ext string, length long, run string"
    rows = spark.read.schema(schema).parquet(f"{path}/{INDEX}")
    last = rows.groupBy("folder", "figure").agg(F.max_by(F.struct("ext", "length"), "run").alias("last")).select("folder", "figure", "last.*")
    return last.select(F.concat(F.lit(f"{path}/"), "folder", F.lit("/"), "figure", "ext").alias("path"), "*")


def read_figures(spark: SparkSession, path: str, *, task_bytes: int = 128 << 20, task_files: int = 10_000) -> DataFrame:
    """The listed figures with their ``content``; each task opens about ``task_files`` files of ``task_bytes`` together."""
    found = list_figures(spark, path)
    n, size = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, -(-n // task_files), -(-size // task_bytes))
    return found.repartition(tasks, "folder", "figure").mapInArrow(opened, "path string, folder string, figure string, ext string, length long, content binary")


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the bytes of their files, some megabytes at a time."""
    for batch in batches:
        start = held = 0
        contents: list[bytes] = []
        for i, path in enumerate(batch.column(0).to_pylist()):
            disk, place = file_system(path)
            with disk.open_input_stream(place) as file:
                contents.append(file.read())
            held += len(contents[-1])
            if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                part = batch.slice(start, i + 1 - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(contents, pa.binary())], names=[*part.schema.names, "content"])
                start, held, contents = i + 1, 0, []
