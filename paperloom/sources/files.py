"""JSON documents, keyword files, archives and figure files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom import kernels, schemas
from paperloom.functions import text as tx
from paperloom.functions.binding import unnest
from paperloom.functions.lexicon import CATEGORY_HEADINGS


def read_parsed(spark: SparkSession, path: str, paper_id: str | None = None) -> DataFrame:
    """Parsed documents, one JSON file each, with ``source_path`` and, of unreadable files, their text in ``unreadable``."""
    schema = f"{schemas.PARSED}, unreadable string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "unreadable")
    docs = reader.option("multiLine", "true").json(path).withColumn("source_path", F.input_file_name())
    return docs if paper_id is None else docs.where(F.col("paper_id") == paper_id)


def read_json_list(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def edge_cases(df: DataFrame) -> DataFrame:
    """Reviewed edge cases for a human reader: all of them, by id."""
    return df.orderBy("paper_id")


def category_name(heading: Column) -> Column:
    """Known category of a heading, by substring in table order; else a slug of the heading."""
    lowered = F.lower(tx.strip(heading))
    slug = F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F
    for pattern, name in CATEGORY_HEADINGS.items():
        out = out.when(F.contains(lowered, F.lit(pattern)), F.lit(name))
    return out.otherwise(slug)


def keyword_blocks(text: Column) -> Column:
    """``(category, keywords)`` blocks of a keyword file: ``*`` lines open a category.

    A file is one value, so a heading reaches its lines by splitting, without a
    window over line numbers.
    """
    blocks = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n[\t ]*\*+"), lambda _, i: i > 0)
    return F.transform(
        blocks,
        lambda b: F.struct(
            category_name(F.get(F.split(b, "\n", 2), F.lit(0))).alias("category"),
            F.array_distinct(F.filter(
                F.transform(F.split(F.coalesce(F.get(F.split(b, "\n", 2), F.lit(1)), F.lit("")), "\n"), lambda l: tx.strip(F.lower(l))),
                lambda l: F.length(l) > 0,
            )).alias("keywords"),
        ),
    )


def read_keyword_text(spark: SparkSession, path: str) -> DataFrame:
    """Keyword text files as ``(category, keyword, pos)``."""
    files = spark.read.text(path, wholetext=True)
    blocks = unnest(files, [], keyword_blocks(F.col("value")), "b", "block")
    return blocks.select("b.category", F.posexplode("b.keywords").alias("pos", "keyword"))


def read_keyword_json(spark: SparkSession, path: str) -> DataFrame:
    """Keyword JSON store as ``(category, keyword)``; a broken file gives no rows."""
    schema = "version string, categories map<string,array<string>>, flat_keywords array<string>"
    store = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    pairs = store.where(F.col("categories").isNotNull()).select(F.explode("categories").alias("category", "ks"))
    return pairs.select("category", F.explode("ks").alias("keyword"))


def resolve_archives(files: DataFrame, *, key: str = "paper_id", content: str = "content") -> DataFrame:
    """Archives to one LaTeX text each: main file picked, includes inlined, errors as a column."""
    schema = T.StructType().add(key, files.schema[key].dataType).add("content", T.StringType()).add("main_file", T.StringType()).add("error", T.StringType())
    return files.select(key, content).mapInPandas(kernels.unpack_archives(key, content), schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``*.tar.gz`` sources; the paper id is the file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(path)
    name = F.regexp_replace(tx.last_path_segment(F.col("path")), r"\.tar\.gz$", "")
    return resolve_archives(files.select(name.alias("paper_id"), "content"))


def image_format(content: Column) -> Column:
    """File extension by magic bytes; png when unknown."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda p: F.startswith(head, F.lit(p))
    return (
        F.when(starts("89504E470D0A1A0A"), ".png")
        .when(starts("FFD8"), ".jpg")
        .when(starts("474946383761") | starts("474946383961"), ".gif")
        .when(starts("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(starts("25504446"), ".pdf")
        .otherwise(".png")
    )


def figure_stats(files: DataFrame) -> DataFrame:
    """Files, bytes and owning papers per extension from a ``(path, length)`` listing."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    paper = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(ext.alias("ext")).agg(
        F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / (1024 * 1024), 2).alias("size_mb"), F.countDistinct(paper).alias("papers")
    )
