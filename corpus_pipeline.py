"""The training-data pipeline: five stages over whole documents, each written and read again by its caller.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.  All but
the last return the columns of ``docs`` as they came, extra ones included; rows whose text
is null or whose id is null pass the filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, mixing, near_dedup, secrets, toxicity
from paperloom.llm.queries import THRESHOLD, fold
from paperloom.session import cut_lineage
from paperloom.sources.tables import load


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not listed; the planner broadcasts the ids only if it measures them small."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents whose score reaches the threshold."""
    lexicon = toxicity.fit(docs, load(spark, folder, "labels"), fold=fold(3, "key") != 1)
    scored = toxicity.score_toxicity(docs, lexicon, score="__toxicity")
    return scored.where(F.col("__toxicity") < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the first of each group of near copies: the smallest id, and its smallest text hash where it has several texts.

    Decisions are taken by id and text, so an id that stands over two texts may keep one of
    them.  Of rows that repeat both, one stays; rows without an id all stay.
    """
    judged = cut_lineage(near_dedup.near_duplicates(docs).select("doc_id", "text_key", "first").where("doc_id IS NOT NULL"))
    dropped = judged.where(~F.col("first")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = (docs["doc_id"].cast("long") == dropped["__id"]) & (F.xxhash64(docs["text"]) == dropped["__key"])
    kept = docs.join(dropped, same, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if judged.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return kept
    # Repeated rows meet by id and text alone, so that a null id never does.
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("r"), F.monotonically_increasing_id().cast("string")))
    return kept.withColumn("__own", own).dropDuplicates(["__own", "text"]).drop("__own")


def decontamination_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return without(docs, cut_lineage(decontaminate.find_leaks(docs, load(spark, folder, "benchmark")).select("doc_id")))


def secret_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace every secret by a mark; ``n_chars``, where there is one, follows the text."""
    out = secrets.scan_secrets(docs, found="__secrets", clean="__clean")
    out = out.withColumn("text", F.when(F.size("__secrets") > 0, F.col("__clean")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("__secrets") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

# A learned lexicon, minimum hashes and a balanced sample have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is cut off before the next reads it several times."""
    docs = load(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
