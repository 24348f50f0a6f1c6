"""Command line: ``python -m paperloom <command> …`` — each command is one Spark job over folders.

Submit it with ``spark-submit`` on a cluster; the master is then the cluster's.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperloom import build_session
from paperloom.functions import dates, scores
from paperloom.operators import changes, chunking, curation, dashboard, evaluation, parsing, quality, search, sections
from paperloom.sources import files, metadata


def collect(spark: SparkSession, a) -> None:
    """Windowed metadata scan, rule split, newest citations first."""
    what = metadata.Search(tuple(a.category) or metadata.DEFAULT_CATEGORIES, tuple(a.keyword), a.start, a.end)
    bounds = spark.range(1).select(F.lit(a.start).alias("start"), F.lit(a.end).alias("end"))
    found = metadata.search_windows(spark.read.parquet(a.input), what, bounds, a.days)
    split = curation.rule_split(found, F.concat_ws(" ", "title", "abstract"))
    split.where(F.col("stage") != "drop").write.mode("overwrite").parquet(a.output)


def parse(spark: SparkSession, a) -> None:
    """LaTeX archives to parsed documents, noise sections removed."""
    parsed = parsing.parse_latex(files.read_archives(spark, a.input).where(F.col("error").isNull()))
    kept = parsed.withColumn("sections", sections.without_excluded(F.col("sections")))
    kept.drop("content").write.mode("overwrite").parquet(a.output)


def embed(spark: SparkSession, a) -> None:
    """Parsed documents to chunks, dense vectors and term weights."""
    docs = spark.read.parquet(a.input)
    plain = F.transform("sections", lambda s: F.struct(s["title"].alias("title"), F.transform(s["paragraphs"], lambda p: p["content"]).alias("paragraphs")))
    chunks = chunking.chunk_documents(docs.select("paper_id", "abstract", plain.alias("sections")))
    chunks.write.mode("overwrite").parquet(f"{a.output}/chunks")
    stored = spark.read.parquet(f"{a.output}/chunks")
    search.embed_texts(stored, a.dim, id_col="chunk_id", text_col="content").write.mode("overwrite").parquet(f"{a.output}/vectors")
    search.encode_sparse(stored, 128, id_col="chunk_id", text_col="content").write.mode("overwrite").parquet(f"{a.output}/terms")


def evaluate(spark: SparkSession, a) -> None:
    """Mean metrics of ranked hits (mode, query_id, paper_id, chunk_id, rank) against judgements."""
    hits, qrels = spark.read.parquet(a.input), spark.read.parquet(a.qrels)
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    metrics = evaluation.query_metrics(evaluation.judge(hits, qrels), ["mode", "query_id"], totals)
    evaluation.mean_metrics(metrics, ["mode"]).write.mode("overwrite").json(a.output)


def score(spark: SparkSession, a) -> None:
    """Topic and final score of every paper."""
    papers = spark.read.parquet(a.input).withColumn("topic", scores.topic(F.concat_ws(" ", "title", "abstract")))
    if "similarity" not in papers.columns:
        papers = papers.withColumn("similarity", F.lit(None).cast("double"))
    curation.score_papers(papers, F.lit(a.reference)).write.mode("overwrite").parquet(a.output)


def sample(spark: SparkSession, a) -> None:
    """Stratified sample of scored papers and its diversity report."""
    chosen = curation.stratified_sample(spark.read.parquet(a.input), a.n)
    chosen.write.mode("overwrite").parquet(a.output)
    curation.diversity(spark.read.parquet(a.output), "topic", "published").write.mode("overwrite").json(a.output.rstrip("/") + "_diversity")


def impact(spark: SparkSession, a) -> None:
    """Rerank gains from an evaluation JSON file."""
    table = dashboard.unpack_results(spark.read.text(a.input, wholetext=True), "value")
    dashboard.rerank_impact(table, ["ndcg_5", "ndcg_10", "mrr", "precision_10"]).write.mode("overwrite").json(a.output)


def keywords(spark: SparkSession, a) -> None:
    """Keyword text file to a keyword table."""
    files.read_keyword_text(spark, a.input).write.mode("overwrite").parquet(a.output)


def check(spark: SparkSession, a) -> None:
    """Quality report of chunk texts."""
    quality.document_report(spark.read.parquet(a.input), "chunk_id", "content").write.mode("overwrite").parquet(a.output)


def migrate(spark: SparkSession, a) -> None:
    """Copy vectors kept as JSON text into typed columns."""
    changes.migrate(spark.read.parquet(a.input)).write.mode("overwrite").parquet(a.output)


def months(spark: SparkSession, a) -> None:
    """Calendar months of a range, as the extended collection walks them."""
    bounds = spark.range(1).select(F.lit(a.start).alias("start"), F.lit(a.end).alias("end"))
    dates.month_windows(bounds).write.mode("overwrite").json(a.output)


COMMANDS = {f.__name__: f for f in (collect, parse, embed, evaluate, score, sample, impact, keywords, check, migrate, months)}


def main(argv: list[str] | None = None) -> None:
    day = dt.date.fromisoformat
    parser = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--input", default="")
    parser.add_argument("--output", required=True)
    parser.add_argument("--qrels", default="")
    parser.add_argument("--category", action="append", default=[])
    parser.add_argument("--keyword", action="append", default=[])
    parser.add_argument("--start", type=day, default=dt.date(2024, 1, 1))
    parser.add_argument("--end", type=day, default=dt.date(2025, 2, 28))
    parser.add_argument("--reference", type=day, default=dt.date.today())
    parser.add_argument("--days", type=int, default=14)
    parser.add_argument("--dim", type=int, default=64)
    parser.add_argument("--n", type=int, default=1000)
    parser.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    COMMANDS[args.command](build_session(f"paperloom-{args.command}", args.master), args)


if __name__ == "__main__":
    main()
