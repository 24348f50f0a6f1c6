"""Command line end to end, and the plans that make the operators scale."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as contract
from conftest import plan
from paperloom import kernels
from paperloom.__main__ import main
from paperloom.operators import changes, curation, search
from paperloom.sources.tables import spread

FOLDER = "/root/testdata/sf0.001"


def test_collect_score_sample_keywords_check(spark, tmp_path):
    rows = [
        (f"p{i}", "A language model" if i % 2 else "Robot arms", "retrieval and attention", ["cs.CL"], dt.date(2024, 1, 1 + i % 28), i)
        for i in range(60)
    ]
    schema = "paper_id string, title string, abstract string, categories array<string>, published date, citation_count int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "meta"))
    main(["collect", "--input", str(tmp_path / "meta"), "--output", str(tmp_path / "found"), "--start", "2024-01-01", "--end", "2024-01-31"])
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.count() == 30 and {r[0] for r in found.select("stage").distinct().collect()} == {"keep"}
    main(["score", "--input", str(tmp_path / "found"), "--output", str(tmp_path / "scored"), "--reference", "2024-06-01"])
    main(["sample", "--input", str(tmp_path / "scored"), "--output", str(tmp_path / "sample"), "--n", "10"])
    assert spark.read.parquet(str(tmp_path / "sample")).count() == 10
    assert spark.read.json(str(tmp_path / "sample_diversity")).first()["passed"] is False
    (tmp_path / "kw.txt").write_text("* Finance\nstocks\nStocks\n")
    main(["keywords", "--input", str(tmp_path / "kw.txt"), "--output", str(tmp_path / "kw")])
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "kw")).select("category", "keyword").collect()] == [("finance_social", "stocks")]
    main(["months", "--output", str(tmp_path / "months"), "--start", "2024-01-15", "--end", "2024-03-02"])
    months = spark.read.json(str(tmp_path / "months")).orderBy("month").collect()
    assert [(r["month"], r["month_end"]) for r in months] == [("2024-01", "2024-01-31"), ("2024-02", "2024-02-29"), ("2024-03", "2024-03-02")]


def test_parse_and_embed_commands(spark, tmp_path):
    text = "\\documentclass{x}\\title{T}\\begin{document}\\section{Method}\n\n" + "word " * 150 + "\n\\section{References}\n\n" + "gone " * 150 + "\\end{document}"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "2401.1.tar.gz").write_bytes(kernels.pack_archive({"main.tex": text}))
    (tmp_path / "src" / "bad.tar.gz").write_bytes(b"no archive")
    main(["parse", "--input", str(tmp_path / "src"), "--output", str(tmp_path / "parsed")])
    row = spark.read.parquet(str(tmp_path / "parsed")).collect()
    assert [(r["paper_id"], r["title"], [s["title"] for s in r["sections"]]) for r in row] == [("2401.1", "T", ["Method"])]
    main(["embed", "--input", str(tmp_path / "parsed"), "--output", str(tmp_path / "index"), "--dim", "8"])
    chunk = spark.read.parquet(str(tmp_path / "index" / "chunks")).collect()
    assert [(c["chunk_id"], c["token_count"]) for c in chunk] == [("2401.1_chunk_0", 150)]
    assert len(spark.read.parquet(str(tmp_path / "index" / "vectors")).first()["embedding"]) == 8


def test_dense_filter_reaches_the_scan(spark):
    text = plan(contract.queries()["dense_filtered"](spark, FOLDER))
    assert "EqualTo(label,3)" in text and "WindowGroupLimit" in text


def test_search_does_not_shuffle_the_corpus(spark, tmp_path):
    """With enough files nothing is exchanged before the scan has cut to k rows per query."""
    rows = spark.range(400).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    rows.repartition(8).write.parquet(str(tmp_path / "v"))
    vectors = spread(spark.read.parquet(str(tmp_path / "v")))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")
    text = plan(search.dense_search(vectors, queries, 3, 2))
    assert "Exchange" not in text[text.index("MapInArrow") :]


def test_payload_side_is_not_shuffled(spark):
    text = plan(contract.queries()["late_materialize_order"](spark, FOLDER))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_bonus_join_leaves_rows_in_place(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("topic"))
    text = plan(curation.with_bonus(df, "topic"))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_small_change_set_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(1000).select("id", F.lit("a").alias("v")).write.parquet(str(tmp_path / "t"))
    spark.range(3).select("id", F.lit("b").alias("v")).write.parquet(str(tmp_path / "c"))
    text = plan(changes.upsert(spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "c")), ["id"]))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
