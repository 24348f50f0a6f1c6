"""Results stay whole: no caps, null keys, null lists, empty windows, map columns, tables kept as folders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from paperloom import kernels
from paperloom.operators import changes, chunking, curation, parsing, sections
from paperloom.sources import files, metadata
from paperloom.sources.state import Progress
from paperloom.sources.store import Store

DAY = dt.date(2024, 1, 1)


def papers(spark, n):
    return spark.range(n).select(
        F.col("id").cast("string").alias("paper_id"), F.lit("a title").alias("title"), F.lit("text").alias("abstract"),
        F.array(F.lit("cs.CL")).alias("categories"), F.date_add(F.lit(DAY), (F.col("id") % 3).cast("int")).alias("published"))


def test_windows_and_pages_have_no_cap(spark):
    table = papers(spark, 12_000)
    bounds = spark.createDataFrame([(DAY, DAY + dt.timedelta(days=13))], "start date, end date")
    assert metadata.search_windows(table, metadata.Search(), bounds, 14).count() == 12_000
    assert metadata.search_batch(table, metadata.Search(), 5_000).count() == 5_000
    assert metadata.search_first_page(table, metadata.Search(), 9_000).count() == 9_000


def test_date_filter_comes_before_the_cut(spark):
    old = metadata.search(papers(spark, 300), metadata.Search(end=DAY), 50)
    assert old.count() == 50 and {r["published"] for r in old.collect()} == {DAY}


def test_raw_search(spark):
    assert metadata.search_raw(papers(spark, 30), "published = DATE'2024-01-01' AND paper_id LIKE '%0'", 99).count() == 1


def test_semantic_filter_keeps_all_by_default(spark):
    rows = spark.range(6_000).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    assert curation.semantic_filter(rows, "v", [1.0, 0.0], threshold=0.5, id_col="id").count() == 6_000


def test_equation_context_among_many_equations(spark):
    text = " ".join(f"$$x_{i}$$" for i in range(60))
    found = spark.createDataFrame([(text,)], "t string").select(parsing.latex_equations(F.col("t")).alias("e")).first()["e"]
    assert len(found) == 60
    at = text.index("$$x_40$$")
    assert found[40]["context_before"] == text[:at][-200:].strip()[-100:]
    assert found[40]["context_after"] == text[at + 8:][:200].strip()[:100]


def test_a_null_topic_keeps_its_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, topic string")
    out = {r["id"]: r["bonus"] for r in curation.with_bonus(rows, "topic").collect()}
    assert set(out) == {1, 2, 3} and out[3] is not None


def test_upsert_and_insert_of_map_columns(spark):
    schema = "chunk_id string, version int, sparse map<int,double>"
    old = spark.createDataFrame([("a", 1, {1: 0.5}), ("b", 1, {2: 0.5})], schema)
    new = spark.createDataFrame([("b", 2, {3: 1.0}), ("b", 3, {4: 1.0}), ("c", 1, None)], schema)
    got = {r["chunk_id"]: r["sparse"] for r in changes.upsert(old, new, ["chunk_id"], "version").collect()}
    assert got == {"a": {1: 0.5}, "b": {4: 1.0}, "c": None}
    kept = {r["chunk_id"]: r["sparse"] for r in changes.insert_ignore(old, new, ["chunk_id"]).collect()}
    assert kept == {"a": {1: 0.5}, "b": {2: 0.5}, "c": None}


def test_chunking_survives_null_lists(spark):
    schema = "paper_id string, abstract string, sections array<struct<title:string,paragraphs:array<string>>>"
    words = " ".join(["word"] * 150)
    rows = [("a", words, None), ("b", words, [("T", None), ("U", [words, None])]), ("c", None, [None])]
    out = chunking.chunk_documents(spark.createDataFrame(rows, schema)).groupBy("paper_id").count().collect()
    assert {r["paper_id"]: r["count"] for r in out} == {"a": 1, "b": 2}


def test_empty_windows_count_as_done(spark, tmp_path):
    progress = Progress(Store(spark, str(tmp_path)))
    progress.start()
    hits = spark.createDataFrame([(DAY, "keep")], "window_start date, stage string")
    searched = spark.createDataFrame([(DAY + dt.timedelta(days=14 * i),) for i in range(5)], "window_start date")
    progress.mark(hits, "stage", searched)
    assert progress.completed().count() == 5
    assert progress.totals().first()["total_collected"] == 1


def test_unreadable_documents_keep_a_trace(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"paper_id": "1", "title": "t"}')
    (tmp_path / "bad.json").write_text('{"paper_id": ')
    rows = files.read_parsed(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and [r["source_path"][-8:] for r in rows if r["unreadable"]] == ["bad.json"]


def test_excluded_subtrees_of_any_depth(spark):
    rows = [(0, None, "References")] + [(i, i - 1, "Text") for i in range(1, 12)] + [(50, None, "Intro"), (51, 50, None)]
    out = sections.nested_excluded(spark.createDataFrame(rows, "section_id int, parent_id int, title string"))
    assert {r["section_id"] for r in out.collect()} == {50, 51}


def test_includes_nest_ring_and_repeat():
    parts = {"main.tex": r"a \input{x} b \include{sub/y.tex} c \input{x} \input{none}", "x.tex": "X", "sub/y.tex": r"[\input{z}\input{../main}]", "sub/z.tex": r"Z \input{y}"}
    assert kernels.main_file({**parts, "a.tex": "plain"}) == "main.tex"
    assert kernels.main_file({"b.tex": r"\documentclass{x}", "main.tex": "plain"}) == "b.tex"
    deep = {f"f{i}.tex": rf"{i} \input{{f{i + 1}}}" for i in range(3000)} | {"f3000.tex": "end"}
    assert kernels.inline_includes(deep, "f0.tex").endswith("2999 end")
    got = kernels.inline_includes(parts, "main.tex")
    assert got.startswith("a X b [Z ") and got.count("X") == 1 and "none" not in got


FOLDER_QUERIES = ["rate_fixed_window", "stream_window_counts", "stream_ingest", "window_scan", "text_search_one", "papers_page", "sentence_split"]


@pytest.mark.parametrize("name", FOLDER_QUERIES)
def test_tables_kept_as_folders(spark, tmp_path_factory, name):
    """Every table in four part files gives the same rows as in one file."""
    one = "/root/testdata/sf0.001"
    many = tmp_path_factory.getbasetemp() / "folders"
    if not many.exists():
        for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
            spark.read.parquet(f"{one}/{t}.parquet").repartition(4).write.parquet(str(many / f"{t}.parquet"))
    got, want = (contract.queries()[name](spark, str(f)) for f in (many, one))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
