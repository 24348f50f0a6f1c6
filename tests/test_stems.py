"""The suffix rules against published pairs of word and stem."""

from pyspark.sql import functions as F

from paperloom.functions.stems import stems
from paperloom.operators import search

PAIRS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consistency consist|consistently consist|consolation consol
consolations consol|consolatory consolatori|console consol|consolidating consolid|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirators conspir
constancy constanc|constantly constant|knack knack|knackeries knackeri|knavish knavish|kneaded knead|kneeling kneel|knightly knight|knots knot|knotted knot
running run|hopping hop|hoping hope|national nation|relational relat|conditional condit|generalization general|generate generat|general general|communication communic
happy happi|cries cri|ties tie|dying die|gas gas|this this|kiwis kiwi|sky sky|skies sky|enjoy enjoy|by by|agreed agre|luxuriated luxuri|hopefulness hope
formality formal|controll control|rational ration|adjustable adjust|defensible defens|adoption adopt|bowdlerize bowdler|probate probat|rate rate|cease ceas|roll roll
news news|proceed proceed|inning inning|outings outing|say say|youth youth|flying fli|sized size|falling fall|mapped map|triplicate triplic|electricity electr|bed bed|shed shed
using use|users user|as as|arsenal arsenal|analogies analog|possibly possibl|only onli|generously generous|apologists apologist|decisiveness decis|ab12 ab12|12 12"""


def test_stems_of_published_pairs(spark):
    pairs = [tuple(p.split()) for line in PAIRS.splitlines() for p in line.split("|")]
    df = spark.createDataFrame(pairs, "word string, stem string").select("word", "stem", F.array("word").alias("words"))
    wrong = [(r["word"], r["got"][0], r["stem"]) for r in df.select("word", "stem", stems("words").alias("got")).collect() if r["got"][0] != r["stem"]]
    assert not wrong


def test_forms_of_a_word_meet_and_stop_words_do_not_count(spark):
    docs = spark.createDataFrame([(1, ["the", "relations", "of", "nations"]), (2, ["relating", "a", "nation"]), (3, ["nation"]), (4, []), (5, None)], "chunk_id int, terms array<string>")
    asked = spark.createDataFrame([(9, ["the", "relation", "national"], [1.0] * 3)], "query_id int, terms array<string>, weights array<double>")
    got = search.text_search(search.stemmed(docs), search.stemmed(asked), 5).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(1, 1.0), (2, 1.0)]


def test_stems_of_a_corpus_equal_those_of_its_rows(spark, monkeypatch):
    """Words are stemmed once, not at each occurrence; counts are those of stemmed rows."""
    monkeypatch.setattr(search, "HOT_WORDS", 3)
    words = ["the", "relations", "relating", "nation", "nations", "skies", "sky", "dying", "die", "ab12", "running", "run"]
    docs = spark.createDataFrame([(i % 37, [words[(i * j) % 12] for j in range(i % 9)]) for i in range(60)] + [(90, None), (91, [])], "chunk_id int, terms array<string>")
    slow = search.stemmed(docs).select("chunk_id", F.explode("terms").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("docs"))
    assert {tuple(r) for r in search.stem_counts(docs).collect()} == {tuple(r) for r in slow.collect()}
    assert search.stem_counts(docs.limit(0)).isEmpty()


def test_a_search_stems_a_word_of_the_corpus_once(spark, monkeypatch):
    """The search gives the rows of stemmed texts, but no row's list of words is stemmed, only distinct words are."""
    words = ["the", "relations", "relating", "nation", "nations", "skies", "sky", "dying", "die", "ab12", "running", "run"]
    rows = [(i, [words[(i * j + i // 12) % 12] for j in range(i % 9)]) for i in range(60)] + [(90, None), (91, []), (92, ["the"])]
    docs = spark.createDataFrame(rows, "chunk_id int, terms array<string>")
    asked = [(1, ["relation", "the"]), (2, ["nation", "skies", "nations"]), (3, ["died", "gone"]), (4, ["the"]), (5, []), (6, ["runs"]), (6, ["dies"])]
    queries = spark.createDataFrame(asked, "query_id int, terms array<string>")
    want = {tuple(r) for r in search.text_search(search.stemmed(docs), search.stemmed(queries), 4).collect()}
    stemmed = search.stemmed
    monkeypatch.setattr(search, "stemmed", lambda df: stemmed(df) if "query_id" in df.columns else 1 / 0)
    assert want and {tuple(r) for r in search.stemmed_search(docs, queries, 4).collect()} == want
    monkeypatch.setattr(search, "_term_row_bytes", lambda queries: search.DEFAULTS.search.query_block_bytes // 2)  # two queries a block
    assert {tuple(r) for r in search.stemmed_search(docs, queries, 4).collect()} == want
    assert search.stemmed_search(docs.limit(0), queries, 4).isEmpty() and search.stemmed_search(docs, queries.limit(0), 4).isEmpty()


def test_stemmed_query_has_no_stem_of_a_row_in_its_plan(spark, tmp_path):
    from conftest import plan
    from paperloom.plans import catalog

    spark.createDataFrame([(i, "Relations of nations, relating running skies") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a relation runs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = catalog.queries()["text_search_stemmed"](spark, str(tmp_path))
    assert hits.count() == 9 and "ization" not in plan(hits)
