"""The trigram set-similarity join against scores of all pairs."""

import random
from collections import Counter

import pytest

from paperloom.operators import search


def grams(text):
    padded = f"  {text.lower()} "
    return {padded[i:i + 3] for i in range(len(padded) - 2)}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_join_equals_the_scan(spark, threshold):
    rnd = random.Random(3)
    words = ["red", "blue", "bold", "sea", "seaside", "green", "grün", "navy"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 5)))) for i in range(150)] + [(150, None), (151, ""), (152, "Red BLUE"), (153, "zq" * 40)]
    asked = [(i, t) for i, t in docs[::7]] + [(900, None), (901, "red blue"), (902, "")]
    got = search.trigram_join(spark.createDataFrame(docs, "chunk_id int, content string"), spark.createDataFrame(asked, "query_id int, query string"), threshold)
    want = {}
    for q, a in asked:
        for d, b in docs:
            if a is not None and b is not None:
                score = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 10)
                if score >= threshold:
                    want[q, d] = score
    rows = got.collect()
    assert len(rows) == len(want) and {(r["query_id"], r["chunk_id"]): r["score"] for r in rows} == want


def test_common_grams_join_nothing(spark):
    """Every text shares its beginning; only what sets texts apart is looked up."""
    docs = spark.createDataFrame([(i, f"common beginning of all names {i * 7919:06d}") for i in range(200)], "chunk_id int, content string")
    asked = docs.where("chunk_id < 3").selectExpr("chunk_id AS query_id", "content AS query")
    assert {(r["query_id"], r["chunk_id"]) for r in search.trigram_join(docs, asked, 0.95).collect()} == {(i, i) for i in range(3)}
    with pytest.raises(ValueError):
        search.trigram_join(docs, asked, 0.0)


def test_copies_are_members_and_no_pair_of_rows_is_lost(spark):
    """Three hundred copies of four names: rows grow with the parts, all pairs follow from classes and members."""
    names = ["red bold nut", "Red bold nut", "red bold bolt", "zinc", None]
    rows = [(i + 1, names[(i + 1) * 7 // 10 % 5]) for i in range(300)]
    parts = spark.createDataFrame(rows, "p_partkey long, p_name string")
    classes, members = search.text_classes(parts, parts["p_partkey"] % 20 == 0, id_col="p_partkey", text_col="p_name")
    owner = {r["id"]: r["class_id"] for r in members.collect()}
    pairs = search.trigram_join(classes, classes.where("asked"), 0.45, id_col="class_id", text_col="text", query_id="class_id", query_text="text").collect()
    assert len(owner) == 300 and len(pairs) <= 9 and all(owner[i] is None for i, n in rows if n is None)
    near = {(r["query_id"], r["chunk_id"]): r["score"] for r in pairs}
    got = {(q, d): near[owner[q], owner[d]] for q in owner if q % 20 == 0 for d in owner if (owner[q], owner[d]) in near}
    want = {}
    for q, a in rows:
        for d, b in rows:
            if q % 20 == 0 and a and b:
                score = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 10)
                if score >= 0.45:
                    want[q, d] = score
    assert got == want and len(want) > 1000


@pytest.mark.parametrize("sizes", [None, (4, 3)])
def test_the_query_has_a_row_for_each_pair_of_parts(spark, tmp_path, monkeypatch, sizes):
    """Also for copies of a name, keys that come twice, under one name or two, and keys or names that are null."""
    from paperloom.plans.search_queries import trigram_matches

    if sizes:
        monkeypatch.setattr(search, "BLOCK_IDS", sizes[0])
        monkeypatch.setattr(search, "PIECE_IDS", sizes[1])
    names = ["red bold nut", "Red bold nut", "red bold bolt", "zinc", None, ""]
    rows = [(i + 1, names[(i + 1) * 7 // 10 % 6]) for i in range(200)]
    rows += [(20, "red bold nut")] * 9 + [(20, "zinc"), (40, "red bold nuts"), (1, "zinc"), (1, "red bold")] + [(None, "zinc")] * 10 + [(None, None), (60, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    out = trigram_matches(spark, str(tmp_path))
    want = Counter()
    for q, a in rows:
        for d, b in rows:
            if q is not None and q % 20 == 0 and a is not None and b is not None:
                score = round(len(grams(a) & grams(b)) / len(grams(a) | grams(b)), 10)
                if score >= 0.45:
                    want[q, d, score] += 1
    assert out.columns == ["query_id", "p_partkey", "score"]
    assert Counter(map(tuple, out.collect())) == want and want.total() > 500
