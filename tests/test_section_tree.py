"""Trees of sections against a plain recursion: levels, order, exclusion, sums, rings and orphans."""

import random

from paperloom.operators import chunking, section_tree
from paperloom.settings import ChunkSettings

SCHEMA = "paper_id string, section_id int, parent_id int, position int, title string, paragraphs array<string>, path string"


def walk(rows, doc):
    """Section id to (level, dropped, sections below and itself, excluded of these), in reading order."""
    own = {r[1]: r for r in rows if r[0] == doc}
    children = {}
    for r in own.values():
        children.setdefault(r[2] if r[2] in own else None, []).append(r)
    found = {}

    def visit(row, level, dropped):
        excluded = row[4] == "References"
        found[row[1]] = None
        below = [visit(c, level + 1, dropped or excluded) for c in sorted(children.get(row[1], []), key=lambda c: (c[3], c[1]))]
        sums = (1 + sum(b[0] for b in below), excluded + sum(b[1] for b in below))
        found[row[1]] = (level, dropped or excluded, *sums)
        return sums

    for top in sorted(children.get(None, []), key=lambda c: (c[3], c[1])):
        visit(top, 1, False)
    return found


def forest(seed, sizes):
    rng, rows = random.Random(seed), []
    for doc, size in sizes.items():
        ids = rng.sample(range(1000), size)
        for i, section in enumerate(ids):
            parent = rng.choice([None, 5000, *ids[:i]]) if rng.random() < 0.2 or i == 0 else rng.choice(ids[max(0, i - 3):i])
            title = rng.choice(["References", "Method", "Results", None, "Data", "Proof"])
            rows.append((doc, section, parent, rng.randint(0, 3), title, [f"{doc} {section} text"], "kept"))
    rng.shuffle(rows)
    return rows


def test_forest_equals_recursion(spark):
    rows = forest(3, {"a": 120, "b": 1, "c": 37})
    tree = section_tree.resolve_tree(spark.createDataFrame(rows, SCHEMA).drop("path"))
    got = {(r["paper_id"], r["section_id"]): (r["level"], r["dropped"], r["subtree_sections"], r["subtree_excluded"]) for r in tree.collect()}
    expected = {(d, s): v for d in "abc" for s, v in walk(rows, d).items()}
    assert got == expected and max(v[0] for v in got.values()) > 16

    stats = {r["paper_id"]: (r["total_sections"], r["excluded_sections"]) for r in section_tree.document_stats(tree).collect()}
    assert stats == {d: (sum(r[0] == d for r in rows), sum(r[0] == d and r[4] == "References" for r in rows)) for d in "abc"}

    kept = {d: [s for s, v in walk(rows, d).items() if not v[1]] for d in "abc"}
    places = {(r["paper_id"], r["section_id"]): r["place"] for r in section_tree.outline(tree).collect()}
    assert places == {(d, s): i + 1 for d in "abc" for i, s in enumerate(kept[d])}

    nested = section_tree.nested_documents(tree)
    texts = {r["paper_id"]: [p for s in r["sections"] for p in s["paragraphs"]] for r in nested.collect()}
    assert texts == {d: [f"{d} {s} text" for s in kept[d]] for d in "abc" if kept[d]}
    chunks = chunking.chunk_documents(nested, ChunkSettings(min_tokens=1))
    ordered = {}
    for r in chunks.orderBy("paper_id", "chunk_index").collect():
        ordered.setdefault(r["paper_id"], []).append(r["content"])
    assert ordered == texts


def test_deep_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    doubled = section_tree._doubled
    monkeypatch.setattr(section_tree, "_doubled", lambda state: rounds.append(1) or doubled(state))
    rows = [("a", i, i - 1 if i else None, 0, "References" if i == 30 else "Method", None, "x") for i in range(40)]
    tree = section_tree.resolve_tree(spark.createDataFrame(rows, SCHEMA).drop("path"))
    got = {r["section_id"]: (r["level"], r["dropped"], r["subtree_sections"]) for r in tree.collect()}
    assert got == {i: (i + 1, i >= 30, 40 - i) for i in range(40)} and len(rounds) == 6


def test_rings_orphans_nulls_and_empty(spark):
    rows = [
        ("a", 1, 2, 0, "References", None, "x"), ("a", 2, 1, 0, "Method", None, "x"), ("a", 3, 2, 0, "Method", None, "x"),
        ("a", 4, 4, 0, None, None, "x"), ("a", 5, 99, None, "Method", None, "x"), ("a", 6, 5, None, "Method", None, "x"),
        ("b", 6, 5, 0, "Method", None, "x"), (None, 7, None, 0, "Method", None, "x"), ("a", None, 1, 0, "Method", None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).drop("path")
    got = {(r["paper_id"], r["section_id"]): (r["level"], r["dropped"], r["subtree_sections"]) for r in section_tree.resolve_tree(df).collect()}
    assert got == {
        ("a", 1): (None, True, None), ("a", 2): (None, True, None), ("a", 3): (None, True, None), ("a", 4): (None, False, None),
        ("a", 5): (1, False, 2), ("a", 6): (2, False, 1), ("b", 6): (1, False, 1),
    }
    assert section_tree.resolve_tree(df.limit(0)).count() == 0


def test_small_documents_are_walked_and_large_ones_doubled(spark, monkeypatch):
    """Same rows as by doubling, whatever a batch holds; without a large document there is not one round."""
    rows = forest(4, {"a": 60, "b": 1, "c": 25}) + [
        ("r", 1, 2, 0, "References", None, "x"), ("r", 2, 1, 0, "Method", None, "x"), ("r", 3, 2, 0, "Method", None, "x"), ("r", 4, 4, 0, None, None, "x"),
        ("r", 5, 99, None, "Method", None, "x"), ("r", 6, 5, None, "Method", None, "x"), (None, 7, None, 0, "Method", None, "x"), ("r", None, 1, 0, "Method", None, "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).drop("path")
    columns = ["paper_id", "section_id", "level", "preorder", "dropped", "subtree_sections", "subtree_excluded"]
    found = lambda tree: {r[:2]: r[2:] for r in map(tuple, tree.select(columns).collect())}
    want = found(section_tree.resolve_tree(df))
    rounds = []
    doubled = section_tree._doubled
    monkeypatch.setattr(section_tree, "_doubled", lambda state: rounds.append(1) or doubled(state))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert found(section_tree.resolve_documents(df)) == want and len(want) == 92 and not rounds
    assert found(section_tree.resolve_documents(df, whole=25)) == want and rounds
    tree = section_tree.resolve_documents(df)
    places = lambda tree: sorted((r["paper_id"], r["section_id"], r["place"]) for r in section_tree.outline(tree).collect())
    assert places(tree) == places(section_tree.resolve_tree(df))
    assert section_tree.resolve_documents(df.limit(0)).count() == 0
