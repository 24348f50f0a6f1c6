"""Byte-pair counting against a naive encoder, and chunks sized by it."""

import base64

import pytest
import public_tokenizers
import regex
from pyspark.sql import functions as F

from paperloom.functions.tokens import BYTE_LEVEL_PATTERN, BytePairTokens
from paperloom.operators import chunking
from paperloom.plans import catalog
from paperloom.settings import ChunkSettings

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "the cat  sat\n\non it's mat", "Überraschung, naïve 中文 😀!", "  lead and trail  ", "3.14159 and 2024", "<|endoftext|>", "ab" * 200, "x"]


def naive(text):
    """Merge the neighbours of lowest rank, one pair after the other."""
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = []
    for piece in regex.findall(BYTE_LEVEL_PATTERN, text or ""):
        parts = [bytes([b]) for b in piece.encode()]
        while True:
            pairs = [(ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)]
            rank, i = min(pairs, default=(1 << 30, 0))
            if rank == 1 << 30:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        out += parts
    return out


def test_count_head_and_tail_equal_a_naive_encoder(spark):
    tokens = BytePairTokens(PATH)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    text = F.col("text")
    got = df.select("i", tokens.count(text).alias("n"), tokens.head(text, 4).alias("head"), tokens.tail(text, 3).alias("tail"), tokens.tail(text, 0).alias("none"))
    for r in got.collect():
        want = naive(TEXTS[r["i"]])
        assert r["n"] == len(want)
        assert r["head"] == b"".join(want[:4]).decode("utf-8", "replace")
        assert r["tail"] == (b"".join(want[-3:]).decode("utf-8", "replace") if len(want) > 3 else TEXTS[r["i"]] or "")
        assert r["none"] == ""


SCHEMA = "paper_id string, abstract string, sections array<struct<title:string,paragraphs:array<string>>>, equations array<struct<text_description:string,context_before:string,context_after:string>>"


def test_chunks_hold_at_most_their_tokens(spark):
    settings = ChunkSettings(max_tokens=60, overlap_tokens=12, min_tokens=10)
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    data = [
        ("packed", "tiny", [("A", [words(12, "alpha"), words(12, "beta"), words(12, "gamma")])], []),
        ("cut", "an abstract of rather more than ten tokens, all told, I think", [("A", [words(80, "word")])], []),
        ("sentences", None, [("A", [" ".join(words(6, f"s{j}x") + " end." for j in range(9))])], [("an equation about things of some length and also some weight", None, None)]),
        ("bare", None, None, None),
    ]
    out = chunking.chunk_documents(spark.createDataFrame(data, SCHEMA), settings, count=BytePairTokens(PATH)).collect()
    by = {}
    for r in out:
        by.setdefault(r["paper_id"], []).append(r)
        assert r["token_count"] == len(naive(r["content"]))
    assert set(by) == {"packed", "cut", "sentences"}
    assert [c["chunk_type"] for c in by["cut"]] == ["abstract", "text"] and by["cut"][1]["token_count"] == 60 and by["cut"][1]["form"] == "truncated"
    assert {c["form"] for c in by["sentences"] if c["chunk_type"] == "text"} == {"sentences"} and by["sentences"][-1]["chunk_type"] == "equation"
    assert all(c["chunk_type"] != "abstract" for c in by["packed"]) and len(by["packed"]) > 1
    first = by["packed"][0]["content"].encode()
    overlap = by["packed"][1]["content"].split("\n\n")[0]
    assert first.endswith(overlap.encode()) and len(naive(overlap)) <= 13


@pytest.mark.parametrize("name", ["bpe_tokens", "bpe_chunks"])
def test_queries_read_whole_tables(spark, name):
    out = catalog.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    if name == "bpe_tokens":
        sizes = dict(zip(out["doc_id"], out["n_tokens"]))
        assert len(sizes) == len(docs)
        for doc, text in zip(docs["doc_id"][:3], docs["text"][:3]):
            assert sizes[doc] == len(naive(text))
    else:
        assert (out["token_count"] > 0).all() and (out["token_count"] <= 600).all()


def test_ends_are_count_head_and_tail_in_pieces_of_few_texts(spark, monkeypatch):
    """One encoding gives all three, and a task never turns a whole batch into Python objects."""
    from paperloom import kernels

    tokens, text = BytePairTokens(PATH), F.col("text")
    df = spark.createDataFrame(list(enumerate(TEXTS * 30)), "i int, text string").repartition(1)
    got = df.select("i", tokens.ends(text, 4, 3).alias("e"), tokens.count(text).alias("n"), tokens.head(text, 4).alias("head"), tokens.tail(text, 3).alias("tail")).collect()
    assert len(got) == len(TEXTS) * 30 and all(tuple(r["e"]) == (r["n"], r["head"], r["tail"]) for r in got)
    seen = []
    monkeypatch.setattr(kernels, "RankTokens", lambda *_: None)
    work = kernels.token_udf(b"", "", lambda _, value: seen.append(value) or 1, "int").func
    import pyarrow as pa

    stream = work(iter([pa.array(["x"] * 1000)]))
    assert len(next(stream)) == len(seen) == kernels.PIECE_TEXTS and sum(len(p) for p in stream) == 1000 - kernels.PIECE_TEXTS
