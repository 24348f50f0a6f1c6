"""Byte-level BPE and token alignment against the plain libraries, text by text."""

import base64
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paperloom.llm import align, perfect_hash, tokens
from tests.llm import rows

BYTE_JSON, PIECES = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def odd_texts():
    """Random strings of white space of all kinds, letters of several scripts, digits, signs and special strings."""
    parts = [
        " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "\u0085", "\x00", "▁", "é", "ß", "中文", "日", "ا", "😀", "👩‍🚀", "é", "x", "Word",
        "don't", "'s", "123", "3.14", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "...", "_", "ſ", "�", "a" * 50, "​", "½",
    ]
    pick = random.Random(7)
    texts = ["".join(pick.choices(parts, k=pick.randint(1, 25))) for _ in range(300)]
    return [*texts, None, "", " ", "  ", "\n", "x", "é ", "a ", "a  b", "a　 b", "▁", " " * 300, "words and so on " * 3000, "q" * 40_000]


@pytest.fixture(scope="module")
def spec():
    return tokens.from_ranks(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN)


@pytest.fixture(scope="module")
def byte_json():
    with open(BYTE_JSON, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def pieces():
    with open(PIECES, "rb") as f:
        return f.read()


def test_ids_bytes_and_spans_equal_the_rank_library(spark, spec):
    with open(vocabularies.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})
    byte_of = {i: b for b, i in ranks.items()}
    texts = odd_texts()
    coded = tokens.encode_bpe(rows.documents(spark, texts), spec, spans=tokens.SPANS)
    got = tokens.decode_bpe(coded, spec, text="back").collect()
    assert len(got) == len(texts)
    for row in got:
        text = row["text"] or ""
        ids = plain.encode_ordinary(text)
        assert row["ids"] == ids and bytes(row["decoded"]) == text.encode() and row["back"] == text
        at, owner = 0, [k for k, c in enumerate(text) for _ in c.encode()]
        begins = {sum(len(c.encode()) for c in text[:k]) for k in range(len(text) + 1)} if len(text) < 500 else None
        split = 0
        if begins is not None:
            for token, first, last in zip(ids, row["char_starts"], row["char_ends"]):
                end = at + len(byte_of[token])
                assert (first, last) == (owner[at], owner[end - 1] + 1)
                split += at not in begins or end not in begins
                at = end
            assert row["n_split"] == split


def test_part_of_a_list_keeps_its_bytes_and_marks_broken_characters(spark, spec):
    df = rows.documents(spark, ["😀 ok"])
    ids = tokens.encode_bpe(df, spec).first()["ids"]
    cut = spark.createDataFrame([(1, ids[1:]), (2, None), (3, []), (4, [None, -5, 10**6, *ids])], "k int, ids array<int>")
    got = {r["k"]: r for r in tokens.decode_bpe(cut, spec, text="back").collect()}
    whole = "😀 ok".encode()
    assert whole.endswith(bytes(got[1]["decoded"])) and "�" in got[1]["back"] and got[1]["back"].endswith(" ok")
    assert bytes(got[2]["decoded"]) == b"" == bytes(got[3]["decoded"]) and bytes(got[4]["decoded"]) == whole


def test_merges_of_the_ranks_are_those_of_the_vocabulary(spec):
    with open(BYTE_JSON, encoding="utf-8") as f:
        listed = json.load(f)["model"]["merges"]
    assert [tuple(m) for m in json.loads(spec)["model"]["merges"]] == [tuple(m.split(" ") if isinstance(m, str) else m) for m in listed]


def test_awkward_rows_and_empty_tables(spark, spec, byte_json, pieces):
    df = rows.awkward(spark)
    coded = tokens.decode_bpe(tokens.encode_bpe(df.withColumn("ids", F.lit("x")), spec), spec)
    assert coded.count() == df.count() and set(df.columns) <= set(coded.columns) and coded.where("decoded <> cast(coalesce(text, '') AS binary)").isEmpty()
    assert tokens.decode_bpe(tokens.encode_bpe(rows.empty(spark), spec, spans=tokens.SPANS), spec).isEmpty()
    linked = align.align(df.withColumn("n_a", F.lit("x")), byte_json, pieces)
    assert linked.count() == df.count() and set(df.columns) <= set(linked.columns)
    assert linked.where("text is null or text = ''").agg(F.sum("n_links"), F.max("groups")).first()[:] == (0, "")
    assert align.align(rows.empty(spark), byte_json, pieces).isEmpty()
    assert align.align(rows.documents(spark, [None, ""]), byte_json, pieces).agg(F.sum("n_a")).first()[0] == 0


def brute_alignment(texts):
    a, b = Tokenizer.from_file(BYTE_JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(tokens.byte_characters())}
    bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    made, counts = [], Counter()
    for text in texts:
        full = (" " + (text or "")).encode()
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in ids[0]) != full or b"".join(bytes_b[i] for i in ids[1]) != full:
            made.append(([], [], [], ""))
            continue
        owner = [[k for k, i in enumerate(side) for _ in table[i]] for side, table in zip(ids, (bytes_a, bytes_b))]
        occurrences = sorted(set(zip(*owner)))
        groups, left, right = [], 0, 0
        for at in range(1, len(full) + 1):
            if at == len(full) or (owner[0][at] > owner[0][at - 1] and owner[1][at] > owner[1][at - 1]):
                x, y = owner[0][at - 1] + 1, owner[1][at - 1] + 1
                groups.append(",".join(map(str, ids[0][left:x])) + "|" + ",".join(map(str, ids[1][right:y])))
                left, right = x, y
        links = [(ids[0][i], ids[1][j]) for i, j in occurrences]
        counts.update(links)
        made.append((*ids, links, ";".join(groups)))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return [
        (len(x), len(y), g.count(";") + bool(g), len(links), sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links), g)
        for x, y, links, g in made
    ]


@pytest.mark.parametrize("lookup", [2_000_000, 40, 0])
def test_alignment_equals_brute_force(spark, byte_json, pieces, monkeypatch, lookup):
    """All pairs sent to the tasks, only the most frequent ones, and none; with several shards and a tree of vectors."""
    monkeypatch.setattr(align, "SHARD_PAIRS", 100)
    monkeypatch.setattr(align, "VECTOR_ROWS", 20)
    monkeypatch.setattr(align, "FAN_IN", 2)
    texts = [t for t in odd_texts() if t is None or len(t) < 9_000] + ["the cat sat on the mat", "the cat sat on the mat", "words " * 900]
    want = brute_alignment(texts)
    assert any(w[0] == 0 for w, t in zip(want, texts) if t) and sum(w[0] > 0 for w in want) > 200
    out = align.align(rows.documents(spark, texts).repartition(6), byte_json, pieces, lookup=lookup)
    got = {r["doc_id"]: tuple(r[c] for c in (*align.SUMS, "groups")) for r in out.collect()}
    assert [got[k + 1] for k in range(len(texts))] == want


def test_perfect_hash_is_minimal_and_strangers_are_told_apart():
    for n in (0, 1, 2, 63, 20_000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 47, n).astype(np.uint64))
        slots = perfect_hash.Slots(perfect_hash.unpack(perfect_hash.pack(perfect_hash.build(keys))))
        assert slots.size == len(keys) and sorted(slots.of(keys)) == list(range(len(keys)))
        assert slots.of(np.arange(5, dtype=np.uint64)).max(initial=-1) < max(n, 1)
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([3, 3], np.uint64))
