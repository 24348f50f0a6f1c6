"""Alignment of the tokens of two tokenizers over the same texts, with corpus-wide counts of linked ids.

Two passes.  The first aligns every text and leaves, per task, how often each id pair is linked.
The distinct pairs get a minimal perfect hash, built in shards; every task's counts become dense
vectors indexed by it, which are summed in a tree.  The second pass aligns the texts again and
looks the counts up; the pair stored in a slot is compared, so no pair takes another one's count.

Only the most frequent pairs travel to the tasks, at most ``lookup``; links of the others, rare
by choice, are joined by shuffle.  No row is dropped on either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm import perfect_hash
from paperloom.llm.batches import append_columns, text_bytes
from paperloom.llm.tokens import BATCH_ROWS, batches_of, byte_tokenizer, distinct_stretches, expand, once, row_offsets, starts_of, stretches
from paperloom.session import cut_lineage

SHARD_PAIRS = 1 << 18  # pairs of one perfect hash, and numbers of one dense vector
VECTOR_ROWS = 1 << 20  # task counts added into one vector before the tree
FAN_IN = 16
LOOKUP_PAIRS = 2_000_000
TASK_PAIRS = 1 << 22  # pairs a task holds before it hands them on

LOW = (1 << 32) - 1

SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Aligner:
    """Both tokenizers, inside a task.  A is byte-level; B is a sentence-piece model, which puts a space before a text."""

    def __init__(self, byte_spec: str, piece_model: bytes) -> None:
        import sentencepiece

        self.a = byte_tokenizer(byte_spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        ids = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in ids]
        spelled = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]
        self.table = pa.array(spelled, pa.large_binary())
        self.size = np.array([len(p) for p in spelled], np.int64)
        # Where a piece held a space after another character, merges could cross a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        numbers = [f"{i}{c}".encode() for i in range(len(self.a.table)) for c in ",|"] + [f"{i}{c}".encode() for i in ids for c in ",;"]
        self.spelled = pa.array(numbers, pa.large_binary())
        self.base = 2 * len(self.a.table)


def aligner(byte_spec: str, piece_model: bytes) -> Aligner:
    return once(("align", hash(byte_spec), hash(piece_model)), lambda: Aligner(byte_spec, piece_model))


def same_bytes(table: pa.Array, ids: np.ndarray, count: np.ndarray, size: np.ndarray, texts: pa.Array) -> np.ndarray:
    """For each stretch, whether its tokens spell it."""
    ends = row_offsets(count)
    want = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    good = np.diff(row_offsets(size[ids])[ends]) == want
    chosen = ids[np.repeat(good, count)]
    made, _ = text_bytes(table.take(pa.array(chosen)))
    data, offsets = text_bytes(texts.filter(pa.array(good)))
    good[np.flatnonzero(good)] = np.diff(row_offsets(made != data)[offsets]) == 0
    return good


class Links:
    """The aligned stretches of a slice of texts; an invalid row has none."""

    def __init__(self, tools: Aligner, data: np.ndarray, offsets: np.ndarray) -> None:
        filled = offsets[1:] > offsets[:-1]
        joined = np.insert(data, offsets[:-1][filled], 32)
        shifted = offsets + row_offsets(filled)
        if tools.cuts:
            bounds, per_row = stretches(joined, shifted, spaces_only=True)
        else:
            bounds, per_row = np.append(shifted[:-1][filled], len(joined)), filled.astype(np.int64)
        index, different = distinct_stretches(joined, bounds)
        texts = different.cast(pa.large_string()).to_pylist()
        a, n_a = tools.a.encode_stretches(different)
        pieces = tools.b.encode([t[1:] for t in texts], num_threads=1) if texts else []
        n_b = np.fromiter(map(len, pieces), np.int64, len(pieces))
        b = np.fromiter((i for p in pieces for i in p), np.int64, int(n_b.sum()))
        good = same_bytes(tools.a.table, a, n_a, tools.a.size, different) & same_bytes(tools.table, b, n_b, tools.size, different)
        # A row counts only if all of it is spelled alike; stretches that no such row has drop out.
        valid = filled & (np.diff(row_offsets(~good[index])[row_offsets(per_row)]) == 0)
        self.index, self.per_row = index[np.repeat(valid, per_row)], np.where(valid, per_row, 0)
        self.weight = np.bincount(self.index, minlength=len(texts))
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)

        ends_a, ends_b = np.cumsum(tools.a.size[a]), np.cumsum(tools.size[b])
        mark = np.zeros((int(ends_a[-1]) if len(ends_a) else 0) + 1, np.uint8)
        mark[ends_a] |= 1
        mark[ends_b] |= 2
        at = np.flatnonzero(mark)
        is_a, is_b = mark[at] & 1, mark[at] >> 1
        both = row_offsets(is_a & is_b)
        self.keys = (a[np.cumsum(is_a, dtype=np.int64) - is_a] << 32) | b[np.cumsum(is_b, dtype=np.int64) - is_b]
        stops = np.searchsorted(at, np.cumsum(np.where(good, pc.binary_length(different).to_numpy(zero_copy_only=False), 0)), side="right")
        self.n_links = np.diff(stops, prepend=0)
        self.counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(both[stops], prepend=0), "n_links": self.n_links}
        self.tokens = (a, b, np.flatnonzero(is_a), np.flatnonzero(is_b), both, n_a + n_b)
        self.tools = tools

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs of all valid rows and how often each is linked."""
        keys, where = np.unique(self.keys, return_inverse=True)
        n = np.bincount(where, np.repeat(self.weight, self.n_links), len(keys)).astype(np.int64)
        return keys[n > 0], n[n > 0]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of a number per stretch."""
        return np.diff(row_offsets(values[self.index])[row_offsets(self.per_row)])

    def per_stretch(self, values: np.ndarray) -> np.ndarray:
        return np.diff(row_offsets(values)[row_offsets(self.n_links)])

    def groups(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` of every row."""
        a, b, at_a, at_b, both, count = self.tokens
        group_a, group_b = both[at_a], both[at_b]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = 2 * a + (both[at_a + 1] - group_a)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")] = self.tools.base + 2 * b + (both[at_b + 1] - group_b)
        data, offsets = text_bytes(self.tools.spelled.take(pa.array(order)))
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(np.ascontiguousarray(offsets[row_offsets(count)])), pa.py_buffer(np.ascontiguousarray(data))])
        whole, ends = text_bytes(each.take(pa.array(self.index)))
        rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.per_row), [None, pa.py_buffer(np.ascontiguousarray(ends[row_offsets(self.per_row)])), pa.py_buffer(np.ascontiguousarray(whole))])
        return pc.binary_slice(rows.cast(pa.binary()), 0, -1).cast(pa.string())

    def repeated(self, chosen: np.ndarray) -> pa.Array:
        """The chosen links' keys of every row, as often as they are linked."""
        kept, keys = self.per_stretch(chosen), self.keys[chosen]
        out = keys[expand(starts_of(kept)[self.index], kept[self.index])]
        return pa.ListArray.from_arrays(pa.array(row_offsets(self.per_text(kept)), pa.int32()), pa.array(out, pa.int64()))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, where, np.concatenate([c for _, c in parts]))
    return keys, n


def task_counts(df: DataFrame, text: str, byte_spec: str, piece_model: bytes) -> DataFrame:
    """First pass: ``task, key, n`` of the pairs each task links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, task, held = aligner(byte_spec, piece_model), TaskContext.get().partitionId(), []

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = merged(held)
            for at in range(0, len(keys), 1 << 16):
                k, c = keys[at:at + (1 << 16)], n[at:at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), task, np.int64)), pa.array(k), pa.array(c)], names=["task", "key", "n"])

        for batch in batches:
            for data, offsets in batches_of(batch.column(0)):
                held.append(Links(tools, data, offsets).pairs())
                if sum(len(k) for k, _ in held) > TASK_PAIRS:
                    held = [merged(held)]
                    if len(held[0][0]) > TASK_PAIRS // 2:
                        yield from out()
                        held = []
        if held:
            yield from out()

    return df.select(df[f"`{text}`"].alias("text")).mapInArrow(run, "task long, key long, n long")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(key, 32) * F.lit(40_503) + key.bitwiseAND(F.lit(LOW)), F.lit(shards)).cast("int")


def hash_shards(keys: DataFrame) -> DataFrame:
    """``shard, levels, keys``: a perfect hash per shard of distinct keys, and the keys in the order of their slots."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["key"].to_numpy()
        levels = perfect_hash.build(own.astype(np.uint64))
        at = np.empty(len(own), np.int64)
        at[perfect_hash.Slots(levels).of(own.astype(np.uint64))] = own
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "levels": [perfect_hash.pack(levels)], "keys": [at.tobytes()]})

    return keys.groupBy("shard").applyInPandas(build, "shard int, levels binary, keys binary")


def dense_counts(counts: DataFrame, hashes: DataFrame, parts: int) -> DataFrame:
    """``shard, counts``: one dense vector a shard, its tasks' vectors summed in a tree of fan-in ``FAN_IN``."""

    def add(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, keys = right.iloc[0], left["key"].to_numpy()
        at, stored = perfect_hash.Slots(perfect_hash.unpack(row["levels"])).of(keys.astype(np.uint64)), np.frombuffer(row["keys"], np.int64)
        if not ((at >= 0).all() and (stored[at] == keys).all()):
            raise ValueError("a pair is missing from its perfect hash")
        vector = np.zeros(len(stored), np.int64)
        np.add.at(vector, at, left["n"].to_numpy())
        return pd.DataFrame({"shard": [row["shard"]], "part": [row["part"]], "counts": [vector.tobytes()]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        vector = sum(np.frombuffer(v, np.int64) for v in rows["counts"])
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "part": [rows["part"].iloc[0]], "counts": [vector.tobytes()]})

    left = counts.withColumn("part", F.pmod("task", F.lit(parts)).cast("int")).groupBy("shard", "part")
    right = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).groupBy("shard", "part")
    vectors = left.cogroup(right).applyInPandas(add, "shard int, part int, counts binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        vectors = vectors.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("shard", "part").applyInPandas(total, "shard int, part int, counts binary")
    return vectors.select("shard", "counts")


def pair_counts(tasks: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``key, count, best`` of every pair, the perfect hashes of the shards and the number of shards."""
    size = tasks.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("key").alias("pairs")).first()
    shards = 1 + int(1.1 * size["pairs"]) // SHARD_PAIRS
    parts = 1 + size["rows"] // (shards * VECTOR_ROWS)
    counts = tasks.withColumn("shard", shard_of(F.col("key"), shards))
    hashes = cut_lineage(hash_shards(counts.select("shard", "key").distinct()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, values = np.frombuffer(keys, np.int64), np.frombuffer(values, np.int64)
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at:at + (1 << 16)]), pa.array(values[at:at + (1 << 16)])], names=["key", "count"])

    table = hashes.join(dense_counts(counts, hashes, parts), "shard").select("keys", "counts").mapInArrow(rows, "key long, count long")
    table = cut_lineage(table.withColumn("b", F.col("key").bitwiseAND(F.lit(LOW))))
    most = table.groupBy("b").agg(F.max("count").alias("most"))  # a row per id of B: its vocabulary bounds the broadcast
    return table.join(F.broadcast(most), "b").select("key", "count", (F.col("count") == F.col("most")).alias("best")), hashes, shards


class Lookup:
    """Counts of the pairs that travel to the tasks, by shard, slot and verified key."""

    def __init__(self, shards: int, hashes: list, pairs: pd.DataFrame) -> None:
        self.shards = shards
        order = np.argsort(pairs["key"].to_numpy())
        key, count, best = (pairs[c].to_numpy()[order] for c in ("key", "count", "best"))
        self.parts = {}
        for row in hashes:
            stored = np.frombuffer(row["keys"], np.int64)
            at = np.searchsorted(key, stored)
            self.parts[row["shard"]] = (row["levels"], stored, count[at], best[at])

    def slots(self) -> dict[int, perfect_hash.Slots]:
        return {shard: perfect_hash.Slots(perfect_hash.unpack(part[0])) for shard, part in self.parts.items()}

    def of(self, slots: dict[int, perfect_hash.Slots], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is stored, its count and whether that is the highest of its B id."""
        found, count, best = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        shard = ((keys >> 32) * 40_503 + (keys & LOW)) % self.shards
        for s, (_, stored, counts, bests) in self.parts.items():
            own = np.flatnonzero(shard == s)
            at = slots[s].of(keys[own].astype(np.uint64))
            own, at = own[at >= 0], at[at >= 0]
            same = stored[at] == keys[own]
            own, at = own[same], at[same]
            found[own], count[own], best[own] = True, counts[at], bests[at]
        return found, count, best


def build_lookup(pairs: DataFrame, hashes: DataFrame, shards: int, limit: int) -> tuple[Lookup, bool]:
    """The pairs to broadcast, ``limit`` at most, and whether these are all."""
    sizes = pairs.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).count().collect()  # 63 rows at most
    total = sum(r["count"] for r in sizes)
    if total <= limit:
        return Lookup(shards, hashes.collect(), pairs.toPandas()), True
    kept, least = 0, 63
    for row in sorted(sizes, key=lambda r: -r["power"]):
        if kept + row["count"] > limit:
            break
        kept, least = kept + row["count"], row["power"]
    frequent = pairs.where(F.col("count") >= F.lit(2**least if least < 63 else 2**63 - 1))
    shards = 1 + kept // SHARD_PAIRS
    return Lookup(shards, hash_shards(frequent.select(shard_of(F.col("key"), shards).alias("shard"), "key")).collect(), frequent.toPandas()), False


def align(
    df: DataFrame, byte_spec: str, piece_model: bytes, text: str = "text", lookup: int = LOOKUP_PAIRS, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the aligned groups of every whole text and the sums of its links.

    ``byte_spec`` is the JSON of a byte-level tokenizer (A), which reads a space and the text;
    ``piece_model`` a serialised sentence-piece model (B), which adds that space itself.  New columns:
    ``groups`` (``a1,a2|b1;a3|b2,b3``), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``
    (links whose corpus-wide count is the highest of their B id, ties included) and ``count_sum``.

    Null and empty texts, and texts the tokens of A or B do not spell, have zeros, no groups and no
    share in the counts.  Repeated rows count as often as they occur.  An empty table stays empty.
    Other columns pass; one that has the name of a new column is replaced.
    """
    spark = df.sparkSession
    pairs, hashes, shards = pair_counts(cut_lineage(task_counts(df, text, byte_spec, piece_model)))
    pairs = cut_lineage(pairs)
    table, complete = build_lookup(pairs, hashes, shards, lookup)
    sent = spark.sparkContext.broadcast(table)
    fields = [T.StructField(c, T.LongType(), False) for c in SUMS] + [T.StructField("groups", T.StringType(), False)]
    if not complete:
        fields.append(T.StructField("__rare", T.ArrayType(T.LongType(), False), False))

    def prepare() -> Callable[[pa.Array], list[pa.Array]]:
        tools, counts = aligner(byte_spec, piece_model), sent.value
        slots = counts.slots()

        def compute(column: pa.Array) -> list[pa.Array]:
            parts: list[list[pa.Array]] = [[] for _ in fields]
            for data, offsets in batches_of(column):
                links = Links(tools, data, offsets)
                found, count, best = counts.of(slots, links.keys)
                numbers = {**links.counts, "n_best": links.per_stretch(best), "count_sum": links.per_stretch(count)}
                made = [pa.array(links.per_text(numbers[c])) for c in SUMS] + [links.groups()]
                if not complete:
                    made.append(links.repeated(~found))
                for part, column_part in zip(parts, made):
                    part.append(column_part)
            kinds = [pa.int64()] * len(SUMS) + [pa.string()] + [pa.list_(pa.int64())] * (not complete)
            return [pa.concat_arrays(p) if p else pa.array([], kind) for p, kind in zip(parts, kinds)]

        return compute

    out = append_columns(df, text, fields, prepare, keep=keep, part_rows=BATCH_ROWS)
    if complete:
        return out
    names = [c for c in out.columns if c != "__rare"]
    out = cut_lineage(out).withColumn("__row", F.monotonically_increasing_id())  # stable: read from the checkpoint
    rare = out.select("__row", F.explode("__rare").alias("key")).groupBy("__row", "key").agg(F.count(F.lit(1)).alias("times"))
    added = rare.join(pairs, "key").groupBy("__row").agg(
        F.sum(F.col("count") * F.col("times")).alias("__count"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best")
    )
    more = {"count_sum": "__count", "n_best": "__best"}
    return out.join(added, "__row", "left").select(
        *[(F.col(f"`{c}`") + F.coalesce(F.col(more[c]), F.lit(0))).alias(c) if c in more else F.col(f"`{c}`") for c in names]
    )
