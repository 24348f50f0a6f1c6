"""Document fingerprints: minimum hashes over the Lempel-Ziv phrases of a text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns, mix, range_hashes

BINS = 128
EMPTY = np.uint32(0xFFFFFFFF)


def phrases(text: str, at: int = 0, seen: set[str] | None = None) -> tuple[list[int], list[int]]:
    """Borders of the LZ78 parse from ``at`` on: each phrase is the longest ``seen`` one and a character more.

    The set of phrases is closed under prefixes, so the longest known prefix is
    searched from the length of the last phrase up or down instead of from one.
    A rest that is a known phrase counts as a phrase again.
    """
    seen = set() if seen is None else seen
    starts, ends = [], []
    n, guess = len(text), 1
    while at < n:
        end = min(at + guess, n)
        if text[at:end] in seen:
            while end < n:
                end += 1
                if text[at:end] not in seen:
                    break
        else:
            while end - at > 1 and text[at:end - 1] not in seen:
                end -= 1
        seen.add(text[at:end])
        starts.append(at)
        ends.append(end)
        guess = max(1, end - at - 1)
        at = end
    return starts, ends


def phrase_hashes(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """A 64-bit hash of each phrase, whatever its place."""
    if not starts:
        return np.zeros(0, np.uint64)
    points = np.frombuffer(text[starts[0]:].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return range_hashes(mix(points + np.uint64(1)), np.array(starts) - starts[0], np.array(ends) - starts[0])


def minima(h: np.ndarray) -> np.ndarray | None:
    """One-permutation minimum hashes in ``BINS`` bins; None without phrases."""
    if not len(h):
        return None
    out = np.full(BINS, EMPTY)
    np.minimum.at(out, (h >> np.uint64(57)).astype(np.int64), (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    return out


def signature(text: str) -> np.ndarray | None:
    """The fingerprint of a text as numbers; None for an empty one."""
    return minima(phrase_hashes(text, *phrases(text)))


def extended(text: str, ends: list[int], h: np.ndarray, keep: int, rest: str) -> np.ndarray | None:
    """Signature of ``text[:keep] + rest``, from the parse of ``text``: what ends within ``keep`` is parsed alike."""
    known = bisect_right(ends, keep)
    at = ends[known - 1] if known else 0
    seen = {text[a:b] for a, b in zip([0, *ends[:known - 1]], ends[:known])} if known else set()
    changed = text[:keep] + rest
    starts, stops = phrases(changed, at, seen)
    return minima(np.concatenate([h[:known], phrase_hashes(changed, starts, stops)]))


def encoded(sig: np.ndarray | None) -> str:
    return "" if sig is None else sig.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard likeness of two phrase sets; two empty texts are alike, one empty is unlike."""
    if a is None or b is None:
        return float(a is None and b is None)
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum())


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the fingerprint of each whole text as a hex string, row by row.

    Equal texts have equal fingerprints; a null or empty text has the empty string;
    no shuffle.  A column already named ``out`` is replaced.
    """
    return append_columns(df, text, [T.StructField(out, T.StringType())], lambda: lambda c: [pa.array([encoded(signature(t or "")) for t in c.to_pylist()], pa.string())], keep)


def beside_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with the fingerprint of itself, of the next by descending ``key`` and of a half-replaced text.

    One shuffle of the texts: rows are dealt by ranges of the key, each range is sorted,
    and the first row of a range is copied to the range before it, so that no window
    spans the table.  After the last document comes the first; a single document is
    followed by itself.  Null keys come last, ties are ordered by text (null first);
    every row is returned once.  An empty table gives an empty one.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Borders of the ranges: as many numbers as partitions, whatever the rows.
    borders = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    borders = sorted(set(borders))
    slot = F.lit(1) if not borders else F.when(F.col("doc_id").isNull(), len(borders) + 1).otherwise(
        F.size(F.filter(F.array(*[F.lit(b) for b in borders]), lambda b: b >= F.col("doc_id")))
    )
    placed = rows.withColumn("slot", slot.cast("int"))
    # The first key of every range decides which row is copied to the range before; one narrow row per range.
    heads = sorted(((r["slot"], r["top"]) for r in placed.groupBy("slot").agg(F.max("doc_id").alias("top")).collect()), key=lambda x: x[0])
    schema = "slot int, top long, before int"
    leads = rows.sparkSession.createDataFrame([(s, top, heads[i - 1][0]) for i, (s, top) in enumerate(heads)], schema)
    copies = placed.join(F.broadcast(leads), "slot", "left").withColumn("to", F.explode(F.array_compact(F.array(
        F.struct(F.col("slot").alias("slot"), F.lit(False).alias("extra")),
        F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.struct(F.col("before").alias("slot"), F.lit(True).alias("extra"))),
    )))).select("to.slot", "to.extra", "doc_id", "text")
    dealt = copies.repartition(parts, "slot").sortWithinPartitions("slot", "extra", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(pairs, fields)


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole ranges to one output row per document; holds two rows at a time."""
    from hashlib import sha256

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None

    def record(now, after):
        _, doc, text, ends, h, sig = now
        half = len(text) // 2
        edited = text[:len(text) - half] + after[2][:half]
        changed = extended(text, ends, h, len(text) - half, after[2][:half])
        return doc, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(sig), encoded(changed), likeness(sig, changed), likeness(sig, after[-1])

    for batch in batches:
        made = []
        for slot, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            if extra and (held is None or held[0] != slot):
                continue  # a copied head that follows the first copy of its range
            text = text or ""
            starts, ends = phrases(text)
            h = phrase_hashes(text, starts, ends)
            now = (slot, doc, text, ends, h, minima(h))
            if held is not None and held[0] == slot:
                made.append(record(held, now))
            held = None if extra else now
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made) if made else [[]] * 7, kinds)], names=names)
