"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns, byte_values, mix, range_hashes, slices, text_bytes
from paperloom.operators.ranking import global_rank
from paperloom.session import cut_lineage

BUCKETS = 1 << 14
BROADCAST_IDS = 1_000_000  # about so many ids (16 MB) are sent to the texts at once


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of letters and digits or of other visible signs, A-Z as a-z."""
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 48) & (data <= 57) | (data >= 128)
    kind = np.where(letter, 2, np.where(data > 32, 1, 0))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(border)
    starts, ends = at[:-1], at[1:]
    seen = kind[starts] > 0
    starts, ends = starts[seen], ends[seen]
    return range_hashes(byte_values(lower=True)[data], starts, ends), np.searchsorted(offsets, starts, side="right") - 1


def gram_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of rows, bucket and row of all one- and two-piece grams, slice by slice."""
    data, offsets = text_bytes(column)
    for i, j in slices(offsets):
        h, row = pieces(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        pair = row[1:] == row[:-1]
        two = mix(h[:-1] * np.uint64(31) + h[1:])[pair]
        yield j - i, (np.concatenate([h, two]) >> np.uint64(50)).astype(np.int64), np.concatenate([row, row[1:][pair]])


def gram_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in the whole column: added up in each task first, ``BUCKETS`` numbers at the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, bucket, _ in gram_rows(batch.column(0)):
                total += np.bincount(bucket, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    rows = df.select(df[f"`{text}`"].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out


def listed(docs: DataFrame, ids: DataFrame, key: str = "doc_id", most: int = BROADCAST_IDS) -> list[DataFrame]:
    """All rows of ``docs`` whose key is in ``ids``, in parts by the hash of the key.

    The ids are counted first; about ``most`` of them travel to the texts for each part, and the texts stay in place.
    """
    ids = cut_lineage(ids.select(ids[f"`{key}`"].alias(key)).distinct())
    n = max(1, -(-ids.count() // most))
    block = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(31)), F.lit(n))
    return [docs.where(block == i).join(F.broadcast(ids.where(block == i)), key, "left_semi") for i in range(n)]


def log_ratios(target: DataFrame | list[DataFrame], raw: DataFrame, text: str = "text", smooth: float = 1.0) -> np.ndarray:
    """``ln p_target - ln p_raw`` of every bucket, from all rows of both tables; the counts of the target's parts add up."""
    good = sum((gram_counts(part, text) for part in ([target] if isinstance(target, DataFrame) else target)), np.zeros(BUCKETS)) + smooth
    all_ = gram_counts(raw, text) + smooth
    return np.log(good / good.sum()) - np.log(all_ / all_.sum())


def weigh(df: DataFrame, ratios: np.ndarray, text: str = "text", out: str = "log_weight", keep: list[str] | None = None) -> DataFrame:
    """``df`` with the mean log ratio of the grams of each whole text; 0 for a null or empty text.  No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)

    def compute(column: pa.Array) -> list[pa.Array]:
        parts = [np.zeros(0)]
        for n, bucket, row in gram_rows(column):
            total = np.bincount(row, weights=shared.value[bucket], minlength=n)
            parts.append(total / np.maximum(np.bincount(row, minlength=n), 1))
        return [pa.array(np.concatenate(parts))]

    return append_columns(df, text, [T.StructField(out, T.DoubleType())], lambda: compute, keep)


def resample(docs: DataFrame, target: DataFrame | list[DataFrame], key: str = "doc_id", text: str = "text", share: float = 0.5, scale: float = 20.0, seed: int = 0) -> DataFrame:
    """Every document with its importance and whether the resample holds it.

    ``log_weight`` is the mean log ratio of the hashed n-gram models of ``target`` and of
    ``docs`` (all rows of both; ``target`` may come in parts), so long texts are not favoured for their length;
    ``score`` maps it to 0 to 1.  Each row draws a Gumbel number from its key and
    ``seed``; the ``share`` of rows with the largest ``scale * log_weight`` plus that
    number is a sample without replacement by importance, whose ranks are taken over
    range partitions.  Null or empty texts weigh 0; repeated rows and null keys are rows
    of their own; an empty target leaves chance alone; an empty table gives an empty one.
    """
    ratios = log_ratios(target, docs, text)
    rows = weigh(docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")), ratios, keep=["doc_id"])
    even = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("gumbel_key", F.lit(float(scale)) * F.col("log_weight") - F.log(-F.log(even)))
    ranked = global_rank(rows, [F.desc("gumbel_key"), F.asc_nulls_last("doc_id"), F.desc("log_weight")], "place")
    wanted = int(round(share * ranked.count()))
    return ranked.select("doc_id", "log_weight", (1.0 / (1.0 + F.exp(F.lit(-10.0) * F.col("log_weight")))).alias("score"), "gumbel_key", (F.col("place") <= wanted).alias("selected"))
