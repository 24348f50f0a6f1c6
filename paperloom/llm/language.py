"""Language identification: nearest clustered centroid of normalised TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns, text_bytes
from paperloom.operators.ranking import top_k_per_group
from paperloom.session import cut_lineage

BUCKETS = 1 << 14
UNKNOWN = "und"


def folded(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1), every other ASCII byte a space."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data)
    out = np.where((out < 128) & ((out < 97) | (out > 122)), 32, out)
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), out + 0x20, out).astype(np.uint32)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Hash bucket of the 1-, 2- and 3-byte grams of one text; runs of spaces count once."""
    b = folded(data)
    if len(b) > 1:
        b = b[~((b == 32) & np.concatenate([[False], b[:-1] == 32]))]
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(257) + b[2:]
    keys = np.concatenate([b + np.uint32(1 << 26), two + np.uint32(1 << 27), three])
    return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text and the damped counts ``1 + ln n`` in them."""
    data, offsets = text_bytes(column)
    for start, end in zip(offsets[:-1], offsets[1:]):
        count = np.bincount(gram_buckets(data[start:end]), minlength=BUCKETS)
        there = np.flatnonzero(count)
        yield there, 1.0 + np.log(count[there])


def weighted(there: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = tf * idf[there]
    norm = np.sqrt(v @ v)
    return v / norm if norm > 0 else v


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means: seeds are the mean and then whatever is farthest from all seeds."""
    def unit(m):
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    seeds = [rows.mean(axis=0)]
    while len(seeds) < min(k, len(rows)):
        near = (rows @ unit(np.array(seeds)).T).max(axis=1)
        seeds.append(rows[int(near.argmin())])
    centres = unit(np.array(seeds))
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.array([rows[own == c].mean(axis=0) for c in np.unique(own)]))
    return centres.astype(np.float32)


@dataclass(frozen=True)
class Centroids:
    """A fitted model: a language per row of ``centres``, inverse document frequencies, rejection distance."""

    langs: list[str]
    centres: np.ndarray
    idf: np.ndarray
    far: float


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: Column | None = None, per_lang: int = 600, clusters: int = 4, rounds: int = 6, quantile: float = 0.002) -> Centroids:
    """Learn centroids from at most ``per_lang`` texts of each language.

    The sample is bounded by ``per_lang`` and drawn by a hash of ``key`` (the text by
    default), so reruns agree; each language is clustered in a task of its own.  What
    reaches the driver is the model: ``clusters`` vectors of ``BUCKETS`` floats per
    language.  Rows with a null text or language are not learned from; a language
    without any row is unknown.  ``quantile`` sets the rejection distance: that share
    of the sample lies farther from its nearest centroid.
    """
    key = F.col(f"`{text}`") if key is None else key
    rows = labelled.select(labelled[f"`{lang}`"].alias("lang"), labelled[f"`{text}`"].alias("text"), F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 31)).alias("h"))
    rows = rows.where("lang IS NOT NULL")
    # One row per language: how far up the hashes four times the wanted texts are to be expected.
    reach = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * per_lang) / F.count(F.lit(1))).alias("reach"))
    near = rows.join(F.broadcast(cut_lineage(reach)), "lang").where(F.col("h") <= F.col("reach") * float(1 << 31)).where("text IS NOT NULL")
    sample = cut_lineage(top_k_per_group(near, ["lang"], per_lang, [F.col("h"), F.xxhash64("text")]).select("lang", "text"))
    n_sample = sample.count()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for there, _ in vectors(batch.column(0)):
                df[there] += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(df[there])], names=["bucket", "n"])

    counts = sample.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    idf = np.full(BUCKETS, np.log(1.0 + n_sample))
    idf[counts.bucket.to_numpy()] = np.log((1.0 + n_sample) / (1.0 + counts.n.to_numpy())) + 0.1

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros((len(pdf), BUCKETS), np.float32)
        for i, (there, tf) in enumerate(vectors(pa.array(pdf["text"]))):
            rows[i, there] = weighted(there, tf, idf)
        centres = cluster(rows, clusters, rounds)
        far = float(np.quantile(1.0 - (rows @ centres.T).max(axis=1), 1.0 - quantile))
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.tobytes() for c in centres], "far": far})

    model = sample.groupBy("lang").applyInPandas(centroids, "lang string, centre binary, far double").toPandas().sort_values(["lang", "centre"])
    centres = np.array([np.frombuffer(c, np.float32) for c in model.centre]).reshape(-1, BUCKETS)
    return Centroids(model.lang.tolist(), centres, idf, float(model.far.max()) if len(model) else 1.0)


def identify(df: DataFrame, model: Centroids, text: str = "text", temperature: float = 0.03, keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``lang_pred``, ``lang_nearest``, ``distance`` and ``score``, one row per row.

    ``lang_nearest`` is the language of the nearest centroid by cosine, ``lang_pred``
    the same unless its distance exceeds the model's rejection distance; then, and for
    a null text, an empty one or one without any letter, it is ``und`` (with a null
    nearest language and score 0 where there is no letter).  ``score`` is the softmax
    of the languages' best cosines.  Equal texts get equal answers; ties go to the
    language first by name; an empty model answers ``und``.  No shuffle; whole texts.
    """
    names = sorted(set(model.langs))
    owner = np.array([names.index(x) for x in model.langs], int)
    shared = df.sparkSession.sparkContext.broadcast((model.centres.T.copy(), model.idf, model.far))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_nearest", T.StringType()), T.StructField("distance", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def compute(column: pa.Array) -> list[pa.Array]:
        centres, idf, far = shared.value
        best = np.zeros((len(column), max(len(names), 1)))
        for i, (there, tf) in enumerate(vectors(column)):
            if names:
                cosine = weighted(there, tf, idf).astype(np.float32) @ centres[there]
                best[i] = [cosine[owner == x].max() for x in range(len(names))]
        top = best.argmax(axis=1)
        near = best[np.arange(len(best)), top]
        share = 1.0 / np.exp((best - near[:, None]) / temperature).sum(axis=1)
        nearest = [names[t] for t in top] if names else [None] * len(column)
        pred = [x if x is not None and 1.0 - n <= far else UNKNOWN for x, n in zip(nearest, near)]
        return [pa.array(pred, pa.string()), pa.array(nearest, pa.string()), pa.array(1.0 - near), pa.array(np.clip(share, 0.0, 1.0))]

    marked = df.withColumn("__letters", F.coalesce(df[f"`{text}`"].rlike(r"\p{L}"), F.lit(False)))
    kept = [*(df.columns if keep is None else keep), "__letters"]
    out = append_columns(marked, text, fields, lambda: compute, [c for c in kept if c not in {f.name for f in fields}])
    has = F.col("__letters")
    return out.withColumns({
        "lang_pred": F.when(has, F.col("lang_pred")).otherwise(F.lit(UNKNOWN)),
        "lang_nearest": F.when(has, F.col("lang_nearest")),
        "distance": F.when(has, F.col("distance")).otherwise(F.lit(1.0)),
        "score": F.when(has, F.col("score")).otherwise(F.lit(0.0)),
    }).drop("__letters")
