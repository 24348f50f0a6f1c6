"""Hard negatives by windows of exact integer scores, over blocks of vectors in Hilbert order.

Rows are ordered by label and Hilbert curve and written as Parquet rows of one block each, with
the least and greatest value of every dimension.  From these zone maps interval arithmetic bounds the
score of an anchor with any row of a block, so an anchor only reads blocks that can hold one of
its positives or a row of one of its windows.  Blocks that cannot be ruled out are all read.

Anchors travel in sets and blocks in runs; a task gets one run and one set.  Both have a
fixed greatest size, so neither a label nor a vector that many rows share grows a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import global_rank, top_k_per_group
from paperloom.session import cut_lineage, ensure_checkpoint_dir

BLOCK_ROWS = 512
LEAST_BLOCK = 64  # a block of fewer rows goes on into the next label
RUN_ROWS = (1024, 65_536)
SET_ROWS = (64, 16_384)
CURVE_BITS = 2
EXACT = 1 << 53


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder, read back; a retried task leaves one copy of its part."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/blocks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of ``cells`` (``bits`` bits per dimension) on the Hilbert curve, as bytes in curve order.

    The axes are turned level by level, from the highest bit down, and Gray-coded.
    """
    x = cells.astype(np.int64).copy()
    n, dims = x.shape
    if not dims:
        return [b""] * n
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            set_ = (x[:, i] & bit) != 0
            swap = np.where(set_, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=1)
    turn = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    planes = np.stack([(x >> level) & 1 for level in range(bits - 1, -1, -1)], axis=1).reshape(n, -1)
    return [row.tobytes() for row in np.packbits(planes.astype(np.uint8), axis=1)]


def taking_part(df: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: int) -> tuple[DataFrame, int]:
    """``key, label, anchor, v`` of the rows that take part, one per key, and the number of dimensions."""
    x = F.col(f"`{vector}`")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite).select(
        F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double")).alias("v"),
    )
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0
    most = min(2**31 - 1, int(((2**63 - 1) / max(dims, 1)) ** 0.5) - 1)  # scores then fit a long
    rows = rows.where(F.forall("v", lambda c: F.abs(c) <= F.lit(float(most)))).withColumn("v", F.transform("v", lambda c: c.cast("int")))
    one = F.min(F.struct("label", "v", "anchor")).alias("row")
    return rows.groupBy("key").agg(one).select("key", "row.label", "row.anchor", "row.v"), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch, shorter ones filled with zeros."""
    out = np.zeros((len(column), dims), np.int32)
    for i, v in enumerate(column):
        own = v.values.to_numpy(zero_copy_only=False) if v.is_valid else ()
        out[i, :len(own)] = own
    return out


def with_curve(rows: DataFrame, dims: int) -> DataFrame:
    """``key, label, anchor, curve, v`` with the vector as bytes of 32-bit integers."""
    low, high = rows.select(F.array_min("v").alias("a"), F.array_max("v").alias("b")).agg(F.least(F.min("a"), F.lit(0)), F.greatest(F.max("b"), F.lit(0))).first()
    step = (high - low) / 2**CURVE_BITS + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(3), dims)
            curve = hilbert_keys(np.minimum((v - float(low)) // step, 2**CURVE_BITS - 1), CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(curve, pa.binary()), pa.array([r.tobytes() for r in v], pa.binary())], names=["key", "label", "anchor", "curve", "v"]
            )

    return rows.mapInArrow(run, "key long, label long, anchor boolean, curve binary, v binary")


BLOCK_SCHEMA = "run int, block long, n int, first_label long, last_label long, low binary, high binary, keys binary, labels binary, anchors binary, vectors binary"


def packed(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """Blocks in order of label and curve; a partition of the order is a run."""
    order = ("label", "curve", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, names = TaskContext.get().partitionId(), 0, [f.split(" ")[0] for f in BLOCK_SCHEMA.split(", ")]
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            keys, labels, anchors, v = (np.concatenate(c) for c in zip(*held))
            row = [part, (part << 32) + made, len(keys), int(labels[0]), int(labels[-1]), v.min(axis=0, initial=2**31 - 1).tobytes(), v.max(axis=0, initial=-2**31).tobytes(),
                   keys.tobytes(), labels.tobytes(), anchors.tobytes(), v.tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            keys, labels, anchors = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            v = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).reshape(len(keys), dims)
            at = 0
            while at < len(keys):
                size = sum(len(h[0]) for h in held)
                if size >= BLOCK_ROWS or (size >= LEAST_BLOCK and held[-1][1][-1] != labels[at]):
                    yield out()
                    made, held, size = made + 1, [], 0
                change = np.flatnonzero(labels[at:] != labels[at])
                end = min(at + BLOCK_ROWS - size, at + int(change[0]) if len(change) else len(keys))
                held.append((keys[at:end], labels[at:end], anchors[at:end].astype(np.uint8), v[at:end]))
                at = end
        if held:
            yield out()

    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("key", "label", "anchor", "v").mapInArrow(run, BLOCK_SCHEMA)


def block_arrays(row: pd.Series | object, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, labels = np.frombuffer(row.keys_, np.int64), np.frombuffer(row.labels, np.int64)
    return keys, labels, np.frombuffer(row.anchors, np.uint8).astype(bool), np.frombuffer(row.vectors, np.int32).reshape(len(keys), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; in doubles where these hold every sum."""
    size = max(int(np.abs(a).max(initial=0).astype(np.int64)), 1) * max(int(np.abs(b).max(initial=0).astype(np.int64)), 1) * max(a.shape[1], 1)
    if size < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def interval(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every anchor with a row of every block."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def best(scores: np.ndarray, allowed: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row, ties by smaller key."""
    n = scores.shape[1]
    k = min(k, n)
    order = np.argsort(keys, kind="stable")
    ranked, open_ = scores[:, order], allowed[:, order]
    if int(np.abs(ranked).max(initial=0)) < (1 << 62) // max(n, 1):
        value = np.where(open_, ranked * n + np.arange(n)[::-1], np.iinfo(np.int64).min)
        top = np.argpartition(value, n - k, axis=1)[:, n - k:] if k < n else np.tile(np.arange(n), (len(scores), 1))
    else:
        top = np.stack([np.lexsort((np.arange(n), -s.astype(object), ~o))[:k] for s, o in zip(ranked, open_)]) if len(scores) else np.zeros((0, k), np.int64)
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    column = top.ravel()
    use = open_[row, column]
    return row[use], order[column[use]]


def cut(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of each pair of the first two columns; then come score and key."""
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    a, b, score, key = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((key, -score, b, a))
    a, b, score, key = a[order], b[order], score[order], key[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return tuple(c[place < k] for c in (a, b, score, key))


FOUND = "anchor_id long, positive_id long, score long, key long"


def frame(columns: tuple[np.ndarray, ...]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "score", "key"), columns)))


def home_positives(blocks: DataFrame, dims: int, k: int) -> DataFrame:
    """The ``k`` best same-label rows of each anchor in its own block: no more than a bound to start from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.rename(columns={"keys": "keys_"}).itertuples():
                keys, labels, anchors, v = block_arrays(row, dims)
                for own in np.array_split(np.flatnonzero(anchors), max(1, anchors.sum() // 64)):
                    scores = products(v[own], v)
                    i, j = best(scores, (labels[own][:, None] == labels) & (keys[own][:, None] != keys), keys, k)
                    if len(i):
                        yield frame((keys[own[i]], np.zeros(len(i), np.int64), scores[i, j], keys[j]))

    return blocks.mapInPandas(run, FOUND)


def anchor_rows(blocks: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.rename(columns={"keys": "keys_"}).itertuples():
                keys, labels, anchors, v = block_arrays(row, dims)
                own = np.flatnonzero(anchors)
                yield pd.DataFrame({"block": row.block, "place": own, "anchor_id": keys[own], "label": labels[own], "v": [v[i].tobytes() for i in own]})

    return blocks.select("block", "keys", "labels", "anchors", "vectors").mapInPandas(run, "block long, place int, anchor_id long, label long, v binary")


def wanted(sets: DataFrame, zones: DataFrame, n_sets: int, n_runs: int, dims: int, same_label: bool) -> DataFrame:
    """``run, set, block, who``: which blocks the anchors of a set must read, and for whom.

    ``sets`` has one row per anchor with its ``windows``, a list of least and greatest scores.
    A run's zone maps meet each set once.
    """
    each_set, each_run = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_sets, n_runs))
    left = zones.withColumn("set", each_set).groupBy("run", "set")
    right = sets.withColumn("run", each_run).select("run", F.col("set").cast("int"), "anchor_id", "label", "v", "windows").groupBy("run", "set")

    def choose(blocks: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        anchors = anchors.sort_values("anchor_id")
        q = np.frombuffer(b"".join(anchors["v"]), np.int32).reshape(len(anchors), dims)
        low, high = (np.frombuffer(b"".join(blocks[c]), np.int32).reshape(len(blocks), dims) for c in ("low", "high"))
        first, last, label = blocks["first_label"].to_numpy(), blocks["last_label"].to_numpy(), anchors["label"].to_numpy()[:, None]
        fits = (first <= label) & (label <= last) if same_label else (first != label) | (last != label)
        least, most = interval(q, low, high)
        size = np.array([len(w) for w in anchors["windows"]], np.int64)
        windows = np.array([list(w) for ws in anchors["windows"] for w in ws], np.int64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(anchors)), size)
        meets = (most[owner] >= windows[:, :1]) & (least[owner] <= windows[:, 1:])
        need = np.zeros(fits.shape, bool)
        np.logical_or.at(need, owner, meets)
        need &= fits
        any_ = np.flatnonzero(need.any(axis=0))
        return pd.DataFrame({
            "run": blocks["run"].iloc[any_].to_numpy(), "set": blocks["set"].iloc[any_].to_numpy(),
            "block": blocks["block"].iloc[any_].to_numpy(), "who": [anchors["anchor_id"].to_numpy()[need[:, j]].tobytes() for j in any_],
        })

    return left.cogroup(right).applyInPandas(choose, "run int, set int, block long, who binary")


def read_windows(sets: DataFrame, blocks: DataFrame, chosen: DataFrame, dims: int, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best rows of each window within a run: ``anchor_id, positive_id, score, key``.

    Only chosen blocks leave the table; each meets the anchors that chose it.
    """
    left = blocks.select("block", F.col("keys").alias("keys_"), "labels", "anchors", "vectors").join(chosen, "block").groupBy("run", "set")
    cells = chosen.select(F.col("run").alias("its_run"), F.col("set").alias("its_set")).distinct()
    right = cells.join(sets, F.col("its_set") == F.col("set")).drop("set").groupBy("its_run", "its_set")

    def read(own: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        anchors = anchors.sort_values("anchor_id").reset_index(drop=True)
        ids, label = anchors["anchor_id"].to_numpy(), anchors["label"].to_numpy()
        q = np.frombuffer(b"".join(anchors["v"]), np.int32).reshape(len(anchors), dims)
        size = np.array([len(w) for w in anchors["windows"]], np.int64)
        start = np.cumsum(size) - size
        windows = np.array([list(w) for ws in anchors["windows"] for w in ws], np.int64).reshape(-1, 2)
        positives = np.array([p for ps in anchors["positives"] for p in ps], np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        for block in own.itertuples():
            keys, labels, _, v = block_arrays(block, dims)
            who = np.searchsorted(ids, np.frombuffer(block.who, np.int64))
            for part in np.array_split(who, max(1, len(who) // 64)):
                scores = products(q[part], v)
                other = (label[part][:, None] == labels) == same_label
                other &= ids[part][:, None] != keys
                for w in range(int(size[part].max(initial=0))):
                    has = np.flatnonzero(size[part] > w)
                    at = start[part[has]] + w
                    inside = other[has] & (scores[has] >= windows[at, :1]) & (scores[has] <= windows[at, 1:])
                    i, j = best(scores[has], inside, keys, k)
                    found.append((ids[part[has[i]]], positives[at[i]], scores[has[i], j], keys[j]))
            found = [cut(found, k)]
        return frame(cut(found, k))

    return left.cogroup(right).applyInPandas(read, FOUND)


def mine(
    df: DataFrame, key: str, vector: str, label: str, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)
) -> DataFrame:
    """For every anchor and each of its positives, the hardest rows of other labels inside the positive's window.

    A component ``x`` counts as ``floor(scale * x)``, a score is the integer inner product; higher
    scores come first, ties by smaller key.  Positives are an anchor's best ``positives`` other rows
    of its label; negatives the best ``negatives`` rows of other labels whose score is between
    ``window`` percent of the positive's.  Returns ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``; anchors without a positive or negative have no row.

    Rows with a null key, label or vector or a null or non-finite component take no part, nor do
    rows with a component whose products could overflow a score.  Shorter vectors count as
    filled with zeros.  Of rows that repeat a key, the one with the smallest label, then vector,
    takes part.  An empty table has no result; other columns are not read.
    """
    rows, dims = taking_part(df, key, vector, label, anchor, scale)
    rows = cut_lineage(rows)
    count = rows.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    run_rows = min(max(count["all"] // 32, RUN_ROWS[0]), RUN_ROWS[1])
    n_runs = 1 + count["all"] // run_rows
    set_rows = min(max(count["anchors"] // 4, SET_ROWS[0]), SET_ROWS[1])
    n_sets = max(1, -(-count["anchors"] // set_rows))
    blocks = written(packed(with_curve(rows, dims), dims, n_runs))
    zones = blocks.select("run", "block", "first_label", "last_label", "low", "high")

    anchors = global_rank(anchor_rows(blocks, dims), [F.col("block"), F.col("place")], rank="place_of_all")
    anchors = anchors.withColumn("set", F.floor((F.col("place_of_all") - 1) / set_rows)).select("set", "anchor_id", "label", "v")
    anchors = cut_lineage(anchors)

    home = top_k_per_group(home_positives(blocks, dims, positives), ["anchor_id"], positives, [F.desc("score"), F.asc("key")])
    known = home.groupBy("anchor_id").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("least"))
    start = F.coalesce(F.col("least"), F.lit(-(2**63)))
    sets = cut_lineage(anchors.join(known, "anchor_id", "left").select(
        "set", "anchor_id", "label", "v", F.array(F.array(start, F.lit(2**63 - 1))).alias("windows"), F.array(F.lit(0).cast("long")).alias("positives")
    ))
    near = read_windows(sets, blocks, cut_lineage(wanted(sets, zones, n_sets, n_runs, dims, True)), dims, positives, True)
    near = cut_lineage(top_k_per_group(near, ["anchor_id"], positives, [F.desc("score"), F.asc("key")]).select("anchor_id", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")))

    # ceil(low * s / 100) and floor(high * s / 100) in integers; a negative score has an empty window.
    s = F.col("positive_score").cast("decimal(38,0)")
    bounds = F.array(F.ceil(s * window[0] / 100).cast("long"), F.floor(s * window[1] / 100).cast("long"))
    asked = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", bounds.alias("w"))).alias("asked"))  # `positives` at most
    sets = cut_lineage(anchors.join(asked, "anchor_id").select("set", "anchor_id", "label", "v", F.col("asked.w").alias("windows"), F.col("asked.positive_id").alias("positives")))
    far = read_windows(sets, blocks, cut_lineage(wanted(sets, zones, n_sets, n_runs, dims, False)), dims, negatives, False)
    far = top_k_per_group(far, ["anchor_id", "positive_id"], negatives, [F.desc("score"), F.asc("key")])
    return far.join(near, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
