"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs that keeps common prefixes.

Every 200-byte string is looked at through its anchor: the 64-byte piece in it with the
smallest hash (the leftmost of several).  Equal strings have equal anchors at equal
places, so only suffixes that start at anchors are sorted, and only those whose anchor
piece occurs twice at all.  Each task sorts its suffixes into a run, codes every suffix by
the prefix it shares with the one before, and deals the run out by ranges; the receiver
merges the runs with a loser tree that compares shared prefixes by their lengths and
never reads known bytes again.  The lengths that come out of the merge say how far
suffixes agree to the right of an anchor; the bytes to its left are compared the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import byte_values, mix, powers, text_bytes
from paperloom.session import cut_lineage

LENGTH, PIECE = 200, 64
SPAN = LENGTH - PIECE + 1  # pieces in a string, and bytes of left context beside an anchor plus one
HOT = 50_000
SPLIT_BYTES, SAMPLED_ROWS = 32, 2_000


def piece_hashes(b: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``size`` bytes of one text."""
    up, down = powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(mix(byte_values() + np.uint64(salt))[b] * up[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:len(b) - size + 1])


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of every anchor of a text, and the first and last string start it stands for."""
    h = piece_hashes(b, PIECE)
    least, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < SPAN:
        by = min(width, SPAN - width)
        right = least[by:] < least[:-by]
        at = np.where(right, at[by:], at[:-by])
        least = np.minimum(least[by:], least[:-by])
        width += by
    cut = np.flatnonzero(at[1:] != at[:-1])
    first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
    return at[first].astype(np.int64), h[at[first]], first, last


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[np.ndarray]:
    data, offsets = text_bytes(batch.column(name))
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def anchor_counts(rows: DataFrame) -> DataFrame:
    """``h, u, v, n``: how often each anchor hash occurs in each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, hashes, counts = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, b in enumerate(texts_of(batch)):
                if len(b) >= LENGTH:
                    h, n = np.unique(anchors(b)[1], return_counts=True)
                    hashes.append(h)
                    counts.append(n)
                    of.append(np.full(len(h), i))
            take = pa.array(np.concatenate(of) if of else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), batch.column("u").take(take), batch.column("v").take(take), pa.array(np.concatenate(counts))], names=["h", "u", "v", "n"])

    return rows.select("u", "v", "text").mapInArrow(run, "h long, u long, v long, n long")


def run_splitters(rows: DataFrame, parts: int) -> np.ndarray:
    """Borders of the ranges, from the anchors of about ``SAMPLED_ROWS`` texts; they only balance the work."""
    share = min(1.0, SAMPLED_ROWS / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for b in texts_of(batch):
                if len(b) >= LENGTH:
                    at = anchors(b)[0]
                    keys += [b[p:p + SPLIT_BYTES].tobytes() for p in at[::1 + len(at) // 64]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    sample = np.sort(np.array([bytes(r["key"]) for r in rows.select("text").sample(share, 7).mapInArrow(run, "key binary").collect()], f"S{SPLIT_BYTES}"))
    return np.unique(sample[np.linspace(0, len(sample), parts + 1).astype(int)[1:-1]]) if len(sample) else sample


def contexts(b: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``LENGTH`` bytes from each place, and the ``SPAN - 1`` before it in reverse; zeros beyond the text."""
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint8), b, np.zeros(LENGTH, np.uint8)])
    right = padded[(p + SPAN - 1)[:, None] + np.arange(LENGTH)]
    left = padded[(p + SPAN - 2)[:, None] - np.arange(SPAN - 1)]
    return right, left


def common(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix each row shares with the row before; the first shares none."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def sorted_rows(rows: np.ndarray) -> np.ndarray:
    """Stable byte order of the rows of a matrix."""
    keys = [r.tobytes() for r in rows]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)


BLOCK = "part int, shared binary, tails binary, left binary, member binary"


def coded_runs(marked: DataFrame, splitters: np.ndarray) -> DataFrame:
    """One sorted, front-coded run per slice of texts, dealt out by range.

    Equal suffixes with equal left context and equal string starts are one entry with
    several members, so copies are pre-aggregated before the exchange.
    """
    borders = marked.sparkSession.sparkContext.broadcast(splitters)

    def blocks(right: list, left: list, member: list) -> Iterator[dict]:
        right, left, member = np.concatenate(right), np.concatenate(left), np.concatenate(member)
        whole = np.concatenate([right, left, member[:, 3:5].astype(np.uint8)], axis=1)
        order = sorted_rows(whole)
        right, left, member, whole = right[order], left[order], member[order], whole[order]
        entry = np.cumsum(common(whole) < whole.shape[1]) - 1
        first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
        part = np.searchsorted(borders.value, right[first, :SPLIT_BYTES].copy().view(f"S{SPLIT_BYTES}").ravel(), side="right")
        for x in np.unique(part):
            mine = np.flatnonzero(part == x)
            y = right[first[mine]]
            shared = common(y)
            tails = y[np.arange(LENGTH) >= shared[:, None]]
            a, z = np.searchsorted(entry, [mine[0], mine[-1] + 1])
            held = member[a:z].copy()
            held[:, 5] = entry[a:z] - mine[0]
            yield {"part": int(x), "shared": shared.astype(np.uint8).tobytes(), "tails": tails.tobytes(), "left": left[first[mine]].tobytes(), "member": held.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, left, member, size = [], [], [], 0
        for batch in batches:
            u, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            out = []
            for i, (b, wanted) in enumerate(zip(texts_of(batch), batch.column("wanted"))):
                at, h, first, last = anchors(b)
                keep = np.isin(h.view(np.int64), wanted.values.to_numpy(zero_copy_only=False))
                at, first, last = at[keep], first[keep], last[keep]
                for k in range(0, len(at), 8192):
                    p, f, e = at[k:k + 8192], first[k:k + 8192], last[k:k + 8192]
                    y, x = contexts(b, p)
                    right.append(y)
                    left.append(x)
                    member.append(np.stack([np.full(len(p), u[i]), np.full(len(p), v[i]), p, p - e, p - f, np.zeros_like(p)], axis=1))
                    size += len(p)
                    if size >= 60_000:
                        out += blocks(right, left, member)
                        right, left, member, size = [], [], [], 0
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if size:
            yield pa.RecordBatch.from_pylist(list(blocks(right, left, member)), schema=schema)

    schema = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("shared", "tails", "left", "member")]])
    return marked.mapInArrow(run, BLOCK)


def decoded(shared: np.ndarray, tails: np.ndarray) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, at, last = [], 0, b""
    tails = tails.tobytes()
    for n in shared.tolist():
        last = last[:n] + tails[at:at + LENGTH - n]
        at += LENGTH - n
        out.append(last)
    return out


def merged(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs of equally long keys with their shared-prefix lengths by a loser tree.

    A head carries the prefix it shares with the key put out last.  Of two heads the
    one that shares more is smaller, and the other keeps its length; only heads that
    share equally much are read, from the first unknown byte on.  Returns (run, place)
    in order and what each key shares with the one before.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    share = [0 if r < len(runs) and runs[r][0] else -1 for r in range(k)]
    keys = [runs[r][0][0] if share[r] == 0 else b"" for r in range(k)]

    def beats(a: int, b: int) -> int:
        """The winner of two heads; the loser's length then refers to the winner."""
        x, y = share[a], share[b]
        if x != y:
            return a if x > y else b
        if x < 0:
            return a
        p, q = keys[a], keys[b]
        if p == q:
            if a < b:
                share[b] = LENGTH
                return a
            share[a] = LENGTH
            return b
        unlike = int.from_bytes(p[x:]) ^ int.from_bytes(q[x:])
        n = LENGTH - (unlike.bit_length() + 7) // 8
        if p[n] < q[n]:
            share[b] = n
            return a
        share[a] = n
        return b

    loser = [0] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win = beats(a, b)
        loser[node] = b if win == a else a
        return win

    top = play(1) if k > 1 else 0
    order, lengths = [], []
    while share[top] >= 0:
        order.append((top, place[top]))
        lengths.append(share[top])
        place[top] += 1
        run_keys, run_shared = runs[top]
        if place[top] < len(run_keys):
            keys[top], share[top] = run_keys[place[top]], run_shared[place[top]]
        else:
            keys[top], share[top] = b"", -1
        node = (top + k) // 2
        while node:
            other = loser[node]
            if beats(other, top) == other:
                loser[node], top = top, other
            node //= 2
    return order, lengths


def repeated_starts(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which strings (entry, distance of the start before the anchor) occur twice.

    ``right`` is what each entry shares with the one before in suffix order.  A string
    that starts ``o`` bytes before its anchor is equal to another where the suffixes
    share ``LENGTH - o`` bytes and the left contexts ``o``: for every ``o`` the entries
    fall into classes by suffix and by left context, and classes of weight two repeat.
    """
    m = len(right)
    group = np.cumsum(right < PIECE)
    by_left = sorted_rows(left)
    by_left = by_left[np.argsort(group[by_left], kind="stable")]
    beside = common(left[by_left])
    beside[1:][group[by_left][1:] != group[by_left][:-1]] = -1
    reach_right = np.maximum(right, np.append(right[1:], 0))
    reach_left = np.zeros(m, np.int64)
    reach_left[by_left] = np.maximum(beside, np.append(beside[1:], 0))
    heavy = weight > 1
    low, high = np.maximum(low, np.where(heavy, 0, LENGTH - reach_right)), np.minimum(high, np.where(heavy, SPAN, reach_left))
    out = np.zeros((m, SPAN), bool)
    for o in range(SPAN):
        valid = np.flatnonzero((low <= o) & (o <= high))
        if not len(valid):
            continue
        suffix = np.cumsum(right < LENGTH - o)
        prefix = np.empty(m, np.int64)
        prefix[by_left] = np.cumsum(beside < o)
        _, which = np.unique(suffix[valid] * np.int64(m + 1) + prefix[valid], return_inverse=True)
        out[valid, o] = np.bincount(which, weights=weight[valid])[which] > 1
    return out


def merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """All runs of one range to the byte ranges ``u, v, start, end`` that repeat."""
    runs, left, member, base = [], [], [], [0]
    for row in pdf.itertuples():
        shared = np.frombuffer(row.shared, np.uint8)
        runs.append((decoded(shared, np.frombuffer(row.tails, np.uint8)), shared.tolist()))
        left.append(np.frombuffer(row.left, np.uint8).reshape(-1, SPAN - 1))
        held = np.frombuffer(row.member, np.int64).reshape(-1, 6).copy()
        held[:, 5] += base[-1]
        member.append(held)
        base.append(base[-1] + len(shared))
    order, lengths = merged(runs)
    rank = np.array([base[r] + i for r, i in order], np.int64)
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    member = np.concatenate(member)
    entry = place[member[:, 5]]
    weight = np.bincount(entry, minlength=len(rank))
    low, high = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    low[entry], high[entry] = member[:, 3], member[:, 4]
    twice = repeated_starts(np.array(lengths, np.int64), np.concatenate(left)[rank], low, high, weight)
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    of, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1] - 1
    # Ranges of every entry, repeated for each of its members.
    member = member[np.argsort(entry, kind="stable")]
    first = np.concatenate([[0], np.cumsum(weight)])
    copies = weight[of]
    whose = np.repeat(first[of], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    held = member[whose]
    return pd.DataFrame({"u": held[:, 0], "v": held[:, 1], "start": held[:, 2] - np.repeat(stop, copies), "end": held[:, 2] - np.repeat(start, copies) + LENGTH})


def hot_starts(marked: DataFrame) -> DataFrame:
    """The strings of anchors too frequent for one range, told apart by two 64-bit hashes and counted as groups.

    A third of all documents may share an anchor; its strings are spread by their own
    hashes and added up in each task before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two, start, of = ([np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for i, (b, wanted) in enumerate(zip(texts_of(batch), batch.column("wanted"))):
                _, h, first, last = anchors(b)
                keep = np.isin(h.view(np.int64), wanted.values.to_numpy(zero_copy_only=False))
                if keep.any():
                    at = np.concatenate([np.arange(f, e + 1) for f, e in zip(first[keep], last[keep])])
                    one.append(piece_hashes(b, LENGTH, 1)[at])
                    two.append(piece_hashes(b, LENGTH, 2)[at])
                    start.append(at)
                    of.append(np.full(len(at), i))
            take = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(one).view(np.int64)), pa.array(np.concatenate(two).view(np.int64)), batch.column("u").take(take), batch.column("v").take(take), pa.array(np.concatenate(start))], names=["one", "two", "u", "v", "start"])

    strings = marked.mapInArrow(run, "one long, two long, u long, v long, start long")
    often = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
    return strings.join(often, ["one", "two"]).select("u", "v", "start", (F.col("start") + LENGTH).alias("end"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes left) of every row.

    Removed is each byte covered by a 200-byte string that also starts elsewhere, in
    the same text or another, judged on the input; overlaps count and matches never
    cross texts.  A null or empty text is empty; texts below 200 bytes stay whole;
    repeated rows are copies of each other and removed alike; null keys are
    ordinary rows; an empty table gives an empty one.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    rows = rows.withColumns({"u": F.xxhash64("doc_id", "text"), "v": F.xxhash64(F.lit(11), "text", "doc_id")})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = anchor_counts(rows)
    often = cut_lineage(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"))

    def wanted(which: DataFrame) -> DataFrame:
        """Texts with the anchor hashes to look at; the list of a text is bounded by its length."""
        lists = counted.join(which.select("h"), "h").groupBy("u", "v").agg(F.collect_set("h").alias("wanted"))
        return rows.join(lists, ["u", "v"]).select("doc_id", "text", "u", "v", "wanted")

    runs = coded_runs(wanted(often.where(F.col("n") <= hot)), run_splitters(rows, parts))
    spans = runs.repartition(parts, "part").groupBy("part").applyInPandas(merge_part, "u long, v long, start long, end long")
    if not often.where(F.col("n") > hot).isEmpty():
        spans = spans.unionAll(hot_starts(wanted(often.where(F.col("n") > hot))))
    found = spans.groupBy("u", "v").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = rows.join(found, ["u", "v"], "left").select("doc_id", "text", "u", "v", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs_, digest, kept = [], [], [], [], []
            for b, found in zip(texts_of(batch), batch.column("spans")):
                left = b
                n_runs = 0
                if found.is_valid and len(found.values):
                    step = np.zeros(len(b) + 1, np.int32)
                    np.add.at(step, found.values.field("start").to_numpy(zero_copy_only=False), 1)
                    np.add.at(step, found.values.field("end").to_numpy(zero_copy_only=False), -1)
                    gone = np.cumsum(step[:-1]) > 0
                    left = b[~gone]
                    n_runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                raw = left.tobytes()
                n.append(len(b))
                removed.append(len(b) - len(left))
                runs_.append(n_runs)
                digest.append(sha256(raw).hexdigest())
                if keep_text:
                    kept.append(raw)
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_text else []), names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if keep_text else [])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else ""))
