"""MinHash near-duplicates: universal hash minima, bands, verification on full sets, star components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import byte_values, mix, range_hashes, shingles, slices, text_bytes, words
from paperloom.llm.components import components
from paperloom.session import broadcast_if_small, cut_lineage

BANDS, ROWS = 36, 6
PAIRS_PER_TASK = 2_000
BLOCK_ROWS = 512
BROADCAST_IDS = 1_000_000  # ids up to this many (16 MB) are sent to the texts; more meet them by a shuffle


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of ``n`` universal hash functions."""
    draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return draw[:n] | np.uint64(1), draw[n:]


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; empty without words."""
    data, offsets = text_bytes(column)
    values = byte_values(lower=True)
    for i, j in slices(offsets):
        part, where = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        starts, ends, row = words(part, where)
        h, of, _, _ = shingles(range_hashes(values[part], starts, ends), row, j - i, width)
        cuts = np.searchsorted(of, np.arange(j - i + 1))
        for k in range(j - i):
            yield np.unique(h[cuts[k]:cuts[k + 1]])


def minima(shingle_set: np.ndarray) -> np.ndarray:
    """The minimum of every universal hash function over one set, as 32 bits each."""
    a, b = multipliers(BANDS * ROWS)
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingle_set), 512):
        out = np.minimum(out, (shingle_set[i:i + 512, None] * a + b).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in signature.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


def described(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, digest, keys, signature``: 128 bits tell equal sets, one byte is kept of each minimum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, keys, signature = [], [], [], []
            for s in sets_of(batch.column(2), width):
                n.append(len(s))
                digest.append(mix(s).sum(dtype=np.uint64).tobytes() + mix(mix(s) ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "big"))
                least = minima(s) if len(s) else None
                keys.append(np.zeros(0, np.int64) if least is None else band_keys(least).view(np.int64))
                signature.append(b"" if least is None else least.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signature, pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "keys", "signature"])

    return docs.mapInArrow(run, "doc_id long, text_key long, n_shingles long, digest binary, keys array<long>, signature binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``doc_id, members`` (the whole sorted set as bytes) of the listed nodes, each read from the row ``reps`` names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in sets_of(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "members"])

    listed = reps.join(ids.distinct(), reps["node"] == ids["doc_id"], "left_semi").select("node", "row.doc_id", "row.text_key")
    own = docs.join(broadcast_if_small(listed, BROADCAST_IDS), ["doc_id", "text_key"]).select(F.col("node").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, members binary").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets satisfy ``100 * shared >= percent * union``.

    A pair's first member may stand in very many pairs: its pairs are cut into salted
    parts of about ``PAIRS_PER_TASK``, and its set is sent once to each part, not to each pair.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAIRS_PER_TASK)).cast("int").alias("parts"))
    heads = counts.join(sets, counts["a"] == sets["doc_id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "members")
    rest = pairs.join(counts, "a").join(sets, pairs["b"] == sets["doc_id"]).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "members")
    dealt = heads.unionAll(rest)
    dealt = dealt.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = None, np.zeros(0, np.uint64)
        for batch in batches:
            first, second = [], []
            for a, b, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                own = np.frombuffer(members.as_buffer(), np.uint64)
                if b is None:
                    held, head = a, own.copy()
                    continue
                if held != a:
                    raise RuntimeError("pair without its first member")
                at = np.searchsorted(head, own)
                shared = int((head[np.minimum(at, len(head) - 1)] == own).sum())
                if 100 * shared >= percent * (len(head) + len(own) - shared):
                    first.append(a)
                    second.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def least_agreement(percent: int) -> float:
    """Share of equal minima that a linked pair falls below with odds of 3e-7 (five standard deviations)."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / (BANDS * ROWS)) ** 0.5


def alike(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree well enough to look at the sets."""
    both = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("s")), "a")
    both = both.join(signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("t")), "b").select("a", "b", "s", "t")
    least = least_agreement(percent) * BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("s", "t"))
            yield batch.select(["a", "b"]).filter(pa.array((s == t).sum(axis=1) >= least))

    return both.mapInArrow(run, "a long, b long")


def signature_judge(payloads: list[bytes], percent: int):
    """Compares one signature with all stored ones."""
    stored = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BANDS * ROWS)
    least = least_agreement(percent) * BANDS * ROWS
    return lambda payload: (stored == np.frombuffer(payload, np.uint8)).sum(axis=1) >= least


def set_judge(payloads: list[bytes], percent: int):
    """Compares one full set with all stored ones through an index from shingle to owner."""
    sets = [np.frombuffer(x, np.uint64) for x in payloads]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]

    def judge(payload: bytes) -> np.ndarray:
        own = np.frombuffer(payload, np.uint64)
        low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(owner[at], minlength=len(sets))
        return 100 * shared >= percent * (len(own) + sizes - shared)

    return judge


def crossed(members: DataFrame, judge_of, percent: int, links: bool) -> DataFrame:
    """Compare members of a bucket across its components, block by block, without making pairs.

    ``members`` is ``bucket, doc_id, component, main, n, payload``.  A bucket's members are
    dealt into blocks of about ``BLOCK_ROWS``; every member outside the main component
    visits all blocks of its bucket and is held against what another component has
    there.  With ``links``, one link ``a, b`` per visitor and component it meets is
    returned; else the ``doc_id`` of all that met someone.
    """
    blocks = F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int")
    stored = members.select("bucket", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.lit(False).alias("visits"), "doc_id", "component", "payload")
    visitors = members.where("component <> main").select("bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("visits"), "doc_id", "component", "payload")
    dealt = stored.unionAll(visitors).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, owners, payloads, judge = None, [], [], [], None
        for batch in batches:
            first, second = [], []
            for bucket, block, visits, doc, component, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if place != (bucket, block):
                    place, ids, owners, payloads, judge = (bucket, block), [], [], [], None
                if not visits:
                    ids.append(doc)
                    owners.append(component)
                    payloads.append(payload)
                    continue
                if not ids:
                    continue
                if judge is None:
                    judge, components_ = judge_of(payloads, percent), np.array(owners)
                met = np.flatnonzero(judge(payload) & (components_ != component))
                if len(met):
                    if links:
                        _, met_first = np.unique(components_[met], return_index=True)
                        met = met[met_first]
                    first += [doc] * len(met)
                    second += [ids[m] for m in met]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["a", "b"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({*first, *second}), pa.int64())], names=["doc_id"])

    return dealt.mapInArrow(run, "a long, b long" if links else "doc_id long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, first`` of every row of ``docs``.

    Texts are words (ASCII letters in lower case) in shingles of ``width``; documents are
    linked if their sets share ``percent`` hundredths of their union, and a component is
    named by its smallest id.  A node is a distinct set, so an id that stands over two texts
    has two nodes and two decisions.  ``text_key`` is the hash of the row's text; ``first`` marks the
    rows of the smallest ``doc_id, text_key`` of a component.  Of the nodes,
    those that share a band of minima (36 bands of 6: a pair at 85 % is missed with odds of
    4e-8, one at 80 % of 2e-5) are candidates.  First each bucket's members are compared
    with its smallest; then, in buckets that this leaves in several components, every
    member outside the largest one with all members outside its own, so that no link
    between components is lost.  Signatures decide whether sets are looked at, full sets
    whether a link stands.  An empty or null text links with nothing, nor does a
    null key (its component is null, and it is kept); a repeated row is returned as often;
    an empty table gives an empty one.
    """
    text_of = F.xxhash64(docs[f"`{text}`"])
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), text_of.alias("text_key"), docs[f"`{text}`"].alias("text"))
    facts = cut_lineage(described(rows, width))
    known = facts.where("doc_id IS NOT NULL AND n_shingles > 0")
    # One node per distinct set, named by its digest and read from its first row.
    reps = cut_lineage(known.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("row")).withColumn("node", F.xxhash64("digest")))
    named = known.join(reps, (known["digest"] == reps["digest"]) & (known["doc_id"] == F.col("row.doc_id")) & (known["text_key"] == F.col("row.text_key")))
    nodes = named.select(F.col("node").alias("doc_id"), "keys", "signature").dropDuplicates(["doc_id"])
    slots = nodes.select("doc_id", F.explode("keys").alias("bucket"))
    full = slots.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(slots.join(full, "bucket").select("bucket", "doc_id", "a"))
    signatures = cut_lineage(nodes.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "signature"))
    stars = cut_lineage(alike(buckets.where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), signatures, percent))
    known_rows = rows.where("doc_id IS NOT NULL")
    sets = shingle_sets(known_rows, stars.select(F.explode(F.array("a", "b")).alias("doc_id")), reps, width)
    links = cut_lineage(confirmed(stars, cut_lineage(sets), percent))
    found = components(links)

    labelled = buckets.join(found, buckets["doc_id"] == found["node"], "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"mark{i}") for i in (0, 1)])
    split = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.bit_xor("mark0").alias("mark0"), F.bit_xor("mark1").alias("mark1"))
    # Two members have been compared already; buckets of the same members, told by 128 bits, are looked at once.
    split = split.where("kinds > 1 AND n > 2").groupBy("n", "mark0", "mark1").agg(F.min(F.struct("bucket", "main")).alias("x")).select("x.bucket", "x.main", "n")
    open_ = cut_lineage(labelled.join(split, "bucket").select("bucket", "doc_id", "component", "main", "n"))
    met = cut_lineage(crossed(open_.join(signatures.withColumnRenamed("signature", "payload"), "doc_id"), signature_judge, percent, links=False).distinct())
    sets = shingle_sets(known_rows, met, reps, width).withColumnRenamed("members", "payload")
    more = crossed(open_.join(sets, "doc_id"), set_judge, percent, links=True)
    found = components(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    # Class of every distinct set: the first row of its node's component.
    classes = reps.join(found.withColumnRenamed("node", "found"), F.col("node") == F.col("found"), "left").select("digest", "row", F.coalesce("component", "node").alias("component"))
    heads = classes.groupBy("component").agg(F.min("row").alias("head"))
    judged = facts.select("doc_id", "text_key", "n_shingles", "digest").join(classes.join(heads, "component").select("digest", "head"), "digest", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    component = F.when(linked, F.col("head.doc_id")).otherwise(F.col("doc_id"))
    first = ~linked | ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key")))
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), "text_key", first.alias("first")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
