"""Mixing sources to target weights: capped targets and a balanced sample by the cube method."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.ranking import global_rank
from paperloom.session import broadcast_if_small, cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3.0
BLOCK_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of words of the text; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``source, source_size`` with the ``target`` of each source.

    Sources are numbered by code point (null last) and given the weights in turn.  All
    sizes together are shared by weight; a target stops at ``cap`` times its source's
    size and what lies above is shared among the others by weight until none is above.
    That point is the level at which the capped shares add up to the whole; it is found
    by a few sums over the source table, which is never gathered anywhere.
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = global_rank(sizes.select("source", "source_size"), [F.asc_nulls_last("source")], "place").withColumn("weight", turn)
    ranked = cut_lineage(ranked)
    level, capped = 0.0, -1
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * F.lit(float(cap))
    while total:
        above = F.col("weight") * F.lit(level) > most
        free, used, n = ranked.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, most)), F.count(F.when(above, 1))).first()
        if n == capped or not free:
            break
        level, capped = (total - (used or 0.0)) / free, n
    return ranked.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def flight(share: list[float], size: list[float], rng: random.Random, land: bool) -> None:
    """Move ``share`` in place to zeros and ones along directions that keep its sum and its size total.

    Three open units at a time span one such direction; each step closes one of them at
    least.  At most two stay open; with ``land`` the number gives way, the size total
    still holds, and one unit at most stays open.
    """
    def step(units: list[int], u: list[float]) -> None:
        up = min((1.0 - share[k]) / x if x > 0 else share[k] / -x for k, x in zip(units, u) if x)
        down = min(share[k] / x if x > 0 else (1.0 - share[k]) / -x for k, x in zip(units, u) if x)
        go = up if rng.random() * (up + down) < down else -down
        for k, x in zip(units, u):
            moved = share[k] + go * x
            share[k] = 0.0 if moved < 1e-9 else 1.0 if moved > 1.0 - 1e-9 else moved

    window: list[int] = []
    for k in range(len(share)):
        if not 0.0 < share[k] < 1.0:
            continue
        window.append(k)
        while len(window) == 3:
            a, b, c = (size[k] for k in window)
            u = [c - b, a - c, b - a]
            scale = max(map(abs, u))
            step(window, [x / scale for x in u] if scale else [1.0, -1.0, 0.0])
            window = [k for k in window if 0.0 < share[k] < 1.0]
    if land and len(window) == 2:
        a, b = (size[k] for k in window)
        scale = max(a, b)
        step(window, [b / scale, -a / scale] if scale else [1.0, -1.0])


def flyer(seed: int, turn: int):
    """The flight of one block, its draws fixed by the block."""
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "id", "size"], kind="stable")
        share = pdf["share"].tolist()
        draws = random.Random(f"{seed}/{turn}/{pdf['block'].iloc[0]}/{pdf['stratum'].iloc[0]}")
        flight(share, pdf["size"].astype(float).tolist(), draws, bool(pdf["blocks"].iloc[0] == 1))
        return pdf.assign(share=share)[["stratum", "id", "size", "share"]]

    return fly


def cube_sample(units: DataFrame, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``units`` (``stratum, id, size, share``) with ``share`` moved to 0 or 1, balanced within each stratum.

    One unit per stratum may keep a share between: the landing problem, a part of it.

    Each stratum is cut by a hash into blocks of about ``block_rows`` units, so one that
    holds a third of all rows is spread like any other; every block flies on its own and
    leaves at most two open units, which meet in the next round.  Rounds go on until a
    stratum fits one block, which lands.  The draws hang on the ids and ``seed`` alone.
    """
    rest = units.select("stratum", "id", "size", F.col("share").cast("double").alias("share"))
    done: list[DataFrame] = []
    schema = rest.schema
    for turn in range(64):
        open_ = (F.col("share") > 0) & (F.col("share") < 1)
        if turn == 0:
            done.append(rest.where(~open_))
            rest = rest.where(open_)
        counts = broadcast_if_small(rest.groupBy("stratum").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("blocks")))
        last = counts.agg(F.max("blocks")).first()[0]
        if last is None:
            break
        placed = rest.join(counts, "stratum").select(
            "stratum", "id", "size", "share", "blocks", F.pmod(F.xxhash64("id", "size", F.lit(seed), F.lit(turn)), F.col("blocks").cast("long")).cast("int").alias("block"))
        # Dealt by block even where a shuffled join has left the rows by stratum.
        dealt = placed.repartition("stratum", "block").withColumn("order", F.xxhash64("id", F.lit(seed)))
        flown = cut_lineage(dealt.groupBy("stratum", "block").applyInPandas(flyer(seed, turn), schema))
        if last == 1:
            done.append(flown)
            break
        # Strata that fit one block have landed; of the others the open units go on.
        flying = flown.join(counts, "stratum")
        landed = ~open_ | (F.col("blocks") == 1)
        done.append(flying.where(landed).drop("blocks"))
        rest = flying.where(~landed).drop("blocks")
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How many words the mix takes of each document: ``doc_id, size, source_size, target, taken``.

    A document is taken whole as often as its source's target holds the source, and once
    more for a balanced sample that makes up the rest; of one document per source a part
    of the words is taken, so that the total meets the target; never above ``cap`` times.  Texts
    do not leave their scan: only keys and sizes are shuffled.  A null or empty text has
    size 0 and gives nothing; a null source is one source, the last; repeated rows are
    taken one by one; null keys are kept; an empty table gives an empty one.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("doc_id"), docs[f"`{source}`"].cast("string").alias("source"), word_count(docs[f"`{text}`"]).alias("size"))
    rows = cut_lineage(rows)
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    # One narrow row per source; the join is null-safe on a column that has no null.
    tag = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = rows.withColumn("stratum", tag)
    targets = targets.select(tag.alias("stratum"), "source_size", "target")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(times - F.round(times)) < 1e-9, F.round(times)).otherwise(times)
    per_source = broadcast_if_small(targets.withColumn("times", near).withColumn("whole", F.floor("times").cast("long")))
    share = F.when(F.col("size") > 0, F.col("times") - F.col("whole")).otherwise(F.lit(0.0))
    units = rows.join(per_source, "stratum").select("stratum", F.col("doc_id").alias("id"), "size", share.alias("share"))
    drawn = cube_sample(units, seed, block_rows)
    return drawn.join(per_source, "stratum").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("whole") + F.round(F.col("size") * F.col("share")).cast("long")).alias("taken"))
