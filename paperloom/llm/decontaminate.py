"""Benchmark decontamination: hash join of template windows with a check that the slots agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import byte_values, range_hashes, shingles, slices, text_bytes
from paperloom.session import cut_lineage

WIDTH = 5
FILTER_BITS = 21
# Units that may follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres "
    "dollar dollars euro euros usd eur cent cents percent degrees kmh mph hz khz mhz kb mb gb w kw v a"
).split()
WORD, NUMBER, NAME, UNIT = range(4)
FORMS = INNER, FOLDED, OPENING = range(3)


class Tokens:
    """Runs of letters and runs of digits of a slice of texts; their hashes are those of the lower-case text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: np.ndarray, low_offsets: np.ndarray):
        starts, ends, self.digits, self.row = cut(data, offsets)
        self.starts, self.ends, _, _ = cut(low, low_offsets)
        self.values, self.padded = byte_values(lower=True)[low], np.append(low, np.uint8(0))
        self.hashes = range_hashes(self.values, self.starts, self.ends) if len(starts) else np.zeros(0, np.uint64)
        self.at = np.arange(len(starts)) - np.searchsorted(self.row, self.row)
        if not len(starts):
            return
        padded = np.append(data, np.uint8(0))
        first, second = padded[starts], padded[starts + 1]
        upper = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        self.capital = upper & (ends - starts >= 2) & ~((second >= 65) & (second <= 90))
        visible = np.maximum.accumulate(np.where(data > 32, np.arange(len(data)), -1))
        before = np.where(starts > 0, visible[starts - 1], -1)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        self.opens = (before < offsets[self.row]) | np.isin(data[before], np.frombuffer(b".!?:", np.uint8)) | (lines[starts] > lines[before + 1])


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, whether of digits, and row of every run of letters or digits."""
    low = data | 32
    letter = (low >= 97) & (low <= 122) | (data >= 128)
    kind = np.where(letter, 2, np.where((data >= 48) & (data <= 57), 3, 0))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    border[1:-1] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(border)
    starts, ends = at[:-1], at[1:]
    seen = kind[starts] >= 2
    starts, ends = starts[seen], ends[seen]
    return starts, ends, kind[starts] == 3, np.searchsorted(offsets, starts, side="right") - 1


def templates(tokens: Tokens, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, canonical hash, slot value and place of every token of one form; words have slot value 0.

    Runs of digits (with ``.,:/-`` between them) are a number, a unit right after a
    number is a unit, and capitalised words are a name: in the form ``INNER`` those that do
    not open a sentence or line, in ``OPENING`` also those that do, in ``FOLDED`` none.  All
    of a kind hash alike.  Everything else is a word in lower case, signs are skipped.  The
    place counts runs before they are joined, so it is the same in every form.
    """
    starts, ends, row, hashes = tokens.starts, tokens.ends, tokens.row, tokens.hashes
    if not len(starts):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), tokens.at
    gap = np.zeros(len(starts), np.int64)
    gap[1:] = starts[1:] - ends[:-1]
    joined = np.zeros(len(starts), bool)
    joined[1:] = row[1:] == row[:-1]
    types = np.where(tokens.digits, NUMBER, WORD)
    if form != FOLDED:
        types[tokens.capital & ~tokens.opens if form == INNER else tokens.capital] = NAME
    after_number = np.zeros(len(starts), bool)
    after_number[1:] = (types[:-1] == NUMBER) & joined[1:] & (gap[1:] <= 1)
    types[after_number & (types == WORD) & np.isin(hashes, unit_hashes())] = UNIT
    between = tokens.padded[np.maximum(starts - 1, 0)]
    same = np.zeros(len(starts), bool)
    same[1:] = (types[1:] == types[:-1]) & joined[1:] & (gap[1:] == 1)
    merge = same & ((types == NUMBER) & np.isin(between, np.frombuffer(b".,:/-", np.uint8)) | (types == NAME) & np.isin(between, np.frombuffer(b" -", np.uint8)))
    head = np.flatnonzero(~merge)
    ends = ends[np.append(head[1:], len(starts)) - 1]
    types, row = types[head], row[head]
    slot = range_hashes(tokens.values, starts[head], ends) if merge.any() else hashes
    return row, np.where(types == WORD, slot, types.astype(np.uint64)), np.where(types == WORD, np.uint64(0), slot), tokens.at[head]


def unit_hashes() -> np.ndarray:
    joined = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return range_hashes(byte_values(lower=True)[joined], np.concatenate([[0], ends[:-1]]), ends)


def windows(df: DataFrame, key: str, text: str, width: int, bits: np.ndarray | None = None) -> DataFrame:
    """``key, whole, form, h, pos, at, slots`` of every template window (those in the bit filter, if given) of whole texts.

    ``pos`` counts the tokens of the form, ``at`` the runs before they are joined; ``whole`` is the hash of the text.
    """
    rows = df.select(df[f"`{key}`"].cast("long").alias("key"), df[f"`{text}`"].alias("text"), F.xxhash64(df[f"`{text}`"]).alias("whole"))
    shared = None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            data, offsets = text_bytes(column)
            low, low_offsets = text_bytes(column if pa.types.is_binary(column.type) else pc.utf8_lower(column))
            for i, j in slices(offsets):
                tokens = Tokens(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], low[low_offsets[i]:low_offsets[j]], low_offsets[i:j + 1] - low_offsets[i])
                for form in FORMS:
                    row, canon, slot, at = templates(tokens, form)
                    h, of, start, span = shingles(canon, row, j - i, width)
                    keep = np.arange(len(h)) if shared is None else np.flatnonzero(shared.value[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=j - i))])
                    mine = pa.array(of[keep] + i)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(mine), batch.column(2).take(mine), pa.array(np.full(len(keep), form, np.int32)), pa.array(h[keep].view(np.int64)),
                        pa.array((keep - first[of[keep]]).astype(np.int64)), pa.array(at[start[keep]].astype(np.int64)),
                        pa.array([slot[s:s + n].view(np.int64).tolist() for s, n in zip(start[keep], span[keep])], pa.list_(pa.int64())),
                    ], names=["key", "whole", "form", "h", "pos", "at", "slots"])

    return rows.mapInArrow(run, "key long, whole long, form int, h long, pos long, at long, slots array<long>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WIDTH, share: float = 0.8) -> DataFrame:
    """Documents that hold a benchmark item: ``doc_id, item_id, matched, n_windows, containment, verbatim``.

    An item leaks into a document if at least ``share`` of its distinct template windows
    of ``width`` tokens occur there in alignments whose slots agree: within one
    alignment, equal numbers, names or units of the item stand against equal ones of the
    document.  Both sides are read in three forms (see ``templates``), so that neither the
    case of a copy nor names that open a sentence hide it: a window counts as found if it is
    in any of them, and the form with the largest share of found windows decides.  Where
    the slots of the form ``INNER`` disagree, the other forms of the same alignment do not count.
    A name exchanged for one in lower or all-capital letters is a changed word.
    ``verbatim`` is false where slots were exchanged, i.e. for
    re-parameterised questions.  Documents pass a bit filter of fixed size (2**21 bits)
    in their scan; what passes meets the item windows in a hash join, whatever the size of
    the benchmark.  Null or empty texts and null keys leak nothing; of a repeated key the
    copies count together; an item shorter than ``width`` only matches a document of
    just these tokens; items of one text leak alike; empty tables give an empty one.
    """
    items = windows(benchmark.where(benchmark[f"`{item}`"].isNotNull()), item, text, width).select(
        F.col("key").alias("item_id"), "whole", "form", "h", F.col("pos").alias("item_pos"), F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    bits = np.zeros(1 << FILTER_BITS, bool)
    # At most 2**21 numbers, however large the benchmark.
    for row in items.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("bit")).distinct().toLocalIterator():
        bits[row["bit"]] = True
    sizes = items.groupBy("item_id", "form").agg(F.countDistinct("h").alias("n_windows"))
    held = windows(docs.where(docs[f"`{key}`"].isNotNull()), key, text, width, bits).drop("whole")
    met = held.join(items, ["form", "h"]).withColumn("shift", F.col("pos") - F.col("item_pos")).withColumn("turn", F.col("at") - F.col("item_at"))
    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p.a != 0)
    # Only windows that an item holds as well: few rows, read several times below.
    met = cut_lineage(met.select(F.col("key").alias("doc_id"), "item_id", "whole", "form", "shift", "turn", "item_at", pairs.alias("pairs")))
    # One alignment: each slot value of the item has one counterpart.
    line = ["doc_id", "item_id", "form", "shift"]
    slots = met.select(*line, F.explode("pairs").alias("p")).distinct()
    bad = slots.groupBy(*line, "p.a").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("p.a") != F.col("p.b")).alias("changed"))
    bad = bad.groupBy(*line).agg((F.max("n") > 1).alias("torn"), F.max("changed").alias("changed"))
    runs = met.drop("pairs").distinct().join(bad, line, "left").withColumn("torn", F.coalesce("torn", F.lit(False)))
    torn = runs.where(F.col("torn") & (F.col("form") == INNER)).select("doc_id", "item_id", "turn", F.lit(True).alias("barred")).distinct()
    runs = runs.where(~F.col("torn")).join(torn, ["doc_id", "item_id", "turn"], "left").where((F.col("form") == INNER) | F.col("barred").isNull())
    places = runs.groupBy("doc_id", "item_id", "whole", "item_at").agg(F.max(F.coalesce("changed", F.lit(False))).alias("changed"))
    found = places.join(items.select("item_id", "whole", "item_at", "form", "h"), ["item_id", "whole", "item_at"])
    found = found.groupBy("doc_id", "item_id", "form").agg(F.countDistinct("h").alias("matched"), F.max("changed").alias("changed")).join(sizes, ["item_id", "form"])
    best = F.max(F.struct((F.col("matched") / F.col("n_windows")).alias("containment"), (-F.col("form")).alias("form"), "matched", "n_windows")).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best, (~F.max("changed")).alias("verbatim"))
    return found.where(F.col("best.matched") >= F.lit(share) * F.col("best.n_windows")).select(
        "doc_id", "item_id", "best.matched", "best.n_windows", "best.containment", "verbatim")
