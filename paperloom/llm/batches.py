"""Whole texts of an Arrow batch as one byte array, and hashes over it.

Everything here runs inside tasks.  A batch is cut into slices of a few megabytes
(a single longer text is a slice of its own), which bounds the memory of a task by
the slice and the longest text, never by the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
PART_ROWS = 500

# Odd multipliers of the hashes and the finalizer of the public splitmix64 generator.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its ``n + 1`` offsets; a null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``budget`` bytes, or of one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1)
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection, so it never joins two of them."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def byte_values(lower: bool = False) -> np.ndarray:
    """A random-looking 64-bit value per byte; ``lower`` gives A-Z the values of a-z."""
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return mix(code + np.uint64(_BASE))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2**64 for ``i`` up to ``n``."""
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every range, from one prefix sum."""
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every ``[^\\x20\\x09-\\x0D]+`` word; words never cross rows."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    now = np.zeros(len(data) + 1, bool)
    now[:-1] = inside
    starts = np.flatnonzero(now & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~now))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first word and size of every run of ``width`` words; a shorter row is one run as a whole."""
    size = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(size)])
    span = np.minimum(size, width)
    count = np.where(size > 0, size - span + 1, 0)
    row = np.repeat(np.arange(n_rows), count)
    start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    out = span[row].astype(np.uint64)
    for k in range(width):
        part = np.zeros(len(row), np.uint64)
        has = span[row] > k
        part[has] = hashes[start[has] + k]
        out = mix(out * np.uint64(_BASE) + part)
    return out, row, start, span[row]


def append_columns(
    df: DataFrame, text: str, fields: list[T.StructField], prepare: Callable, keep: list[str] | None = None, part_rows: int = PART_ROWS
) -> DataFrame:
    """Rows of ``df`` (its ``keep`` columns, or all) with computed columns.

    ``prepare()`` runs once in each task and returns a function that gets the string
    column of one batch as an Arrow array and returns one Arrow array per field.  Rows stay in place: no shuffle, and repeated keys, nulls
    and any other columns pass unchanged.  A new column replaces one of its own name.
    """
    names = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([*source.schema.fields, *fields])
    width = len(kept)
    at = kept.index(text) if text in kept else width
    if at == width:
        source = df.select(*[f"`{c}`" for c in kept], df[f"`{text}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for whole in batches:
            for start in range(0, whole.num_rows, part_rows):  # few texts at a time as Python objects
                batch = whole.slice(start, part_rows)
                made = compute(batch.column(at))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*kept, *[f.name for f in fields]])

    return source.mapInArrow(run, schema)
