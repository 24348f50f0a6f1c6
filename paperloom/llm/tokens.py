"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut where white space follows another character: the split pattern always begins
a new match there, so a stretch has the same ids alone as inside its text.  A slice of a
batch is dictionary-encoded by stretch, each different one is encoded once, and the ids are
gathered back by index.  Nothing is shuffled; memory is bounded by a slice or one text.

The rank file is read where the plan is built and travels with the function, so executors
need the library but not the file.
"""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns, slices, text_bytes

SLICE_BYTES = 4 << 20
BATCH_ROWS = 2_000
JOINED_BYTES = 1 << 16
INT_MAX = 2**31 - 1


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes as themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {b: chr(b) for b in printable}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank (the id) of a rank file: one base64 token and one number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts the lower ranks leave of a token, which its own rank joins."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], INT_MAX))
        if ranks.get(parts[at] + parts[at + 1], INT_MAX) >= ranks[token]:
            raise ValueError(f"no merges of lower rank lead to {token!r}")
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def from_ranks(path: str, pattern: str) -> str:
    """A tokenizer, as JSON, that splits by ``pattern`` and merges by the ranks of the file; it knows no special tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, char = read_ranks(path), byte_characters()
    spelled = lambda token: "".join(char[b] for b in token)
    ordered = sorted((t for t in ranks if len(t) > 1), key=ranks.get)
    model = models.BPE({spelled(t): r for t, r in ranks.items()}, [tuple(map(spelled, last_merge(t, ranks))) for t in ordered])
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made.to_str()


def once(key: object, build: Callable[[], object]) -> object:
    """A value kept for the life of a Python worker, which runs many tasks; the newest four stay."""
    kept = sys.modules.setdefault("paperloom_worker_values", types.ModuleType("paperloom_worker_values")).__dict__.setdefault("values", {})
    if key not in kept:
        while len(kept) >= 4:
            kept.pop(next(iter(kept)))
        kept[key] = build()
    return kept[key]


class ByteTokenizer:
    """Encoder and byte table of a byte-level tokenizer, inside a task."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(spec)
        self.encoder.encode_special_tokens = True
        byte_of = {ord(c): b for b, c in enumerate(byte_characters())}
        vocab = self.encoder.get_vocab(with_added_tokens=True)
        spelled = [""] * (max(vocab.values(), default=-1) + 1)
        for token, at in vocab.items():
            spelled[at] = token
        # A special token is spelled in plain characters; those outside the table stand for themselves.
        self.table = pa.array([b"".join(bytes([byte_of[ord(c)]]) if ord(c) in byte_of else c.encode() for c in t) for t in spelled], pa.large_binary())
        self.size = np.array([len(t) for t in self.table.to_pylist()] or [0], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        made = [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int64, int(count.sum())), count

    def encode_stretches(self, different: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches.  Those that may follow each other are joined into fewer, longer texts and cut apart by their bytes."""
        data, offsets = text_bytes(different)
        first, last = data[offsets[:-1]], offsets[1:] - 1
        joins = (first == 32) | ((first >= 9) & (first <= 13))
        joins &= visible(data[last], np.where(last > offsets[:-1], data[last - 1], 0))
        together = different.filter(pa.array(joins))
        joined, ends = text_bytes(together)
        texts = [joined[ends[a]:ends[b]].tobytes().decode() for a, b in slices(ends, JOINED_BYTES)]
        ids, _ = self.encode(texts)
        bytes_before = row_offsets(self.size[ids])
        at = np.searchsorted(bytes_before, ends)
        if not np.array_equal(bytes_before[at], ends):
            raise ValueError("a token crosses a cut")
        alone, n_alone = self.encode(different.filter(pa.array(~joins)).cast(pa.large_string()).to_pylist())
        count, start = np.empty(len(different), np.int64), np.empty(len(different), np.int64)
        count[joins], count[~joins] = np.diff(at), n_alone
        start[joins], start[~joins] = at[:-1], starts_of(n_alone) + len(ids)
        return np.concatenate([ids, alone])[expand(start, count)], count


def byte_tokenizer(spec: str) -> ByteTokenizer:
    return once(("byte", hash(spec), len(spec)), lambda: ByteTokenizer(spec))


def visible(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether a character ends here that is visible ASCII or one of U+00C0 to U+07FF, none of which is white space."""
    return ((last > 32) & (last < 127)) | ((last >= 0x80) & (before >= 0xC3) & (before <= 0xDF))


def stretches(data: np.ndarray, offsets: np.ndarray, spaces_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of all rows, and how many each row has (an empty row none).

    A stretch begins with its row, and at ASCII white space whose predecessor is visible ASCII
    or a two-byte character of U+00C0 to U+07FF, none of which is white space.  ``spaces_only``
    cuts at U+0020 only, and not at the last byte of a row.
    """
    n = len(data)
    cut = data == 32
    if not spaces_only:
        cut |= (data >= 9) & (data <= 13)
    before, second = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], second[2:] = data[:-1], data[:-2]
    cut &= visible(before, second)
    if spaces_only:
        ends = offsets[1:][offsets[1:] > offsets[:-1]]
        cut[ends - 1] = False
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut[starts] = True
    at = np.flatnonzero(cut)
    return np.append(at, n), np.searchsorted(at, offsets[1:]) - np.searchsorted(at, offsets[:-1])


def distinct_stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of the different stretches each one is, and these."""
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = whole.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` for ``count[i]`` steps, one range after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - count), count)


def starts_of(count: np.ndarray) -> np.ndarray:
    return np.cumsum(count) - count


def row_offsets(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count, dtype=np.int64)])


def encode_rows(tokenizer: ByteTokenizer, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and how many each row has."""
    bounds, per_row = stretches(data, offsets)
    index, different = distinct_stretches(data, bounds)
    ids, count = tokenizer.encode_stretches(different)
    own = count[index]
    return ids[expand(starts_of(count)[index], own)], np.diff(row_offsets(own)[row_offsets(per_row)])


def character_spans(data: np.ndarray, offsets: np.ndarray, size: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last-but-one character of every token in its row, and whether it starts or ends inside a character.

    A character that several tokens share belongs to the span of each of them.
    """
    lead = (data & 0xC0) != 0x80
    before = row_offsets(lead)
    ends = np.cumsum(size)
    starts = ends - size
    base = np.repeat(before[offsets[:-1]], count)
    opens = np.append(lead, True)
    return before[starts] - ~opens[starts] - base, before[ends] - base, ~opens[starts] | ~opens[ends]


def int_lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(row_offsets(count), pa.int32()), pa.array(values, pa.int32()))


SPANS = ("char_starts", "char_ends", "n_split")


def encode_bpe(
    df: DataFrame, spec: str, text: str = "text", ids: str = "ids", spans: tuple[str, ...] = (), keep: list[str] | None = None
) -> DataFrame:
    """``df`` with the token ids of every whole text; ``spec`` is the JSON of a byte-level tokenizer.

    ``spans`` adds any of ``char_starts`` and ``char_ends`` (code points, end exclusive) and
    ``n_split``, the tokens that start or end inside a character.  A null or empty text has an
    empty list.  Strings of special tokens are plain text.  Rows, repeated ones included, stay in
    place; other columns pass, one that has the name of a new column is replaced.
    """
    numbers = T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField(c, T.LongType() if c == "n_split" else numbers, False) for c in (ids, *spans)]

    def prepare() -> Callable[[pa.Array], list[pa.Array]]:
        tokenizer = byte_tokenizer(spec)

        def compute(column: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(column)
            parts: list[list[pa.Array]] = [[] for _ in fields]
            for a, b in slices(offsets, SLICE_BYTES):
                own, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                found, count = encode_rows(tokenizer, own, at)
                made = {"ids": int_lists(found, count)}
                if spans:
                    first, last, split = character_spans(own, at, tokenizer.size[found], count)
                    made |= {"char_starts": int_lists(first, count), "char_ends": int_lists(last, count)}
                    made["n_split"] = pa.array(np.diff(row_offsets(split)[row_offsets(count)]))
                for part, name in zip(parts, ("ids", *spans)):
                    part.append(made[name])
            kinds = [pa.int64() if f.name == "n_split" else pa.list_(pa.int32()) for f in fields]
            return [pa.concat_arrays(p) if p else pa.array([], kind) for p, kind in zip(parts, kinds)]

        return compute

    return append_columns(df, text, fields, prepare, keep=keep, part_rows=BATCH_ROWS)


def decode_bpe(df: DataFrame, spec: str, ids: str = "ids", data: str = "decoded", text: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with the bytes its id lists stand for, from the reversed byte table.

    ``text`` also names a column with the characters: bytes of a character whose other tokens are
    missing from the list become U+FFFD, so any stretch of a list can be decoded, while ``data``
    keeps them.  A null list is empty; null ids and ids outside the vocabulary stand for nothing.
    """
    fields = [T.StructField(data, T.BinaryType(), False)] + ([T.StructField(text, T.StringType(), False)] if text else [])

    def prepare() -> Callable[[pa.Array], list[pa.Array]]:
        table = byte_tokenizer(spec).table

        def compute(column: pa.Array) -> list[pa.Array]:
            values = pc.list_flatten(column)
            count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = pc.fill_null(pc.and_(pc.greater_equal(values, 0), pc.less(values, len(table))), False).to_numpy(zero_copy_only=False)
            chosen = pc.fill_null(values, -1).to_numpy(zero_copy_only=False)[known]
            joined, ends = text_bytes(table.take(pa.array(chosen, pa.int64())))
            rows = ends[row_offsets(known)[row_offsets(count)]]
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(joined))])
            made = [raw.cast(pa.binary())]
            if text:
                made.append(pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string()))
            return made

        return compute

    return append_columns(df, ids, fields, prepare, keep=keep)


def batches_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a string column, a slice at a time."""
    data, offsets = text_bytes(column)
    for a, b in slices(offsets, SLICE_BYTES):
        yield data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
