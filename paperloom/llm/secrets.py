"""Secret scan: keyword automaton, anchored patterns at its hits, checksums on what they find."""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns

# Kinds in the order of the report, keywords that open a candidate, patterns anchored there.
KINDS = ("assign", "access", "hex", "github", "npm", "iban", "card")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "iban": ("iban",),
    "card": ("card", "visa", "mastercard"),
}
PATTERNS = {
    "assign": r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "npm": r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "iban": r"(?ai:iban)[:=\x20]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])",
    "card": r"(?ai:mastercard|visa|card)[^0-9\n]{1,16}([0-9](?:[\x20-]?[0-9]){12,18})(?![0-9])",
}
HEX = r"[0-9a-f]{32,}"
SHORTEST_VALUE, SHORTEST_ACCESS = 8, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def crc_token(body: str) -> bool:
    """The last six base-62 digits are the CRC-32 of what stands before them."""
    value = 0
    for digit in body[-6:]:
        value = value * 62 + BASE62.index(digit)
    return value == zlib.crc32(body[:-6].encode())


def luhn(digits: str) -> bool:
    """The Luhn sum; a row of one digit repeated is no card number."""
    numbers = [int(c) for c in digits if c.isdigit()][::-1]
    return len(set(numbers)) > 1 and (sum(numbers[::2]) + sum(sum(divmod(2 * n, 10)) for n in numbers[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    compact = account.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= SHORTEST_VALUE
    if kind == "access":
        return match.end() - match.start() >= SHORTEST_ACCESS
    if kind in ("github", "npm"):
        return crc_token(match[1])
    return luhn(match[1]) if kind == "card" else mod97(match[1])


def machine() -> tuple:
    """The keyword automaton (values: keyword length and kind) and the compiled patterns."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for key in keys:
            automaton.add_word(key, (len(key), kind))
    automaton.make_automaton()
    return automaton, {k: re.compile(p) for k, p in PATTERNS.items()}, re.compile(HEX)


def find(text: str | None, tools: tuple) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, sorted; leftmost and non-overlapping per kind.

    A candidate that fails its length or checksum still uses up its characters, as a
    scan with the bare pattern would.  Offsets count code points.
    """
    if not text:
        return []
    automaton, patterns, hexes = tools
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered: lower A-Z alone, so that offsets hold
        low = text.translate(_LOWER)
    found = [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
    free = dict.fromkeys(KEYWORDS, 0)
    hits = sorted({(end + 1 - length, kind) for end, (length, kind) in automaton.iter(low)})
    for start, kind in hits:
        if start < free[kind] or not (match := patterns[kind].match(text, start)):
            continue
        free[kind] = match.end()
        if accepted(kind, match):
            found.append((start, KINDS.index(kind), match.end()))
    return sorted(found)


def redacted(text: str | None, found: list[tuple[int, int, int]], mark: str) -> str | None:
    """``text`` with the union of the spans replaced, one mark per run."""
    if not found:
        return text
    out, stop = [], 0
    for i, (start, _, end) in enumerate(found):
        if i == 0 or start > stop:
            out += [text[stop:start], mark]
        stop = max(stop, end)
    return "".join([*out, text[stop:]])


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, text: str = "text", found: str = "secrets", clean: str | None = None, mark: str = "[SECRET]", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a column of its secrets (start, kind, end) and, if named, one of the redacted text.

    Row-wise, without a shuffle.  A null or empty text has no secrets and stays as it
    is; repeated rows are scanned alike; an empty table gives an empty one; a column
    already named like a new one is replaced.  Texts are scanned whole.
    """
    fields = [T.StructField(found, SPAN)] + ([T.StructField(clean, T.StringType())] if clean else [])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def prepare():
        tools = machine()

        def compute(column: pa.Array) -> list[pa.Array]:
            texts = column.to_pylist()
            spans = [find(t, tools) for t in texts]
            out = [pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in x] for x in spans], kind)]
            return out + ([pa.array([redacted(t, x, mark) for t, x in zip(texts, spans)], pa.string())] if clean else [])

        return compute

    return append_columns(df, text, fields, prepare, keep)


def digest(found: str = "secrets") -> list:
    """Counts, hash and listing of the found spans, as plain column expressions."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("s"), F.array_position(kinds, s.kind).alias("k"), s.end.alias("e"))))

    def listing(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.k.cast("int")), s.s.cast("string"), s.e.cast("string"))))

    def count(kind):
        return F.size(F.filter(found, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = listing(F.filter(ordered, lambda s: s.k <= 3))
    return [count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listing(ordered).alias("spans")]


def brute_digest(text: str | None) -> tuple[int, int, int, str]:
    """The contract's base spans straight from its patterns, for tests."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(PATTERNS["assign"], text) if len(m[1]) >= SHORTEST_VALUE]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(PATTERNS["access"], text) if m.end() - m.start() >= SHORTEST_ACCESS]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    n = [sum(k == x for _, k, _ in spans) for x in range(3)]
    return (*n, sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans)).encode()).hexdigest())
