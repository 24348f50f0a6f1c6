"""Toxicity: a learned lexicon searched with edit distance, and the context of each hit."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.batches import append_columns
from paperloom.operators.ranking import top_k
from paperloom.session import cut_lineage

WORD = re.compile(r"[^\W\d_]+")
# Letters with one or two digits or signs between them: a word may be disguised by them.
CHAIN = re.compile(r"[^\W\d_]+(?:[\d_*@$#!+.^~|%&'’-]{1,2}[^\W\d_]+)+")
DISGUISE = re.compile(r"[\d_*@$#!+^~|%&]")
CONTEXT = 40
SHORTEST, SHORTEST_STEM, LONGEST = 3, 4, 7  # letters of a word at least, of a beginning at least and at most
MEMORY = 150_000  # words remembered by a task
# Marks of a quotation, verbs that report speech, words that address the reader, and their factors.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›"}
REPORTING = frozenset("said says wrote writes called quoted quote term word sagte schrieb dit écrit dijo escribió".split())
ADDRESS = frozenset("you your youre ye du ihr dich dein tu vous toi tú vosotros".split())
QUOTED, REPORTED, ADDRESSED = 0.55, 0.8, 1.1


@dataclass(frozen=True)
class Lexicon:
    """Terms (whole words) and stems (word beginnings) with the share of toxic documents among those that hold them.

    ``fuzzy`` has the factor of a near miss by (entry, distance) and ``trust`` that of
    entries of which no near miss was seen; ``base`` is the score without any hit.
    """

    terms: dict[str, float]
    stems: dict[str, float]
    fuzzy: dict[tuple[str, int], float] = field(default_factory=dict)
    trust: float = 0.9
    base: float = 0.05


def allowed(length: int) -> int:
    """Edits forgiven in a term: none below five letters, one, and two from nine letters."""
    return 0 if length < 5 else 1 if length < 9 else 2


def entries_of(text: str) -> set[tuple[str, bool]]:
    """The words of a text and their beginnings, as (letters, is a beginning)."""
    found = {w for w in set(WORD.findall(text.lower())) if len(w) >= SHORTEST}
    return {(w, False) for w in found if len(w) <= 40} | {(w[:n], True) for w in found for n in range(SHORTEST_STEM, min(len(w), LONGEST) + 1)}


class Matcher:
    """A Levenshtein automaton run along the lexicon trie.

    The state after a trie path is one row of edit distances between that path and
    every beginning of the word; a branch is left when the row holds nothing within
    the edits that any entry below it allows, so a word visits a thin strip of the trie.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.trie: dict = {}
        for word in lexicon.terms:
            self._put(word, ("term", word))
        for word in lexicon.stems:
            self._put(word, ("stem", word))
        # An edit budget of k leaves one of k + 1 equal parts of an entry intact: the first at the start of the
        # word, the last at the end of it (a stem's: near its place), the middle one of three shifted by one at most.
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        self.places: dict[tuple[int, int], set[str]] = {}
        for word in [*lexicon.terms, *lexicon.stems]:
            k, n = allowed(len(word)), len(word)
            if not k:
                self.places.setdefault((0, n), set()).add(word)
                continue
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            self.heads.setdefault(cuts[1], set()).add(word[:cuts[1]])
            if word in lexicon.terms:
                self.tails.setdefault(n - cuts[k], set()).add(word[cuts[k]:])
            for i in range(1, k + 1):
                if i < k or word in lexicon.stems:
                    for shift in range(-k, k + 1) if i == k else (-1, 0, 1):
                        self.places.setdefault((cuts[i] + shift, cuts[i + 1] - cuts[i]), set()).add(word[cuts[i]:cuts[i + 1]])
        # A longer word differs from every term and equals none of its own beginnings' matches: the rest is not looked at.
        self.longest = max((len(w) for w in [*lexicon.terms, *lexicon.stems]), default=0) + 3
        self.memory: dict[str, tuple | None] = {}
        self.clean: set[str] = set()
        # Four letters forgive no edit, but a sign in place of an inner letter is no other word.
        self.masked: dict[str, tuple[str, bool]] = {}
        for stem, entries in ((True, lexicon.stems), (False, lexicon.terms)):
            self.masked |= {f"{w[:i]}?{w[i + 1:]}": (w, stem) for w in sorted(entries) if len(w) == 4 for i in (1, 2)}

    def _put(self, word: str, value: tuple) -> None:
        node = self.trie
        for letter in word:
            node = node.setdefault(letter, {})
            node[0] = max(node.get(0, 0), allowed(len(word)))  # the most edits forgiven below
        node.setdefault("", []).append(value)

    def candidate(self, word: str) -> bool:
        """Cheap and complete: false only for words that no entry can match."""
        for n, known in self.heads.items():
            if word[:n] in known:
                return True
        for n, known in self.tails.items():
            if word[-n:] in known:
                return True
        for (at, n), known in self.places.items():
            if word[at:at + n] in known:
                return True
        return False

    def matching(self, words: set[str]) -> set[str]:
        """Those of ``words`` that match an entry; the others are remembered as a set, so a text of known words costs one difference."""
        left = words - self.clean
        found = {w for w in left if self.search(w)}
        if len(self.clean) >= MEMORY:
            self.clean.clear()
        self.clean |= left - found
        return found

    def search(self, word: str) -> tuple[float, int, str] | None:
        """(share, distance, entry) of the best entry that ``word`` matches; words seen before are remembered."""
        if len(word) < SHORTEST:
            return None
        memory = self.memory
        if word not in memory:
            if len(memory) >= MEMORY:
                memory.clear()
            memory[word] = self._search(word) if self.candidate(word) else None
        return memory[word]

    def disguised(self, chain: str) -> list[tuple[int, int, tuple[float, int, str]]]:
        """(start, end, found) of what a chain of letters and signs hides; its plain words are not looked at.

        Every stretch of its pieces is tried as it is, each sign an edit, and with the
        signs removed.  Signs that join words anyway (``.``, ``-``, apostrophes) are only removed, and then the rest has to match exactly.
        """
        pieces = [m.span() for m in WORD.finditer(chain)]
        out, free = [], 0
        for i, (start, _) in enumerate(pieces[:-1]):
            if start < free:
                continue
            best, bare = None, chain[slice(*pieces[i])]
            if self.search(bare):
                continue
            for a, b in pieces[i + 1:]:
                if len(bare) >= self.longest or self.search(chain[a:b]):
                    break
                bare += chain[a:b]
                whole = chain[start:b]
                found = self.search(bare)
                if DISGUISE.search(whole):
                    found = max((f for f in (found, self.search(whole), self._unmasked(whole)) if f), default=None, key=lambda f: (f[0], -f[1], f[2]))
                elif found and found[1]:
                    found = None
                if found and (best is None or (found[0], -found[1]) > (best[1][0], -best[1][1])):
                    best = (b, found)
            if best:
                out.append((start, *best))
                free = best[0]
        return out

    def _unmasked(self, whole: str) -> tuple[float, int, str] | None:
        """The entry of four letters of which one inner letter is a sign here."""
        mask = DISGUISE.sub("?", whole[:4])
        entry, stem = self.masked.get(mask, ("", False))
        if not entry or len(whole) > 4 and not stem:
            return None
        exact = (self.lexicon.stems if stem else self.lexicon.terms)[entry]
        return exact * self.lexicon.fuzzy.get((entry, 1), self.lexicon.trust), 1, entry

    def _search(self, word: str) -> tuple[float, int, str] | None:
        """Walk the trie with the automaton."""
        best: tuple[float, int, str] | None = None
        word = word[:self.longest]
        stack = [(self.trie, tuple(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for kind, entry in node.get("", ()):
                distance = row[-1] if kind == "term" else min(row[max(0, len(entry) - 2):])
                if distance <= allowed(len(entry)):
                    exact = (self.lexicon.terms if kind == "term" else self.lexicon.stems)[entry]
                    share = exact if distance == 0 else exact * self.lexicon.fuzzy.get((entry, distance), self.lexicon.trust)
                    if best is None or (share, -distance, entry) > (best[0], -best[1], best[2]):
                        best = (share, distance, entry)
            for letter, child in node.items():
                if letter:
                    down = [row[0] + 1]
                    for i, mine in enumerate(word):
                        down.append(min(down[-1] + 1, row[i + 1] + 1, row[i] + (mine != letter)))
                    if min(down) <= child[0]:
                        stack.append((child, tuple(down)))
        return best


def quoted_ranges(text: str) -> list[tuple[int, int]]:
    """Stretches of at most 300 characters between a pair of quotation marks on one line."""
    found, at = [], 0
    while at < len(text):
        close = QUOTES.get(text[at])
        end = text.find(close, at + 1, at + 300) if close else -1
        if end > 0 and "\n" not in text[at:end]:
            found.append((at, end))
            at = end
        at += 1
    return found


def hits(text: str, matcher: Matcher) -> list[tuple[int, int, float, int]]:
    """(start, end, share after context, distance) of every word that matches the lexicon."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lowered: lower A-Z alone, so that offsets hold
        low = text.translate({c: c + 32 for c in range(65, 91)})
    known = matcher.matching(set(WORD.findall(low)))
    hidden = [(m.start() + a, m.start() + b, found) for m in CHAIN.finditer(low) for a, b, found in matcher.disguised(m[0])]
    if not known and not hidden:
        return []
    quotes = quoted_ranges(low) if any(q in low for q in QUOTES) else []
    out = []
    plain = [(m.start(), m.end(), matcher.search(m[0])) for m in WORD.finditer(low) if m[0] in known]
    for start, end, (share, distance, _) in sorted(plain + hidden):
        near = set(WORD.findall(low, max(0, start - CONTEXT), start + CONTEXT))
        if any(a < start < b for a, b in quotes):
            share *= QUOTED
        elif near & REPORTING and (low[start - 1:start] in "'‘*_" or low[end:end + 1] in "'’*_"):
            share *= REPORTED
        elif near & ADDRESS:
            share = min(1.0 - (1.0 - share) ** ADDRESSED, 0.999)
        out.append((start, end, share, distance))
    return out


def toxicity_of(text: str | None, matcher: Matcher) -> tuple[float, list]:
    """Score and hits of one text; abuse adds up, quotation does not."""
    found = hits(text or "", matcher)
    if not found:
        return matcher.lexicon.base, found
    clear = np.prod([1.0 - s for _, _, s, _ in found if s > QUOTED])
    return float(max(1.0 - clear, max(s for _, _, s, _ in found), matcher.lexicon.base)), found


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fold: Column | None = None,
        per_class: int = 4000, max_entries: int = 1000, support: int = 8, precision: float = 0.9) -> Lexicon:
    """Learn the lexicon from at most ``per_class`` labelled documents of each class.

    The sample is bounded by ``per_class`` and drawn by a hash of the key, so reruns
    agree.  Kept are words and word beginnings found in at least ``support`` toxic
    documents, which are at least ``precision`` of all their documents and one more, at most
    ``max_entries`` of either, by support.  A beginning must stand for three different
    words.  Of these, entries are taken greedily while they explain two toxic documents
    that no earlier one explains, and wherever they have a quarter of the largest
    support: words that merely share a copied document with an abuse are left out.
    Equal texts count once.  Rows with a null key, label or text are not learned from; of a key labelled
    twice the larger label counts.  Without labels the lexicon is empty.
    """
    wanted = labels.select(labels[f"`{key}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("toxic")).where("key IS NOT NULL AND toxic IS NOT NULL")
    wanted = wanted.where(fold if fold is not None else F.lit(True)).groupBy("key").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("key", F.lit(29))
    picked = top_k(wanted.where("toxic = 1"), per_class, order, F.col("key")).unionAll(top_k(wanted.where("toxic <> 1"), per_class, order, F.col("key")))
    texts = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text")).where("text IS NOT NULL")
    # At most two times ``per_class`` keys, whatever the table.
    sample = cut_lineage(texts.join(F.broadcast(picked), "key").groupBy(F.sha2("text", 256).alias("key")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic = total.get(1, 0)
    if not n_toxic:
        return Lexicon({}, {})
    toxic, clean = sample.where("toxic = 1").select("key", "text"), sample.where("toxic <> 1").select("key", "text")

    def tally(df: DataFrame, among: frozenset | None) -> DataFrame:
        """Documents per entry (only ``among`` these, if given), added up in each task before the shuffle."""
        shared = None if among is None else df.sparkSession.sparkContext.broadcast(among)

        def run(batches):
            seen: Counter = Counter()
            for batch in batches:
                for t in batch.column(1).to_pylist():
                    seen.update(entries_of(t) if shared is None else entries_of(t) & shared.value)
            names, counts = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([e for e, _ in names], pa.string()), pa.array([s for _, s in names], pa.bool_()), pa.array(counts, pa.int64())], names=["entry", "stem", "n"])

        return df.mapInArrow(run, "entry string, stem boolean, n long").groupBy("entry", "stem").agg(F.sum("n").alias("n"))

    # Everything collected here is bounded by the sample.
    bad = {(r["entry"], r["stem"]): r["n"] for r in tally(toxic, None).where(F.col("n") >= support).collect()}
    fine = {(r["entry"], r["stem"]): r["n"] for r in tally(clean, frozenset(bad)).collect()}
    good = [e for e, n in bad.items() if n / (n + fine.get(e, 0) + 1) >= precision]
    good = [e for stem in (False, True) for e in sorted((x for x in good if x[1] == stem), key=lambda e: (-bad[e], e))[:max_entries]]
    share = {e: (bad[e] + 0.5) / (bad[e] + fine.get(e, 0) + 1.0) for e in good}
    known = sample.sparkSession.sparkContext.broadcast(frozenset(good))

    def places(batches):
        """(entry, document) for the chosen entries, and (entry, word) for the words a beginning stands for."""
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(e, s, key, False) for e, s in entries_of(t) & known.value]
                rows += [(w[:n], True, w, True) for w in set(WORD.findall(t.lower())) for n in range(SHORTEST_STEM, min(len(w), LONGEST) + 1) if (w[:n], True) in known.value]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.bool_(), pa.string(), pa.bool_()))], names=["entry", "stem", "value", "form"])

    found = toxic.mapInArrow(places, "entry string, stem boolean, value string, form boolean").distinct().collect()
    where: dict[tuple, set] = {}
    forms: Counter = Counter()
    for r in found:
        if r["form"]:
            forms[r["entry"]] += 1
        else:
            where.setdefault((r["entry"], r["stem"]), set()).add(r["value"])
    left = {e: docs for e, docs in where.items() if not e[1] or forms[e[0]] >= 3}
    strong = max((len(d) for d in left.values()), default=0) / 4
    whole: dict[str, float] = {}
    kept: dict[str, float] = {}
    explained: set = set()
    while left:
        best = max(left, key=lambda e: (len(left[e]) * share[e], not e[1], len(e[0]), e[0]))
        # Of beginnings that stand for the same documents the longest says most.
        best = max((e for e in left if e == best or best[1] and e[1] and e[0].startswith(best[0]) and len(where[e]) >= 0.97 * len(where[best])), key=lambda e: (len(e[0]), len(where[e]), e[0]))
        explained |= left.pop(best)
        (kept if best[1] else whole)[best[0]] = share[best]
        same = {e for e in left if (e[0].startswith(best[0]) or best[0].startswith(e[0])) and len(where[e] - where[best]) <= 0.1 * len(where[e])}
        left = {e: rest if len(where[e]) < strong else docs for e, docs in left.items() if e not in same and (len(rest := docs - explained) >= 2 or len(where[e]) >= strong)}
    rough = Lexicon(whole, kept, trust=1.0)

    # How far near misses can be trusted, and how toxic documents without any hit are, from the same sample.
    shared = sample.sparkSession.sparkContext.broadcast(vars(rough))

    def prepare():
        matcher = Matcher(Lexicon(**shared.value))

        def matched(column: pa.Array) -> list[pa.Array]:
            out = []
            for t in column.to_pylist():
                low = t.lower()
                found = [matcher.search(w) for w in set(WORD.findall(low))] + [f for c in set(CHAIN.findall(low)) for _, _, f in matcher.disguised(c)]
                out.append(sorted({f"{f[1]}{f[2]}" for f in found if f}) or ["9"])
            return [pa.array(out, pa.list_(pa.string()))]

        return matched

    seen = append_columns(sample, "text", [T.StructField("hits", T.ArrayType(T.StringType()))], prepare, ["toxic"])
    by_hit = seen.select("toxic", F.explode("hits").alias("hit")).groupBy("hit").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    table = {r["hit"]: (r["bad"], r["n"]) for r in by_hit.collect()}  # at most three rows per lexicon entry
    # A prior of nine abuses in ten near misses, outweighed by counter-examples.
    fuzzy = {(hit[1:], int(hit[0])): (bad + 2.7) / (n + 3) for hit, (bad, n) in table.items() if hit[0] in "12"}
    bad, n = table.get("9", (0, 0))
    return Lexicon(whole, kept, fuzzy, 0.9, min(0.3, (bad + 0.5) / (n + 1.0)))


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "toxicity", spans: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` with a score from 0 to 1 and, if named, the hits (start, end, score, distance).

    Row-wise over whole texts, without a shuffle.  A null or empty text scores the base
    rate of documents without hits; equal texts score alike; an empty table gives an
    empty one; a column already named like a new one is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(lexicon))
    hit = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("distance", T.IntegerType())])
    fields = [T.StructField(score, T.DoubleType())] + ([T.StructField(spans, T.ArrayType(hit))] if spans else [])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("distance", pa.int32())]))

    def prepare():
        matcher = Matcher(Lexicon(**shared.value))

        def compute(column: pa.Array) -> list[pa.Array]:
            found = [toxicity_of(t, matcher) for t in column.to_pylist()]
            out = [pa.array([s for s, _ in found], pa.float64())]
            return out + ([pa.array([[{"start": a, "end": b, "score": s, "distance": d} for a, b, s, d in h] for _, h in found], kind)] if spans else [])

        return compute

    return append_columns(df, text, fields, prepare, keep)
