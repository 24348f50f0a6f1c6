"""English stems by suffix rules, as one column expression without Python.

The published second Porter algorithm.  Its rules are written once, as SQL text that differs between
dialects only in how a lambda and a back reference are spelled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The algorithm's exceptional forms, its unchanged words and its suffix rules, each group from the longest suffix to the shortest.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
UNCHANGED = ["sky", "news", "howe", "atlas", "cosmos", "bias", "andes"]
UNCHANGED_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
LONG_PREFIX = "gener|commun|arsen"

V, C = "[aeiouy]", "[^aeiouy]"
SHORT_END = f"({C}{V}[^aeiouywxY]|^{V}{C})$"


@dataclass(frozen=True)
class Dialect:
    first: Callable[[str, str, str], str]  # value, variable, body: the body for one value
    matches: Callable[[str, str], str]
    replace: Callable[[str, str, str], str]  # all matches; \1 is the first group


SPARK = Dialect(
    lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]",
    lambda w, p: f"({w} rlike '{p}')",
    lambda w, p, r: "regexp_replace({}, '{}', '{}')".format(w, p, r.replace("\\1", "$1")),
)
DUCKDB = Dialect(
    lambda value, name, body: f"list_transform([{value}], lambda {name}: {body})[1]",
    lambda w, p: f"regexp_matches({w}, '{p}')",
    lambda w, p, r: f"regexp_replace({w}, '{p}', '{r}', 'g')",
)


def _cut(w: str, n: int, add: str = "") -> str:
    kept = f"left({w}, length({w}) - {n})" if n else w
    return f"concat({kept}, '{add}')" if add else kept


def _region(w: str, d: Dialect, second: bool = False) -> str:
    """Where the first or second region starts; beyond any word if there is none."""
    more = f"{C}*{V}+{C}" if second else ""
    plain, prefixed = f"^{C}*{V}+{C}{more}", f"^({LONG_PREFIX}){more}"
    size = lambda p: f"CASE WHEN {d.matches(w, p)} THEN length(regexp_extract({w}, '{p}', 0)) ELSE 9999 END"
    return f"(CASE WHEN {d.matches(w, f'^({LONG_PREFIX})')} THEN {size(prefixed)} ELSE {size(plain)} END)"


def _inside(w: str, n: int, d: Dialect, second: bool = False) -> str:
    return f"length({w}) - {n} >= {_region(w, d, second)}"


def _first_suffix(w: str, rules: list[tuple[str, str]]) -> str:
    """The action of the longest suffix a word ends with; others leave it as it is."""
    return "CASE " + " ".join(f"WHEN {w} LIKE '%{suffix}' THEN {action}" for suffix, action in rules) + f" ELSE {w} END"


def _steps(d: Dialect) -> list[Callable[[str], str]]:
    def when(condition: str, then: str, w: str) -> str:
        return f"CASE WHEN {condition} THEN {then} ELSE {w} END"

    def consonant_y(w: str) -> str:
        return d.replace(d.replace(w, "^y", "Y"), "([aeiouy])y", "\\1Y")

    def plural(w: str) -> str:
        ie = f"CASE WHEN length({w}) > 4 THEN {_cut(w, 2)} ELSE {_cut(w, 1)} END"
        return _first_suffix(w, [("sses", _cut(w, 2)), ("ied", ie), ("ies", ie), ("us", w), ("ss", w), ("s", when(d.matches(w, f"{V}.+s$"), _cut(w, 1), w))])

    def past(w: str) -> str:
        def cut(n: int) -> str:
            stem = _cut(w, n)
            mended = (
                f"CASE WHEN {d.matches('x', '(at|bl|iz)$')} THEN concat(x, 'e') WHEN {d.matches('x', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN {_cut('x', 1)} "
                f"WHEN {d.matches('x', SHORT_END)} AND length(x) <= {_region('x', d)} THEN concat(x, 'e') ELSE x END"
            )
            return when(d.matches(stem, V), d.first(stem, "x", mended), w)

        ee = lambda n: when(_inside(w, n, d), _cut(w, n - 2), w)
        done = ", ".join(f"'{x}'" for x in UNCHANGED_AFTER_PLURAL)
        rules = [("eedly", ee(5)), ("ingly", cut(5)), ("edly", cut(4)), ("eed", ee(3)), ("ing", cut(3)), ("ed", cut(2))]
        return when(f"{w} IN ({done})", w, _first_suffix(w, rules))

    def final_y(w: str) -> str:
        return when(d.matches(w, f"^.+{C}[yY]$"), _cut(w, 1, "i"), w)

    def step_2(w: str) -> str:
        rules = [(s, when(_inside(w, len(s), d), _cut(w, len(s), to), w)) for s, to in STEP_2]
        rules.append(("ogi", when(f"{w} LIKE '%logi' AND {_inside(w, 3, d)}", _cut(w, 1), w)))
        rules.append(("li", when(f"{d.matches(w, '[cdeghkmnrt]li$')} AND {_inside(w, 2, d)}", _cut(w, 2), w)))
        return _first_suffix(w, rules)

    def step_3(w: str) -> str:
        rules = [(s, when(_inside(w, len(s), d), _cut(w, len(s), to), w)) for s, to in STEP_3]
        rules.insert(2, ("ative", when(_inside(w, 5, d, second=True), _cut(w, 5), w)))
        return _first_suffix(w, rules)

    def step_4(w: str) -> str:
        rules = [(s, when(_inside(w, len(s), d, second=True), _cut(w, len(s)), w)) for s in STEP_4]
        rules.insert(6, ("ion", when(f"{d.matches(w, '[st]ion$')} AND {_inside(w, 3, d, second=True)}", _cut(w, 3), w)))
        return _first_suffix(w, rules)

    def final_letter(w: str) -> str:
        e = when(f"{_inside(w, 1, d, second=True)} OR ({_inside(w, 1, d)} AND NOT {d.matches(_cut(w, 1), SHORT_END)})", _cut(w, 1), w)
        return _first_suffix(w, [("e", e), ("ll", when(_inside(w, 1, d, second=True), _cut(w, 1), w))])

    return [consonant_y, plural, past, final_y, step_2, step_3, step_4, final_letter]


def stem_sql(word: str, d: Dialect) -> str:
    """SQL text for the stem of a lower-case word; words of one or two letters stay."""
    value = word
    for i, step in enumerate(_steps(d)):
        value = d.first(value, f"s{i}", step(f"s{i}"))
    fixed = " ".join(f"WHEN {word} = '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())
    same = ", ".join(f"'{x}'" for x in UNCHANGED)
    return f"CASE WHEN length({word}) < 3 OR {word} IN ({same}) THEN {word} {fixed} ELSE lower({value}) END"


def stems(words: str) -> Column:
    """Stems of an ``array<string>`` column of lower-case words, named ``words``; repeats stay."""
    return F.expr(f"transform({words}, w -> {stem_sql('w', SPARK)})")


def stems_of(word: str) -> Column:
    """The stem of a string column of lower-case words."""
    return F.expr(stem_sql(f"`{word}`", SPARK))
