"""Text columns: tokens, sentences, cleaning and display helpers.

Patterns use ``\\p{..}`` classes so that letters outside ASCII count as letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.binding import let
from paperloom.functions.lexicon import STOP_WORDS

NON_WORD = r"[^\p{L}\p{N}]+"
# Python-style white space: Java's own \s is ASCII only.
# The outer range lets plain letters fail at once.
SPACE = (
    r"[[\x{09}-\x{20}\x{85}-\x{3000}]&&"
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)


def _not_blank(token: Column) -> Column:
    return token != ""


def tokens(text: Column) -> Column:
    """Lower-case letter/digit runs, in text order, repeats kept."""
    return F.filter(F.split(F.lower(text), NON_WORD), _not_blank)


def content_tokens(text: Column) -> Column:
    """Tokens without the words a full-text query ignores; no stemming."""
    return F.filter(tokens(text), lambda t: ~t.isin(STOP_WORDS))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, SPACE + "+"), _not_blank)


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def sentences(text: Column) -> Column:
    """Split after ``. ! ?`` followed by white space; trimmed, blanks dropped."""
    parts = F.split(text, r"(?<=[.!?])" + SPACE + "+")
    return F.filter(F.transform(parts, strip), _not_blank)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def head_tokens(text: Column, n: int) -> Column:
    return F.concat_ws(" ", F.slice(words(text), 1, n))


def tail_tokens(text: Column, n: int) -> Column:
    """The last ``n`` words, or the text itself when it has no more than that."""
    all_words = words(text)
    return F.when(F.size(all_words) <= n, text).otherwise(F.concat_ws(" ", F.slice(all_words, -n, n)))


def one_line(text: Column) -> Column:
    """Line breaks become spaces, then trim: how titles and abstracts are stored."""
    return F.trim(F.translate(text, "\n", " "))


def alnum_ratio(text: Column) -> Column:
    """Share of letters and digits; null for an empty text."""
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.length(text))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def html_escape(text: Column) -> Column:
    out = text
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def contains_any(text: Column, needles: list[str]) -> Column:
    return let(text, lambda t: F.exists(string_array(needles), lambda k: F.contains(t, k)))


def matching(text: Column, needles: list[str]) -> Column:
    """The needles found in ``text``, in list order."""
    return let(text, lambda t: F.filter(string_array(needles), lambda k: F.contains(t, k)))


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def strip_prefix_ci(text: Column, prefix: str) -> Column:
    return F.regexp_replace(text, f"(?i)^{prefix}", "")


def paper_id(text: Column) -> Column:
    """Normalised paper id: the scheme prefix goes, case-insensitively."""
    return strip_prefix_ci(text, "arXiv:")


def without_version(text: Column) -> Column:
    return F.regexp_replace(text, r"v\d+$", "")


def last_path_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def safe_file_name(text: Column) -> Column:
    return F.translate(text, "/:", "__")


def share_vocabulary(left: Column, right: Column) -> Column:
    """Number of distinct words two texts have in common."""
    return F.size(F.array_intersect(words(left), words(right)))


def shingles(items: Column, n: int, glue: str) -> Column:
    """Runs of ``n`` neighbouring items joined by ``glue``.

    Built by zipping the list with its own shifts: a lambda that sliced the list
    would evaluate the list again for every position.
    """
    runs = items
    for shift in range(1, n):
        later = F.slice(items, shift + 1, F.greatest(F.size(items) - shift, F.lit(0)))
        runs = F.zip_with(runs, later, lambda a, b: F.concat(a, F.lit(glue), b))
    return F.filter(runs, lambda r: r.isNotNull())


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the lower-case text padded with blanks."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(shingles(F.split(padded, ""), 3, ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))),
        F.lit(0.0),
    )


def stable_key(text: Column) -> Column:
    """Positive 63-bit key that is the same in every process."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
