"""LaTeX cleaning and extraction as regular-expression columns.

The order of the cleaning steps is part of the result and is kept as a list of
steps; texts without a back-slash, brace, dollar or quote mark skip the chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import SPACE, strip

# Commands removed with their argument, in removal order.
DROP_WITH_ARGUMENT = [
    "cite", "citep", "citet", "citeauthor", "citeyear", "ref", "eqref", "pageref", "autoref", "Cref", "cref", "label",
    "footnote", "thanks", "marginpar",
]
DROP_FILES = [r"includegraphics(?:\[[^\]]*\])?", "input", "include"]

# Layout commands removed on their own, in removal order.
DROP_LAYOUT = [
    "noindent", "indent", r"par\b", "newline", "linebreak", "pagebreak", "newpage", "clearpage", "hfill", "vfill",
    r"hspace\{[^}]*\}", r"vspace\{[^}]*\}", "smallskip", "medskip", "bigskip", "centering", "raggedright", "raggedleft",
]

# Formatting commands whose argument stays, in order.
UNWRAP = [
    "textbf", "textit", "emph", "texttt", "textrm", "textsf", "textsc", "underline", r"textcolor\{[^}]*\}",
    r"colorbox\{[^}]*\}", "mbox", "hbox", "vbox", "fbox", r"makebox(?:\[[^\]]*\])?", r"parbox(?:\[[^\]]*\])?\{[^}]*\}",
    r"raisebox\{[^}]*\}(?:\[[^\]]*\])?", r"scalebox\{[^}]*\}", r"resizebox\{[^}]*\}\{[^}]*\}", r"rotatebox\{[^}]*\}",
    "phantom", "hphantom", "vphantom",
]

# Literal replacements in order; escapes carry two back-slashes, as
# the tables this must agree with do, so a single escaped percent stays.
REPLACEMENTS = [
    (r"\\%", "%"), (r"\\&", "&"), (r"\\#", "#"), (r"\\_", "_"), (r"\\$", "$"), (r"\\{", "{"), (r"\\}", "}"),
    (r"\\textbackslash", "\\"), (r"\\textasciitilde", "~"), (r"\\textasciicircum", "^"),
    (r"\\ldots", "..."), (r"\\dots", "..."), (r"\\cdots", "..."),
    ("---", "\u2014"), ("--", "\u2013"), ("``", '"'), ("''", '"'), ("`", "'"), ("~", " "),
]


def _sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _tidy(text: Column) -> Column:
    text = _sub(text, r"[ \t]+", " ")
    text = _sub(text, r"\n{3,}", "\n\n")
    return strip(_sub(text, f"(?m)^{SPACE}+", ""))


def clean(text: Column) -> Column:
    """LaTeX text to plain text; null gives an empty text."""
    out = text
    for name in DROP_WITH_ARGUMENT + DROP_FILES:
        out = _sub(out, rf"\\{name}\{{[^}}]*\}}", "")
    for name in DROP_LAYOUT:
        out = _sub(out, rf"\\{name}", "")
    for name in UNWRAP:
        out = _sub(out, rf"\\{name}\{{([^}}]*)\}}", "$1")
    for _ in range(3):
        out = _sub(out, r"\\[a-zA-Z]+(?:\[[^\]]*\])?\{([^{}]*)\}", "$1")
    out = _sub(out, rf"\\[a-zA-Z]+(?:\[[^\]]*\])?(?={SPACE}|$|[^a-zA-Z{{])", "")
    out = _replace_all(out, REPLACEMENTS)
    out = _sub(out, "``([^']+)''", '"$1"')
    out = _sub(out, "`([^']+)'", "'$1'")
    out = _sub(out, r"\$([^$]+)\$", "$1")
    out = _sub(out, r"\\\(([^)]+)\\\)", "$1")
    out = _sub(out, rf"\{{{SPACE}*\}}", "")
    out = F.translate(out, "{}", "")
    marked = F.rlike(text, F.lit(r"[\\{}$`~]|--|''"))
    return F.coalesce(F.when(marked, _tidy(out)).otherwise(_tidy(text)), F.lit(""))


def section_title(title: Column) -> Column:
    out = _sub(clean(title), rf"^[\p{{Nd}}.]+{SPACE}*", "")
    return strip(_sub(out, "[.:;,]+$", ""))


def paper_title(title: Column) -> Column:
    out = _sub(title, r"(?<!\\)%[^\n]*\n?", "")
    out = clean(_sub(out, f"{SPACE}+", " "))
    out = _sub(out, f"^(?:[:\\-\u2013\u2014]|{SPACE})+", "")
    out = _sub(out, f"(?:[:\\-\u2013\u2014]|{SPACE})+$", "")
    return strip(_replace_all(out, [("\\", ""), ("  ", " ")]))


def equation(latex: Column) -> Column:
    out = _sub(latex, r"\\begin\{(equation|align|gather|multline)\*?\}", "")
    out = _sub(out, r"\\end\{(equation|align|gather|multline)\*?\}", "")
    out = _sub(out, r"\\label\{[^}]*\}", "")
    return F.coalesce(strip(_sub(out, f"{SPACE}+", " ")), F.lit(""))


def plain_text(latex: Column) -> Column:
    """Aggressive extraction: environments and all commands go first."""
    out = _sub(latex, r"(?s)\\begin\{[^}]*\}.*?\\end\{[^}]*\}", "")
    out = _sub(out, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{[^}]*\})?", "")
    return strip(F.translate(clean(out), "\\{}", ""))


def caption(text: Column) -> Column:
    """Caption text without its "Figure N:" prefix."""
    out = _sub(clean(text), rf"(?i)^(?:Figure|Fig\.?){SPACE}*\p{{Nd}}+[.:]{SPACE}*", "")
    return F.coalesce(strip(out), F.lit(""))


def math_heavy(text: Column, threshold: float = 0.3) -> Column:
    """More math marks than the threshold allows per word; no words at all counts as heavy."""
    from paperloom.functions.text import word_count

    marks = F.regexp_count(text, F.lit(r"\$|\\\(|\\\)|\\\[|\\\]|\\begin\{"))
    n = word_count(text)
    empty = text.isNull() | (F.length(text) == 0)
    return F.when(empty, F.lit(False)).when(n == 0, F.lit(True)).otherwise(marks / n > threshold)


def first_group(text: Column, pattern: str) -> Column:
    """First capture of the first match, or null when there is none."""
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def include_names(content: Column) -> Column:
    """File names of all input/include commands, in text order."""
    return F.regexp_extract_all(content, F.lit(rf"\\(input|include){SPACE}*\{{([^}}]+)\}}"), F.lit(2))
