"""Structured documents from LaTeX and Markdown text, one row in, one row out.

Positions matter in these formats.  A text is split at the matches of a regular
expression and the matches are extracted beside the pieces, so the i-th match lies
between two neighbouring pieces whatever characters the text holds.  The whole parse
is JVM expressions; lists stay inside their document's row, so parsing never shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import latex as lx
from paperloom.functions.binding import let, unnest
from paperloom.functions.text import SPACE, strip

MIN_PARAGRAPH = 20
# Characters looked at on either side of a match, and how many neighbouring pieces hold
# them for sure: every other piece is a match, and the shortest one is ``$x$``.
AROUND = 200
REACH = 2 * -(-AROUND // 3)

# Title commands in order of preference, matched without regard to case.
TITLE_COMMANDS = ["title", "icmltitle", "neuripstitle", "iclrtitle", "acltitle", "Title", "icmltitlerunning", "titlerunning"]

# Display equations in extraction order.
DISPLAY_MATH = [
    r"\\begin\{equation\*?\}(.*?)\\end\{equation\*?\}",
    r"\\begin\{align\*?\}(.*?)\\end\{align\*?\}",
    r"\\begin\{gather\*?\}(.*?)\\end\{gather\*?\}",
    r"\\begin\{multline\*?\}(.*?)\\end\{multline\*?\}",
    r"\$\$([^$]+)\$\$",
    r"\\\[(.+?)\\\]",
]
# What a text must hold for the pattern at the same place to match at all.
DISPLAY_SIGNS = [r"\begin{equation", r"\begin{align", r"\begin{gather", r"\begin{multline", "$$", r"\["]
INLINE_MATH = r"(?<!\$)\$(?!\$)([^\$\n]+)\$(?!\$)"


def body(content: Column) -> Column:
    """Text of the document environment; the whole text where there is none or it is empty."""
    inner = F.regexp_extract(content, r"(?s)\\begin\{document\}(.*?)\\end\{document\}", 1)
    return F.when(F.length(inner) > 0, inner).otherwise(content)


def balanced_argument(rest: Column) -> Column:
    """Text up to the brace that closes a group opened just before it; null if none does.

    One fold over the pieces between closing braces keeps the depth and the length so far.
    """
    pieces = F.split(rest, r"\}")
    closed = F.slice(pieces, 1, F.size(pieces) - 1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("chars"))

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.translate(piece, "{", ""))
        return F.when(state["depth"] == 0, state).otherwise(
            F.struct((state["depth"] + opened - 1).alias("depth"), (state["chars"] + F.length(piece) + 1).alias("chars")))

    nested = let(F.aggregate(closed, start, step), lambda e: F.when(e["depth"] == 0, F.left(rest, e["chars"] - 1)))
    flat = r"^([^{}]*)\}"
    return F.when(F.rlike(rest, F.lit(flat)), F.regexp_extract(rest, flat, 1)).otherwise(nested)


def title(content: Column) -> Column:
    """First title command that yields text; its argument may nest braces to any depth."""
    options = []
    for name in dict.fromkeys(n.lower() for n in TITLE_COMMANDS):
        command = rf"(?i)\\{name}{SPACE}*\{{"
        start = F.regexp_instr(content, F.lit(command))
        options.append(F.when(start > 0, F.regexp_replace(content.substr(start, F.length(content)), "^" + command, "")))
    cleaned = F.transform(F.array(*options), lambda r: lx.paper_title(balanced_argument(r)))
    return F.coalesce(F.get(F.filter(cleaned, lambda t: F.coalesce(F.length(t), F.lit(0)) > 0), F.lit(0)), F.lit(""))


def abstract(content: Column) -> Column:
    env = lx.first_group(content, r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}")
    command = lx.first_group(content, r"\\abstract\{([^}]+)\}")
    return lx.clean(F.coalesce(env, command))


def _paragraphs(content: Column, separator: str, skip_code: bool = False) -> Column:
    """Cleaned paragraphs of a section; ``order`` is the place before short ones are dropped."""
    raw = F.transform(F.split(content, separator), lambda p, i: F.struct((i + 1).alias("order"), p.alias("raw")))
    if skip_code:
        raw = F.filter(raw, lambda p: ~F.rlike(strip(p["raw"]), F.lit("^(#|```)")))
    cleaned = F.transform(raw, lambda p: F.struct(p["order"].alias("order"), lx.clean(p["raw"]).alias("content")))
    return F.filter(cleaned, lambda p: F.length(strip(p["content"])) >= MIN_PARAGRAPH)


def _pieces(content: Column, regex: str, *groups: int) -> Column:
    """The text between matches (``gaps``, one more than matches) and the given groups of every match (``g0``, ``g1`` ...)."""
    return F.struct(F.split(content, regex).alias("gaps"), *[F.regexp_extract_all(content, F.lit(regex), F.lit(g)).alias(f"g{g}") for g in groups])


def latex_sections(content: Column) -> Column:
    """Flat section list ``(order, level, title, paragraphs)`` from the three heading commands."""
    def listed(m: Column) -> Column:
        return F.transform(m["g1"], lambda prefix, i: F.struct(
            (i + 1).alias("order"),
            (F.length(prefix) / 3 + 1).cast("int").alias("level"),
            lx.section_title(F.get(m["g2"], i)).alias("title"),
            _paragraphs(F.get(m["gaps"], i + 1), rf"\n{SPACE}*\n|\\par\b").alias("paragraphs"),
        ))

    heading = r"\\((?:sub){0,2})section\*?\{([^}]+)\}"
    return let(content, lambda c: let(_pieces(c, heading, 1, 2), listed))


def _matches(content: Column, pattern: str, sign: str) -> Column:
    """Every match with its capture and up to 100 characters either side, from the 200 characters next to it.

    The surroundings come from the neighbouring piece or, where that is short, from a
    bounded number of pieces, so the work is linear in the text and in the matches.
    ``sign`` is a string every match contains: a text without it is not searched.
    """
    text = F.when(content.isNull() | F.contains(content, F.lit(sign)), content).otherwise("")

    def listed(m: Column) -> Column:
        both = F.flatten(F.transform(m["gaps"], lambda g, i: F.array(g, F.coalesce(F.get(m["g0"], i), F.lit("")))))
        ends = F.struct(
            F.transform(both, lambda p: F.right(p, F.lit(AROUND))).alias("tails"), F.transform(both, lambda p: F.left(p, F.lit(AROUND))).alias("heads"))

        def entry(whole: Column, i: Column, e: Column) -> Column:
            at, next_gap = 2 * i + 1, 2 * i + 3  # places of the gaps around the match, from 1
            first = F.greatest(at - REACH, F.lit(1))
            before, after = F.get(e["tails"], at - 1), F.get(e["heads"], next_gap - 1)
            left = F.when(F.length(before) >= AROUND, before).otherwise(
                F.right(F.array_join(F.slice(e["tails"], first, at - first + 1), ""), F.lit(AROUND)))
            right = F.when(F.length(after) >= AROUND, after).otherwise(
                F.left(F.array_join(F.slice(e["heads"], next_gap, F.lit(REACH)), ""), F.lit(AROUND)))
            return F.struct(
                whole.alias("whole"), F.get(m["g1"], i).alias("inner"),
                F.right(strip(left), F.lit(100)).alias("before"), F.left(strip(right), F.lit(100)).alias("after"),
            )

        return let(ends, lambda e: F.transform(m["g0"], lambda w, i: entry(w, i, e)))

    return let(text, lambda t: let(_pieces(t, "(?s)" + pattern, 0, 1), listed))


def latex_equations(content: Column, inline_min: int = 20) -> Column:
    """Display equations by pattern, then inline ones of at least ``inline_min`` characters (0: none)."""
    def shaped(e: Column, inline: bool) -> Column:
        inner = strip(e["inner"]) if inline else e["inner"]
        label = F.lit(None).cast("string") if inline else lx.first_group(e["whole"], r"\\label\{([^}]+)\}")
        return F.struct(
            lx.equation(inner).alias("latex"), label.alias("label"), F.lit(inline).alias("is_inline"),
            e["before"].alias("context_before"), e["after"].alias("context_after"),
        )

    def listed(text: Column) -> Column:
        lists = [F.transform(_matches(text, p, sign), lambda e: shaped(e, False)) for p, sign in zip(DISPLAY_MATH, DISPLAY_SIGNS)]
        if inline_min > 0:
            long_enough = F.filter(_matches(text, INLINE_MATH, "$"), lambda e: F.length(strip(e["inner"])) >= inline_min)
            lists.append(F.transform(long_enough, lambda e: shaped(e, True)))
        return F.concat(*lists)

    return let(content, listed)


def latex_figures(content: Column) -> Column:
    envs = F.regexp_extract_all(content, F.lit(r"(?s)\\begin\{figure\*?\}(.*?)\\end\{figure\*?\}"), F.lit(1))
    return F.transform(
        envs,
        lambda e, i: F.struct(
            (i + 1).alias("number"),
            F.when(F.rlike(e, F.lit(r"\\caption\{([^}]+)\}")), lx.clean(F.regexp_extract(e, r"\\caption\{([^}]+)\}", 1))).alias("caption"),
            lx.first_group(e, r"\\label\{([^}]+)\}").alias("label"),
            lx.first_group(e, r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}").alias("image"),
        ),
    )


def tabular_markdown(env: Column) -> Column:
    """A tabular as a Markdown table; a header rule follows the first row only if it opens the table."""
    inner = F.regexp_extract(env, r"(?s)\\begin\{tabular\}(?:\{[^}]*\})?(.*?)\\end\{tabular\}", 1)
    rows = F.transform(F.split(inner, r"\\\\"), lambda r, i: F.struct(i.alias("i"), strip(r).alias("r")))
    kept = F.filter(rows, lambda x: (F.length(x["r"]) > 0) & ~F.rlike(x["r"], F.lit(r"^\\[hc]line")))

    def line(x: Column) -> Column:
        cells = F.transform(F.split(x["r"], "&"), lambda c: lx.clean(strip(c)))
        row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
        return F.when(x["i"] == 0, F.concat(row, F.lit("\n"), rule)).otherwise(row)

    return F.array_join(F.transform(kept, line), "\n")


def latex_tables(content: Column) -> Column:
    envs = F.regexp_extract_all(content, F.lit(r"(?s)\\begin\{table\*?\}(.*?)\\end\{table\*?\}"), F.lit(1))

    def table(e: Column, i: Column) -> Column:
        markdown = tabular_markdown(e)
        breaks = F.length(markdown) - F.length(F.replace(markdown, F.lit("\n"), F.lit("")))
        return F.struct(
            (i + 1).alias("number"),
            F.when(F.rlike(e, F.lit(r"\\caption\{([^}]+)\}")), lx.clean(F.regexp_extract(e, r"\\caption\{([^}]+)\}", 1))).alias("caption"),
            lx.first_group(e, r"\\label\{([^}]+)\}").alias("label"),
            markdown.alias("content"),
            F.when(F.length(markdown) > 0, breaks - 1).otherwise(0).alias("row_count"),
        )

    return F.transform(envs, table)


def parse_latex(df: DataFrame, content_col: str = "content", inline_min: int = 20) -> DataFrame:
    """Add title, abstract, sections, equations, figures and tables to rows of resolved LaTeX."""
    inner = df.withColumn("__body", body(F.col(content_col)))
    b = F.col("__body")
    return inner.select(
        *df.columns,
        title(F.col(content_col)).alias("title"),
        abstract(F.col(content_col)).alias("abstract"),
        latex_sections(b).alias("sections"),
        latex_equations(b, inline_min).alias("equations"),
        latex_figures(b).alias("figures"),
        latex_tables(b).alias("tables"),
        F.lit("latex").alias("parse_method"),
    )


# --- Markdown -----------------------------------------------------------------


def markdown_title(md: Column) -> Column:
    return strip(F.regexp_extract(md, rf"(?m)^#{SPACE}+(.+)$", 1))


def markdown_abstract(md: Column) -> Column:
    """Text below an Abstract heading, else the first block after the title if it is long enough."""
    found = rf"(?is)(?:^|\n)#+{SPACE}*Abstract{SPACE}*\n(.*?)(?=\n#|\z)"
    blocks = F.split(md, rf"\n##?{SPACE}+", 3)
    second = F.get(blocks, F.lit(1))
    fallback = F.when((F.size(blocks) > 2) & (F.length(second) > 100), lx.clean(second))
    return F.when(F.rlike(md, F.lit(found)), lx.clean(strip(F.regexp_extract(md, found, 1)))).otherwise(F.coalesce(fallback, F.lit("")))


def markdown_sections(md: Column) -> Column:
    """Sections below level-1 headings, one level up; the title and the abstract are no sections."""
    def listed(m: Column) -> Column:
        every = F.transform(m["g1"], lambda signs, i: F.struct(
            F.length(signs).alias("depth"), strip(F.get(m["g2"], i)).alias("title"), F.get(m["gaps"], i + 1).alias("text")))
        kept = F.filter(every, lambda s: (s["depth"] > 1) & (F.lower(s["title"]) != "abstract"))
        return F.transform(
            kept,
            lambda s, i: F.struct(
                (i + 1).alias("order"), (s["depth"] - 1).alias("level"), s["title"].alias("title"),
                _paragraphs(strip(s["text"]), rf"\n{SPACE}*\n", skip_code=True).alias("paragraphs"),
            ),
        )

    return let(_pieces(md, rf"(?:^|\n)(#{{1,4}}){SPACE}+(.+?)(?=\n)", 1, 2), listed)


def markdown_equations(md: Column) -> Column:
    return F.transform(
        _matches(md, r"\$\$(.+?)\$\$", "$$"),
        lambda e: F.struct(
            strip(e["inner"]).alias("latex"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_inline"),
            e["before"].alias("context_before"), e["after"].alias("context_after"),
        ),
    )


def markdown_figures(md: Column) -> Column:
    pattern = F.lit(r"!\[([^\]]*)\]\(([^)]+)\)")
    pairs = F.arrays_zip(F.regexp_extract_all(md, pattern, F.lit(1)).alias("c"), F.regexp_extract_all(md, pattern, F.lit(2)).alias("p"))
    return F.transform(
        pairs,
        lambda x, i: F.struct(
            (i + 1).alias("number"), F.nullif(x["c"], F.lit("")).alias("caption"),
            F.lit(None).cast("string").alias("label"), x["p"].alias("image"),
        ),
    )


def markdown_tables(md: Column) -> Column:
    """Pipe tables with their header cells, data row count and the caption line right above."""
    table = r"(\|[^\n]+\|\n\|[-: |]+\|\n(?:\|[^\n]+\|\n?)+)"
    hits = _matches(md, table, "|\n|")

    def shaped(e: Column, i: Column) -> Column:
        content = strip(e["whole"])
        rows = F.split(content, "\n")
        header = F.filter(F.transform(F.split(F.get(rows, F.lit(0)), r"\|"), strip), lambda c: F.length(c) > 0)
        above = rf"(?i)(?:Table|Tab\.?){SPACE}*\p{{Nd}}*[.:]{SPACE}*([^\n]+)\z"
        return F.struct(
            (i + 1).alias("number"), lx.first_group(e["before"], above).alias("caption"), F.lit(None).cast("string").alias("label"),
            content.alias("content"), F.greatest(F.size(rows) - 2, F.lit(0)).alias("row_count"), header.alias("headers"),
        )

    return F.transform(hits, shaped)


def parse_markdown(df: DataFrame, markdown_col: str = "markdown") -> DataFrame:
    md = F.col(markdown_col)
    return df.select(
        *df.columns,
        markdown_title(md).alias("title"),
        markdown_abstract(md).alias("abstract"),
        markdown_sections(md).alias("sections"),
        markdown_equations(md).alias("equations"),
        markdown_figures(md).alias("figures"),
        markdown_tables(md).alias("tables"),
        F.lit("marker").alias("parse_method"),
    )


def html_to_markdown(html: Column) -> Column:
    """Page body as Markdown: headings, paragraphs and line breaks; scripts, styles and navigation go."""
    out = F.regexp_replace(html, r"(?is)<(script|style|nav|head)\b.*?</\1>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    for level in range(1, 5):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    # A paragraph that opens with a bold line is a section in all but name.
    out = F.regexp_replace(out, r"(?is)<p><b>(.*?)<br>", "\n\n## $1\n\n")
    out = F.regexp_replace(out, r"(?i)<(p|div|article|br)\b[^>]*>", "\n\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, rf"\n(?:{SPACE}*\n)+", "\n\n"))


# --- Results ------------------------------------------------------------------


def parse_with_fallback(latex: DataFrame, markdown: DataFrame, key: str = "paper_id") -> DataFrame:
    """LaTeX result where it has sections, else the Markdown one, else an error row."""
    def columns(prefix):
        return F.struct(*[F.col(c) for c in ("title", "abstract", "sections", "equations", "figures", "parse_method")]).alias(prefix)

    a = latex.select(key, columns("l"))
    b = markdown.select(key, columns("m"))
    joined = a.join(b, key, "full_outer")
    usable = F.coalesce(F.size("l.sections") > 0, F.lit(False))
    pick = F.when(usable, F.col("l")).otherwise(F.coalesce("m", "l"))
    done = joined.select(key, pick.alias("d"))
    return done.select(
        key, "d.*", F.when(F.coalesce(F.size("d.sections"), F.lit(0)) == 0, F.lit("no sections found")).alias("error")
    )


def parse_sources(df: DataFrame, key: str = "paper_id", latex_col: str = "latex", markdown_col: str = "markdown") -> DataFrame:
    """As ``parse_with_fallback`` for papers that have both sources in one row: no join, no shuffle.

    Markdown is only parsed where it is needed, and every field is a column of its own, so
    that fields nobody asks for are not computed.
    """
    names = ("title", "abstract", "sections", "equations", "figures", "parse_method")
    tex = parse_latex(df.select(key, latex_col, markdown_col), latex_col).select(
        key, latex_col, markdown_col, *[F.col(n).alias(f"__tex_{n}") for n in names])
    usable = F.col(latex_col).isNotNull() & F.coalesce(F.size("__tex_sections") > 0, F.lit(False))
    chosen = tex.withColumn("__use", usable | F.col(markdown_col).isNull())
    both = parse_markdown(chosen.withColumn("__markdown", F.when(~F.col("__use"), F.col(markdown_col))), "__markdown")
    picked = both.select(key, *[F.when(F.col("__use"), F.col(f"__tex_{n}")).otherwise(F.col(n)).alias(n) for n in names])
    return picked.select("*", F.when(F.coalesce(F.size("sections"), F.lit(0)) <= 0, F.lit("no sections found")).alias("error"))


def counts(df: DataFrame) -> DataFrame:
    """Add the counters of a parsed document."""
    paragraphs = F.aggregate("sections", F.lit(0), lambda a, s: a + F.size(s["paragraphs"]))
    return df.select(
        "*",
        F.size("sections").alias("total_sections"), paragraphs.alias("total_paragraphs"),
        F.size("equations").alias("total_equations"), F.size("figures").alias("total_figures"), F.size("tables").alias("total_tables"),
    )


def full_text(sections: Column) -> Column:
    """All paragraphs, blank lines between them."""
    texts = F.flatten(F.transform(sections, lambda s: F.transform(s["paragraphs"], lambda p: p["content"])))
    return F.array_join(texts, "\n\n")


def numbered(df: DataFrame, key: str = "paper_id") -> DataFrame:
    """Paragraph rows with the ids ``<paper>_sec_N`` and ``<paper>_para_N`` counted over the document."""
    per_section = F.transform("sections", lambda s: F.transform(s["paragraphs"], lambda p: F.struct(
        s["order"].alias("section_order"), s["level"].alias("level"), s["title"].alias("section_title"),
        p["order"].alias("order"), p["content"].alias("content"))))
    rows = unnest(df, [key], F.flatten(per_section), "p", "n")
    return rows.select(
        key,
        F.concat(F.col(key), F.lit("_sec_"), F.col("p.section_order")).alias("section_id"),
        F.concat(F.col(key), F.lit("_para_"), F.col("n") + 1).alias("paragraph_id"),
        "p.level", "p.section_title", "p.order", "p.content",
    )


def parsing_stats(results: DataFrame) -> DataFrame:
    """Success and failure per method with totals and rates; empty input divides by one."""
    ok = F.col("error").isNull()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok & (F.col("parse_method") == "latex")).alias("latex_success"),
        F.count_if(ok & (F.col("parse_method") == "marker")).alias("marker_success"),
        F.count_if(~ok).alias("failed"),
        F.round(F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("success_rate"),
    )
