"""Parsing, section filtering, quality and chunking over the contract tables.

LaTeX and Markdown sources are derived from the tables by Spark: the markup is
wrapped around the rows' own text, so what a parse must return is known.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import latex as lx
from paperloom.functions import text as tx
from paperloom.functions.binding import unnest
from paperloom.functions.tokens import BytePairTokens
from paperloom.operators import chunking, parsing, quality, section_tree, sections
from paperloom.plans.registry import query
from paperloom.sources.tables import load, spread

def documents(spark, folder):
    return spread(load(spark, folder, "documents"))


# Letters, digits, blanks and full stops survive every cleaning step unchanged.
SAFE = r"[^\p{L}\p{N} .\n]"


def plain_documents(spark, folder):
    """Documents reduced to characters no cleaning step touches."""
    docs = documents(spark, folder)
    text = F.regexp_replace(F.regexp_replace("text", SAFE, ""), " +", " ")
    return docs.select("doc_id", "lang", "source", text.alias("text"))


PLAIN_SQL = r"""plain AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(text, '[^\p{L}\p{N} .\n]', '', 'g'), ' +', ' ', 'g') AS text FROM documents),
ln AS (SELECT doc_id, trim(l) AS line, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM plain))"""


@query(
    "latex_clean",
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, chr(10), ' '), '[^\p{L}\p{N} .]', '', 'g'), ' +', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(trim(t || ' end (lang) x + y q-' || chr(8212) || ' "quoted" tail')) AS cleaned FROM t JOIN documents USING (doc_id)""".replace("(lang)", "' || lang || '"),
)
def latex_clean(spark, folder):
    docs = documents(spark, folder)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.translate("text", "\n", " "), r"[^\p{L}\p{N} .]", ""), " +", " "))
    marked = F.concat(
        F.lit(r"\noindent\textbf{"), text, F.lit(r"}\cite{a,b} \label{sec:x}end \emph{\textit{"), F.col("lang"),
        F.lit(r"}} $x + y$ \footnote{gone} q----- ``quoted'' {}\textcolor{red}{tail}\vspace{1em}"),
    )
    # Five hyphens are one em dash and one en dash.
    return docs.select("doc_id", F.md5(F.replace(lx.clean(marked), F.lit("\u2014\u2013"), F.lit("-\u2014"))).alias("cleaned"))


def latex_source(spark, folder):
    """One LaTeX paper per document."""
    return plain_documents(spark, folder).select("doc_id", "lang", "source", latex_content().alias("content"))


def latex_content():
    """A document's lines as sections, every third one a subsection."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda l: F.trim(l)), lambda l: F.length(l) > 0)
    section = lambda l, i: F.concat(
        F.when(i % 3 == 2, F.lit("\\subsection{")).otherwise(F.lit("\\section*{")),
        (i + 1).cast("string"), F.lit(". Part "), (i + 1).cast("string"), F.lit("}\n\n"),
        l, F.lit("\n\nshort\n\n"), F.lit("Second paragraph of \\textbf{part "), (i + 1).cast("string"), F.lit("}.\\par Third one, long enough too."),
        F.lit("\n"),
    )
    body = F.array_join(F.transform(lines, section), "\n")
    return F.concat(
        F.lit("\\documentclass{article}\n\\title{A {\\bf nested {title}} for "), F.col("source"), F.lit(" % note\n}\n\\begin{document}\n\\begin{abstract}\n"),
        F.coalesce(F.get(lines, F.lit(0)), F.lit("none")), F.lit("\n\\end{abstract}\n"), body,
        F.lit("\nBefore math \\begin{equation}\\label{eq:one} a = "), F.col("doc_id").cast("string"), F.lit(" \\end{equation} after math.\n$$ b $$\n"),
        F.lit("inline $\\alpha + \\beta + \\gamma + \\delta$ and $x$ here\n"),
        F.lit("\\begin{figure}\\includegraphics[width=3cm]{img/a.png}\\caption{Figure 1: \\textbf{Plot}}\\label{fig:a}\\end{figure}\n"),
        F.lit("\\begin{table}\\caption{Scores}\\begin{tabular}{ll}a & b \\\\ \\hline\n1 & "), F.col("lang"), F.lit(" \\\\\\end{tabular}\\end{table}\n"),
        F.lit("\\end{document}\n"),
    )


@query(
    "latex_parse",
    f"""WITH {PLAIN_SQL}, n AS (SELECT doc_id, count(*) AS k FROM ln WHERE line <> '' GROUP BY doc_id),
f AS (SELECT doc_id, first(line ORDER BY i) AS line FROM ln WHERE line <> '' GROUP BY doc_id)
SELECT doc_id, 'A nested title for ' || source AS title, md5(coalesce(f.line, 'none')) AS abstract, coalesce(k, 0)::INTEGER AS n_sections,
  'a = ' || doc_id AS equation_1, 'eq:one' AS label_1, 3::INTEGER AS n_equations, '\\alpha + \\beta + \\gamma + \\delta' AS inline_math,
  'Before math' AS before_tail, 'after math.' AS after_head,
  'Figure 1: \\textbfPlot' AS caption, 'img/a.png' AS image, '| a | b |' || chr(10) || '| --- | --- |' AS table_md, 0::INTEGER AS row_count
FROM plain LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id)""".replace("\\\\", "\\"),
)
def latex_parse(spark, folder):
    parsed = parsing.parse_latex(latex_source(spark, folder))
    eq = lambda i, f: F.get("equations", F.lit(i))[f]
    fig, tab = F.get("figures", F.lit(0)), F.get("tables", F.lit(0))
    return parsed.select(
        "doc_id", "title", F.md5("abstract").alias("abstract"), F.size("sections").alias("n_sections"),
        eq(0, "latex").alias("equation_1"), eq(0, "label").alias("label_1"), F.size("equations").alias("n_equations"),
        eq(2, "latex").alias("inline_math"), F.right(eq(0, "context_before"), F.lit(11)).alias("before_tail"),
        F.left(eq(0, "context_after"), F.lit(11)).alias("after_head"),
        fig["caption"].alias("caption"), fig["image"].alias("image"), tab["content"].alias("table_md"), tab["row_count"].alias("row_count"),
    )


@query(
    "latex_sections",
    f"""WITH {PLAIN_SQL}, kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ln WHERE line <> ''),
paras AS (SELECT doc_id, n, 2 AS p, line AS content FROM kept WHERE length(line) >= 20
  UNION ALL SELECT doc_id, n, 4, 'Second paragraph of part ' || n || '.' FROM kept
  UNION ALL SELECT doc_id, n, 5, 'Third one, long enough too.' FROM kept)
SELECT doc_id, n::INTEGER AS section_order, CASE WHEN n % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS level, 'Part ' || n AS title, p::INTEGER AS paragraph_order,
  md5(content) AS content FROM paras""",
)
def latex_sections(spark, folder):
    """The last section also holds the tail of the document: paragraphs from the sixth on."""
    source = latex_source(spark, folder)
    found = unnest(source, ["doc_id"], parsing.latex_sections(parsing.body(F.col("content"))), "s")
    rows = found.select("doc_id", "s.order", "s.level", "s.title", F.explode("s.paragraphs").alias("p"))
    return rows.where(F.col("p.order") <= 5).select(
        "doc_id", F.col("order").alias("section_order"), "level", "title", F.col("p.order").alias("paragraph_order"), F.md5("p.content").alias("content")
    )


PAGE_TITLE = r"""trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'))"""


@query(
    "page_markdown",
    rf"""SELECT page_id, {PAGE_TITLE} AS title, len(regexp_extract_all(html, '(?is)<p><b>.*?<br>'))::INTEGER AS total_sections FROM pages""",
)
def page_markdown(spark, folder):
    """Pages parsed as Markdown documents."""
    pages = spread(load(spark, folder, "pages"))
    parsed = parsing.counts(parsing.parse_markdown(pages.select("page_id", parsing.html_to_markdown(F.col("html")).alias("markdown"))))
    return parsed.select("page_id", "title", "total_sections")


@query(
    "page_title",
    f"SELECT page_id, {PAGE_TITLE} AS title FROM pages WHERE html LIKE '%<h1%'",
)
def page_title(spark, folder):
    pages = load(spark, folder, "pages").where(F.contains("html", F.lit("<h1")))
    return pages.select("page_id", parsing.markdown_title(parsing.html_to_markdown(F.col("html"))).alias("title"))


@query(
    "markdown_sections",
    f"""WITH {PLAIN_SQL}, kept AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ln WHERE line <> '')
SELECT doc_id, n::INTEGER AS section_order, (n % 3 + 1)::INTEGER AS level, 'Part ' || n AS title,
  (CASE WHEN length(line) >= 20 THEN 2 ELSE 1 END)::INTEGER AS n_paragraphs FROM kept""",
)
def markdown_sections(spark, folder):
    md = parsing.markdown_sections(F.col("markdown"))
    rows = unnest(markdown_source(spark, folder), ["doc_id"], md, "s").where(F.col("s.title") != "Tail")
    return rows.select("doc_id", F.col("s.order").alias("section_order"), "s.level", "s.title", F.size("s.paragraphs").alias("n_paragraphs"))


def markdown_source(spark, folder):
    return plain_documents(spark, folder).select("doc_id", "source", markdown_content().alias("markdown"))


def both_sources(spark, folder):
    """English papers have LaTeX as well, all have a converted page."""
    return plain_documents(spark, folder).select(
        "doc_id", F.when(F.col("lang") == "en", latex_content()).alias("latex"), markdown_content().alias("markdown"))


def markdown_content():
    lines = F.filter(F.transform(F.split("text", "\n"), lambda l: F.trim(l)), lambda l: F.length(l) > 0)
    part = lambda l, i: F.concat(
        F.repeat(F.lit("#"), (i + 1) % 3 + 2), F.lit(" Part "), (i + 1).cast("string"), F.lit("\n\n"), l,
        F.lit("\n\n```code```\n\nA paragraph that is long enough\n"),
    )
    head = F.concat(F.lit("# Title of "), F.col("source"), F.lit("\n\n## Abstract\nThe abstract of "), F.col("source"), F.lit("\n\n"))
    tables = F.concat(F.lit("\n## Tail\n\n$$ e = "), F.col("doc_id").cast("string"), F.lit(" $$\n\n![A figure](img.png)\n\nTable 1: Sizes\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"))
    return F.concat(head, F.array_join(F.transform(lines, part), "\n"), tables)


@query(
    "markdown_parse",
    """SELECT doc_id, 'Title of ' || source AS title, 'The abstract of ' || source AS abstract, 'e = ' || doc_id AS equation,
  'A figure' AS figure, 'img.png' AS image, 'Sizes' AS caption, 2::INTEGER AS row_count, 'a,b' AS headers FROM documents""",
)
def markdown_parse(spark, folder):
    parsed = parsing.parse_markdown(markdown_source(spark, folder))
    tab, fig = F.get("tables", F.lit(0)), F.get("figures", F.lit(0))
    return parsed.select(
        "doc_id", "title", "abstract", F.get("equations", F.lit(0))["latex"].alias("equation"), fig["caption"].alias("figure"),
        fig["image"].alias("image"), tab["caption"].alias("caption"), tab["row_count"].alias("row_count"), F.array_join(tab["headers"], ",").alias("headers"),
    )


@query(
    "parse_fallback",
    """SELECT CASE WHEN trim(regexp_replace(text, '[^\\p{L}\\p{N} .\\n]', '', 'g'), ' ' || chr(10)) = '' THEN 'none' WHEN lang = 'en' THEN 'latex' ELSE 'marker' END AS method,
  count(*) AS n FROM documents GROUP BY method""".replace("\\\\", "\\"),
)
def parse_fallback(spark, folder):
    done = parsing.parse_sources(both_sources(spark, folder), "doc_id")
    method = F.when(F.col("error").isNotNull(), "none").otherwise(F.col("parse_method"))
    return done.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n"))


TITLES_SQL = """titled AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN p_size || '. References' WHEN 1 THEN ' Author   Contributions ' WHEN 2 THEN '3.1 Related  Work'
  WHEN 3 THEN 'Conclusion' WHEN 4 THEN 'Acknowledgements' WHEN 5 THEN 'Appendix A' ELSE p_name END AS title, p_size % 7 AS k FROM part)"""


def titled(spark, folder):
    k = F.col("p_size") % 7
    title = (
        F.when(k == 0, F.concat(F.col("p_size").cast("string"), F.lit(". References")))
        .when(k == 1, " Author   Contributions ").when(k == 2, "3.1 Related  Work").when(k == 3, "Conclusion")
        .when(k == 4, "Acknowledgements").when(k == 5, "Appendix A").otherwise(F.col("p_name"))
    )
    return load(spark, folder, "part").select("p_partkey", "p_type", title.alias("title"))


@query("excluded_sections", f"WITH {TITLES_SQL} SELECT p_partkey, k IN (0, 1, 4) AS excluded FROM titled")
def excluded_sections(spark, folder):
    return titled(spark, folder).select("p_partkey", sections.is_excluded(F.col("title")).alias("excluded"))


@query(
    "section_importance",
    f"WITH {TITLES_SQL} SELECT p_partkey, CASE k WHEN 2 THEN 0.6 ELSE 0.7 END::DOUBLE AS importance FROM titled",
)
def section_importance(spark, folder):
    return titled(spark, folder).select("p_partkey", sections.importance(F.col("title")).alias("importance"))


@query(
    "section_stats",
    """WITH s AS (SELECT count(*) AS t, count(*) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) AS x FROM orders)
SELECT t AS total_sections, x AS excluded_sections, t - x AS retained_sections, round(x / t::DOUBLE, 6) AS exclusion_rate FROM s""",
)
def section_stats(spark, folder):
    """Each customer's orders are the sections of one document (a customer's orders are few by design)."""
    title = F.when(F.col("o_orderpriority") == "1-URGENT", "1. Bibliography").when(F.col("o_orderpriority") == "5-LOW", "Broader Impact").otherwise("Method")
    docs = load(spark, folder, "orders").select("o_custkey", F.array(F.struct(title.alias("title"))).alias("sections"))
    return sections.section_stats(docs)


# Orders as sections, 64 to a document: a binary tree in even documents, one chain in odd ones.
TREE_SQL = """s AS (SELECT o_orderkey AS section_id, o_orderkey // 64 AS paper_id, CASE WHEN o_orderkey % 64 = 0 THEN NULL
    WHEN o_orderkey // 64 % 2 = 0 THEN o_orderkey // 64 * 64 + (o_orderkey % 64 - 1) // 2 ELSE o_orderkey - 1 END AS parent_id,
  o_custkey AS position, o_orderpriority = '1-URGENT' AND o_orderkey % 8 > 5 AS x FROM orders),
climb AS (SELECT section_id, section_id AS above, x FROM s UNION ALL
  SELECT c.section_id, p.section_id, c.x FROM climb c JOIN s ON s.section_id = c.above JOIN s p ON p.section_id = s.parent_id)"""


def section_rows(spark, folder):
    key = F.col("o_orderkey")
    local = key % 64
    heap = F.floor(key / 64) * 64 + F.floor((local - 1) / 2)
    parent = F.when(local == 0, F.lit(None)).when(F.floor(key / 64) % 2 == 0, heap).otherwise(key - 1).cast("long")
    title = F.when((F.col("o_orderpriority") == "1-URGENT") & (key % 8 > 5), "2. References").otherwise("Method")
    return load(spark, folder, "orders").select(
        F.floor(key / 64).cast("long").alias("paper_id"), key.alias("section_id"), parent.alias("parent_id"), F.col("o_custkey").alias("position"), title.alias("title"))


@query(
    "section_subtrees",
    f"""WITH RECURSIVE {TREE_SQL},
up AS (SELECT c.section_id, count(*)::INTEGER AS level, bool_or(a.x) AS dropped FROM climb c JOIN s a ON a.section_id = c.above GROUP BY c.section_id),
down AS (SELECT above AS section_id, count(*)::BIGINT AS subtree_sections, count(*) FILTER (x)::BIGINT AS subtree_excluded FROM climb GROUP BY above)
SELECT paper_id, section_id, level, dropped, subtree_sections, subtree_excluded FROM s JOIN up USING (section_id) JOIN down USING (section_id)""",
)
def section_subtrees(spark, folder):
    """Every section with its level, its exclusion from above and the sums of its subtree."""
    tree = section_tree.resolve_documents(section_rows(spark, folder))
    return tree.select("paper_id", "section_id", "level", "dropped", "subtree_sections", "subtree_excluded")


@query(
    "section_tree_stats",
    f"""WITH RECURSIVE {TREE_SQL} SELECT paper_id, count(*)::BIGINT AS total_sections, count(*) FILTER (x)::BIGINT AS excluded_sections,
  count(*) FILTER (NOT x)::BIGINT AS retained_sections, round(count(*) FILTER (x) / count(*)::DOUBLE, 6) AS exclusion_rate FROM s GROUP BY paper_id""",
)
def section_tree_stats(spark, folder):
    return section_tree.document_stats(section_tree.resolve_documents(section_rows(spark, folder)))


@query(
    "section_outline",
    f"""WITH RECURSIVE {TREE_SQL}, walk AS (SELECT section_id, paper_id, x, [position, section_id] AS path FROM s WHERE parent_id IS NULL UNION ALL
  SELECT s.section_id, s.paper_id, walk.x OR s.x, walk.path || [s.position, s.section_id] FROM s JOIN walk ON s.parent_id = walk.section_id)
SELECT paper_id, section_id, (row_number() OVER (PARTITION BY paper_id ORDER BY path))::INTEGER AS place FROM walk WHERE NOT x""",
)
def section_outline(spark, folder):
    """Kept sections in reading order."""
    return section_tree.outline(section_tree.resolve_documents(section_rows(spark, folder))).select("paper_id", "section_id", "place")


@query("nested_chunks")
def nested_chunks(spark, folder):
    """Each line of a document is a section below the one at half its place; chunked in reading order."""
    lines = unnest(documents(spark, folder), ["doc_id"], tx.lines(F.col("text")), "line", "position")
    parent = F.when(F.col("position") > 0, F.floor((F.col("position") - 1) / 2).cast("int"))
    rows = lines.select(
        "doc_id", F.col("position").alias("section_id"), parent.alias("parent_id"), "position",
        F.concat(F.lit("Part "), "position").alias("title"), F.array("line").alias("paragraphs"))
    nested = section_tree.nested_documents(section_tree.resolve_documents(rows, doc="doc_id"), doc="doc_id")
    return chunking.chunk_documents(nested, key="doc_id").select("doc_id", "chunk_id", "chunk_index", "section_title", "token_count", "char_count")


@query(
    "quality_report",
    r"""WITH m AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS a,
  len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]{10,}')) AS runs, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents)
SELECT doc_id, true AS passed, ((n >= 50 AND a / n::DOUBLE < 0.5)::INTEGER + (n >= 20 AND runs > 0)::INTEGER)::INTEGER AS issue_count,
  (n >= 50 AND a / n::DOUBLE < 0.5)::INTEGER AS low_alnum, (n >= 20 AND runs > 0)::INTEGER AS special_runs,
  n::INTEGER AS total_characters, words::INTEGER AS total_words FROM m""",
)
def quality_report(spark, folder):
    return quality.document_report(documents(spark, folder), "doc_id", "text")


@query(
    "quality_issues",
    r"""WITH m AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS a FROM
  (SELECT doc_id, text || ' ' || repeat('#*', doc_id % 300) AS text FROM documents))
SELECT 'content_ratio' AS issue_type, 'warning' AS severity, count(*) AS n FROM m WHERE n >= 50 AND a / n::DOUBLE < 0.5 HAVING count(*) > 0
UNION ALL SELECT 'special_chars', 'warning', count(*) FROM m WHERE n >= 20 AND regexp_matches(text, '[^\p{L}\p{N}_\s]{10,}') HAVING count(*) > 0""",
)
def quality_issues(spark, folder):
    noisy = F.concat("text", F.lit(" "), F.repeat(F.lit("#*"), (F.col("doc_id") % 300).cast("int")))
    rows = quality.issue_rows(documents(spark, folder).select("doc_id", noisy.alias("text")), "doc_id", "text")
    return rows.groupBy("issue_type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(
    "valid_text",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 10 AND NOT contains(text, chr(65533))
  AND length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / length(text)::DOUBLE >= 0.3 AS valid FROM documents""",
)
def valid_text(spark, folder):
    return documents(spark, folder).select("doc_id", quality.is_valid(F.col("text")).alias("valid"))


@query(
    "math_heavy",
    r"""SELECT doc_id, len(string_split(text, '$')) - 1 > 0.02 * len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS heavy FROM documents""",
)
def math_heavy(spark, folder):
    return documents(spark, folder).select("doc_id", lx.math_heavy(F.col("text"), 0.02).alias("heavy"))


@query(
    "fixed_text",
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS fixed
FROM (SELECT page_id, replace(url, '/', ' /  ') AS t FROM pages)""",
)
def fixed_text(spark, folder):
    messy = F.concat(F.lit("\ufffd "), F.replace("url", F.lit("/"), F.lit(" /  ")), F.lit("\u0000"))
    return load(spark, folder, "pages").select("page_id", F.md5(quality.fixed(messy)).alias("fixed"))


@query(
    "sentence_split",
    r"""SELECT doc_id, i::INTEGER AS pos, md5(s) AS sentence FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents))""",
)
def sentence_split(spark, folder):
    rows = unnest(documents(spark, folder), ["doc_id"], tx.sentences(F.col("text")), "s", "p")
    return rows.select("doc_id", (F.col("p") + 1).alias("pos"), F.md5("s").alias("sentence"))


@query(
    "paragraph_split",
    """SELECT doc_id, i::INTEGER AS pos, length(p)::INTEGER AS n FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)) WHERE length(p) >= 20""",
)
def paragraph_split(spark, folder):
    rows = unnest(documents(spark, folder), ["doc_id"], tx.lines(F.col("text")), "t", "p")
    return rows.where(F.length("t") >= 20).select("doc_id", (F.col("p") + 1).alias("pos"), F.length("t").alias("n"))


# The packing rules as a walk over units: one recursion step per unit of a document.
UNITS_SQL = r"""para AS (SELECT doc_id, p, pi FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))),
wc AS (SELECT *, len(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')) AS w FROM para),
sent AS (SELECT doc_id, pi, si, s, len(list_filter(regexp_split_to_array(s, '\s+'), lambda w: w <> '')) AS w FROM (SELECT doc_id, pi, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM
  (SELECT doc_id, pi, list_filter(list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM wc WHERE w > 512))),
units AS (SELECT doc_id, pi, 0 AS si, 0 AS kind, p AS t, w FROM wc WHERE w <= 512 UNION ALL SELECT doc_id, pi, si, 1, s, w FROM sent),
seq AS (SELECT doc_id, kind, pi, w, t, row_number() OVER (PARTITION BY doc_id ORDER BY pi, si) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pi, si) AS cum FROM units),
docs AS (SELECT doc_id, list(kind ORDER BY i) AS ks, list(pi ORDER BY i) AS ps, list(w ORDER BY i) AS ws, list_prepend(0, list(cum ORDER BY i)) AS cs, list(t ORDER BY i) AS ts, sum(w) AS total, count(*) AS n FROM seq GROUP BY doc_id)"""

WALK_SQL = f"""WITH RECURSIVE {UNITS_SQL},
walk AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS st, 0::BIGINT AS tok, 0::BIGINT AS carry, []::STRUCT(form VARCHAR, a BIGINT, b BIGINT, c BIGINT)[] AS out FROM docs WHERE total > 512
UNION ALL
SELECT doc_id, i + 1, CASE WHEN long THEN i + 2 WHEN newrun THEN i + 1 WHEN over AND k = 1 THEN back WHEN over THEN i + 1 ELSE st END,
  CASE WHEN long THEN 0 WHEN newrun THEN w WHEN over AND k = 1 THEN cs[i + 1] - cs[back] + w WHEN over THEN least(50, ws[i]) + w ELSE tok + w END,
  CASE WHEN k = 1 OR newrun THEN 0 WHEN over THEN i ELSE carry END,
  (CASE WHEN i + 1 > st AND ((newrun AND (prev = 0 OR tok >= 100)) OR (NOT newrun AND (over OR long)))
     THEN [{{'form': CASE prev WHEN 1 THEN 'sentences' ELSE 'paragraphs' END, 'a': st, 'b': i, 'c': carry}}] ELSE [] END)
  || (CASE WHEN long THEN [{{'form': 'truncated', 'a': i + 1, 'b': i + 1, 'c': 0}}] ELSE [] END)
FROM (SELECT s.*, CASE WHEN i > 0 THEN ks[i] ELSE k END AS prev, k = 1 AND w > 512 AS long,
    i > 0 AND (CASE WHEN k = 1 OR ks[i] = 1 THEN ps[i] <> ps[i + 1] ELSE false END) AS newrun,
    tok + w > 512 AND i + 1 > st AS over,
    list_min(list_filter(range(st, i + 2), lambda j: cs[i + 1] - cs[j] <= 50)) AS back
  FROM (SELECT walk.doc_id, i, st, tok, carry, ks, ps, ws, cs, ks[i + 1] AS k, ws[i + 1] AS w FROM walk JOIN docs USING (doc_id) WHERE i < n) s)),
ends AS (SELECT w.doc_id, n AS i, CASE ks[n] WHEN 1 THEN 'sentences' ELSE 'paragraphs' END AS form, st AS a, n AS b, carry AS c FROM walk w JOIN docs USING (doc_id)
  WHERE w.i = n AND n >= st AND tok >= 100),
borders AS (SELECT doc_id, i, o.form, o.a, o.b, o.c FROM (SELECT doc_id, i, unnest(out) AS o FROM walk)
  UNION ALL SELECT doc_id, i + 1, form, a, b, c FROM ends
  UNION ALL SELECT doc_id, 1, 'section', 1, n, 0 FROM docs WHERE total BETWEEN 100 AND 512),
sized AS (SELECT b.doc_id, b.i, b.form, b.a, b.b, CASE b.form WHEN 'truncated' THEN 512 ELSE cs[b + 1] - cs[a] + CASE WHEN c > 0 THEN least(50, ws[c]) ELSE 0 END END AS tokens FROM borders b JOIN docs USING (doc_id))"""


def chunk_source(spark, folder):
    """Each document is one section whose lines are its paragraphs."""
    body = F.struct(F.lit("Body").alias("title"), tx.lines(F.col("text")).alias("paragraphs"))
    return documents(spark, folder).select("doc_id", F.array(body).alias("sections"))


@query(
    "chunk_documents",
    f"""{WALK_SQL} SELECT doc_id, doc_id || '_chunk_' || (row_number() OVER (PARTITION BY doc_id ORDER BY i, a, b) - 1) AS chunk_id,
  (row_number() OVER (PARTITION BY doc_id ORDER BY i, a, b) - 1)::INTEGER AS chunk_index, form, tokens::INTEGER AS token_count FROM sized""",
)
def chunk_documents(spark, folder):
    chunks = chunking.chunk_documents(chunk_source(spark, folder), key="doc_id")
    return chunks.select("doc_id", "chunk_id", "chunk_index", "form", "token_count")


@query(
    "chunk_stats",
    f"""{WALK_SQL} SELECT count(*) AS total_chunks, 0::BIGINT AS abstract_chunks, count(*) AS text_chunks, 0::BIGINT AS equation_chunks,
  sum(tokens)::BIGINT AS total_tokens, min(tokens)::INTEGER AS min_tokens, max(tokens)::INTEGER AS max_tokens, round(avg(tokens), 6) AS avg_tokens FROM sized""",
)
def chunk_stats(spark, folder):
    return chunking.chunk_stats(chunking.chunk_documents(chunk_source(spark, folder), key="doc_id")).drop("with_overlap")


def byte_pairs():
    import public_tokenizers  # the rank files of this machine; only these two queries need them

    return BytePairTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("bpe_tokens")
def bpe_tokens(spark, folder):
    """Byte-pair length of every text, its first 32 tokens and its last 50."""
    sized = documents(spark, folder).select("doc_id", byte_pairs().ends(F.col("text"), 32, 50).alias("e"))
    return sized.select("doc_id", F.col("e.n").alias("n_tokens"), F.md5(F.col("e.head").cast("binary")).alias("head"), F.md5(F.col("e.tail").cast("binary")).alias("tail"))


@query("bpe_chunks")
def bpe_chunks(spark, folder):
    """Chunks sized, cut and overlapped by byte-pair tokens."""
    chunks = chunking.chunk_documents(chunk_source(spark, folder), key="doc_id", count=byte_pairs())
    return chunks.select("doc_id", "chunk_id", "chunk_index", "form", "token_count", "char_count")


def _sql_words(text):
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


@query(
    "chunk_overlaps",
    f"""{WALK_SQL},
built AS (SELECT b.doc_id, b.i, b.a, b.b, 'text' AS chunk_type, CASE form WHEN 'truncated' THEN array_to_string(({_sql_words("ts[a]")})[1:512], ' ')
  WHEN 'sentences' THEN array_to_string(ts[a:b], ' ')
  ELSE CASE WHEN c > 0 AND ws[c] <= 50 THEN ts[c] || chr(10) || chr(10)
    WHEN c > 0 THEN array_to_string(({_sql_words("ts[c]")})[ws[c] - 49:ws[c]], ' ') || chr(10) || chr(10) ELSE '' END
    || array_to_string(ts[a:b], chr(10) || chr(10)) END AS content FROM borders b JOIN docs USING (doc_id)),
summary AS (SELECT doc_id, 0 AS i, 0 AS a, 0 AS b, 'abstract' AS chunk_type, trim(p) AS content FROM wc WHERE pi = 1 AND w >= 100),
every AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, a, b) - 1 AS n FROM (SELECT * FROM built UNION ALL SELECT * FROM summary)),
ends AS (SELECT doc_id, n, list_distinct({_sql_words("left(content, 200)")}) AS h, list_distinct({_sql_words("right(content, 200)")}) AS t FROM every),
links AS (SELECT y.doc_id, y.n, len(list_intersect(x.t, y.h)) > 5 AS touch FROM ends x JOIN ends y ON x.doc_id = y.doc_id AND x.n = y.n - 1)
SELECT e.doc_id || '_chunk_' || e.n AS chunk_id, chunk_type, len({_sql_words("content")})::INTEGER AS token_count, length(content)::INTEGER AS char_count,
  coalesce(p.touch, false) AS has_overlap_before, coalesce(q.touch, false) AS has_overlap_after
FROM every e LEFT JOIN links p ON p.doc_id = e.doc_id AND p.n = e.n LEFT JOIN links q ON q.doc_id = e.doc_id AND q.n = e.n + 1""".replace("ends AS (SELECT doc_id, n, list_distinct", "edges AS (SELECT doc_id, n, list_distinct").replace("FROM ends x JOIN ends y", "FROM edges x JOIN edges y"),
)
def chunk_overlaps(spark, folder):
    """Chunks with abstract and their overlap flags."""
    docs = chunk_source(spark, folder).withColumn("abstract", F.get(F.col("sections")[0]["paragraphs"], F.lit(0)))
    chunks = chunking.chunk_documents(docs, key="doc_id")
    return chunks.select("chunk_id", "chunk_type", "token_count", "char_count", "has_overlap_before", "has_overlap_after")
