"""Stages around collection: readiness, verdict budgets, statistics and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates
from paperloom.functions import latex as lx
from paperloom.functions import text as tx
from paperloom.functions import vectors as vx
from paperloom.functions import verdicts as vd
from paperloom.operators import chunking, curation, listing, parsing, sections, windows
from paperloom.plans.curation_queries import NEGATIVE, PAPERS_SQL, STRONG, papers, sql_list
from paperloom.plans.document_queries import both_sources
from paperloom.plans.listing_queries import BOUNDS_SQL, order_bounds
from paperloom.plans.registry import query
from paperloom.plans.source_queries import scratch
from paperloom.sources import metadata
from paperloom.sources.state import Progress
from paperloom.sources.store import Store
from paperloom.sources.tables import load, spread


@query(
    "papers_ready_for_parsing",
    f"""WITH {PAPERS_SQL} SELECT paper_id, citation_count FROM papers WHERE parse_status = 'P' AND (paper_id % 3 = 0 OR paper_id % 5 = 0)
ORDER BY citation_count DESC, paper_id LIMIT 300""",
)
def papers_ready_for_parsing(spark, folder):
    rows = papers(spark, folder).select(
        "paper_id", "citation_count", F.when(F.col("parse_status") == "P", "pending").otherwise("parsed").alias("parse_status"),
        F.when(F.col("paper_id") % 3 == 0, "a.pdf").alias("pdf_path"), F.when(F.col("paper_id") % 5 == 0, "a.tar.gz").alias("latex_path"),
    )
    ready = listing.ready_for_parsing(rows, 300, order=[F.desc("citation_count"), F.asc("paper_id")])
    return ready.select("paper_id", "citation_count")


@query(
    "papers_by_status",
    f"WITH {PAPERS_SQL} SELECT paper_id, citation_count FROM papers WHERE parse_status = 'F' ORDER BY citation_count DESC, paper_id LIMIT 25 OFFSET 75",
)
def papers_by_status(spark, folder):
    order = [F.desc("citation_count"), F.asc("paper_id")]
    return listing.by_status(papers(spark, folder), "F", 25, offset=75, order=order).select("paper_id", "citation_count")


@query(
    "citation_lookup",
    """SELECT 'arx' || p_partkey || 'v' || (p_size % 4 + 1) AS paper_id, n AS citation_count FROM part LEFT JOIN
  (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount > 0.09 GROUP BY l_partkey) ON l_partkey = p_partkey""",
)
def citation_lookup(spark, folder):
    """Lookup by id without its version; papers the source does not know get null."""
    counts = load(spark, folder, "lineitem").where(F.col("l_discount") > 0.09).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("citation_count"))
    source = counts.select(F.concat(F.lit("arx"), F.col("l_partkey").cast("string")).alias("paper_id"), "citation_count")
    version = (F.col("p_size") % 4 + 1).cast("string")
    asked = load(spark, folder, "part").select(F.concat(F.lit("arx"), F.col("p_partkey").cast("string"), F.lit("v"), version).alias("paper_id"))
    return metadata.citations_for(asked, source)


STAGE = f"""CASE WHEN list_bool_or(list_transform({sql_list([n.lower() for n in NEGATIVE])}, lambda k: contains(lower(text), k))) THEN 'drop'
  WHEN list_bool_or(list_transform({sql_list(STRONG)}, lambda k: contains(lower(text), k))) THEN 'keep' ELSE 'edge' END"""
STAGED_SQL = f"staged AS (SELECT doc_id, {STAGE} AS stage FROM documents)"


def staged(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    return curation.rule_split(docs, F.col("text"), negative=NEGATIVE, strong=STRONG).select(F.col("doc_id").alias("paper_id"), "stage")


@query(
    "collection_stats",
    f"""WITH {STAGED_SQL} SELECT count(*) AS collected, count(*) FILTER (stage = 'keep') AS kept, count(*) FILTER (stage = 'edge') AS edges,
  count(*) FILTER (stage = 'drop') AS dropped, round(count(*) FILTER (stage = 'keep') / count(*)::DOUBLE, 6) AS kept_share FROM staged""",
)
def collection_stats(spark, folder):
    return curation.collection_stats(staged(spark, folder))


@query(
    "edge_verdicts",
    f"""WITH {STAGED_SQL}, e AS (SELECT * FROM staged WHERE stage = 'edge' ORDER BY doc_id LIMIT 150)
SELECT e.doc_id AS paper_id, true AS accepted, 'quality 1' AS reason FROM e JOIN labels USING (doc_id) WHERE quality = 1
UNION ALL SELECT doc_id, NULL, NULL FROM staged WHERE stage = 'edge' AND doc_id NOT IN (SELECT doc_id FROM e)""",
)
def edge_verdicts(spark, folder):
    """The labels answer for the model; unlabelled documents have no answer and are rejected."""
    labels = load(spark, folder, "labels").select(F.col("doc_id").alias("paper_id"), "quality")
    edges = staged(spark, folder).where(F.col("stage") == "edge").join(labels, "paper_id", "left")
    answer = F.concat(F.lit("DECISION: "), F.when(F.col("quality") == 1, "YES").otherwise("No"), F.lit("\nREASON: quality "), F.col("quality").cast("string"))
    accepted, unasked = curation.verify_edges(edges, answer, 150, order=[F.asc("paper_id")])
    a = accepted.select("paper_id", F.lit(True).alias("accepted"), F.col("relevance_reason").alias("reason"))
    return a.unionByName(unasked.select("paper_id", F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("string").alias("reason")))


@query(
    "verdict_partition",
    """SELECT 'suitable' AS kind, count(*) AS n FROM labels WHERE quality = 1 AND toxic = 0 UNION ALL SELECT 'unsuitable', count(*) FROM labels WHERE NOT (quality = 1 AND toxic = 0)
UNION ALL SELECT 'keywords', count(DISTINCT doc_id % 50) FROM labels WHERE toxic = 0""",
)
def verdict_partition(spark, folder):
    """Toxic rows stand for answers that are no JSON: they count as unsuitable and suggest nothing."""
    body = F.concat(
        F.lit('{"suitable": '), F.when(F.col("quality") == 1, "true").otherwise("false"),
        F.lit(', "ng_keywords": [" Word'), (F.col("doc_id") % 50).cast("string"), F.lit(' ", "ab"]}'),
    )
    answer = F.when(F.col("toxic") == 1, F.lit("sorry")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    parsed = vd.fenced_json(answer, "struct<suitable:boolean,ng_keywords:array<string>>")
    rows = load(spark, folder, "labels").select("doc_id", parsed.alias("v"))
    good, bad = curation.by_verdict(rows, F.col("v.suitable"))
    words = curation.suggested_keywords(rows, F.col("v.ng_keywords"))
    counted = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return counted(good, "suitable").unionByName(counted(bad, "unsuitable")).unionByName(counted(words, "keywords"))


@query(
    "parsing_stats",
    """SELECT count(*) AS total, count(*) FILTER (lang = 'en') AS latex_success, count(*) FILTER (lang <> 'en') AS marker_success, 0::BIGINT AS failed,
  1.0::DOUBLE AS success_rate FROM documents""",
)
def parsing_stats(spark, folder):
    return parsing.parsing_stats(parsing.parse_sources(both_sources(spark, folder), "doc_id"))


@query(
    "embedding_stats",
    """SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS failed, round(count(vec_id) / count(*)::DOUBLE, 6) AS success_rate
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def embedding_stats(spark, folder):
    vectors = load(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunking.embedding_stats(load(spark, folder, "documents").select("doc_id").join(vectors, "doc_id", "left"))


@query(
    "equation_chunks",
    """SELECT 'p' || p_partkey || '_chunk_0' AS chunk_id, 'Context: Before' || chr(10) || chr(10) || 'The ' || p_name || ' of ' || p_brand || ' has size ' || p_size || ' and it costs ' || floor(p_retailprice)::INTEGER || ' in all.' AS content
FROM part WHERE p_size % 2 = 0""",
)
def equation_chunks(spark, folder):
    described = F.concat(
        F.lit("The "), "p_name", F.lit(" of "), "p_brand", F.lit(" has size "), F.col("p_size").cast("string"), F.lit(" and it costs "),
        F.floor("p_retailprice").cast("int").cast("string"), F.lit(" in all. "),
    )
    equation = F.struct(
        F.when(F.col("p_size") % 2 == 0, described).alias("text_description"), F.lit(" Before ").alias("context_before"), F.lit("").alias("context_after")
    )
    empty = F.array().cast("array<struct<title:string,paragraphs:array<string>>>")
    docs = load(spark, folder, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("paper_id"), empty.alias("sections"), F.array(equation).alias("equations"))
    return chunking.chunk_documents(docs).select("chunk_id", "content")


@query(
    "caption_and_title_text",
    """SELECT p_partkey, p_name || ' shown' AS caption, 'The ' || p_name || ' paper' AS title, 'x = ' || p_size AS equation, p_name || ' tail' AS plain FROM part""",
)
def caption_and_title_text(spark, folder):
    size = F.col("p_size").cast("string")
    return load(spark, folder, "part").select(
        "p_partkey",
        lx.caption(F.concat(F.lit("Fig. "), size, F.lit(": \\textbf{"), "p_name", F.lit("} shown"))).alias("caption"),
        lx.paper_title(F.concat(F.lit(": The % note\n {"), "p_name", F.lit("} paper --"))).alias("title"),
        lx.equation(F.concat(F.lit("\\begin{align} \\label{e} x =\n "), size, F.lit(" \\end{align}"))).alias("equation"),
        lx.plain_text(F.concat("p_name", F.lit(" \\begin{foo}gone\\end{foo}\\bar[o]{z} tail"))).alias("plain"),
    )


@query(
    "nested_section_filter",
    "SELECT n_nationkey AS section_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 1 AND r_name <> 'ASIA'",
)
def nested_section_filter(spark, folder):
    """Regions are top sections, nations their subsections: an excluded region takes its nations along."""
    regions = load(spark, folder, "region").select(
        (F.col("r_regionkey") + 1000).alias("section_id"), F.lit(None).cast("int").alias("parent_id"), F.when(F.col("r_name") == "ASIA", "References").otherwise("Body").alias("title")
    )
    nations = load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("section_id"), (F.col("n_regionkey") + 1000).alias("parent_id"), F.when(F.col("n_nationkey") % 4 == 1, "2. Funding").otherwise("Text").alias("title")
    )
    kept = sections.nested_excluded(regions.unionByName(nations))
    return kept.where(F.col("section_id") < 1000).select("section_id")


@query(
    "resumed_collection",
    f"""WITH {BOUNDS_SQL}, o AS (SELECT o_orderkey, s + (floor((o_orderdate::DATE - s) / 14.0) * 14)::INTEGER AS window_start, o_orderstatus FROM orders, b)
SELECT (SELECT count(*) FROM (SELECT unnest(generate_series(s, e, INTERVAL 14 DAY)) FROM b)) AS windows, count(*) AS total_collected, count(*) FILTER (o_orderstatus = 'F') AS total_filtered FROM o""",
)
def resumed_collection(spark, folder):
    """A first run up to the middle, then a second run over the whole range that skips what is done."""
    stage = F.when(F.col("o_orderstatus") == "F", "drop").otherwise("keep").alias("stage")
    orders = load(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), stage)
    progress = Progress(Store(spark, scratch(spark)))
    progress.start()
    bounds = order_bounds(spark, folder)
    half = dates.date_windows(bounds, 14).where(F.month("window_start") > 6)
    for skip in (half, progress.completed()):
        hits = windows.window_scan(orders, bounds, 14, day_col="d", id_col="o_orderkey", completed=skip)
        searched = dates.date_windows(bounds, 14).join(skip.select("window_start"), "window_start", "left_anti")
        progress.mark(hits, "stage", searched)
    return progress.totals()


@query(
    "sparse_map_weights",
    """WITH k AS (SELECT user_id, CAST(props->>'k' AS INTEGER) AS term, count(*)::DOUBLE AS w FROM events GROUP BY ALL),
m AS (SELECT k.*, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, term) AS r FROM k)
SELECT user_id, count(*)::INTEGER AS terms, sum(w) AS weight, sum(w * w) AS self_product FROM m WHERE r <= 20 GROUP BY user_id""",
)
def sparse_map_weights(spark, folder):
    """Per-user term maps cut to their 20 heaviest entries, and each map's product with itself.

    A user has at most a hundred terms here, so the map is bounded by the vocabulary.
    """
    term = F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k"))
    counts = load(spark, folder, "events").groupBy("user_id", term.alias("term")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    packed = counts.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "w")))).alias("m"))
    cut = packed.select("user_id", vx.top_weights(F.col("m"), 20).alias("m"))
    return cut.select(
        "user_id", F.size("m").alias("terms"), F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, x: a + x).alias("weight"),
        vx.sparse_dot(F.col("m"), F.col("m")).alias("self_product"),
    )


@query(
    "overlap_vocabulary",
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS ws FROM conversations)
SELECT a.conv_id, a.turn, len(list_intersect(a.ws, b.ws))::INTEGER AS shared FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""",
)
def overlap_vocabulary(spark, folder):
    """Neighbouring turns by an equi-join on the previous turn number: no window over a long conversation."""
    turns = load(spark, folder, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    both = turns.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", tx.share_vocabulary(F.col("text"), F.col("previous")).alias("shared"))
