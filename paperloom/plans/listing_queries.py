"""Pages, counts, joins, data changes, windows, chat context and JSON over the contract tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import dates, text as tx
from paperloom.operators import changes, chat, listing, search, windows
from paperloom.plans import fixtures as fx
from paperloom.plans.curation_queries import PAPERS_SQL, papers
from paperloom.plans.registry import query
from paperloom.sources.tables import load


@query(
    "papers_page",
    f"WITH {PAPERS_SQL} SELECT paper_id, citation_count, published FROM papers WHERE parse_status = 'O' ORDER BY citation_count DESC, paper_id LIMIT 20 OFFSET 40",
)
def papers_page(spark, folder):
    rows = papers(spark, folder).withColumnRenamed("published", "published_date")
    page = listing.page(rows, number=3, size=20, status="O", columns=["paper_id", "citation_count", "published_date"])
    return page.withColumnRenamed("published_date", "published")


@query(
    "papers_page_by_date",
    f"WITH {PAPERS_SQL} SELECT paper_id, published FROM papers ORDER BY published ASC, paper_id LIMIT 50 OFFSET 50",
)
def papers_page_by_date(spark, folder):
    rows = papers(spark, folder).withColumnRenamed("published", "published_date")
    page = listing.page(rows, number=2, size=50, sort_by="published_date", order="asc", columns=["paper_id", "published_date"])
    return page.withColumnRenamed("published_date", "published")


@query(
    "papers_top",
    f"WITH {PAPERS_SQL} SELECT paper_id, citation_count, published FROM papers ORDER BY citation_count DESC NULLS LAST, published DESC, paper_id LIMIT 50 OFFSET 50",
)
def papers_top(spark, folder):
    order = [F.desc_nulls_last("citation_count"), F.desc("published"), F.asc("paper_id")]
    rows = papers(spark, folder).select("paper_id", "citation_count", "published")
    return rows.orderBy(*order).offset(50).limit(50)


@query(
    "status_counts",
    """SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
  count(*) FILTER (o_orderstatus = 'F') AS "F" FROM orders""",
)
def status_counts(spark, folder):
    return listing.status_counts(load(spark, folder, "orders"), "o_orderstatus", ["O", "P", "F"])


@query("count_papers_with_chunks", "SELECT count(DISTINCT source) AS papers, count(*) AS chunks FROM documents")
def count_papers_with_chunks(spark, folder):
    return load(spark, folder, "documents").agg(F.countDistinct("source").alias("papers"), F.count(F.lit(1)).alias("chunks"))


@query(
    "papers_by_ids",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def papers_by_ids(spark, folder):
    ids = load(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, folder, "customer").join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "paper_with_chunks",
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
def paper_with_chunks(spark, folder):
    customers = load(spark, folder, "customer").select("c_custkey")
    orders = load(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return listing.with_children(customers, orders, "c_custkey")


@query(
    "citation_enrichment",
    """WITH c AS (SELECT p_partkey, coalesce(n, 0) AS citation_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem
  WHERE l_returnflag = 'R' AND l_quantity > 45 GROUP BY l_partkey) ON l_partkey = p_partkey)
SELECT count(*) AS papers, count(*) FILTER (citation_count > 0) AS with_citations, sum(citation_count)::BIGINT AS total_citations FROM c""",
)
def citation_enrichment(spark, folder):
    heavy = load(spark, folder, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    counts = heavy.groupBy(F.col("l_partkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("citation_count"))
    parts = load(spark, folder, "part").select(F.col("p_partkey").alias("paper_id"))
    return listing.citation_stats(listing.with_citations(parts, counts))


@query("ids_missing_vectors", "SELECT doc_id FROM documents ANTI JOIN embeddings ON vec_id = doc_id")
def ids_missing_vectors(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id")
    return listing.lacking(docs, load(spark, folder, "embeddings"), "doc_id", "vec_id")


@query(
    "papers_without_chunks",
    "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
)
def papers_without_chunks(spark, folder):
    customers = load(spark, folder, "customer").where(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    return listing.lacking(customers, load(spark, folder, "orders").where(F.col("o_orderstatus") == "P"), "c_custkey", "o_custkey")


@query(
    "dedup_first_wins",
    "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
)
def dedup_first_wins(spark, folder):
    events = load(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return listing.dedup_first(events, "user_id", [F.asc("ts"), F.asc("event_id")]).drop("ts")


@query(
    "text_validity_sets",
    """(SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT vec_id FROM embeddings""",
)
def text_validity_sets(spark, folder):
    docs, labels = load(spark, folder, "documents").select("doc_id"), load(spark, folder, "labels").select("doc_id")
    return docs.intersect(labels).subtract(load(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id")))


INCOMING_SQL = """incoming AS (SELECT c_custkey + 50 AS c_custkey, c_name || '*' AS c_name, c_acctbal, o.n AS version FROM customer
  JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey),
target AS (SELECT c_custkey, c_name, c_acctbal, 0::BIGINT AS version FROM customer)"""


def target_and_incoming(spark, folder):
    customers = load(spark, folder, "customer")
    counts = load(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("version"))
    target = customers.select("c_custkey", "c_name", "c_acctbal", F.lit(0).cast("bigint").alias("version"))
    incoming = customers.join(counts, "c_custkey").select(
        (F.col("c_custkey") + 50).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), "c_acctbal", "version"
    )
    return target, incoming


@query(
    "upsert_latest",
    f"""WITH {INCOMING_SQL}, every AS (SELECT *, 1 AS side FROM incoming UNION ALL SELECT *, 0 FROM target)
SELECT c_custkey, c_name, c_acctbal, version FROM every QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY side DESC, version DESC) = 1""",
)
def upsert_latest(spark, folder):
    target, incoming = target_and_incoming(spark, folder)
    return changes.upsert(target, incoming, ["c_custkey"], "version")


@query(
    "upsert_versions",
    """SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
def upsert_versions(spark, folder):
    """Every event is a version of its user's row: the newest wins within one batch."""
    events = load(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return changes.upsert(events.where(F.lit(False)), events, ["user_id"], "event_id")


@query(
    "insert_ignore",
    f"""WITH {INCOMING_SQL} SELECT * FROM target UNION ALL SELECT * FROM incoming ANTI JOIN target USING (c_custkey)""",
)
def insert_ignore(spark, folder):
    target, incoming = target_and_incoming(spark, folder)
    return changes.insert_ignore(target, incoming, ["c_custkey"])


@query(
    "update_fields",
    f"""WITH {INCOMING_SQL} SELECT t.c_custkey, coalesce(i.c_name, t.c_name) AS c_name, t.c_acctbal,
  CASE WHEN i.c_custkey IS NOT NULL THEN 7 ELSE t.version END::BIGINT AS version FROM target t
  LEFT JOIN (SELECT c_custkey, CASE WHEN version > 10 THEN c_name END AS c_name FROM incoming) i USING (c_custkey)""",
)
def update_fields(spark, folder):
    target, incoming = target_and_incoming(spark, folder)
    change = incoming.select("c_custkey", F.when(F.col("version") > 10, F.col("c_name")).alias("c_name"))
    return changes.update(target, change, ["c_custkey"], touched="version", now=F.lit(7).cast("bigint"))


@query(
    "delete_cascade",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'parent' AS kind, count(*) AS left_over FROM customer ANTI JOIN gone USING (c_custkey)
UNION ALL SELECT 'child', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'deleted', count(*) FROM gone""",
)
def delete_cascade(spark, folder):
    customers, orders = load(spark, folder, "customer"), load(spark, folder, "orders")
    gone = customers.where(F.col("c_acctbal") < 0)
    parents, children = changes.delete_cascade(customers, orders, gone, "c_custkey", "o_custkey")
    counted = lambda df, kind: df.agg(F.count(F.lit(1)).alias("left_over")).select(F.lit(kind).alias("kind"), "left_over")
    deleted = changes.deleted_count(customers, gone, ["c_custkey"]).select(F.lit("deleted").alias("kind"), F.col("deleted").alias("left_over"))
    return counted(parents, "parent").unionByName(counted(children, "child")).unionByName(deleted)


@query(
    "migrate_vectors",
    """SELECT vec_id AS chunk_id, round(list_sum(embedding::DOUBLE[]), 5) AS total, label + 1 AS n_terms, label * 0.5::DOUBLE AS weight FROM embeddings
WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def migrate_vectors(spark, folder):
    """Vectors leave as JSON text, sparse ones in either spelling, and are read back."""
    vectors = load(spark, folder, "embeddings")
    keys = F.sequence(F.lit(0), F.col("label"))
    weights = F.transform(keys, lambda i: F.col("label") * F.lit(0.5))
    pair = F.to_json(F.struct(keys.alias("indices"), weights.alias("values")))
    plain = F.to_json(F.map_from_arrays(keys.cast("array<string>"), weights))
    chunks = vectors.select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("paper_id"),
        F.to_json("embedding").alias("dense_json"), F.when(F.col("label") % 2 == 0, pair).otherwise(plain).alias("sparse_json"),
    )
    there = load(spark, folder, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("chunk_id"))
    moved = changes.migrate(chunks, there)
    total = F.aggregate("dense", F.lit(0.0), lambda a, x: a + x)
    return moved.select("chunk_id", F.round(total, 5).alias("total"), F.size("sparse").alias("n_terms"), F.element_at("sparse", 0).alias("weight"))


@query(
    "migration_check",
    "SELECT (SELECT count(*) FROM embeddings) AS source_count, (SELECT count(*) FROM documents) AS target_count, (SELECT count(*) FROM documents) >= (SELECT count(*) FROM embeddings) AS passed",
)
def migration_check(spark, folder):
    return changes.migration_check(load(spark, folder, "embeddings"), load(spark, folder, "documents"))


BOUNDS_SQL = "b AS (SELECT min(o_orderdate)::DATE AS s, max(o_orderdate)::DATE AS e FROM orders)"


def order_bounds(spark, folder):
    days = load(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))
    return days.agg(F.min("d").alias("start"), F.max("d").alias("end"))


@query(
    "date_windows",
    f"""WITH {BOUNDS_SQL} SELECT w::DATE AS window_start, least(w::DATE + 13, e) AS window_end FROM b, LATERAL (SELECT unnest(generate_series(s, e, INTERVAL 14 DAY)) AS w)""",
)
def date_windows(spark, folder):
    return dates.date_windows(order_bounds(spark, folder), 14)


@query(
    "month_windows",
    f"""WITH {BOUNDS_SQL} SELECT strftime(m, '%Y-%m') AS month, m::DATE AS month_start, least(last_day(m), e) AS month_end
FROM b, LATERAL (SELECT unnest(generate_series(date_trunc('month', s), e, INTERVAL 1 MONTH)) AS m)""",
)
def month_windows(spark, folder):
    return dates.month_windows(order_bounds(spark, folder))


@query(
    "window_scan",
    f"""WITH {BOUNDS_SQL}, o AS (SELECT o_orderkey, o_orderdate::DATE AS d, s + (floor((o_orderdate::DATE - s) / 14.0) * 14)::INTEGER AS window_start FROM orders, b),
skip AS (SELECT DISTINCT window_start FROM o WHERE month(window_start) = 2)
SELECT o_orderkey, d, window_start FROM o WHERE window_start NOT IN (SELECT window_start FROM skip)
QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY d DESC, o_orderkey) <= 60""",
)
def window_scan(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    bounds = order_bounds(spark, folder)
    done = dates.date_windows(bounds, 14).where(F.month("window_start") == 2)
    hits = windows.window_scan(orders, bounds, 14, day_col="d", id_col="o_orderkey", per_window=60, completed=done)
    return hits.select("o_orderkey", "d", "window_start")


@query(
    "date_parsing",
    """SELECT o_orderkey, o_orderdate::DATE AS from_iso, o_orderdate::DATE AS from_zulu, NULL::DATE AS broken, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(o_orderdate, '%Y%m%d') || '0000' AS day_start, strftime(o_orderdate, '%Y%m%d') || '2359' AS day_end FROM orders""",
)
def date_parsing(spark, folder):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    d = F.to_date("o_orderdate")
    return load(spark, folder, "orders").select(
        "o_orderkey",
        dates.to_day(day).alias("from_iso"),
        dates.to_day(F.concat(day, F.lit("T00:00:00Z"))).alias("from_zulu"),
        dates.to_day(F.concat(F.lit("n/a "), day)).alias("broken"),
        dates.month_key(d).alias("month"),
        dates.stamp(d, False).alias("day_start"),
        dates.stamp(d, True).alias("day_end"),
    )


ONE_SQL = f"""WITH {fx.TERM_CTES}, {fx.sparse_leg(30)},
h AS (SELECT l.item_id, l.doc_id, l.score, l.rank, d.source, d.text FROM sparse_leg l JOIN documents d USING (doc_id)),
f AS (SELECT *, rank AS hit_rank FROM h QUALIFY row_number() OVER (PARTITION BY item_id, source ORDER BY h.rank) = 1),
one AS (SELECT item_id, doc_id, score, source, text, hit_rank, row_number() OVER (PARTITION BY item_id ORDER BY hit_rank) AS r FROM f QUALIFY r <= 10),
bud AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY item_id ORDER BY r) AS used FROM one QUALIFY used <= 20000)"""


def chat_hits(spark, folder):
    """Three times as many hits as papers wanted, with the payload a context needs."""
    docs = load(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("paper_id"), F.col("text").alias("content"), F.col("lang").alias("section_title")
    )
    hits = fx.sparse_hits(spark, folder, 30)
    full = search.with_content(hits, docs, id_col="doc_id", columns=["paper_id", "content", "section_title"])
    return chat.one_per_paper(full, 10)


@query("dedup_per_paper", f"{ONE_SQL} SELECT item_id, doc_id, source, r::INTEGER AS rank FROM one")
def dedup_per_paper(spark, folder):
    return fx.as_items(chat_hits(spark, folder)).select("item_id", "doc_id", F.col("paper_id").alias("source"), "rank")


@query(
    "context_budget",
    f"{ONE_SQL} SELECT item_id, doc_id, r::INTEGER AS rank, length(text) // 4 AS est_tokens, used::BIGINT AS used_tokens FROM bud",
)
def context_budget(spark, folder):
    kept = fx.as_items(chat.within_budget(chat_hits(spark, folder), budget=20_000))
    return kept.select("item_id", "doc_id", "rank", "est_tokens", "used_tokens")


@query(
    "chat_sources",
    f"""{ONE_SQL} SELECT item_id, r::INTEGER AS rank, source, source AS title, substr(text, 1, 500) AS snippet, round_even(score, 3) AS similarity FROM one""",
)
def chat_sources(spark, folder):
    """No source table names a paper here, so every title falls back to the id."""
    papers_table = load(spark, folder, "nation").select(F.col("n_name").alias("paper_id"), F.col("n_name").alias("title"))
    out = chat.sources(chat_hits(spark, folder), papers_table)
    return out.select(F.col("query_id").alias("item_id"), "rank", F.col("paper_id").alias("source"), "title", "snippet", "similarity")


@query(
    "chat_history_tail",
    "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS from_end FROM conversations QUALIFY from_end <= 6",
)
def chat_history_tail(spark, folder):
    return chat.history_tail(load(spark, folder, "conversations")).select("conv_id", "turn", "role", "from_end")


PROMPT_HEAD = chat.SYSTEM_TEXT.replace("'", "''")


@query(
    "prompt_build",
    f"""{ONE_SQL}, ctx AS (SELECT item_id, string_agg('[' || r || '] Paper: ' || source || ' | Section: ' || lang || chr(10) || b.text || chr(10), chr(10) || '---' || chr(10) ORDER BY r) AS c
  FROM bud b JOIN documents USING (doc_id, source) GROUP BY item_id),
tail AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6),
hist AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text || chr(10), '' ORDER BY turn) AS h FROM tail GROUP BY conv_id)
SELECT ctx.item_id, md5('{PROMPT_HEAD}' || chr(10) || chr(10) || 'Excerpts:' || chr(10) || c || chr(10)
  || CASE WHEN length(coalesce(h, '')) > 0 THEN chr(10) || chr(10) || 'Earlier turns:' || chr(10) || h ELSE '' END
  || chr(10) || 'Question: ' || b.text || chr(10) || chr(10) || 'Answer:') AS prompt_md5
FROM ctx JOIN benchmark b USING (item_id) LEFT JOIN hist ON conv_id = ctx.item_id""",
)
def prompt_build(spark, folder):
    context = chat.build_context(chat.within_budget(chat_hits(spark, folder), budget=20_000))
    history = chat.history_text(load(spark, folder, "conversations")).withColumnRenamed("conv_id", "query_id")
    items = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = context.join(items, "query_id").join(history, "query_id", "left")
    text = chat.prompt(F.col("question"), F.col("context"), F.col("history"))
    return rows.select(F.col("query_id").alias("item_id"), F.md5(text).alias("prompt_md5"))


@query(
    "papers_with_abstract",
    """SELECT doc_id, source FROM documents WHERE length(trim(text)) >= 50""",
)
def papers_with_abstract(spark, folder):
    return listing.with_abstract(load(spark, folder, "documents"), abstract_col="text").select("doc_id", "source")


@query(
    "upsert_sparse_maps",
    """WITH k AS (SELECT user_id, CAST(props->>'k' AS INTEGER) AS term, count(*) AS w FROM events GROUP BY ALL),
u AS (SELECT user_id, sum(w) AS w FROM k WHERE term IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN -1.0 WHEN user_id % 2 = 0 THEN 2.0 * w ELSE w END::DOUBLE AS weight FROM u""",
)
def upsert_sparse_maps(spark, folder):
    """Sparse vectors (maps) replaced and inserted by key: two versions for every third user, one for every second."""
    term = F.try_element_at(F.from_json("props", "map<string,int>"), F.lit("k"))
    counts = load(spark, folder, "events").groupBy("user_id", term.alias("term")).agg(F.count(F.lit(1)).cast("double").alias("w")).where("term IS NOT NULL")
    total = counts.groupBy("user_id").agg(F.sum("w").alias("w"))
    table = total.select("user_id", F.lit(1).alias("version"), F.create_map(F.lit(0), F.col("w")).alias("sparse"))
    double = table.where("user_id % 2 = 0").select("user_id", F.lit(2).alias("version"), F.transform_values("sparse", lambda k, w: 2 * w).alias("sparse"))
    marked = table.where("user_id % 3 = 0").select("user_id", F.lit(3).alias("version"), F.transform_values("sparse", lambda k, w: F.lit(-1.0)).alias("sparse"))
    old = table.where("user_id % 5 <> 0")
    changed = changes.upsert(old, double.unionByName(marked), ["user_id"], "version")
    whole = changes.insert_ignore(changed, table, ["user_id"])
    return whole.select("user_id", F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda a, w: a + w).alias("weight"))


@query(
    "json_props",
    """SELECT event_type, count(*) AS n, sum(CAST(props->>'k' AS BIGINT))::BIGINT AS total, max(CAST(props->>'k' AS INTEGER)) AS largest,
  count(*) FILTER (json_exists(props, '$.k')) AS has_k FROM events GROUP BY event_type""",
)
def json_props(spark, folder):
    events = load(spark, folder, "events").select("event_type", F.from_json("props", "map<string,int>").alias("p"))
    k = F.try_element_at("p", F.lit("k"))
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("largest"),
        F.count_if(F.map_contains_key("p", F.lit("k"))).alias("has_k"),
    )


@query(
    "string_helpers",
    r"""SELECT page_id, split_part(url, '/', -1) AS segment, translate(url, '/:', '__') AS file_name,
  CASE WHEN length(url) > 30 THEN substr(url, 1, 30) || '...' ELSE url END AS short_url,
  replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  page_id::VARCHAR AS paper, page_id::VARCHAR AS unversioned FROM pages""",
)
def string_helpers(spark, folder):
    url, pid = F.col("url"), F.col("page_id").cast("string")
    return load(spark, folder, "pages").select(
        "page_id",
        tx.last_path_segment(url).alias("segment"),
        tx.safe_file_name(url).alias("file_name"),
        tx.ellipsis(url, 30).alias("short_url"),
        tx.html_escape(url).alias("escaped"),
        tx.paper_id(F.concat(F.lit("ARXIV:"), pid)).alias("paper"),
        tx.without_version(F.concat(pid, F.lit("v12"))).alias("unversioned"),
    )
