"""Retrieval evaluation over the benchmark passages and everything derived from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import coverage, dashboard, evaluation, fusion, rerank, search
from paperloom.operators.containment import contains_join
from paperloom.plans import fixtures as fx
from paperloom.plans.registry import query
from paperloom.session import cut_lineage
from paperloom.sources.tables import load, spread

MODES = ("dense", "sparse", "text", "hybrid")
ORDER = ["dense", "dense+rerank", "sparse", "sparse+rerank", "hybrid", "hybrid+rerank"]
PAIR_METRICS = ("ndcg_5", "ndcg_10", "mrr", "precision_10")

QRELS = "qrels AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"

LEGS_SQL = f"""{fx.TERM_CTES}, {fx.EMBED_CTES}, {fx.dense_leg(20)}, {fx.sparse_leg(20)}, {fx.text_leg(20)},
{fx.fused({"dense": 1.0, "sparse": 1.0}, 10, name="hybrid")}, {QRELS}"""

HITS_SQL = """hits AS (
  SELECT 'dense' AS mode, item_id, doc_id, rank FROM dense_leg WHERE rank <= 10
  UNION ALL SELECT 'sparse', item_id, doc_id, rank FROM sparse_leg WHERE rank <= 10
  UNION ALL SELECT 'text', item_id, doc_id, rank FROM text_leg WHERE rank <= 10
  UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM hybrid)"""

RERANKED_SQL = """base AS (SELECT * FROM hits WHERE mode <> 'text'),
pair AS (SELECT f.mode, f.item_id, f.doc_id, f.rank AS r0, count(*) OVER (PARTITION BY f.mode, f.item_id) AS n,
  round((SELECT count(*) FROM qry_tf q JOIN doc_tf d USING (term) WHERE q.item_id = f.item_id AND d.doc_id = f.doc_id)
    / (SELECT count(*) FROM qry_tf q WHERE q.item_id = f.item_id)::DOUBLE, 10) AS s FROM base f),
again AS (SELECT mode || '+rerank' AS mode, item_id, doc_id,
  row_number() OVER (PARTITION BY mode, item_id ORDER BY CASE WHEN n <= 5 THEN NULL ELSE s END DESC NULLS LAST, r0) AS rank
  FROM pair QUALIFY rank <= 5),
all_hits AS (SELECT mode, item_id, doc_id, rank FROM base UNION ALL SELECT * FROM again)"""


def metrics_sql(hits: str, name: str = "metrics") -> str:
    def ideal(k):
        return f"list_sum(list_transform(range(1, least(n_rel, {k})::BIGINT + 1), lambda i: 1 / log2(i + 1)))"

    return f"""
judged AS (SELECT h.*, (q.doc_id IS NOT NULL)::INTEGER AS rel FROM {hits} h LEFT JOIN qrels q USING (item_id, doc_id)),
wanted AS (SELECT item_id, count(*) AS n_relevant FROM qrels GROUP BY item_id),
agg AS (SELECT mode, item_id, count(*) AS n, sum(rel) AS n_rel,
  coalesce(sum(rel) FILTER (rank <= 5), 0) AS rel_5, coalesce(sum(rel) FILTER (rank <= 10), 0) AS rel_10,
  min(rank) FILTER (rel = 1) AS first_rel,
  sum(CASE WHEN rank <= 5 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg_5,
  sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg_10 FROM judged GROUP BY ALL),
{name} AS (SELECT mode, item_id, coalesce(1.0::DOUBLE / first_rel, 0.0) AS mrr,
  CASE WHEN n_rel > 0 THEN dcg_5 / {ideal(5)} ELSE 0.0 END AS ndcg_5,
  CASE WHEN n_rel > 0 THEN dcg_10 / {ideal(10)} ELSE 0.0 END AS ndcg_10,
  CASE WHEN n >= 5 THEN rel_5 / 5.0::DOUBLE ELSE n_rel / greatest(n, 1)::DOUBLE END AS precision_5,
  CASE WHEN n >= 10 THEN rel_10 / 10.0::DOUBLE ELSE n_rel / greatest(n, 1)::DOUBLE END AS precision_10,
  CASE WHEN coalesce(n_relevant, 0) > 0 THEN rel_10 / n_relevant::DOUBLE ELSE 0.0 END AS recall_10,
  CASE WHEN rel_10 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_rate_10, n AS num_results
  FROM agg LEFT JOIN wanted USING (item_id))"""


COLUMNS = "mrr ndcg_5 ndcg_10 precision_5 precision_10 recall_10 hit_rate_10".split()
ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in COLUMNS)
AVERAGED = ", ".join(f"round(avg({c}), 8) AS avg_{c}" for c in COLUMNS) + ", count(*) AS num_queries"


def judgements(spark, folder):
    """Relevant documents of each benchmark item: those whose text holds its passage."""
    pairs = contains_join(
        spread(load(spark, folder, "documents").select("doc_id", "text")), load(spark, folder, "benchmark"),
        doc_id="doc_id", doc_text="text", passage_id="item_id", passage_text="text",
    )
    return pairs.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))


def base_hits(spark, folder):
    """Top-10 hits per mode; each leg scans the corpus once and is kept, being queries x depth rows."""
    legs = {
        name: cut_lineage(make(spark, folder, 20))
        for name, make in (("dense", fx.dense_hits), ("sparse", fx.sparse_hits), ("text", fx.text_hits))
    }
    hybrid = fusion.rrf({"dense": (legs["dense"], 1.0), "sparse": (legs["sparse"], 1.0)}, 10)
    columns = ["query_id", "chunk_id", "score", "rank"]
    modes = {name: leg.where(F.col("rank") <= 10).select(*columns) for name, leg in legs.items()}
    modes["hybrid"] = hybrid.select(*columns)
    return modes


def with_rerank(spark, folder, modes):
    """Every base mode but full text, and its reranked twin cut to five."""
    docs = load(spark, folder, "documents").withColumnRenamed("text", "content")
    items = load(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = {}
    for name in ("dense", "sparse", "hybrid"):
        hits = modes[name]
        full = search.with_content(hits, docs, id_col="doc_id", columns=["content"]).join(items, "query_id")
        out[name] = hits
        out[name + dashboard.SUFFIX] = rerank.rerank(full, 5).select(*hits.columns)
    return out


def metrics_of(spark, folder, modes):
    qrels = cut_lineage(judgements(spark, folder)).withColumn("paper_id", F.lit(None).cast("string"))
    hits = dashboard.union_modes(modes).withColumn("paper_id", F.col("chunk_id").cast("string"))
    judged = evaluation.judge(hits, qrels)
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return evaluation.query_metrics(judged, ["mode", "query_id"], totals)


@query("qrels_contains", f"WITH {QRELS} SELECT * FROM qrels")
def qrels_contains(spark, folder):
    return fx.as_items(judgements(spark, folder))


@query(
    "eval_metrics",
    f"WITH {LEGS_SQL}, {HITS_SQL}, {metrics_sql('hits')} SELECT mode, item_id, {ROUNDED}, num_results FROM metrics",
)
def eval_metrics(spark, folder):
    metrics = metrics_of(spark, folder, base_hits(spark, folder))
    rounded = [F.round(c, 8).alias(c) for c in COLUMNS]
    return metrics.select("mode", F.col("query_id").alias("item_id"), *rounded, "num_results")


@query(
    "eval_means",
    f"WITH {LEGS_SQL}, {HITS_SQL}, {RERANKED_SQL}, {metrics_sql('all_hits')} SELECT mode, {AVERAGED} FROM metrics GROUP BY mode",
)
def eval_means(spark, folder):
    modes = with_rerank(spark, folder, base_hits(spark, folder))
    return evaluation.mean_metrics(metrics_of(spark, folder, modes), ["mode"])


STYLE = "CASE WHEN length(text) < 180 THEN 'keyword' WHEN length(text) < 220 THEN 'natural_short' WHEN length(text) < 260 THEN 'natural_long' ELSE 'conceptual' END"
DIFFICULTY = "CASE WHEN length(text) % 3 = 0 THEN 'easy' WHEN length(text) % 3 = 1 THEN 'medium' ELSE 'hard' END"


def query_groups(spark, folder):
    """Stand-in query style and difficulty, both from the length of the query text."""
    return load(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.expr(STYLE).alias("style"), F.expr(DIFFICULTY).alias("difficulty")
    )


@query(
    "eval_by_group",
    f"""WITH {LEGS_SQL}, {HITS_SQL}, {metrics_sql('hits')},
tagged AS (SELECT m.*, {STYLE} AS style, {DIFFICULTY} AS difficulty FROM metrics m JOIN benchmark USING (item_id))
SELECT mode, 'all' AS grouping, 'all' AS value, {AVERAGED} FROM tagged GROUP BY mode
UNION ALL SELECT mode, 'style', style, {AVERAGED} FROM tagged GROUP BY mode, style
UNION ALL SELECT mode, 'difficulty', difficulty, {AVERAGED} FROM tagged GROUP BY mode, difficulty""",
)
def eval_by_group(spark, folder):
    metrics = metrics_of(spark, folder, base_hits(spark, folder))
    tagged = metrics.join(query_groups(spark, folder), "query_id")
    return evaluation.grouped_means(tagged, "mode", ["style", "difficulty"])


@query(
    "hit_rate",
    f"""WITH {LEGS_SQL}, {HITS_SQL}, grid AS (SELECT item_id, mode FROM benchmark, (SELECT unnest(['dense', 'sparse', 'text', 'hybrid']) AS mode)),
hit AS (SELECT DISTINCT mode, item_id FROM hits JOIN qrels USING (item_id, doc_id) WHERE rank <= 10)
SELECT g.mode, round(avg((h.item_id IS NOT NULL)::INTEGER), 8) AS hit_rate_10, count(*) AS num_queries
FROM grid g LEFT JOIN hit h ON h.mode = g.mode AND h.item_id = g.item_id GROUP BY g.mode""",
)
def hit_rate(spark, folder):
    metrics = metrics_of(spark, folder, base_hits(spark, folder))
    queries = query_groups(spark, folder).select("query_id")
    full = evaluation.complete(metrics, queries, MODES, ["mode", "query_id"])
    return full.groupBy("mode").agg(F.round(F.avg("hit_rate_10"), 8).alias("hit_rate_10"), F.count(F.lit(1)).alias("num_queries"))


@query(
    "eval_by_paper",
    f"""WITH {fx.TERM_CTES}, {fx.sparse_leg(10)}, {QRELS},
rel AS (SELECT DISTINCT item_id, source FROM qrels JOIN documents USING (doc_id)),
judged AS (SELECT l.item_id, l.rank, (r.source IS NOT NULL)::INTEGER AS rel FROM sparse_leg l JOIN documents d USING (doc_id)
  LEFT JOIN rel r ON r.item_id = l.item_id AND r.source = d.source)
SELECT item_id, coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1), 0.0) AS mrr,
  round(sum(rel) / (SELECT count(*) FROM rel r WHERE r.item_id = j.item_id)::DOUBLE, 8) AS recall_10 FROM judged j
WHERE item_id IN (SELECT item_id FROM rel) GROUP BY item_id""",
)
def eval_by_paper(spark, folder):
    """Paper-level judgements: several chunks of one relevant paper each count, so recall may exceed 1."""
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"))
    qrels = judgements(spark, folder).join(docs, "chunk_id").select("query_id", "paper_id").distinct()
    qrels = qrels.withColumn("chunk_id", F.lit(None).cast("bigint"))
    hits = fx.sparse_hits(spark, folder, 10).join(docs, "chunk_id")
    judged = evaluation.judge(hits, qrels)
    totals = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    metrics = evaluation.query_metrics(judged, ["query_id"], totals).join(totals, "query_id", "left_semi")
    return metrics.select(F.col("query_id").alias("item_id"), "mrr", F.round("recall_10", 8).alias("recall_10"))


GRID_SQL = """vals AS (SELECT unnest(list_transform(range(11), lambda i: round(i * 0.1, 1)))::DOUBLE AS v),
grid AS (SELECT DISTINCT round(d.v / (d.v + s.v + c.v), 12) AS dense_weight, round(s.v / (d.v + s.v + c.v), 12) AS sparse_weight,
  round(c.v / (d.v + s.v + c.v), 12) AS third_weight FROM vals d, vals s, vals c
  WHERE d.v + s.v + c.v >= 0.9 AND d.v + s.v + c.v <= 1.1)"""

CANDIDATES_SQL = """cand AS (SELECT item_id, doc_id, max(dr) AS dr, max(sr) AS sr, max(tr) AS tr FROM (
  SELECT item_id, doc_id, rank AS dr, NULL AS sr, NULL AS tr FROM dense_leg
  UNION ALL SELECT item_id, doc_id, NULL, rank, NULL FROM sparse_leg
  UNION ALL SELECT item_id, doc_id, NULL, NULL, rank FROM text_leg) GROUP BY ALL)"""


@query(
    "weight_grid",
    f"""WITH {LEGS_SQL}, {GRID_SQL}, {CANDIDATES_SQL},
scored AS (SELECT g.*, item_id, doc_id, dr, sr, tr, round(coalesce(dense_weight / (60 + dr), 0.0)
  + coalesce(sparse_weight / (60 + sr), 0.0) + coalesce(third_weight / (60 + tr), 0.0), 12) AS score FROM cand, grid g),
hits AS (SELECT dense_weight::VARCHAR || '|' || sparse_weight::VARCHAR || '|' || third_weight::VARCHAR AS mode, dense_weight, sparse_weight,
  third_weight, item_id, doc_id, row_number() OVER (PARTITION BY dense_weight, sparse_weight, third_weight, item_id
  ORDER BY score DESC, dr ASC NULLS LAST, sr ASC NULLS LAST, tr ASC NULLS LAST, doc_id) AS rank FROM scored QUALIFY rank <= 10),
{metrics_sql('hits')}, w AS (SELECT DISTINCT mode, dense_weight, sparse_weight, third_weight FROM hits)
SELECT dense_weight, sparse_weight, third_weight, round(avg(mrr), 8) AS avg_mrr, round(avg(ndcg_10), 8) AS avg_ndcg_10,
  round(avg(precision_5), 8) AS avg_precision_5, count(*) AS num_queries FROM metrics JOIN w USING (mode) GROUP BY ALL""",
)
def weight_grid(spark, folder):
    legs = {"dense": fx.dense_hits, "sparse": fx.sparse_hits, "third": fx.text_hits}
    hits = {name: (make(spark, folder, 20), 1.0) for name, make in legs.items()}
    candidates = cut_lineage(fusion.rrf(hits, 60).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "third_rank"))
    grid = evaluation.weight_grid(spark)
    return evaluation.grid_search(candidates, grid, judgements(spark, folder))


LATENCY_SQL = f"""WITH {LEGS_SQL}, {HITS_SQL}, {RERANKED_SQL}, {metrics_sql('all_hits')},
cost AS (SELECT mode, round(avg(n_chars) / 10, 6) AS latency FROM all_hits JOIN documents USING (doc_id) GROUP BY mode),
res AS (SELECT mode AS model, {", ".join(f"round(avg({c}), 8) AS {c}" for c in COLUMNS)}, any_value(latency) AS latency
  FROM metrics JOIN cost USING (mode) GROUP BY mode),
prs AS (SELECT b.model, {", ".join(f"b.{c} AS base_{c}, r.{c} AS rr_{c}" for c in [*COLUMNS, "latency"])}
  FROM res b JOIN res r ON r.model = b.model || '+rerank'),
eff AS (SELECT model, CASE WHEN rr_latency - base_latency <= 0 THEN 'Infinity'::DOUBLE
  ELSE round((rr_ndcg_10 - base_ndcg_10) / (rr_latency - base_latency) * 1000, 6) END AS efficiency,
  CASE WHEN base_ndcg_10 = 0 THEN 0.0 ELSE (rr_ndcg_10 - base_ndcg_10) / base_ndcg_10 * 100 END AS delta FROM prs)"""


def result_table(spark, folder):
    """Mean metrics per model with a deterministic cost in place of wall-clock time."""
    modes = with_rerank(spark, folder, base_hits(spark, folder))
    hits = dashboard.union_modes(modes)
    docs = load(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    cost = hits.join(docs, "chunk_id").groupBy("mode").agg(F.round(F.avg("n_chars") / 10, 6).alias("latency"))
    means = evaluation.mean_metrics(metrics_of(spark, folder, modes), ["mode"]).join(cost, "mode")
    table = means.select(F.col("mode").alias("model"), *[F.col(f"avg_{c}").alias(c) for c in COLUMNS], "latency")
    return cut_lineage(table)


def _pair_columns():
    out = []
    for m in PAIR_METRICS:
        out.append(f"round(CASE WHEN base_{m} = 0 THEN 0.0 ELSE (rr_{m} - base_{m}) / base_{m} * 100 END, 6) AS delta_{m}")
        out.append(f"round(greatest(rr_{m} - base_{m}, 0.0), 8) AS gain_{m}, round(greatest(base_{m} - rr_{m}, 0.0), 8) AS loss_{m}")
    return ", ".join(out)


@query("rerank_gain", f"{LATENCY_SQL} SELECT model, {_pair_columns()}, efficiency FROM prs JOIN eff USING (model)")
def rerank_gain(spark, folder):
    return dashboard.rerank_impact(result_table(spark, folder), PAIR_METRICS)


PLACE = "coalesce(nullif(list_position(" + str(ORDER) + ", model), 0), 99)"


@query(
    "dashboard_summary",
    f"""{LATENCY_SQL}, o AS (SELECT *, {PLACE} AS place, model LIKE '%+rerank' AS rr FROM res)
SELECT (SELECT model FROM o ORDER BY ndcg_10 DESC, place, model LIMIT 1) AS best_quality,
  (SELECT max(ndcg_10) FROM o) AS best_quality_value,
  (SELECT model FROM o ORDER BY latency, place, model LIMIT 1) AS fastest,
  (SELECT model FROM o WHERE NOT rr ORDER BY latency, place, model LIMIT 1) AS fastest_base,
  (SELECT model FROM o WHERE NOT rr AND latency < 100 ORDER BY ndcg_10 DESC, place, model LIMIT 1) AS best_balance,
  (SELECT model FROM o WHERE NOT rr AND latency < 300 ORDER BY ndcg_10 DESC, place, model LIMIT 1) AS recommended,
  (SELECT round(avg(round(delta, 6)), 6) FROM eff) AS mean_gain,
  (SELECT model FROM eff WHERE efficiency < 'Infinity'::DOUBLE ORDER BY efficiency DESC, {PLACE}, model LIMIT 1) AS best_efficiency""",
)
def dashboard_summary(spark, folder):
    return dashboard.summary(result_table(spark, folder), ORDER)


@query(
    "best_flags",
    f"""{LATENCY_SQL} SELECT model, mrr, ndcg_10, precision_10, latency, mrr = (SELECT max(mrr) FROM res) AS best_mrr,
  ndcg_10 = (SELECT max(ndcg_10) FROM res) AS best_ndcg_10, precision_10 = (SELECT max(precision_10) FROM res) AS best_precision_10,
  latency = (SELECT min(latency) FROM res) AS fastest FROM res""",
)
def best_flags(spark, folder):
    return dashboard.best_flags(result_table(spark, folder), ["mrr", "ndcg_10", "precision_10"])


@query(
    "compare_models",
    f"""{LATENCY_SQL}, a AS (SELECT * FROM res WHERE model = 'dense'), b AS (SELECT * FROM res WHERE model = 'sparse'),
v AS (SELECT 'mrr' AS metric, a.mrr AS value_a, b.mrr AS value_b FROM a, b
  UNION ALL SELECT 'ndcg_10', a.ndcg_10, b.ndcg_10 FROM a, b UNION ALL SELECT 'latency', a.latency, b.latency FROM a, b)
SELECT metric, value_a, value_b, round(CASE WHEN metric = 'latency' THEN CASE WHEN value_b = 0 THEN 0.0 ELSE (value_a - value_b) / value_b * 100 END
  ELSE CASE WHEN value_a = 0 THEN 0.0 ELSE (value_b - value_a) / value_a * 100 END END, 6) AS delta,
  CASE WHEN value_a = value_b THEN 'tie' WHEN (value_a < value_b) = (metric = 'latency') THEN 'A' ELSE 'B' END AS winner FROM v""",
)
def compare_models(spark, folder):
    return dashboard.compare_models(result_table(spark, folder), "dense", "sparse", ["mrr", "ndcg_10"], ["latency"])


STYLE_SQL = f"""WITH {LEGS_SQL}, {HITS_SQL}, {metrics_sql('hits')},
tagged AS (SELECT m.*, {STYLE} AS style, {DIFFICULTY} AS difficulty FROM metrics m JOIN benchmark USING (item_id)),
overall AS (SELECT mode AS model, round(avg(mrr), 8) AS mrr FROM tagged GROUP BY mode),
by_style AS (SELECT mode AS model, style, round(avg(mrr), 8) AS mrr FROM tagged GROUP BY mode, style),
by_diff AS (SELECT mode AS model, difficulty, round(avg(mrr), 8) AS mrr FROM tagged GROUP BY mode, difficulty)"""


def style_tables(spark, folder):
    metrics = metrics_of(spark, folder, base_hits(spark, folder)).join(query_groups(spark, folder), "query_id")
    means = cut_lineage(evaluation.grouped_means(metrics, "mode", ["style", "difficulty"]))
    pick = lambda kind, name: means.where(F.col("grouping") == kind).select(
        F.col("mode").alias("model"), F.col("value").alias(name), F.col("avg_mrr").alias("mrr")
    )
    return pick("all", "all").drop("all"), pick("style", "style"), pick("difficulty", "difficulty")


@query(
    "style_delta",
    f"""{STYLE_SQL}, grid AS (SELECT o.model, o.mrr, s.style FROM overall o, (SELECT DISTINCT style FROM by_style) s),
val AS (SELECT g.model, g.style, coalesce(nullif(b.mrr, 0), g.mrr, 0.0) AS value FROM grid g LEFT JOIN by_style b USING (model, style))
SELECT v.model, v.style, v.value, round(CASE WHEN v.model = 'dense' OR b.value <= 0 THEN 0.0 ELSE (v.value - b.value) / b.value * 100 END, 6) AS delta
FROM val v JOIN val b ON b.model = 'dense' AND b.style = v.style""",
)
def style_delta(spark, folder):
    overall, by_style, _ = style_tables(spark, folder)
    return dashboard.style_delta(by_style, overall, "dense")


@query(
    "heat_map",
    f"""{STYLE_SQL} SELECT o.model, s.style, d.difficulty,
  round(greatest(0.0, least(1.0, coalesce(s.mrr * (d.mrr / nullif(o.mrr, 0)), o.mrr))), 8) AS cell
FROM overall o JOIN by_style s USING (model) JOIN by_diff d USING (model)""",
)
def heat_map(spark, folder):
    overall, by_style, by_diff = style_tables(spark, folder)
    cells = (
        overall.withColumnRenamed("mrr", "o")
        .join(by_style.withColumnRenamed("mrr", "s"), "model")
        .join(by_diff.withColumnRenamed("mrr", "d"), "model")
    )
    cell = dashboard.heat_cell(F.col("s"), F.col("d"), F.col("o"))
    return cells.select("model", "style", "difficulty", F.round(cell, 8).alias("cell"))


# Judgements for the coverage queries: the documents found by the sparse leg are
# each item's claimed papers; documents with a vector are the ones in the store.
CLAIMED_SQL = f"""WITH {fx.TERM_CTES}, {fx.sparse_leg(5)},
claimed AS (SELECT item_id, doc_id, rank FROM sparse_leg),
store AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings WHERE embedding IS NOT NULL UNION SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL),
split AS (SELECT c.item_id, list(c.doc_id ORDER BY rank) FILTER (s.doc_id IS NOT NULL) AS found,
  list(c.doc_id ORDER BY rank) FILTER (s.doc_id IS NULL) AS missing, count(*) AS n FROM claimed c LEFT JOIN store s USING (doc_id) GROUP BY c.item_id)"""


def claimed(spark, folder):
    hits = fx.sparse_hits(spark, folder, 5)
    return cut_lineage(hits.select("query_id", F.col("chunk_id").alias("paper_id"), F.col("rank").alias("pos")))


def store_papers(spark, folder):
    return coverage.embedded_papers(
        (load(spark, folder, "embeddings"), "vec_id", "embedding"), (load(spark, folder, "labels"), "doc_id", "quality")
    )


@query(
    "valid_queries",
    f"""{CLAIMED_SQL} SELECT item_id, coalesce(array_to_string(found, ','), '') AS relevant_papers,
  coalesce(array_to_string(missing, ','), '') AS missing_papers, n AS original_relevant_count, found IS NOT NULL AS valid FROM split""",
)
def valid_queries(spark, folder):
    split = coverage.split_queries(claimed(spark, folder), store_papers(spark, folder))
    return split.select(
        F.col("query_id").alias("item_id"),
        F.concat_ws(",", F.col("relevant_papers").cast("array<string>")).alias("relevant_papers"),
        F.concat_ws(",", F.col("missing_papers").cast("array<string>")).alias("missing_papers"),
        "original_relevant_count",
        "valid",
    )


@query(
    "coverage_stats",
    f"""{CLAIMED_SQL}, w AS (SELECT DISTINCT doc_id FROM claimed)
SELECT count(*) AS total_queries, count(found) AS valid_queries, count(*) - count(found) AS invalid_queries,
  round(100 * count(found) / count(*)::DOUBLE, 6) AS coverage_percent, (SELECT count(*) FROM w) AS total_relevant_papers,
  (SELECT count(*) FROM w SEMI JOIN store USING (doc_id)) AS papers_in_db,
  (SELECT count(*) FROM w ANTI JOIN store USING (doc_id)) AS papers_missing FROM split""",
)
def coverage_stats(spark, folder):
    judged, present = claimed(spark, folder), store_papers(spark, folder)
    return coverage.coverage_stats(coverage.split_queries(judged, present), judged, present)


@query(
    "papers_with_vectors",
    "SELECT DISTINCT vec_id AS paper_id FROM embeddings WHERE embedding IS NOT NULL UNION SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL",
)
def papers_with_vectors(spark, folder):
    return store_papers(spark, folder)


@query(
    "generated_query_filter",
    """SELECT item_id, trim(text) AS query, length(text)::INTEGER AS n FROM benchmark WHERE length(text) BETWEEN 10 AND 300""",
)
def generated_query_filter(spark, folder):
    """Generated queries are kept between 10 and 300 characters, then trimmed."""
    items = load(spark, folder, "benchmark")
    return items.where(F.length("text").between(10, 300)).select("item_id", F.trim("text").alias("query"), F.length("text").alias("n"))
