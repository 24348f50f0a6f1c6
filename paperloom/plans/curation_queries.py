"""Keyword split, scoring, sampling and diversity over the contract tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from paperloom.functions import lexicon as lx
from paperloom.functions import scores as sc
from paperloom.functions import verdicts as vd
from paperloom.operators import changes, curation
from paperloom.plans import fixtures as fx
from paperloom.plans.registry import query
from paperloom.sources.tables import load, spread

REFERENCE = dt.date(2001, 9, 1)

# Invented keywords that occur in the fixture's invented prose.
NEGATIVE = ["wheshth", "Thedst", "pa%%%", "xxx", "unge", "ciónosi"]
STRONG = ["erand", "thand", "ionst", "leau", "schei"]


def sql_list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def papers(spark, folder):
    """Orders as papers: line items are citations, priority is the topic, price a similarity."""
    orders = load(spark, folder, "orders")
    cites = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.count(F.lit(1)).alias("citation_count"))
    base = orders.select(
        F.col("o_orderkey").alias("paper_id"),
        F.to_date("o_orderdate").alias("published"),
        F.col("o_orderpriority").alias("topic"),
        F.col("o_orderstatus").alias("parse_status"),
        (F.col("o_totalprice") / 400000).alias("similarity"),
    )
    return base.join(cites, "paper_id", "left").na.fill(0, ["citation_count"])


PAPERS_SQL = """papers AS (SELECT o_orderkey AS paper_id, o_orderdate::DATE AS published, o_orderpriority AS topic, o_orderstatus AS parse_status,
  o_totalprice / 400000 AS similarity, coalesce(n, 0) AS citation_count FROM orders LEFT JOIN
  (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

SCORED_SQL = f"""{PAPERS_SQL}, hist AS (SELECT topic, count(*) / (SELECT count(*) FROM papers)::DOUBLE AS share FROM papers GROUP BY topic),
parts AS (SELECT p.*, ln(1 + citation_count / (CASE WHEN m <= 0 THEN 1.0 ELSE m END)) AS cit, exp(-m / 6.0) AS rec,
  greatest(0.0, least(1.0, similarity)) AS sem, CASE WHEN share < 0.2 THEN 1.0 + (0.2 - share) * 2 ELSE 1.0 END AS bonus
  FROM (SELECT *, date_diff('day', published, DATE '2001-09-01') / 30.0::DOUBLE AS m FROM papers) p JOIN hist USING (topic)),
scored AS (SELECT *, round(0.4 * least(1.0, cit / 5) + 0.3 * rec + 0.2 * sem + 0.1 * (bonus - 1) * 0.5, 8) AS final_score FROM parts)"""


@query(
    "keyword_split3",
    f"""SELECT doc_id, CASE WHEN list_bool_or(list_transform({sql_list([n.lower() for n in NEGATIVE])}, lambda k: contains(lower(text), k))) THEN 'drop'
  WHEN list_bool_or(list_transform({sql_list(STRONG)}, lambda k: contains(lower(text), k))) THEN 'keep' ELSE 'edge' END AS stage FROM documents""",
)
def keyword_split3(spark, folder):
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    return curation.rule_split(docs, F.col("text"), negative=NEGATIVE, strong=STRONG).select("doc_id", "stage")


@query(
    "rule_split_fixed_lists",
    f"""SELECT stage, count(*) AS n FROM (SELECT CASE
  WHEN list_bool_or(list_transform({sql_list([n.lower() for n in lx.NEGATIVE_PHRASES])}, lambda k: contains(lower(text), k))) THEN 'drop'
  WHEN list_bool_or(list_transform({sql_list(lx.STRONG_INDICATORS)}, lambda k: contains(lower(text), k))) THEN 'keep' ELSE 'edge' END AS stage
  FROM documents) GROUP BY stage""",
)
def rule_split_fixed_lists(spark, folder):
    staged = curation.rule_split(spread(load(spark, folder, "documents").select("doc_id", "text")), F.col("text"))
    return staged.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query(
    "keyword_matches",
    f"""SELECT doc_id, array_to_string(m, '|') AS matched, len(m)::INTEGER AS n FROM (SELECT doc_id,
  list_filter({sql_list(STRONG)}, lambda k: contains(lower(text), k)) AS m FROM documents) WHERE len(m) > 0""",
)
def keyword_matches(spark, folder):
    out, _ = curation.partition_by_keywords(spread(load(spark, folder, "documents").select("doc_id", "text")), F.col("text"), STRONG)
    return out.select("doc_id", F.array_join("matched", "|").alias("matched"), F.size("matched").alias("n"))


@query(
    "keyword_join",
    "SELECT DISTINCT p_partkey, kw AS keyword FROM part, (SELECT DISTINCT lower(n) AS kw FROM (SELECT unnest(string_split(p_name, ' ')) AS n FROM part)) WHERE contains(lower(p_name), kw)",
)
def keyword_join(spark, folder):
    parts = load(spark, folder, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("w")).select(F.lower("w").alias("keyword"))
    return curation.keyword_matches_table(parts, words, id_col="p_partkey", text_col="p_name")


def topic_sql():
    names = list(lx.TOPIC_KEYWORDS)
    counts = ", ".join(f"len(list_filter({sql_list(lx.TOPIC_KEYWORDS[n])}, lambda k: contains(lower(text), k)))" for n in names)
    return f"""topics AS (SELECT doc_id, CASE WHEN list_max(h) > 0 THEN {sql_list(names)}[list_position(h, list_max(h))] ELSE 'other' END AS topic
  FROM (SELECT doc_id, [{counts}] AS h FROM documents))"""


@query("topic_classify", f"WITH {topic_sql()} SELECT doc_id, topic FROM topics")
def topic_classify(spark, folder):
    return spread(load(spark, folder, "documents").select("doc_id", "text")).select("doc_id", sc.topic(F.col("text")).alias("topic"))


@query(
    "topic_hist",
    f"""WITH {topic_sql()} SELECT topic, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM topics)::DOUBLE, 6) AS percent FROM topics GROUP BY topic""",
)
def topic_hist(spark, folder):
    topics = spread(load(spark, folder, "documents").select("doc_id", "text")).select(sc.topic(F.col("text")).alias("topic"))
    return curation.shares(topics, "topic").select("topic", "n", F.round(F.col("share") * 100, 6).alias("percent"))


@query(
    "category_top10",
    "SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, category LIMIT 10",
)
def category_top10(spark, folder):
    kinds = load(spark, folder, "part").select(F.coalesce("p_type", F.lit("unknown")).alias("category"))
    return kinds.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query(
    "citation_score",
    f"""WITH {PAPERS_SQL} SELECT paper_id, citation_count, round(ln(1 + citation_count / (CASE WHEN m <= 0 THEN 1.0 ELSE m END)), 8) AS citation,
  round(exp(-m / 6.0), 8) AS recency FROM (SELECT *, date_diff('day', published, DATE '2001-09-01') / 30.0::DOUBLE AS m FROM papers)""",
)
def citation_score(spark, folder):
    ref = F.lit(REFERENCE)
    months = sc.age_months(F.col("published"), ref)
    return papers(spark, folder).select(
        "paper_id",
        "citation_count",
        F.round(sc.citation_score(F.col("citation_count"), months), 8).alias("citation"),
        F.round(sc.recency(F.col("published"), ref), 8).alias("recency"),
    )


@query(
    "final_score",
    f"""WITH {SCORED_SQL} SELECT paper_id, final_score, round_even(least(1.0, cit / 5), 4) AS citation, round_even(rec, 4) AS recency,
  round_even(sem, 4) AS semantic, round_even(bonus, 4) AS stratified FROM scored""",
)
def final_score(spark, folder):
    scored = curation.score_papers(papers(spark, folder), F.lit(REFERENCE), equal_share=0.2)
    return scored.select("paper_id", "final_score", "citation", "recency", "semantic", "stratified")


@query(
    "score_range",
    f"WITH {SCORED_SQL} SELECT round(min(final_score), 6) AS lowest, round(max(final_score), 6) AS highest, round(avg(final_score), 6) AS mean FROM scored",
)
def score_range(spark, folder):
    scored = curation.score_papers(papers(spark, folder), F.lit(REFERENCE), equal_share=0.2)
    return scored.agg(*[F.round(f("final_score"), 6).alias(n) for f, n in ((F.min, "lowest"), (F.max, "highest"), (F.avg, "mean"))])


BONUS_TARGETS = {"1-URGENT": 0.25, "2-HIGH": 0.15, "3-MEDIUM": 0.3}


@query(
    "stratified_bonus",
    f"""WITH {PAPERS_SQL}, hist AS (SELECT topic, count(*) AS n, count(*) / (SELECT count(*) FROM papers)::DOUBLE AS share FROM papers GROUP BY topic),
t AS (SELECT *, CASE topic WHEN '1-URGENT' THEN 0.25 WHEN '2-HIGH' THEN 0.15 WHEN '3-MEDIUM' THEN 0.3 ELSE 0.1 END::DOUBLE AS target FROM hist)
SELECT topic, n, round(CASE WHEN share < target THEN 1.0 + (target - share) * 2 ELSE 1.0 END, 8) AS bonus FROM t""",
)
def stratified_bonus(spark, folder):
    boosted = curation.with_bonus(papers(spark, folder), "topic", targets=BONUS_TARGETS)
    return boosted.groupBy("topic", F.round("bonus", 8).alias("bonus")).agg(F.count(F.lit(1)).alias("n"))


SHARES = {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.2, "4-NOT SPECIFIED": 0.05}
TARGET = 333

SAMPLE_SQL = f"""{SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY final_score DESC, paper_id) AS r FROM scored),
q AS (SELECT unnest({sql_list(SHARES)}) AS topic, unnest({[int(TARGET * v / sum(SHARES.values())) for v in SHARES.values()]}) AS quota),
own AS (SELECT ranked.* FROM ranked JOIN q USING (topic) WHERE r <= quota),
fill AS (SELECT * FROM ranked ANTI JOIN own USING (paper_id) ORDER BY final_score DESC, paper_id LIMIT {TARGET} - (SELECT count(*) FROM own)),
sample AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, paper_id)::INTEGER AS final_rank FROM (SELECT * FROM own UNION ALL SELECT * FROM fill))"""


def sample(spark, folder):
    scored = curation.score_papers(papers(spark, folder), F.lit(REFERENCE), equal_share=0.2)
    return curation.stratified_sample(scored, TARGET, distribution=SHARES)


@query("stratified_sample", f"WITH {SAMPLE_SQL} SELECT paper_id, topic, final_score, final_rank FROM sample")
def stratified_sample(spark, folder):
    return sample(spark, folder).select("paper_id", "topic", "final_score", "final_rank")


@query(
    "diversity",
    f"""WITH {SAMPLE_SQL}, h AS (SELECT topic, count(*) / (SELECT count(*) FROM sample)::DOUBLE AS p FROM sample GROUP BY topic),
m AS (SELECT strftime(published, '%Y-%m') AS k, count(*) AS n FROM sample GROUP BY k),
v AS (SELECT round_even((SELECT sum(-p * log2(p)) FROM h), 3) AS topic_entropy, round_even((SELECT stddev_pop(n) / avg(n) FROM m), 3) AS temporal_cv,
  round_even((SELECT min(p) FROM h), 6) AS min_share)
SELECT *, topic_entropy >= 3.5 AS entropy_ok, temporal_cv <= 0.3 AS cv_ok, min_share >= 0.05 AS coverage_ok,
  topic_entropy >= 3.5 AND temporal_cv <= 0.3 AND min_share >= 0.05 AS passed FROM v""",
)
def diversity(spark, folder):
    return curation.diversity(sample(spark, folder), "topic", "published")


@query(
    "diversity_whole",
    f"""WITH {PAPERS_SQL}, h AS (SELECT topic, count(*) / (SELECT count(*) FROM papers)::DOUBLE AS p FROM papers GROUP BY topic),
m AS (SELECT strftime(published, '%Y-%m') AS k, count(*) AS n FROM papers GROUP BY k)
SELECT round_even((SELECT entropy(topic) FROM papers), 3) AS topic_entropy, round_even((SELECT stddev_pop(n) / avg(n) FROM m), 3) AS temporal_cv""",
)
def diversity_whole(spark, folder):
    return curation.diversity(papers(spark, folder), "topic", "published").select("topic_entropy", "temporal_cv")


@query(
    "semantic_filter",
    f"""WITH {fx.CENTROID_CTES}, s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], qv), 10) AS similarity FROM embeddings, overall)
SELECT vec_id, round_even(similarity, 4) AS similarity FROM s WHERE similarity >= 0.05""",
)
def semantic_filter(spark, folder):
    vectors = load(spark, folder, "embeddings")
    anchor = fx.mean_vectors(vectors).first()["query_vector"]
    return curation.semantic_filter(vectors, "embedding", anchor, threshold=0.05, id_col="vec_id").select("vec_id", "similarity")


@query(
    "ranked_papers",
    f"""WITH {PAPERS_SQL} SELECT paper_id, citation_count, published, row_number() OVER (ORDER BY citation_count DESC, published DESC NULLS LAST, paper_id)::INTEGER AS rank
FROM papers QUALIFY rank <= 200""",
)
def ranked_papers(spark, folder):
    best = curation.ranked_papers(papers(spark, folder), 200, "citation_count", "published", "paper_id")
    return best.select("paper_id", "citation_count", "published", "rank")


@query(
    "global_rank",
    f"""WITH {PAPERS_SQL} SELECT paper_id, row_number() OVER (ORDER BY citation_count DESC, published DESC NULLS LAST, paper_id) AS rank FROM papers""",
)
def global_rank(spark, folder):
    from paperloom.operators.ranking import global_rank as rank_all

    narrow = papers(spark, folder).select("paper_id", "citation_count", "published")
    order = [F.desc("citation_count"), F.desc_nulls_last("published"), F.asc("paper_id")]
    return rank_all(narrow, order).select("paper_id", "rank")


# Verdict texts are derived from the labels table, one answer per labelled document.
@query(
    "verdict_lines",
    """SELECT doc_id, CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS decision, quality = 1 AS relevant,
  'toxicity ' || toxic AS reason FROM labels""",
)
def verdict_lines(spark, folder):
    answer = F.concat(
        F.lit("DECISION: Uncertain\nnoise\nDECISION: "), F.when(F.col("quality") == 1, "Yes").otherwise("No"),
        F.lit("\nREASON:  toxicity "), F.col("toxic").cast("string"), F.lit(" \n"),
    )
    rows = load(spark, folder, "labels").withColumn("answer", answer)
    return rows.select(
        "doc_id", vd.decision(F.col("answer")).alias("decision"), vd.is_relevant(F.col("answer")).alias("relevant"),
        vd.reason(F.col("answer")).alias("reason"),
    )


@query(
    "verdict_json",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS suitable, CASE WHEN toxic = 1 THEN NULL ELSE 'kw ' || doc_id END AS keyword FROM labels""",
)
def verdict_json(spark, folder):
    body = F.concat(
        F.lit('{"suitable": '), F.when(F.col("quality") == 1, "true").otherwise("false"),
        F.lit(', "ng_keywords": ["KW '), F.col("doc_id").cast("string"), F.lit('"]}'),
    )
    answer = F.when(F.col("toxic") == 1, F.lit("```json\n{broken")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    parsed = vd.fenced_json(answer, "struct<suitable:boolean,ng_keywords:array<string>>")
    rows = load(spark, folder, "labels").select("doc_id", parsed.alias("v"))
    return rows.select("doc_id", F.col("v.suitable").alias("suitable"), F.lower(F.trim(F.get("v.ng_keywords", F.lit(0)))).alias("keyword"))


@query(
    "keyword_log",
    """WITH k AS (SELECT DISTINCT lower(p_type) AS category, lower(word) AS keyword FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part))
SELECT category, keyword, 'removed' AS action FROM k WHERE keyword IN ('red', 'bolt')
UNION ALL SELECT 'extra', kw, 'added' FROM (SELECT unnest(['quark', 'zonk']) AS kw)""",
)
def keyword_log(spark, folder):
    parts = load(spark, folder, "part")
    table = parts.select(F.lower("p_type").alias("category"), F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")).distinct()
    return changes.keyword_log(table, changes.keyword_changes(table, add={"extra": ["Quark ", "zonk", "QUARK"]}, remove=["Red", "bolt"]))


@query(
    "bonus_null_topic",
    """WITH t AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE 'q' || quality END AS topic FROM labels),
s AS (SELECT topic, count(*) / (SELECT count(*) FROM t)::DOUBLE AS share FROM t GROUP BY topic)
SELECT doc_id, t.topic, round(s.share, 8) AS share FROM t JOIN s ON s.topic IS NOT DISTINCT FROM t.topic""",
)
def bonus_null_topic(spark, folder):
    """Rows without a topic are a group like any other."""
    topic = F.when(F.col("toxic") != 1, F.concat(F.lit("q"), F.col("quality").cast("string")))
    rows = load(spark, folder, "labels").select("doc_id", topic.alias("topic"))
    boosted = curation.with_bonus(rows, "topic")
    share = curation.shares(rows, "topic").select(F.col("topic").alias("own"), "share")
    return boosted.join(share, F.col("topic").eqNullSafe(F.col("own"))).select("doc_id", "topic", F.round("share", 8).alias("share"))


@query(
    "keyword_changes",
    """WITH k AS (SELECT DISTINCT lower(p_type) AS category, lower(word) AS keyword FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part)),
kept AS (SELECT * FROM k WHERE keyword NOT IN ('red', 'bolt'))
SELECT category, count(*) AS n FROM (SELECT * FROM kept UNION ALL SELECT 'extra', kw FROM (SELECT unnest(['quark', 'zonk']) AS kw)) GROUP BY category""",
)
def keyword_changes(spark, folder):
    parts = load(spark, folder, "part")
    table = parts.select(F.lower("p_type").alias("category"), F.explode(F.split(F.lower("p_name"), " ")).alias("keyword")).distinct()
    changed = changes.keyword_changes(table, add={"extra": ["Quark ", "zonk", "QUARK"]}, remove=["Red", "bolt"])
    return changes.keyword_stats(changed)
