"""Adapters from the contract tables to the engine's data model, and their SQL twins.

``documents`` stand in for chunks (``source`` is the owning paper), ``benchmark``
for evaluation queries, ``embeddings`` for dense vectors, ``orders`` with their
``lineitem`` rows for papers with citations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import search
from paperloom.sources.tables import load, spread

EMBED_DIM = 64

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"

# Terms and counts of documents and benchmark items.
TERM_CTES = f"""
doc_tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
doc_tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_tok GROUP BY ALL),
qry_tok AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark),
qry_tf AS (SELECT item_id, term, count(*) AS tf FROM qry_tok GROUP BY ALL)
"""


def _hashed(table: str, key: str) -> str:
    """Hashed bag-of-words vectors, long form, unit length."""
    return f"""
{table}_raw AS (SELECT {key}, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % {EMBED_DIM} AS pos, sum(tf)::DOUBLE AS v
  FROM {table}_tf GROUP BY ALL),
{table}_vec AS (SELECT {key}, pos, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {table}_raw)
"""


EMBED_CTES = _hashed("doc", "doc_id") + "," + _hashed("qry", "item_id")


def dense_leg(depth: int) -> str:
    return f"""
dense_all AS (SELECT item_id, doc_id, round(sum(q.v * d.v), 10) AS score FROM qry_vec q JOIN doc_vec d USING (pos) GROUP BY ALL),
dense_leg AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM dense_all
  QUALIFY rank <= {depth})"""


def sparse_leg(depth: int) -> str:
    return f"""
sparse_all AS (SELECT item_id, doc_id, sum(q.tf * d.tf)::DOUBLE AS score FROM qry_tf q JOIN doc_tf d USING (term) GROUP BY ALL),
sparse_leg AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sparse_all
  QUALIFY rank <= {depth})"""


def text_leg(depth: int) -> str:
    return f"""
doc_len AS (SELECT doc_id, count(*) AS n FROM doc_tok GROUP BY doc_id),
qry_n AS (SELECT item_id, count(*) AS n_terms FROM qry_tf GROUP BY item_id),
text_hit AS (SELECT q.item_id, d.doc_id, count(*) AS found, sum(d.tf) AS freq
  FROM qry_tf q JOIN doc_tf d USING (term) GROUP BY ALL),
text_all AS (SELECT item_id, doc_id, round(freq / n::DOUBLE, 10) AS score
  FROM text_hit JOIN qry_n USING (item_id) JOIN doc_len USING (doc_id) WHERE found = n_terms),
text_leg AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM text_all
  QUALIFY rank <= {depth})"""


def fused(legs: dict[str, float], k: int, rrf_k: int = 60, name: str = "fused") -> str:
    """Union of legs and one aggregation; ties by rank inside the legs, in leg order."""
    rows = " UNION ALL ".join(
        f"SELECT item_id, doc_id, '{leg}' AS leg, score, rank, {weight} / ({rrf_k} + rank) AS part FROM {leg}_leg" for leg, weight in legs.items()
    )
    cols = ", ".join(
        f"max(score) FILTER (leg = '{leg}') AS {leg}_score, min(rank) FILTER (leg = '{leg}') AS {leg}_rank" for leg in legs
    )
    ties = ", ".join(f"{leg}_rank ASC NULLS LAST" for leg in legs)
    return f"""
{name}_rows AS ({rows}),
{name}_all AS (SELECT item_id, doc_id, round(sum(part), 12) AS score, {cols} FROM {name}_rows GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {ties}, doc_id) AS rank FROM {name}_all
  QUALIFY rank <= {k})"""


# Dense vectors averaged over a group, long form then as lists.
CENTROID_CTES = """
vec_long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
centroid AS (SELECT label, list(a ORDER BY pos) AS qv FROM (SELECT label, pos, avg(x) AS a FROM vec_long GROUP BY ALL) GROUP BY label),
overall AS (SELECT list(a ORDER BY pos) AS qv FROM (SELECT pos, avg(x) AS a FROM vec_long GROUP BY pos))
"""


def mean_vectors(vectors: DataFrame, group: str | None = None) -> DataFrame:
    """Mean vector per group, or of the whole table: one row per dimension is aggregated, never a list of vectors."""
    keys = [group] if group else []
    longs = vectors.select(*keys, F.posexplode("embedding").alias("pos", "x"))
    means = longs.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("a"))
    # At most one entry per dimension and group reaches this list.
    packed = F.sort_array(F.collect_list(F.struct("pos", "a")))
    query_id = F.col(group).alias("query_id") if group else F.lit(0).alias("query_id")
    grouped = means.groupBy(*keys).agg(packed.alias("p"))
    return grouped.select(query_id, F.transform("p", lambda e: e["a"]).alias("query_vector"))


def chunk_terms(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(F.col("doc_id").alias("chunk_id"), tx.tokens(F.col("text")).alias("terms"))


def benchmark_terms(spark: SparkSession, folder: str) -> DataFrame:
    return search.term_queries(load(spark, folder, "benchmark"), "item_id", "text")


def chunk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(load(spark, folder, "documents").select("doc_id", "text"))
    return search.embed_texts(docs, EMBED_DIM, id_col="doc_id", text_col="text").withColumnRenamed("doc_id", "chunk_id")


def benchmark_vectors(spark: SparkSession, folder: str) -> DataFrame:
    items = load(spark, folder, "benchmark")
    return search.embed_texts(items, EMBED_DIM, id_col="item_id", text_col="text", out="query_vector").withColumnRenamed(
        "item_id", "query_id"
    )


def dense_hits(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    return search.dense_search(chunk_vectors(spark, folder), benchmark_vectors(spark, folder), depth, EMBED_DIM)


def sparse_hits(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    return search.sparse_search(chunk_terms(spark, folder), benchmark_terms(spark, folder), depth)


def text_hits(spark: SparkSession, folder: str, depth: int) -> DataFrame:
    return search.text_search(chunk_terms(spark, folder), benchmark_terms(spark, folder), depth)


def as_items(hits: DataFrame) -> DataFrame:
    return hits.withColumnRenamed("query_id", "item_id").withColumnRenamed("chunk_id", "doc_id")
