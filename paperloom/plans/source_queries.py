"""Readers, writers, stores and streams, fed with data derived from the contract tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from paperloom import kernels, schemas
from paperloom.functions.binding import unnest
from paperloom.operators import search, vector_index
from paperloom.plans import fixtures as fx
from paperloom.plans import limiter_queries, search_queries  # noqa: F401  (their oracles are reused below)
from paperloom.plans.registry import oracle_sql, query
from paperloom.session import ensure_checkpoint_dir
from paperloom.sources import figure_files, files, metadata, paged
from paperloom.sources.store import Store, search_postings, write_postings
from paperloom.sources.tables import load, spread
from paperloom.streaming import ingest as streaming_ingest
from paperloom.streaming import limiter as streaming_limiter


def scratch(spark) -> str:
    """A fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/run-{uuid.uuid4().hex}"


@query(
    "archive_includes",
    r"""SELECT doc_id, md5('\documentclass{article}' || chr(10) || '\begin{document}' || text || ' and ' || lang || ' tail' || '\end{document}') AS content,
  'main.tex' AS main_file, NULL::VARCHAR AS error FROM documents WHERE lang <> 'de'
UNION ALL SELECT doc_id, NULL, NULL, 'no source file in archive' FROM documents WHERE lang = 'de'""",
)
def archive_includes(spark, folder):
    """Archives with nested, missing and circular includes; one language ships no source file."""
    file = lambda name, *text: F.struct(F.lit(name).alias("name"), F.concat(*text).alias("text"))
    tex = F.array(
        file("main.tex", F.lit("\\documentclass{article}\n\\begin{document}\\input{parts/one}\\include{ two }\\input{gone}\\end{document}")),
        file("parts/one.tex", F.col("text"), F.lit("\\input{more}")),
        file("parts/more.tex", F.lit(" and ")),
        file("two.tex", F.col("lang"), F.lit("\\input{two}\\input{parts/one} tail")),
    )
    other = F.array(file("readme.md", F.lit("nothing")))
    packed = kernels.archive_udf()(F.when(F.col("lang") == "de", other).otherwise(tex))
    docs = load(spark, folder, "documents").select("doc_id", packed.alias("content"))
    out = files.resolve_archives(docs, key="doc_id")
    return out.select("doc_id", F.md5("content").alias("content"), "main_file", "error")


@query(
    "figure_formats",
    """SELECT CASE doc_id % 6 WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' ELSE '.png' END AS format, count(*) AS n
FROM documents GROUP BY format""",
)
def figure_formats(spark, folder):
    magic = F.array(*[F.lit(m) for m in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "255044462D", "00")])
    head = F.unhex(F.get(magic, (F.col("doc_id") % 6).cast("int")))
    docs = load(spark, folder, "documents").select(F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return docs.groupBy(files.image_format(F.col("content")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "figure_stats",
    """SELECT '.' || lower(split_part(lang, '-', 1)) AS ext, count(*) AS files, round(sum(n_chars) / (1024.0 * 1024.0)::DOUBLE, 2) AS size_mb,
  count(DISTINCT source) AS papers FROM documents GROUP BY ext""",
)
def figure_stats(spark, folder):
    path = F.concat(F.lit("/figures/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.upper("lang"))
    return files.figure_stats(load(spark, folder, "documents").select(path.alias("path"), F.col("n_chars").alias("length")))


@query(
    "figure_files",
    """SELECT source AS paper, 'fig' || doc_id AS figure, CASE doc_id % 6 WHEN 1 THEN '.jpg' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' WHEN 4 THEN '.pdf' ELSE '.png' END AS ext,
  md5(text) AS body FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""",
)
def figure_files_written(spark, folder):
    """One image per document, written by the tasks and read back from its file."""
    magic = F.array(*[F.lit(m) for m in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "524946460000000057454250", "255044462D", "00")])
    head = F.unhex(F.get(magic, (F.col("doc_id") % 6).cast("int")))
    docs = load(spark, folder, "documents")
    path = scratch(spark)
    figure_files.write_figures(docs.select(
        F.col("source").alias("paper_id"), F.concat(F.lit("fig"), F.col("doc_id").cast("string")).alias("figure_id"), F.concat(head, F.encode("text", "UTF-8")).alias("content"),
    ), path)
    start = F.when(F.col("ext") == ".jpg", 5).when(F.col("ext") == ".gif", 7).when(F.col("ext") == ".webp", 13).when(F.col("ext") == ".pdf", 6)
    start = start.when(F.startswith(F.col("content"), F.unhex(F.lit("89504E47"))), 9).otherwise(2)
    return figure_files.read_figures(spark, path).select(
        F.col("folder").alias("paper"), "figure", "ext", F.md5(F.substring(F.col("content"), start, F.length("content"))).alias("body"))


@query(
    "keyword_file",
    """WITH k AS (SELECT p_partkey, list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda x: x <> '') AS ks FROM part)
SELECT p_partkey, 'biomedical' AS category, len(ks)::INTEGER AS n FROM k
UNION ALL SELECT p_partkey, 'own_topic_' || p_partkey, 1 FROM k""",
)
def keyword_file(spark, folder):
    text = F.concat(
        F.lit("ignored line\n* Biomedical / anything\n"), F.replace("p_name", F.lit(" "), F.lit("\n\n")), F.lit("\n"), F.upper(F.element_at(F.split("p_name", " "), 1)),
        F.lit("\n\n** Own topic: "), F.col("p_partkey").cast("string"), F.lit(" *\n  Some Keyword \n"),
    )
    rows = unnest(load(spark, folder, "part"), ["p_partkey"], files.keyword_blocks(text), "b")
    return rows.select("p_partkey", "b.category", F.size("b.keywords").alias("n"))


@query(
    "json_documents",
    "SELECT 'p' || doc_id AS paper_id, lang AS title, 1::INTEGER AS n_sections, md5(text) AS content FROM documents",
)
def json_documents(spark, folder):
    """Parsed documents written as JSON and read back with the explicit schema."""
    docs = load(spark, folder, "documents")
    paragraph = F.struct(F.lit("para_1").alias("paragraph_id"), F.col("text").alias("content"), F.lit(1).alias("order"))
    section = F.struct(F.lit("sec_1").alias("section_id"), F.lit("Body").alias("title"), F.lit(1).alias("level"), F.lit(1).alias("order"), F.array(paragraph).alias("paragraphs"))
    path = scratch(spark)
    files.write_json(docs.select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.col("lang").alias("title"), F.array(section).alias("sections")), path)
    back = spark.read.schema(schemas.PARSED).option("mode", "DROPMALFORMED").json(path)
    return back.select("paper_id", "title", F.size("sections").alias("n_sections"), F.md5(F.get(F.get("sections", F.lit(0))["paragraphs"], F.lit(0))["content"]).alias("content"))


@query(
    "store_changes",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 <> 0""",
)
def store_changes(spark, folder):
    """Create, upsert and delete through versioned parquet folders."""
    store = Store(spark, scratch(spark))
    customers = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    store.create("customers", customers)
    store.upsert("customers", customers.where(F.col("c_custkey") % 3 == 0).withColumn("c_name", F.concat("c_name", F.lit("!"))), ["c_custkey"])
    store.delete("customers", customers.where(F.col("c_custkey") % 5 == 0), ["c_custkey"])
    return store.read("customers")


@query("sparse_index_topk", oracle_sql()["sparse_truncated_topk"])
def sparse_index_topk(spark, folder):
    """The same answer as the one-pass scan, from the inverted index."""
    texts = spread(load(spark, folder, "documents").select("doc_id", "text"))
    docs = search.encode_sparse(texts, 128, id_col="doc_id", text_col="text").withColumnRenamed("doc_id", "chunk_id")
    path = scratch(spark)
    write_postings(docs, path, buckets=16)
    return fx.as_items(search_postings(spark, path, fx.benchmark_terms(spark, folder), 10, buckets=16))


META_SQL = """meta AS (SELECT o_orderkey::VARCHAR AS paper_id, o_orderpriority AS title, o_orderdate::DATE AS published, o_orderstatus AS cat FROM orders),
hit AS (SELECT * FROM meta WHERE cat IN ('O', 'P') AND (contains(lower(title), 'urgent') OR contains(lower(title), 'low')))"""
WHAT = metadata.Search(("O", "P"), ("Urgent", "LOW"), dt.date(1996, 1, 1), dt.date(2001, 7, 15))


def metadata_table(spark, folder):
    table = load(spark, folder, "orders").select(
        F.concat(F.lit("http://host/abs/arXiv:"), F.col("o_orderkey").cast("string")).alias("paper_id"),
        F.concat(F.lit("\n "), "o_orderpriority").alias("title"), F.lit("none").alias("abstract"),
        F.array("o_orderstatus").alias("categories"), F.to_date("o_orderdate").alias("published"),
    )
    return metadata.normalised(table)


def served_metadata(spark, folder):
    """The metadata as pages of a service, read back by date window."""
    path = scratch(spark)
    paged.write_pages(metadata_table(spark, folder), path)
    return paged.read_pages(spark, path)


@query(
    "metadata_search",
    f"""WITH {META_SQL} SELECT paper_id, title, published FROM hit
WHERE published BETWEEN DATE '1996-01-01' AND DATE '2001-07-15' ORDER BY published DESC, paper_id LIMIT 2500""",
)
def metadata_search(spark, folder):
    return metadata.search(metadata_table(spark, folder), WHAT, 2500).select("paper_id", "title", "published")


@query(
    "metadata_first_page",
    f"""WITH {META_SQL} SELECT paper_id, published FROM hit WHERE published BETWEEN DATE '1996-01-01' AND DATE '2001-07-15' ORDER BY published DESC, paper_id LIMIT 5000""",
)
def metadata_first_page(spark, folder):
    return metadata.search_first_page(metadata_table(spark, folder), WHAT, 5000).select("paper_id", "published")


@query(
    "metadata_windows",
    f"""WITH {META_SQL}, b AS (SELECT min(o_orderdate)::DATE AS s FROM orders)
SELECT paper_id, s + (floor((published - s) / 30.0) * 30)::INTEGER AS window_start FROM hit, b""",
)
def metadata_windows(spark, folder):
    """Every window of the paged service, a task or more each."""
    days = load(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    found = metadata.search_windows(served_metadata(spark, folder), WHAT, days, 30)
    return found.select("paper_id", "window_start")


@query(
    "metadata_paged",
    f"""WITH {META_SQL} SELECT paper_id, title, published FROM hit WHERE published BETWEEN DATE '1996-01-01' AND DATE '2001-07-15'""",
)
def metadata_paged(spark, folder):
    """All pages of a dated search: the dates reach the source, which leaves the other windows alone."""
    return served_metadata(spark, folder).where(WHAT.predicate()).select("paper_id", "title", "published")


@query("stream_sliding_log", oracle_sql()["rate_sliding_log"])
def stream_sliding_log(spark, folder):
    """The limiter as a stateful stream over the event file, into a parquet sink."""
    schema = load(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque?")  # a pattern takes one file as well as a folder
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    events = stream.select("event_id", "event_type", (micros / F.lit(1000000.0)).alias("t"))
    flagged = streaming_limiter.sliding_log_stream(events, 3, 3600.0, key="event_type", order="event_id", clock="t")
    out = scratch(spark)
    run = flagged.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query(
    "stream_window_counts",
    """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(window_start, '%Y-%m-%d %H:%M') AS window_start, event_type, n FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(date_trunc('millisecond', ts)) FROM events) - INTERVAL 1 HOUR""",
)
def stream_window_counts(spark, folder):
    """Closed six-hour windows of the event stream, one hour of lateness allowed."""
    schema = load(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parque?")  # a pattern takes one file as well as a folder
    # Seconds since the epoch, so the windows do not move with the session's time zone.
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1000000.0)
    events = stream.select(F.timestamp_micros((seconds * 1000000).cast("bigint")).alias("at"), "event_type")
    counts = streaming_ingest.windowed_counts(events, time_col="at", group="event_type", width="6 hours", late="1 hour")
    out = scratch(spark)
    run = counts.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = spark.read.parquet(f"{out}/rows")
    start = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(window.start))"), "yyyy-MM-dd HH:mm")
    return closed.select(start.alias("window_start"), "event_type", "n")


@query(
    "stream_ingest",
    """SELECT o_orderkey, floor((o_orderdate::DATE - DATE '1995-01-01') / 14.0)::INTEGER AS window_no FROM orders""",
)
def stream_ingest(spark, folder):
    """Windowed ingest as a file stream, run twice: the second run finds nothing new."""
    out = scratch(spark)
    orders = load(spark, folder, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    # Small row groups, because a task reads no less than one of them, however large the file is.
    landing = orders.unionByName(orders).repartition(4).write.option("parquet.block.size", streaming_ingest.SPLIT_BYTES)
    landing.parquet(f"{out}/landing")
    for _ in range(2):
        streaming_ingest.ingest(
            spark, f"{out}/landing", orders.schema, f"{out}/papers", f"{out}/state", id_col="o_orderkey", day_col="day",
            start=dt.date(1995, 1, 1), days=14, files_per_batch=2,
        )
    return spark.read.parquet(f"{out}/papers").select("o_orderkey", "window_no")


CELLS = 64


def filed_vectors(spark, folder):
    """The vectors as an index in a fresh folder, and every twentieth of them as a query."""
    vectors = load(spark, folder, "embeddings")
    centres = vector_index.train_cells(vectors, CELLS, fx.EMBED_DIM, id_col="vec_id")
    path = scratch(spark)
    vector_index.write_index(vectors, centres, path, id_col="vec_id")
    queries = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors, vector_index.read_index(spark, path), centres, queries


@query(
    "vector_index_all_cells",
    """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
)
def vector_index_all_cells(spark, folder):
    """The index probed in every cell is the exact search."""
    _, index, centres, queries = filed_vectors(spark, folder)
    return vector_index.search_index(index, centres, queries, 10, len(centres)).withColumnRenamed("chunk_id", "vec_id")


@query("vector_index_topk")
def vector_index_topk(spark, folder):
    """Approximate neighbours with the probes that measured recall asks for."""
    vectors, index, centres, queries = filed_vectors(spark, folder)
    probes, _ = vector_index.calibrate(index, centres, vectors, queries, 10, id_col="vec_id")
    return vector_index.search_index(index, centres, queries, 10, probes).withColumnRenamed("chunk_id", "vec_id")


@query(
    "vector_index_recall",
    "SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0",
)
def vector_index_recall(spark, folder):
    """Whether the calibrated index finds 0.9 of the exact hits of all queries."""
    vectors, index, centres, queries = filed_vectors(spark, folder)
    probes, _ = vector_index.calibrate(index, centres, vectors, queries, 10, id_col="vec_id")
    exact = search.dense_join(vectors, queries, 10, fx.EMBED_DIM, id_col="vec_id")
    got = vector_index.recall(vector_index.search_index(index, centres, queries, 10, probes), exact)
    return queries.agg(F.count(F.lit(1)).alias("n_queries")).withColumn("reached", F.lit(got >= 0.9))
