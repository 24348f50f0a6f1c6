"""Exact dense, sparse, full-text and late-interaction search.

All legs return ``(query_id, chunk_id, score, rank)``; content is joined later,
for the survivors only.  A query set is turned into one matrix that travels to
the tasks; its size is checked and larger sets are scanned block by block, so
no query or row is ever left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom import kernels
from paperloom.functions import text as tx
from paperloom.functions import vectors as vx
from paperloom.functions.lexicon import STOP_WORDS
from paperloom.functions.stems import stems, stems_of
from paperloom.operators.ranking import top_k, top_k_per_group
from paperloom.session import broadcast_if_small, cut_lineage
from paperloom.settings import DEFAULTS


def leg_order() -> list[Column]:
    return [F.desc("score"), F.asc("chunk_id")]


def _leg_schema(query_id: T.DataType, chunk_id: T.DataType) -> T.StructType:
    return T.StructType().add("query_id", query_id).add("chunk_id", chunk_id).add("score", T.DoubleType())


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])


def _blocks(queries: DataFrame, row_bytes: int):
    """Collect the query set in blocks whose matrix stays below the configured size.

    Blocks are hash slices of the query id; the count decides how many.
    """
    limit = DEFAULTS.search.query_block_bytes
    per_block = max(1, limit // max(1, row_bytes))
    first = queries.limit(per_block + 1).collect()
    if len(first) <= per_block:
        yield first
        return
    n_blocks = -(-queries.count() // max(1, per_block // 2))
    for block in range(n_blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).collect()


CUT_SALTS = 32


def _finish(parts: list[DataFrame], k: int) -> DataFrame:
    """The best ``k`` of each query, in two cuts.

    Every task hands on ``k`` rows per query; a first cut by query and chunk hash thins
    these out in parallel, so the last one reads ``CUT_SALTS`` times ``k`` rows per query
    however many tasks there were.
    """
    candidates = reduce(DataFrame.unionByName, parts).withColumn("__salt", F.pmod(F.xxhash64("chunk_id"), F.lit(CUT_SALTS)))
    thinned = top_k_per_group(candidates, ["query_id", "__salt"], k, leg_order(), rank="__place").drop("__place", "__salt")
    return top_k_per_group(thinned, ["query_id"], k, leg_order())


def dense_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    *,
    id_col: str = "chunk_id",
    vector_col: str = "embedding",
    threshold: float | None = None,
    where: Column | None = None,
) -> DataFrame:
    """Exact cosine top-k of every query ``(query_id, query_vector)`` over ``vectors``.

    ``threshold`` is strict and applies before the cut; ``where`` is a payload
    filter on the corpus, which reaches the scan.
    """
    source = vectors if where is None else vectors.where(where)
    source = source.where(vx.has_dimension(F.col(vector_col), dim)).select(
        F.col(id_col).alias("chunk_id"), F.col(vector_col).alias("embedding")
    )
    schema = _leg_schema(queries.schema["query_id"].dataType, source.schema["chunk_id"].dataType)
    parts = []
    for rows in _blocks(queries.select("query_id", "query_vector"), dim * 8):
        matrix = np.array([r["query_vector"] for r in rows], dtype="float64").reshape(len(rows), dim)
        run = kernels.dense_scan([r["query_id"] for r in rows], matrix, k, threshold, _arrow(schema))
        parts.append(source.mapInArrow(run, schema))
    return _finish(parts, k)


JOIN_BLOCK_ROWS = 4096
# A block of queries stays in its task while rows pass: it has up to so many times the rows of a block, and up to so many bytes.
JOIN_QUERY_BLOCKS = 8
JOIN_QUERY_BYTES = 16 * 1024 * 1024
# Tasks for each slot, so that the last ones do not wait long.
JOIN_WAVES = 4


def _packed(rows: DataFrame, id_col: str, vector_col: str, dim: int, blocks: int, kind: str) -> DataFrame:
    """Vectors in ``blocks`` of about the same size, one row a block: ``block, ids, values``."""
    own = rows.where(vx.has_dimension(F.col(vector_col), dim)).select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"))
    own = own.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    kept = own.groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return cut_lineage(kept.select("block", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("values")))


def dense_join(
    vectors: DataFrame, queries: DataFrame, k: int, dim: int, *, id_col: str = "chunk_id", vector_col: str = "embedding", threshold: float | None = None,
) -> DataFrame:
    """``dense_search`` for a query set as large as the corpus: no vector reaches the driver.

    Both sides are packed into blocks by hash.  A task holds one block of queries, through which
    all blocks of rows (or, with few queries, a part of them) stream; it keeps ``k`` rows per query.
    Rows travel once for each block of queries, not for each pair of blocks.
    """
    floats = all(df.schema[col].dataType == T.ArrayType(T.FloatType()) for df, col in ((vectors, vector_col), (queries, "query_vector")))
    kind = "array<float>" if floats else "array<double>"
    together = JOIN_BLOCK_ROWS * max(1, min(JOIN_QUERY_BLOCKS, JOIN_QUERY_BYTES // (JOIN_BLOCK_ROWS * dim * 8)))
    n_left, n_right = 1 + queries.count() // together, 1 + vectors.count() // JOIN_BLOCK_ROWS
    parts = min(n_right, -(-JOIN_WAVES * vectors.sparkSession.sparkContext.defaultParallelism // n_left))
    left = _packed(queries, "query_id", "query_vector", dim, n_left, kind)
    right = _packed(vectors, id_col, vector_col, dim, n_right, kind)
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = left.withColumn("part", numbers(parts)).select(
        (F.col("block") * parts + F.col("part")).alias("task"), F.lit(-1).cast("long").alias("place"),
        F.col("ids").alias("query_ids"), F.lit(None).cast(right.schema["ids"].dataType).alias("row_ids"), "values",
    )
    rows = right.withColumn("query_block", numbers(n_left)).select(
        (F.col("query_block") * parts + F.col("block") % parts).alias("task"), F.col("block").alias("place"),
        F.lit(None).cast(left.schema["ids"].dataType).alias("query_ids"), F.col("ids").alias("row_ids"), "values",
    )
    # Tasks are numbered, so each has a partition of its own; a hash of the number would put several into one.
    dealt = asked.unionByName(rows).repartitionById(n_left * parts, F.col("task").cast("int")).sortWithinPartitions("task", "place")
    schema = _leg_schema(queries.schema["query_id"].dataType, vectors.schema[id_col].dataType)
    run = kernels.block_streams(dim, k, threshold, _arrow(schema))
    return _finish([dealt.select("task", "query_ids", "row_ids", "values").mapInArrow(run, schema)], k)


def equation_search(equations: DataFrame, queries: DataFrame, k: int, dim: int, *, threshold: float | None = None) -> DataFrame:
    """Best described equations for each query vector: ``(query_id, chunk_id, score, rank)`` and the equation's columns.

    ``equations`` is ``(equation_id, paper_id, latex, text_description, embedding)``; rows
    without a description or a vector are not searched.
    """
    described = equations.where(F.length(F.trim("text_description")) > 0)
    hits = dense_search(described, queries, k, dim, id_col="equation_id", threshold=threshold)
    shown = equations.select(F.col("equation_id").alias("chunk_id"), "paper_id", "latex", "text_description")
    return hits.join(shown, "chunk_id")


def dense_search_one(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """Single-vector search as a plain expression: no Python in the plan."""
    score = vx.cosine(F.col(vector_col), vx.vector_literal(query))
    scored = vectors.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("chunk_id"), F.round(score, kernels.SCORE_DIGITS).alias("score")
    )
    return top_k(scored, k, *leg_order())


def _term_row_bytes(queries: DataFrame) -> int:
    """Bytes of the longest query's postings: a term, a query number and a weight each."""
    longest = queries.agg(F.max(F.size("terms")).alias("n")).first()["n"]
    return 64 * max(1, longest or 1)


def term_queries(df: DataFrame, query_id: str, text: str) -> DataFrame:
    """Query texts as ``(query_id, terms, weights)``; repeats are summed by the matrix."""
    toks = tx.tokens(F.col(text))
    return df.select(
        F.col(query_id).alias("query_id"), toks.alias("terms"), F.transform(toks, lambda _: F.lit(1.0)).alias("weights")
    )


def sparse_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    keep_zero: bool = False,
) -> DataFrame:
    """Exact sparse dot-product top-k in one pass over the corpus, without a shuffle of terms.

    ``docs`` is ``(chunk_id, terms[, weights])``, ``queries`` is
    ``(query_id, terms, weights)``.  ``keep_zero`` keeps rows without a shared
    term eligible, as a relational scan would; an index never returns them.
    """
    weighted = "weights" in docs.columns
    source = docs.select("chunk_id", "terms", *(["weights"] if weighted else []))
    schema = _leg_schema(queries.schema["query_id"].dataType, source.schema["chunk_id"].dataType)
    parts = []
    for rows in _blocks(queries.select("query_id", "terms", "weights"), _term_row_bytes(queries)):
        asked = kernels.QueryTerms([tuple(r) for r in rows])
        run = kernels.sparse_scan(asked, k, keep_zero, weighted, _arrow(schema))
        parts.append(source.mapInArrow(run, schema))
    return _finish(parts, k)


def text_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Full-text search: rows holding all terms of the query, by frequency over length.

    ``docs`` is ``(chunk_id, terms)`` with repeats, ``queries`` is ``(query_id, terms)``.
    """
    return _all_terms(docs, queries, k)


def _all_terms(docs: DataFrame, queries: DataFrame, k: int, forms: DataFrame | None = None) -> DataFrame:
    """``text_search``; with ``forms``, ``(word, term)``, the words of ``docs`` count as the terms they stand for."""
    source = docs.select("chunk_id", "terms")
    schema = _leg_schema(queries.schema["query_id"].dataType, source.schema["chunk_id"].dataType)
    asked = queries.select(
        "query_id",
        F.array_distinct("terms").alias("terms"),
        F.transform(F.array_distinct("terms"), lambda _: F.lit(1.0)).alias("weights"),
    )
    parts = []
    for rows in _blocks(asked, _term_row_bytes(asked)):
        known = None
        if forms is not None:
            # A stem has few forms, so these are a few times the terms of the block.
            wanted = docs.sparkSession.createDataFrame(pa.table({"term": pa.array(sorted({t for r in rows for t in r["terms"]}), pa.string())}))
            known = [tuple(r) for r in forms.join(F.broadcast(wanted), "term").select("word", "term").collect()]
        run = kernels.all_terms_scan(kernels.QueryTerms([tuple(r) for r in rows], known), k, _arrow(schema))
        parts.append(source.mapInArrow(run, schema))
    return _finish(parts, k)


def stemmed_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``text_search`` of the ``stemmed`` rows and queries, in which a word of the corpus is stemmed once, not at each occurrence.

    A first pass gathers the corpus' distinct words; those with the stem of a query's word travel to
    the second, which counts the words as they stand.  A larger query set takes both passes for each block.
    """
    asked = cut_lineage(stemmed(queries.where(F.col("terms").isNotNull())).select("query_id", "terms"))
    each = docs.select(F.explode(F.array_distinct("terms")).alias("word")).distinct()
    # Never null: the planner would test that of every occurrence's stem, below the distinct.
    forms = each.select("word", F.coalesce(stems_of("word"), F.lit("")).alias("term"))
    return _all_terms(without_stop_words(docs), asked, k, forms)


def without_stop_words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("terms", F.filter("terms", lambda t: ~t.isin(STOP_WORDS)))


def stemmed(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``terms`` without stop words and as stems, so that forms of a word meet.

    A text column's stems are worked out in its row, for corpus and queries alike.
    """
    return without_stop_words(docs).withColumn("terms", stems("terms"))


HOT_WORDS = 100_000


def stem_counts(docs: DataFrame) -> DataFrame:
    """Every stem of ``(chunk_id, terms)`` with its occurrences ``n`` and rows ``docs``; stop words do not count.

    The ``HOT_WORDS`` most frequent words are stemmed once and sent to the rows; of the others
    each is stemmed once a row, after its repeats are added up.
    """
    pairs = without_stop_words(docs).select("chunk_id", F.explode("terms").alias("term"))
    words = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    hot = cut_lineage(top_k(words, HOT_WORDS, F.desc("n"), F.asc("term")).select("term", stems_of("term").alias("known")))
    each = pairs.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(hot), "term", "left")
    found = each.select(F.coalesce("known", stems_of("term")).alias("stem"), "chunk_id", "n")
    rows = found.groupBy("stem", "chunk_id").agg(F.sum("n").alias("n"))
    return rows.groupBy("stem").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


def text_search_one(
    docs: DataFrame, query: list[str], k: int, *, id_col: str = "chunk_id", text_col: str = "content", ignore_stop_words: bool = False,
) -> DataFrame:
    """One full-text query as a plain expression.

    With ``ignore_stop_words`` they count neither in the query nor in the texts, as in
    a text index; a query of nothing else then finds nothing.
    """
    asked = [t.lower() for t in query if not (ignore_stop_words and t.lower() in STOP_WORDS)]
    if not asked:
        docs = docs.limit(0)
    terms = F.array_distinct(tx.string_array(asked))
    toks = tx.content_tokens(F.col(text_col)) if ignore_stop_words else tx.tokens(F.col(text_col))
    scored = docs.select(F.col(id_col).alias("chunk_id"), toks.alias("toks")).where(
        F.size(F.array_except(terms, F.col("toks"))) == 0
    )
    frequency = F.size(F.filter("toks", lambda t: F.array_contains(terms, t)))
    return top_k(
        scored.select("chunk_id", F.round(frequency / F.size("toks"), kernels.SCORE_DIGITS).alias("score")), k, *leg_order()
    )


def trigram_search(docs: DataFrame, query: str, k: int, *, id_col: str = "chunk_id", text_col: str = "content", threshold: float = 0.0) -> DataFrame:
    """Rows by Jaccard similarity of character trigrams with the query."""
    score = tx.jaccard(tx.trigrams(F.col(text_col)), tx.trigrams(F.lit(query)))
    scored = docs.select(F.col(id_col).alias("chunk_id"), F.round(score, kernels.SCORE_DIGITS).alias("score"))
    return top_k(scored.where(F.col("score") > threshold), k, *leg_order())


GRAM_BUCKETS = 1 << 14
CLASS_ROWS = 200_000
BLOCK_IDS = 128
PIECE_IDS = 8


def _ordered_grams(texts: DataFrame, counts: list[int]) -> DataFrame:
    """``id, grams``: distinct trigrams as hashes, the ones in the rarest buckets first."""
    hashes = F.transform(tx.trigrams(F.col("text")), lambda g: F.xxhash64(g))
    sizes = F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")  # folded to one literal
    keyed = F.transform(hashes, lambda g: F.struct(F.get(sizes, F.pmod(g, F.lit(GRAM_BUCKETS)).cast("int")).alias("n"), g.alias("g")))
    return texts.select("id", F.transform(F.array_sort(keyed), lambda s: s["g"]).alias("grams"))


def trigram_join(
    docs: DataFrame, queries: DataFrame, threshold: float, *, id_col: str = "chunk_id", text_col: str = "content", query_id: str = "query_id", query_text: str = "query",
) -> DataFrame:
    """All ``(query_id, chunk_id, score)`` whose trigram sets have a Jaccard similarity of at least ``threshold``.

    Two such sets share a gram among the first ``size - ceil(threshold * size) + 1`` of each, in any
    order both follow.  The order puts rare grams first, by counts of ``GRAM_BUCKETS`` hash buckets
    over the corpus, so common grams join nothing; sizes and places rule out more pairs before any
    set is compared.  Null texts have no partner.  ``threshold`` is above 0 and at most 1.
    Every pair is a row: of tables with many equal texts join the ``text_classes``, ``member_pairs`` gives the rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    corpus = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = queries.where(F.col(query_text).isNotNull()).select(F.col(query_id).alias("id"), F.col(query_text).alias("text"))
    bucket = F.explode(F.transform(tx.trigrams(F.col("text")), lambda g: F.pmod(F.xxhash64(g), F.lit(GRAM_BUCKETS)).cast("int"))).alias("bucket")
    counts = [0] * GRAM_BUCKETS
    for row in corpus.select(bucket).groupBy("bucket").count().collect():  # GRAM_BUCKETS rows at most
        counts[row["bucket"]] = row["count"]
    right, left = (cut_lineage(_ordered_grams(t, counts)) for t in (corpus, asked))
    need = lambda n: F.ceil(F.lit(threshold) * n - 1e-9).cast("int")

    def prefix(sets: DataFrame, side: str) -> DataFrame:
        n = F.size("grams")
        kept = sets.withColumn("n", n).withColumn("head", F.slice("grams", 1, n - need(n) + 1))
        return kept.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), F.posexplode("head").alias(f"{side}_at", "gram"))

    # Lists weigh more than the planner's estimate for their type: a broadcast would bring a whole side to the driver.
    met = prefix(left, "q").join(prefix(right, "d").hint("merge"), "gram")
    shared = F.lit(1) + F.least(F.col("q_n") - F.col("q_at"), F.col("d_n") - F.col("d_at")) - 1
    fits = (F.col("d_n") >= need(F.col("q_n"))) & (F.col("q_n") >= need(F.col("d_n")))
    fits &= shared + F.least("q_at", "d_at") >= F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("q_n") + F.col("d_n")) - 1e-9)
    pairs = met.where(fits).select("q_id", "d_id").distinct()
    near = pairs.join(right.select(F.col("id").alias("d_id"), F.col("grams").alias("d_grams")).hint("merge"), "d_id")
    both = near.join(left.select(F.col("id").alias("q_id"), F.col("grams").alias("q_grams")).hint("merge"), "q_id")
    exact = F.size(F.array_intersect("q_grams", "d_grams")) / F.size(F.array_union("q_grams", "d_grams"))
    scored = both.select(F.col("q_id").alias("query_id"), F.col("d_id").alias("chunk_id"), F.round(exact, kernels.SCORE_DIGITS).alias("score"))
    return scored.where(F.col("score") >= threshold)


def text_classes(docs: DataFrame, asked: Column, *, id_col: str = "chunk_id", text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """Texts that are equal but for their case, and whose they are.

    Classes are ``(class_id, text, asked)``: a number of the class, as ids may repeat or be null, and
    whether ``asked`` holds for any row of it.  Members are ``(class_id, id, asked, n, n_asked)``, one
    for every row, with the rows and the asked ones of its class; a row without a text has no class.
    Rows are combined in their tasks, so the copies of a text cost its reducer one row a task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"), asked.alias("asked"))
    grouped = rows.where(F.col("text").isNotNull()).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("n_asked"))
    # The checkpoint fixes the numbers.
    classes = cut_lineage(grouped.select(F.monotonically_increasing_id().alias("class_id"), "text", "n", "n_asked"))
    # A few hot texts may own all rows: their classes are sent to the rows when they are few, else AQE splits the hot partitions.
    small = broadcast_if_small(classes, CLASS_ROWS)
    members = rows.join(small, "text", "left").select("class_id", "id", "asked", "n", "n_asked")
    return classes.select("class_id", "text", (F.col("n_asked") > 0).alias("asked")), members


def _id_blocks(members: DataFrame, size: str) -> DataFrame:
    """``class_id, block, ids``: the ids of a class, cut into blocks of some ``BLOCK_IDS`` by the hash of the id.

    ``size`` is the column with the rows of the class.  An id is listed as often as it comes, ``PIECE_IDS``
    times in one place at most, so an id of many rows goes to several blocks.
    """
    counted = members.where(F.col("class_id").isNotNull()).groupBy("class_id", size, "id").agg(F.count(F.lit(1)).alias("copies"))
    cut = counted.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / PIECE_IDS).cast("int"))))
    listed = F.array_repeat("id", F.least(F.lit(PIECE_IDS), F.col("copies") - F.col("piece") * PIECE_IDS).cast("int"))
    block = F.pmod(F.xxhash64("id", "piece"), F.ceil(F.col(size) / BLOCK_IDS))
    return cut.select("class_id", block.alias("block"), listed.alias("ids")).groupBy("class_id", "block").agg(F.flatten(F.collect_list("ids")).alias("ids"))


def member_pairs(hits: DataFrame, members: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)`` of every asked member and every member of the classes that ``hits`` pairs.

    Members meet as blocks of ids, so a shuffled row stands for some ``BLOCK_IDS`` squared pairs; a task holds
    the pairs of one such row at a time.  The rows are dealt to the tasks by class and block: also a class that
    owns all members is spread over all of them.
    """
    parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _id_blocks(members.where("asked"), "n_asked").select(F.col("class_id").alias("query_id"), F.col("block").alias("query_block"), F.col("ids").alias("query_ids"))
    every = _id_blocks(members, "n").select(F.col("class_id").alias("chunk_id"), F.col("block").alias("chunk_block"), F.col("ids").alias("chunk_ids"))
    # As in ``trigram_join``, lists are not broadcast.
    met = hits.join(asked.hint("merge"), "query_id").join(every.hint("merge"), "chunk_id")
    # The number is given, as the bytes of a row, by which AQE would merge partitions, say little of its pairs.
    dealt = met.repartition(parts, "query_id", "query_block", "chunk_id", "chunk_block")
    each = dealt.select("score", "chunk_ids", F.explode("query_ids").alias("query_id"))
    return each.select("query_id", F.explode("chunk_ids").alias("chunk_id"), "score")


def maxsim_long(vectors: DataFrame, query_tokens: list[list[float]], k: int, *, doc_col: str, vector_col: str, dim: int) -> DataFrame:
    """Late interaction over one-row-per-token storage.

    Each task keeps the best cosine per document and query token, so a document
    that owns a third of all token rows sends one row per task, not its tokens.
    """
    source = vectors.where(vx.has_dimension(F.col(vector_col), dim)).select(
        F.col(doc_col).alias("chunk_id"), F.col(vector_col).alias("embedding")
    )
    partial = T.StructType().add("chunk_id", source.schema["chunk_id"].dataType).add("best", T.ArrayType(T.DoubleType()))
    matrix = np.array(query_tokens, dtype="float64").reshape(len(query_tokens), dim)
    local = source.mapInArrow(kernels.group_max_scan(matrix, _arrow(partial)), partial)
    best = local.groupBy("chunk_id").agg(*[F.max(F.get("best", F.lit(i))).alias(f"q{i}") for i in range(len(query_tokens))])
    total = reduce(lambda a, b: a + b, [F.greatest(F.lit(0.0), F.col(f"q{i}")) for i in range(len(query_tokens))])
    return top_k(best.select("chunk_id", F.round(total, kernels.SCORE_DIGITS).alias("score")), k, *leg_order())


def maxsim_nested(docs: DataFrame, query_tokens: list[list[float]], k: int, *, id_col: str = "chunk_id", tokens_col: str = "token_embeddings") -> DataFrame:
    """Late interaction over one-row-per-document storage (``array<array<float>>``)."""
    scorer = F.pandas_udf(kernels.late_interaction(np.array(query_tokens, dtype="float64")), T.DoubleType())
    scored = docs.where(F.col(tokens_col).isNotNull()).select(
        F.col(id_col).alias("chunk_id"), F.round(scorer(F.col(tokens_col)), kernels.SCORE_DIGITS).alias("score")
    )
    return top_k(scored, k, *leg_order())


def embed_texts(docs: DataFrame, dim: int, *, id_col: str, text_col: str, out: str = "embedding") -> DataFrame:
    """Dense embedding hook; the built-in model is a hashed bag of words."""
    source = docs.select(F.col(id_col), tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    schema = T.StructType().add(id_col, source.schema[id_col].dataType).add(out, T.ArrayType(T.DoubleType()))
    return source.mapInArrow(kernels.hashed_embedding(dim, _arrow(schema)), schema)


def encode_sparse(docs: DataFrame, k: int, *, id_col: str, text_col: str) -> DataFrame:
    """Sparse encoding ``(id, terms, weights)`` kept to the ``k`` heaviest terms."""
    source = docs.select(F.col(id_col), tx.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))
    schema = (
        T.StructType()
        .add(id_col, source.schema[id_col].dataType)
        .add("terms", T.ArrayType(T.StringType()))
        .add("weights", T.ArrayType(T.DoubleType()))
    )
    return source.mapInArrow(kernels.term_weights(k, _arrow(schema)), schema)


def with_content(hits: DataFrame, docs: DataFrame, *, id_col: str, columns: list[str]) -> DataFrame:
    """Late materialisation: fetch payload columns for ranked ids, keeping their order column.

    Hits are queries x k rows: counted, then broadcast, so the payload is scanned
    in place and only its matching rows move.
    """
    payload = docs.select(F.col(id_col).alias("chunk_id"), *columns)
    return payload.join(broadcast_if_small(hits), "chunk_id", "inner")
