"""Documents to retrieval chunks: abstract, packed sections, described equations.

Sizes are measured and texts are cut and joined by JVM expressions; only the
lists of unit sizes go through Python, which returns chunk borders.  A document
stays in its row from start to end, so chunking needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import kernels
from paperloom.functions import text as tx
from paperloom.functions.binding import let, unnest
from paperloom.functions.tokens import BytePairTokens
from paperloom.settings import ChunkSettings

CHUNK = "struct<content:string,section_title:string,chunk_type:string,form:string,token_count:int>"


def _chunk(content: Column, title: Column, kind: str, form: Column) -> Column:
    return F.struct(
        content.alias("content"), title.alias("section_title"), F.lit(kind).alias("chunk_type"), form.alias("form"),
        tx.word_count(content).cast("int").alias("token_count"),
    )


def _no_chunks() -> Column:
    return F.array().cast(f"array<{CHUNK}>")


def _units(max_tokens: int, count: Callable[[Column], Column]) -> Column:
    """Paragraphs of all sections in order; a paragraph above the limit becomes its sentences."""
    def paragraph_units(section: Column, s: Column) -> Column:
        def one(text: Column, p: Column) -> Column:
            unit = lambda t, size, kind: F.struct(
                s.alias("section"), p.alias("paragraph"), F.lit(kind).alias("kind"), size.alias("size"), t.alias("text")
            )
            whole = lambda n: F.when(n <= max_tokens, F.array(unit(text, n, 0))).otherwise(
                F.transform(tx.sentences(text), lambda t: unit(t, count(t).cast("int"), 1))
            )
            return let(count(text).cast("int"), whole)

        return F.flatten(F.transform(section["paragraphs"], one))

    return F.flatten(F.transform(F.col("sections"), paragraph_units))


def chunk_documents(
    docs: DataFrame, settings: ChunkSettings = ChunkSettings(), *, key: str = "paper_id",
    count: Callable[[Column], Column] | BytePairTokens = tx.word_count,
) -> DataFrame:
    """Chunk rows of ``(key, abstract, sections[, equations])``.

    ``sections`` is ``array<struct<title, paragraphs:array<string>>>``.  ``count``
    is the tokenizer: white-space words, another column function that sizes a text, or
    byte-pair tokens, which also decide where overlaps begin and long sentences end.
    """
    pairs = count if isinstance(count, BytePairTokens) else None
    # A document without a list has an empty one; so has a section.
    lists = {c: F.coalesce(c, F.array().cast(docs.schema[c].dataType)) for c in ("sections", "equations") if c in docs.columns}
    docs = docs.withColumns(lists)
    filled = F.transform(F.filter("sections", lambda s: s.isNotNull()), lambda s: s.withField("paragraphs", F.filter(
        F.coalesce(s["paragraphs"], F.array().cast("array<string>")), lambda p: p.isNotNull())))
    docs = docs.withColumn("sections", filled)
    if pairs is None:
        rows = docs.withColumn("__units", _units(settings.max_tokens, count))
    else:
        rows = docs.withColumn("__units", pairs.units(F.transform("sections", lambda s: s["paragraphs"]), settings.max_tokens))
    u = F.col("__units")
    pack = kernels.pack_udf(settings.max_tokens, settings.overlap_tokens, settings.min_tokens)
    rows = rows.withColumn(
        "__borders",
        pack(u["section"], u["paragraph"], u["kind"], u["size"]),
    )

    if pairs is not None:
        first = F.transform("__borders", lambda b: F.get(u, b["first"])["text"])
        carried_from = F.transform("__borders", lambda b: F.coalesce(F.get(u, F.when(b["carry"] >= 0, b["carry"]))["text"], F.lit("")))
        rows = rows.withColumn("__heads", pairs.heads(first, settings.max_tokens)).withColumn("__tails", pairs.tails(carried_from, settings.overlap_tokens))

    def body(border: Column, i: Column) -> Column:
        texts = F.transform(F.slice(u, border["first"] + 1, border["last"] - border["first"] + 1), lambda x: x["text"])
        joined = F.when(border["form"] == "sentences", F.array_join(texts, " ")).otherwise(F.array_join(texts, "\n\n"))
        tail = tx.tail_tokens(F.get(u, border["carry"])["text"], settings.overlap_tokens) if pairs is None else F.get("__tails", i)
        carried = F.concat(tail, F.lit("\n\n"), joined)
        content = (
            F.when(border["form"] == "truncated", tx.head_tokens(F.get(texts, F.lit(0)), settings.max_tokens) if pairs is None else F.get("__heads", i))
            .when(border["carry"] >= 0, carried)
            .otherwise(joined)
        )
        title = F.get(F.col("sections"), border["section"])["title"]
        return let(content, lambda c: _chunk(c, title, "text", border["form"]))

    parts = [F.transform("__borders", body)]
    if settings.include_abstract and "abstract" in docs.columns:
        summary = tx.strip(F.coalesce(F.col("abstract"), F.lit("")))
        long_enough = (tx.word_count(summary) >= settings.min_tokens) if pairs is None else F.length(summary) > 0
        parts.insert(0, F.when(long_enough, F.array(_chunk(summary, F.lit("Abstract"), "abstract", F.lit("abstract")))).otherwise(_no_chunks()))
    if settings.include_equations and "equations" in docs.columns:
        parts.append(_equation_chunks(settings, sized=pairs is None))
    made = F.concat(*parts)
    if pairs is not None:  # sized after they are put together, then cut by their kind's least size
        rows = rows.select(key, made.alias("__made"))
        rows = rows.withColumn("__counts", pairs.counts(F.transform("__made", lambda c: c["content"])))
        sized = F.zip_with("__made", "__counts", lambda c, n: c.withField("token_count", n))
        least = lambda c: F.when(c["chunk_type"] == "abstract", settings.min_tokens).when(c["chunk_type"] == "equation", settings.equation_min_tokens).otherwise(0)
        made = F.filter(sized, lambda c: c["token_count"] >= least(c))
    numbered = rows.select(key, let(made, lambda cs: mark_overlaps(cs, settings.overlap_tokens)).alias("__chunks"))
    exploded = unnest(numbered, [key], F.col("__chunks"), "c", "chunk_index")
    return exploded.select(
        F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col(key), "chunk_index", "c.*", F.length("c.content").alias("char_count"),
    )


def _equation_chunks(settings: ChunkSettings, sized: bool = True) -> Column:
    """Only equations with a description; their contexts are quoted around it."""
    described = F.filter("equations", lambda e: F.length(tx.strip(F.coalesce(e["text_description"], F.lit("")))) > 0)

    def content(e: Column) -> Column:
        before = F.when(F.length(e["context_before"]) > 0, F.concat(F.lit("Context: "), tx.strip(e["context_before"])))
        after = F.when(F.length(e["context_after"]) > 0, F.concat(F.lit("Following context: "), tx.strip(e["context_after"])))
        return F.concat_ws("\n\n", before, tx.strip(e["text_description"]), after)

    chunks = F.transform(described, lambda e: _chunk(content(e), F.lit("Equation"), "equation", F.lit("equation")))
    return F.filter(chunks, lambda c: c["token_count"] >= settings.equation_min_tokens) if sized else chunks


def mark_overlaps(chunks: Column, overlap: int) -> Column:
    """Flag neighbours whose touching ends share more than five distinct words."""
    if overlap <= 0:
        touches = lambda a, b: F.lit(False)
    else:
        touches = lambda a, b: F.coalesce(tx.share_vocabulary(F.right(a, F.lit(200)), F.left(b, F.lit(200))) > 5, F.lit(False))
    return F.transform(
        chunks,
        lambda c, i: F.struct(
            *[c[f].alias(f) for f in ("content", "section_title", "chunk_type", "form", "token_count")],
            ((i > 0) & touches(F.get(chunks, i - 1)["content"], c["content"])).alias("has_overlap_before"),
            touches(c["content"], F.get(chunks, i + 1)["content"]).alias("has_overlap_after"),
        ),
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        *[F.count_if(F.col("chunk_type") == t).alias(f"{t}_chunks") for t in ("abstract", "text", "equation")],
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.avg("token_count"), 6).alias("avg_tokens"),
        F.count_if("has_overlap_before").alias("with_overlap"),
    )


def embedding_stats(embedded: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """How many rows got a vector, how many failed."""
    return embedded.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(vector_col).isNotNull()).alias("embedded"),
        F.count_if(F.col(vector_col).isNull()).alias("failed"),
        F.round(F.count_if(F.col(vector_col).isNotNull()) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("success_rate"),
    )
