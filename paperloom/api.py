"""Request-level entry points: the calls a service would make, as library functions.

Every call checks its arguments and returns a DataFrame; nothing is collected
here and no server is started.  A service collects the page it shows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import chat, fusion, listing, rerank, search
from paperloom.settings import DEFAULTS

MODES = ("dense", "sparse", "text", "hybrid", "hybrid_full", "second_dense")


@dataclass(frozen=True)
class SearchRequest:
    """Queries as text; ``weights`` and ``depth`` override the defaults of the mode."""

    queries: DataFrame  # (query_id, query)
    mode: str = "hybrid"
    top_k: int = 10
    rerank: bool = False
    rerank_by: str = "overlap"
    weights: Sequence[float] | None = None
    depth: int | None = None
    paper_id: str | None = None

    def check(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown search mode {self.mode!r}; known: {', '.join(MODES)}")
        if not 1 <= self.top_k <= DEFAULTS.search.max_top_k:
            raise ValueError(f"top_k must be between 1 and {DEFAULTS.search.max_top_k}")
        if self.weights is not None and not all(0 <= w <= 1 for w in self.weights):
            raise ValueError("weights must lie between 0 and 1")


class Library:
    """Search, listing and chat retrieval over one set of tables.

    ``chunks``: (chunk_id, paper_id, content, section_title); ``vectors``:
    (chunk_id, embedding[, second]); ``papers``: the paper table.  ``embed`` turns
    ``(query_id, query)`` into ``(query_id, query_vector)``; without it the hashed
    stand-in is used on both sides.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, papers: DataFrame, vectors: DataFrame | None = None, *, dim: int = 64, embed=None):
        self.spark, self.chunks, self.papers, self.dim = spark, chunks, papers, dim
        self.embed = embed or self._hashed
        self.vectors = vectors if vectors is not None else search.embed_texts(chunks, dim, id_col="chunk_id", text_col="content")

    def _hashed(self, queries: DataFrame) -> DataFrame:
        return search.embed_texts(queries, self.dim, id_col="query_id", text_col="query", out="query_vector")

    def _chunks(self, request: SearchRequest) -> DataFrame:
        return self.chunks if request.paper_id is None else self.chunks.where(F.col("paper_id") == request.paper_id)

    def _dense(self, request: SearchRequest, depth: int, column: str = "embedding") -> DataFrame:
        vectors = self.vectors
        if request.paper_id is not None:
            vectors = vectors.join(self._chunks(request).select("chunk_id"), "chunk_id", "left_semi")
        return search.dense_search(vectors, self.embed(request.queries), depth, self.dim, vector_col=column)

    def _terms(self, request: SearchRequest) -> tuple[DataFrame, DataFrame]:
        docs = search.encode_sparse(self._chunks(request), DEFAULTS.search.sparse_top_k, id_col="chunk_id", text_col="content")
        return docs, search.term_queries(request.queries, "query_id", "query")

    def _sparse(self, request: SearchRequest, depth: int) -> DataFrame:
        return search.sparse_search(*self._terms(request), depth)

    def _text(self, request: SearchRequest, depth: int) -> DataFrame:
        docs = self._chunks(request).select("chunk_id", search.tx.tokens(F.col("content")).alias("terms"))
        return search.text_search(docs, search.term_queries(request.queries, "query_id", "query"), depth)

    def search(self, request: SearchRequest) -> DataFrame:
        """Ranked hits with payload: ``(query_id, rank, chunk_id, paper_id, content, section_title, score, …)``."""
        request.check()
        too_long = request.queries.where((F.length("query") > DEFAULTS.search.max_query_chars) | (F.length(F.trim("query")) == 0))
        if not too_long.isEmpty():
            raise ValueError(f"queries must hold 1 to {DEFAULTS.search.max_query_chars} characters")
        k = rerank.pool_size(request.top_k) if request.rerank else request.top_k
        hits = self._hits(request, k)
        full = search.with_content(hits, self.chunks, id_col="chunk_id", columns=["paper_id", "content", "section_title"])
        if not request.rerank:
            return full
        return rerank.rerank(full.join(request.queries, "query_id"), request.top_k, by=request.rerank_by)

    def _hits(self, request: SearchRequest, k: int) -> DataFrame:
        depth = request.depth or DEFAULTS.fusion.store_depth_factor * k
        if request.mode == "dense":
            return self._dense(request, k)
        if request.mode == "second_dense":
            return self._dense(request, k, "second")
        if request.mode == "sparse":
            return self._sparse(request, k)
        if request.mode == "text":
            return self._text(request, k)
        if request.mode == "hybrid":
            d, s = request.weights or DEFAULTS.fusion.store_weights
            return fusion.rrf({"dense": (self._dense(request, depth), d), "sparse": (self._sparse(request, depth), s)}, k, DEFAULTS.fusion.rrf_k)
        d, s, t = request.weights or DEFAULTS.fusion.three_leg_weights
        legs = {"dense": (self._dense(request, depth), d), "sparse": (self._sparse(request, depth), s), "text": (self._text(request, depth), t)}
        return fusion.rrf(legs, k, DEFAULTS.fusion.rrf_k)

    def search_stats(self) -> DataFrame:
        return self.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("paper_id").alias("papers"))

    def list_papers(self, **page) -> DataFrame:
        return listing.page(self.papers, **page)

    def paper(self, paper_id: str) -> DataFrame:
        return self.papers.where(F.col("paper_id") == paper_id)

    def paper_chunks(self, paper_id: str) -> DataFrame:
        order = ["chunk_index"] if "chunk_index" in self.chunks.columns else ["chunk_id"]
        return self.chunks.where(F.col("paper_id") == paper_id).orderBy(*order)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks.where(F.col("chunk_id") == chunk_id)

    def stats(self) -> DataFrame:
        return listing.status_counts(self.papers)

    def chat_context(self, queries: DataFrame, *, top_k: int = 5, mode: str = "hybrid", history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """``(sources, prompts)`` for each query; the answering model is up to the caller."""
        if not 1 <= top_k <= 20:
            raise ValueError("top_k must be between 1 and 20")
        hits = self.search(SearchRequest(queries, mode, min(top_k * DEFAULTS.chat.over_fetch, DEFAULTS.search.max_top_k)))
        best = chat.one_per_paper(hits, top_k)
        context = chat.build_context(chat.within_budget(best)).join(queries, "query_id")
        if history is not None:
            past = chat.history_text(history).withColumnRenamed("conv_id", "query_id")
            context = context.join(past, "query_id", "left")
        else:
            context = context.withColumn("history", F.lit(None).cast("string"))
        prompts = context.select("query_id", chat.prompt(F.col("query"), F.col("context"), F.col("history")).alias("prompt"))
        return chat.sources(best, self.papers), prompts
