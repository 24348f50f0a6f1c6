"""Retrieval side of a chat answer: one chunk per paper, context budget, prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.listing import with_titles
from paperloom.operators.ranking import first_per_group, top_k_per_group
from paperloom.settings import DEFAULTS

_C = DEFAULTS.chat

# Instructions that precede every answer.
SYSTEM_TEXT = (
    "Answer the question from the numbered excerpts below and from nothing else.\n"
    "Put the number of the excerpt, as in [1], behind every statement taken from it.\n"
    "Where the excerpts hold no answer, state that instead of guessing.\n"
    "Keep to a few exact sentences; name results and how they were obtained."
)


def one_per_paper(hits: DataFrame, k: int, *, paper_col: str = "paper_id") -> DataFrame:
    """Best hit of every paper per query, then the best ``k`` papers; rank is renumbered."""
    best = first_per_group(hits, ["query_id", paper_col], [F.asc("rank")])
    return top_k_per_group(best.withColumnRenamed("rank", "hit_rank"), ["query_id"], k, [F.asc("hit_rank")])


def within_budget(hits: DataFrame, *, content_col: str = "content", budget: int = _C.context_tokens) -> DataFrame:
    """Longest prefix of each query's ranked sources whose estimated tokens fit the budget.

    The running sum only grows, so stopping at the first overflow is a filter.
    """
    estimate = F.floor(F.length(content_col) / F.lit(_C.chars_per_token)).cast("bigint")
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = hits.withColumn("est_tokens", estimate).withColumn("used_tokens", F.sum("est_tokens").over(running))
    return used.where(F.col("used_tokens") <= budget)


def _context_entry() -> Column:
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Paper: "), F.col("paper_id"))
    section = F.when(F.coalesce(F.length("section_title"), F.lit(0)) > 0, F.concat(F.lit(" | Section: "), "section_title")).otherwise("")
    return F.concat(head, section, F.lit("\n"), F.col("content"), F.lit("\n"))


def build_context(hits: DataFrame) -> DataFrame:
    """One numbered context text per query from its few budgeted sources."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("rank"), _context_entry().alias("part"))))
    packed = hits.groupBy("query_id").agg(entries.alias("e"))
    return packed.select("query_id", F.array_join(F.transform("e", lambda x: x["part"]), "\n---\n").alias("context"))


def history_tail(messages: DataFrame, n: int = _C.history_messages, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Last ``n`` messages of each conversation; longer tails are cut before the shuffle."""
    return top_k_per_group(messages, [conv_col], n, [F.desc(turn_col)], rank="from_end")


def history_text(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The tail as ``Role: text`` lines in turn order, one row per conversation."""
    tail = history_tail(messages, conv_col=conv_col, turn_col=turn_col)
    speaker = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(speaker, F.lit(": "), F.col("text"), F.lit("\n"))
    packed = tail.groupBy(conv_col).agg(F.sort_array(F.collect_list(F.struct(F.col(turn_col), line.alias("line")))).alias("e"))
    return packed.select(conv_col, F.array_join(F.transform("e", lambda x: x["line"]), "").alias("history"))


def prompt(question: Column, context: Column, history: Column) -> Column:
    past = F.when(
        F.coalesce(F.length(history), F.lit(0)) > 0, F.concat(F.lit("\n\nEarlier turns:\n"), history)
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit(SYSTEM_TEXT + "\n\nExcerpts:\n"), context, F.lit("\n"), past,
        F.lit("\nQuestion: "), question, F.lit("\n\nAnswer:"),
    )


def sources(hits: DataFrame, papers: DataFrame, *, key: str = "paper_id") -> DataFrame:
    """Display rows of the answer's sources: title (id when unknown), snippet, rounded score."""
    return with_titles(hits, papers, default=F.col(key).cast("string"), key=key).select(
        "query_id", "rank", key, "title",
        F.substring("content", 1, _C.snippet_chars).alias("snippet"),
        F.bround("score", 3).alias("similarity"),
    )
