"""Rule-based and semantic selection of papers, scoring and sampling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scores as sc
from paperloom.functions import text as tx
from paperloom.functions import vectors as vx
from paperloom.functions import verdicts as vd
from paperloom.functions.binding import unnest
from paperloom.functions.lexicon import NEGATIVE_PHRASES, STRONG_INDICATORS, TARGET_SHARES, TOPIC_KEYWORDS
from paperloom.operators.containment import contains_join
from paperloom.operators.ranking import ranked_top_k, top_k, top_k_per_group
from paperloom.session import broadcast_if_small
from paperloom.settings import DEFAULTS


def rule_split(df: DataFrame, text: Column, *, negative: list[str] = NEGATIVE_PHRASES, strong: list[str] = STRONG_INDICATORS, out: str = "stage") -> DataFrame:
    """Three-way split by plain substrings: ``drop`` beats ``keep`` beats ``edge``.

    One narrow pass; the two lists are constants of the plan.
    """
    lowered = F.lower(text)
    stage = (
        F.when(tx.contains_any(lowered, [n.lower() for n in negative]), "drop")
        .when(tx.contains_any(lowered, strong), "keep")
        .otherwise("edge")
    )
    return df.withColumn(out, stage)


def keyword_matches(df: DataFrame, text: Column, keywords: list[str], out: str = "matched") -> DataFrame:
    """Attach the excluded keywords a text holds, in list order."""
    return df.withColumn(out, tx.matching(F.lower(text), keywords))


def keyword_matches_table(df: DataFrame, keywords: DataFrame, *, id_col: str, text_col: str, keyword_col: str = "keyword") -> DataFrame:
    """``(id, keyword)`` pairs where the keywords come from a table of any size."""
    lowered = df.select(id_col, F.lower(text_col).alias("__text"))
    listed = keywords.select(F.col(keyword_col), F.col(keyword_col).alias("__needle")).distinct()
    return contains_join(lowered, listed, doc_id=id_col, doc_text="__text", passage_id=keyword_col, passage_text="__needle")


def partition_by_keywords(df: DataFrame, text: Column, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(filtered out, passed)``: two filters over one projection."""
    matched = keyword_matches(df, text, keywords)
    hit = F.size("matched") > 0
    return matched.where(hit), matched.where(~hit)


def semantic_filter(df: DataFrame, vector_col: str, anchor: list[float], *, threshold: float | None = None, cap: int | None = None, id_col: str) -> DataFrame:
    """Rows at least ``threshold`` close to the anchor; with ``cap`` only that many, the best first."""
    threshold = DEFAULTS.score.semantic_threshold if threshold is None else threshold
    similarity = F.round(vx.cosine(F.col(vector_col), vx.vector_literal(anchor)), 10)
    scored = df.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    best = scored if cap is None else top_k(scored, cap, F.desc("similarity"), F.asc(id_col))
    return best.withColumn("similarity", F.bround("similarity", 4))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Histogram with each group's share of the whole."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def with_bonus(df: DataFrame, topic_col: str, *, targets: Mapping[str, float] | None = None, equal_share: float | None = None) -> DataFrame:
    """Attach the under-representation bonus of each row's group.

    The histogram is aggregated first (map-side combined), so a group holding a
    third of the rows is a counter; it is counted and broadcast back, so the rows
    themselves are never shuffled by group.
    """
    if targets is None:
        share = 1.0 / (len(TOPIC_KEYWORDS) + 1) if equal_share is None else equal_share
        target: Column = F.lit(share)
    else:
        entries = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
        target = F.coalesce(F.try_element_at(entries, F.col(topic_col)), F.lit(0.1))
    bonus = shares(df, topic_col).select(F.col(topic_col).alias("__topic"), sc.under_represented_bonus(F.col("share"), target).alias("bonus"))
    return df.join(broadcast_if_small(bonus), F.col(topic_col).eqNullSafe(F.col("__topic"))).drop("__topic")


def score_papers(df: DataFrame, reference: Column, *, topic_col: str = "topic", equal_share: float | None = None) -> DataFrame:
    """Final score and its components from ``citation_count``, ``published`` and ``similarity``."""
    months = F.coalesce(sc.age_months(F.col("published"), reference), F.lit(sc.MISSING_DATE_MONTHS))
    citation = sc.citation_score(F.coalesce(F.col("citation_count"), F.lit(0)), months)
    fresh = sc.recency(F.col("published"), reference)
    meaning = sc.semantic(F.col("similarity"))
    boosted = with_bonus(df, topic_col, equal_share=equal_share)
    return boosted.select(
        *df.columns,
        F.round(sc.final_score(citation, fresh, meaning, F.col("bonus")), 8).alias("final_score"),
        F.bround(F.least(F.lit(1.0), citation / 5), 4).alias("citation"),
        F.bround(fresh, 4).alias("recency"),
        F.bround(meaning, 4).alias("semantic"),
        F.bround("bonus", 4).alias("stratified"),
    )


def quotas(target: int, distribution: Mapping[str, float] = TARGET_SHARES) -> dict[str, int]:
    """Whole-number quota per topic; ``other`` gets what rounding leaves."""
    whole = sum(distribution.values())
    out = {name: int(target * share / whole) for name, share in distribution.items()}
    out["other"] = target - sum(out.values())
    return out


def stratified_sample(
    df: DataFrame, target: int, *, topic_col: str = "topic", score_col: str = "final_score", id_col: str = "paper_id",
    distribution: Mapping[str, float] = TARGET_SHARES,
) -> DataFrame:
    """Best rows per topic up to its quota, topped up with the best of the rest.

    No row ranked below ``target`` inside its topic can be chosen, so every topic
    is first cut to ``target`` rows, map-side.  What is left is a few thousand
    rows however large the table; the fill and the final rank run on those.
    """
    share = quotas(target, distribution)
    order = [F.desc(score_col), F.asc(id_col)]
    pool = top_k_per_group(df, [topic_col], target, order, rank="__in_topic")
    quota = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    pool = pool.withColumn("__own", F.col("__in_topic") <= F.coalesce(F.try_element_at(quota, F.col(topic_col)), F.lit(0)))
    # Quota rows come first, then the best of the rest: the first `target` are the sample.
    chosen = pool.orderBy(F.desc("__own"), *order).limit(target)
    final = chosen.withColumn("final_rank", F.row_number().over(Window.orderBy(*order)))
    return final.drop("__in_topic", "__own")


def diversity(df: DataFrame, topic_col: str, date_col: str) -> DataFrame:
    """Topic entropy, month-to-month variation, smallest topic share and the gates on them."""
    topics = shares(df, topic_col).agg(
        F.sum(-F.col("share") * F.log2("share")).alias("entropy"), F.min("share").alias("min_share")
    )
    months = df.where(F.col(date_col).isNotNull()).groupBy(F.date_format(date_col, "yyyy-MM").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    spread = months.agg(F.coalesce(F.try_divide(F.stddev_pop("n"), F.avg("n")), F.lit(0.0)).alias("cv"))
    one = F.lit(1).alias("__one")
    both = topics.select("*", one).join(spread.select("*", one), "__one")
    entropy, cv = F.bround("entropy", 3), F.bround("cv", 3)
    return both.select(
        entropy.alias("topic_entropy"),
        cv.alias("temporal_cv"),
        F.bround("min_share", 6).alias("min_share"),
        (entropy >= 3.5).alias("entropy_ok"),
        (cv <= 0.3).alias("cv_ok"),
        (F.col("min_share") >= 0.05).alias("coverage_ok"),
        ((entropy >= 3.5) & (cv <= 0.3) & (F.col("min_share") >= 0.05)).alias("passed"),
    )


def ranked_papers(df: DataFrame, n: int, citation_col: str, date_col: str, id_col: str) -> DataFrame:
    """Best ``n`` by citations, then date; a missing date sorts last."""
    return ranked_top_k(df, n, [F.desc(citation_col), F.desc_nulls_last(date_col), F.asc(id_col)])


def verify_edges(edges: DataFrame, answer: Column, max_verify: int, *, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Ask about the first ``max_verify`` edge cases: ``(accepted, left unasked)``.

    The budget is part of the operator; what it leaves out is returned, not lost.
    ``answer`` is the model's text for a row, null where no model answered, which
    rejects the row.
    """
    ranked = ranked_top_k(edges, max_verify, order, rank="__ask")
    asked = ranked.withColumn("__answer", answer)
    verdict = asked.withColumn("relevance_reason", vd.reason(F.col("__answer"))).where(vd.is_relevant(F.col("__answer")))
    unasked = edges.join(ranked.select("paper_id"), "paper_id", "left_anti")
    return verdict.drop("__answer", "__ask"), unasked


def by_verdict(df: DataFrame, suitable: Column) -> tuple[DataFrame, DataFrame]:
    """``(suitable, unsuitable)``; a missing verdict counts as unsuitable."""
    good = F.coalesce(suitable, F.lit(False))
    return df.where(good), df.where(~good)


def suggested_keywords(df: DataFrame, keywords: Column, min_length: int = 3) -> DataFrame:
    """Distinct keywords proposed by verdicts, lower-cased and trimmed, short ones dropped."""
    rows = unnest(df, [], F.coalesce(keywords, F.array().cast("array<string>")), "k")
    cleaned = rows.select(F.lower(F.trim("k")).alias("keyword"))
    return cleaned.where(F.length("keyword") >= min_length).distinct()


def collection_stats(df: DataFrame, stage_col: str = "stage") -> DataFrame:
    """Collected, kept, edge and dropped counts with the share that was kept."""
    return df.agg(
        F.count(F.lit(1)).alias("collected"),
        *[F.count_if(F.col(stage_col) == s).alias(n) for s, n in (("keep", "kept"), ("edge", "edges"), ("drop", "dropped"))],
        F.round(F.count_if(F.col(stage_col) == "keep") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("kept_share"),
    )
