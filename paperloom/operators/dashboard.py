"""Derived metrics of an evaluation table: deltas, gains, winners, recommendations.

Input is long form, one row per ``model``; a reranked twin is named ``<model>+rerank``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIX = "+rerank"


def base_model(model: Column) -> Column:
    return F.replace(model, F.lit(SUFFIX), F.lit(""))


def is_reranked(model: Column) -> Column:
    return F.contains(model, F.lit(SUFFIX))


def delta_percent(base: Column, new: Column) -> Column:
    """Relative change in percent; 0 when the base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(new - base, base) * 100)


def efficiency(ndcg_gain: Column, extra_ms: Column) -> Column:
    """Quality gained per second of extra latency; infinite when it costs nothing."""
    return F.when(extra_ms <= 0, F.lit(float("inf"))).otherwise(F.try_divide(ndcg_gain, extra_ms) * 1000)


def heat_cell(style: Column, difficulty: Column, overall: Column) -> Column:
    """Style value scaled by the difficulty's ratio to the mean, clamped to [0, 1]; the mean where either is missing."""
    scaled = style * F.try_divide(difficulty, overall)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(scaled, overall, F.lit(0.0))))


def signed_percent(delta: Column) -> Column:
    return F.concat(F.when(delta >= 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f%%", delta))


def model_pairs(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Each base model beside its reranked twin: a self equi-join on the base name."""
    base = results.where(~is_reranked(F.col("model"))).select("model", *[F.col(m).alias(f"base_{m}") for m in metrics])
    twin = results.where(is_reranked(F.col("model"))).select(
        base_model(F.col("model")).alias("model"), *[F.col(m).alias(f"rr_{m}") for m in metrics]
    )
    return base.join(twin, "model")


def rerank_impact(results: DataFrame, metrics: Sequence[str], latency: str = "latency") -> DataFrame:
    """Change in percent per metric, gain/loss parts and efficiency per base model."""
    pairs = model_pairs(results, [*metrics, latency])
    columns = [F.col("model")]
    for m in metrics:
        b, r = F.col(f"base_{m}"), F.col(f"rr_{m}")
        columns += [
            F.round(delta_percent(b, r), 6).alias(f"delta_{m}"),
            F.round(F.greatest(r - b, F.lit(0.0)), 8).alias(f"gain_{m}"),
            F.round(F.greatest(b - r, F.lit(0.0)), 8).alias(f"loss_{m}"),
        ]
    gain = F.col("rr_ndcg_10") - F.col("base_ndcg_10")
    extra = F.col(f"rr_{latency}") - F.col(f"base_{latency}")
    return pairs.select(*columns, F.round(efficiency(gain, extra), 6).alias("efficiency"))


def summary(results: DataFrame, order: Sequence[str], quality: str = "ndcg_10", latency: str = "latency") -> DataFrame:
    """One row of cards: best, fastest, fastest base, best balance, mean gain, best efficiency.

    Ties go to the model that comes first in ``order``; names outside it follow by name.
    """
    place = model_place(F.col("model"), order)
    rows = results.withColumn("__place", place)
    base = ~is_reranked(F.col("model"))
    best = lambda cond, key: F.min_by(F.when(cond, F.col("model")), F.when(cond, key))
    quality_key = F.struct((-F.col(quality)).alias("q"), F.col("__place"), F.col("model"))
    speed_key = F.struct(F.col(latency).alias("l"), F.col("__place"), F.col("model"))
    cards = rows.agg(
        best(F.lit(True), quality_key).alias("best_quality"),
        F.max(quality).alias("best_quality_value"),
        best(F.lit(True), speed_key).alias("fastest"),
        best(base, speed_key).alias("fastest_base"),
        best(base & (F.col(latency) < 100), quality_key).alias("best_balance"),
        best(base & (F.col(latency) < 300), quality_key).alias("recommended"),
    )
    impact = rerank_impact(results, [quality], latency).withColumn("__place", model_place(F.col("model"), order))
    finite = F.col("efficiency") < float("inf")
    gains = impact.agg(
        F.round(F.coalesce(F.avg(f"delta_{quality}"), F.lit(0.0)), 6).alias("mean_gain"),
        best(finite, F.struct((-F.col("efficiency")).alias("e"), F.col("__place"), F.col("model"))).alias("best_efficiency"),
    )
    return cards.withColumn("__one", F.lit(1)).join(gains.withColumn("__one", F.lit(1)), "__one").drop("__one")


def model_place(model: Column, order: Sequence[str]) -> Column:
    """Position in the fixed display order; unknown names come after all known ones."""
    found = F.array_position(F.array(*[F.lit(m) for m in order]), model)
    return F.when(found > 0, found).otherwise(F.lit(len(order) + 1))


def best_flags(results: DataFrame, high: Sequence[str], latency: str = "latency") -> DataFrame:
    """Every model with flags for the best value per metric and the lowest latency."""
    extremes = results.agg(*[F.max(m).alias(f"__max_{m}") for m in high], F.min(latency).alias("__min_latency"))
    joined = results.withColumn("__one", F.lit(1)).join(extremes.withColumn("__one", F.lit(1)), "__one")
    flags = [(F.col(m) == F.col(f"__max_{m}")).alias(f"best_{m}") for m in high]
    return joined.select("model", *high, latency, *flags, (F.col(latency) == F.col("__min_latency")).alias("fastest"))


def compare_models(results: DataFrame, a: str, b: str, high: Sequence[str], low: Sequence[str]) -> DataFrame:
    """Metric by metric: both values, the change in percent and the winner (A, B or tie)."""
    metrics = [*high, *low]
    long = results.where(F.col("model").isin(a, b)).select(
        "model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    )
    wide = long.groupBy("m.metric").agg(
        F.max(F.when(F.col("model") == a, F.col("m.value"))).alias("value_a"),
        F.max(F.when(F.col("model") == b, F.col("m.value"))).alias("value_b"),
    )
    lower_is_better = F.col("metric").isin(*low) if low else F.lit(False)
    va, vb = F.coalesce("value_a", F.lit(0.0)), F.coalesce("value_b", F.lit(0.0))
    a_wins = (lower_is_better & (va < vb)) | (~lower_is_better & (va > vb))
    delta = F.when(lower_is_better, delta_percent(vb, va)).otherwise(delta_percent(va, vb))
    return wide.select(
        "metric",
        va.alias("value_a"),
        vb.alias("value_b"),
        F.round(delta, 6).alias("delta"),
        F.when(va == vb, "tie").when(a_wins, "A").otherwise("B").alias("winner"),
    )


def style_delta(by_style: DataFrame, overall: DataFrame, baseline: str, metric: str = "mrr") -> DataFrame:
    """Change in percent of a metric per query style against a baseline model.

    Where a style is missing the overall value stands in; nothing is invented when
    there is no style data at all.  The baseline's own row is 0.
    """
    styles = by_style.select("style").distinct()
    models = overall.select("model", F.col(metric).alias("__overall"))
    n_styles = styles.agg(F.collect_set("style").alias("__styles"))  # the style names: a handful
    grid = (
        models.withColumn("__one", F.lit(1))
        .join(n_styles.withColumn("__one", F.lit(1)), "__one")
        .select("model", "__overall", F.explode("__styles").alias("style"))
    )
    filled = grid.join(by_style.select("model", "style", F.col(metric).alias("__style")), ["model", "style"], "left")
    value = F.coalesce(F.when(F.col("__style") != 0, F.col("__style")), F.col("__overall"), F.lit(0.0))
    valued = filled.select("model", "style", value.alias("value"))
    base = valued.where(F.col("model") == baseline).select("style", F.col("value").alias("base"))
    change = F.when(F.col("model") == baseline, F.lit(0.0)).when(F.col("base") > 0, (F.col("value") - F.col("base")) / F.col("base") * 100)
    return valued.join(base, "style").select("model", "style", "value", F.round(F.coalesce(change, F.lit(0.0)), 6).alias("delta"))


def unpack_results(df: DataFrame, json_col: str) -> DataFrame:
    """An evaluation JSON ``{model: {metric: value}}`` as one row per model."""
    entry = "struct<avg_mrr:double,`avg_ndcg@5`:double,`avg_ndcg@10`:double,`avg_precision@5`:double,`avg_precision@10`:double,avg_search_time_ms:double,num_queries:bigint>"
    parsed = F.from_json(F.col(json_col), f"map<string,{entry}>")
    rows = df.select(F.explode(parsed).alias("model", "m"))
    return rows.select(
        "model",
        F.col("m.avg_mrr").alias("mrr"),
        F.col("m").getField("avg_ndcg@5").alias("ndcg_5"),
        F.col("m").getField("avg_ndcg@10").alias("ndcg_10"),
        F.col("m").getField("avg_precision@5").alias("precision_5"),
        F.col("m").getField("avg_precision@10").alias("precision_10"),
        F.col("m.avg_search_time_ms").alias("latency"),
        F.col("m.num_queries").alias("num_queries"),
    )


def union_modes(metrics: dict[str, DataFrame]) -> DataFrame:
    """Per-mode hit lists stacked under a ``mode`` column."""
    return reduce(DataFrame.unionByName, [df.withColumn("mode", F.lit(name)) for name, df in metrics.items()])
