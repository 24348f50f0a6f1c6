"""Which sections enter the index, and how much they weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.lexicon import DEFAULT_SECTION_WEIGHT, EXCLUDED_TITLES, SECTION_WEIGHTS
from paperloom.functions.text import SPACE, strip
from paperloom.session import cut_lineage

_EXCLUDED = "(?i)^(?:" + "|".join(EXCLUDED_TITLES) + ")$"


def normal_title(title: Column) -> Column:
    """Trimmed, without leading numbering, inner white space collapsed."""
    bare = F.regexp_replace(strip(title), rf"^[\p{{Nd}}.]+{SPACE}*", "")
    return F.regexp_replace(bare, f"{SPACE}+", " ")


def is_excluded(title: Column) -> Column:
    return F.coalesce(F.rlike(normal_title(title), F.lit(_EXCLUDED)), F.lit(False))


def importance(title: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for pair in SECTION_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(weights, normal_title(F.lower(title))), F.lit(DEFAULT_SECTION_WEIGHT))


def without_excluded(sections: Column) -> Column:
    return F.filter(sections, lambda s: ~is_excluded(s["title"]))


def section_stats(df: DataFrame, sections: str = "sections") -> DataFrame:
    """Total, excluded and retained sections over a table of parsed documents."""
    dropped = F.filter(F.col(sections), lambda s: is_excluded(s["title"]))
    sums = df.select(F.size(sections).alias("t"), F.size(dropped).alias("x")).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_sections"), F.coalesce(F.sum("x"), F.lit(0)).alias("excluded_sections")
    )
    return sums.select(
        "total_sections", "excluded_sections",
        (F.col("total_sections") - F.col("excluded_sections")).alias("retained_sections"),
        F.round(F.col("excluded_sections") / F.greatest("total_sections", F.lit(1)), 6).alias("exclusion_rate"),
    )


def nested_excluded(rows: DataFrame) -> DataFrame:
    """For hand-made nested input as ``(section_id, parent_id, title)`` rows: drop excluded sections with their subtree.

    Repeats until no further section falls, so any depth is reached; a ring of parents
    ends as well, since a section falls once.
    """
    flagged = cut_lineage(rows.withColumn("__out", F.coalesce(is_excluded(F.col("title")), F.lit(False))))
    before, now = -1, flagged.where("__out").count()
    while now != before:
        gone = flagged.where("__out").select(F.col("section_id").alias("__gone")).distinct()
        joined = flagged.join(gone, F.col("parent_id") == F.col("__gone"), "left")
        flagged = cut_lineage(joined.withColumn("__out", F.col("__out") | F.col("__gone").isNotNull()).drop("__gone"))
        before, now = now, flagged.where("__out").count()
    return flagged.where(~F.col("__out")).drop("__out")
