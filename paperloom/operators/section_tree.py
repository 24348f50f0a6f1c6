"""Sections of sections: levels, document order and subtree sums of trees of any depth.

Sections come as flat rows that name their parent.  Every round doubles the distance a
row looks up, so a tree of depth d is resolved in log2(d) rounds of joins on the
document and the section; a document with most of all sections is spread over all
tasks as well, because no step works on a document as a whole.

Most documents are small: ``resolve_documents`` walks those as a whole, in one pass over
rows sorted by document, and leaves only the large ones to the doubling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from paperloom import kernels
from paperloom.operators.sections import is_excluded
from paperloom.session import broadcast_if_small, cut_lineage

# A document of at most this many sections is held by one task at a time, as four short columns.
WHOLE_SECTIONS = 10_000


def resolve_documents(
    rows: DataFrame, *, doc: str = "paper_id", section_id: str = "section_id", parent_id: str = "parent_id",
    position: str = "position", title: str = "title", whole: int = WHOLE_SECTIONS,
) -> DataFrame:
    """What ``resolve_tree`` adds, but ``path``; documents of up to ``whole`` sections are shuffled once."""
    columns = {"doc": doc, "section_id": section_id, "parent_id": parent_id, "position": position, "title": title}
    named = rows.where(F.col(doc).isNotNull() & F.col(section_id).isNotNull())
    # Counts are added up in the tasks; large documents are few, at most one for each ``whole`` rows.
    large = cut_lineage(named.groupBy(doc).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > whole).select(doc))
    if large.isEmpty():
        return _walked(named, **columns)
    large = broadcast_if_small(large)
    doubled = resolve_tree(named.join(large, doc, "left_semi"), **columns).drop("path")
    return _walked(named.join(large, doc, "left_anti"), **columns).unionByName(doubled)


def _walked(named: DataFrame, *, doc: str, section_id: str, parent_id: str, position: str, title: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, named.schema[c].dataType) for c in (doc, section_id)])
    schema = schema.add("level", "integer").add("preorder", "integer").add("dropped", "boolean").add("subtree_sections", "long").add("subtree_excluded", "long")
    own = F.coalesce(is_excluded(F.col(title)), F.lit(False))
    # Sorted as the children of one parent are, so that the walk compares nothing but ids.
    ordered = named.repartition(doc).sortWithinPartitions(doc, position, section_id)
    rows = ordered.select(doc, section_id, F.col(parent_id).alias("__parent"), own.alias("__out"))
    return named.join(rows.mapInArrow(kernels.tree_walk(to_arrow_schema(schema)), schema), [doc, section_id])


def resolve_tree(
    rows: DataFrame, *, doc: str = "paper_id", section_id: str = "section_id", parent_id: str = "parent_id",
    position: str = "position", title: str = "title",
) -> DataFrame:
    """Add ``level, path, preorder, dropped, subtree_sections, subtree_excluded`` to section rows.

    ``section_id`` is unique within its document and ``position`` orders the children of
    one parent (ties by id).  ``path`` sorts a document's sections as they are read,
    parents first, and ``preorder`` numbers them so, from 1.  ``dropped`` is true for a section with an excluded title and for all
    below it; the sums count a section with everything below it.  A parent that is null
    or missing makes a top section.  Sections on a ring of parents, or below one, have no
    level, path, number or sums; they are dropped if a title on their way up is excluded.  A row
    without a document or an id is left out.
    """
    named = rows.where(F.col(doc).isNotNull() & F.col(section_id).isNotNull())
    own = F.coalesce(is_excluded(F.col(title)), F.lit(False))
    nodes = named.select(
        F.col(doc).alias("__doc"), F.col(section_id).alias("__id"), F.col(parent_id).alias("__parent"), own.alias("__out"),
        F.array(F.struct(F.col(position).alias("position"), F.col(section_id).alias("id"))).alias("__path"),
        F.lit(1).cast("long").alias("__n"), own.cast("long").alias("__x"),
    )
    known = nodes.select("__doc", F.col("__id").alias("__parent"), F.col("__id").alias("__jump"))
    top = nodes.where(F.col("__parent").isNull()).withColumn("__jump", F.lit(None).cast(nodes.schema["__id"].dataType))
    below = nodes.where(F.col("__parent").isNotNull()).join(known, ["__doc", "__parent"], "left")
    state = cut_lineage(below.unionByName(top).drop("__parent"))
    rounds, total = 0, state.count()
    # A tree of n sections is done after log2(n) doublings; what still climbs then is on a ring.
    while 2 ** rounds <= max(total, 1) and not state.where(F.col("__jump").isNotNull()).isEmpty():
        state = cut_lineage(_doubled(state))
        rounds += 1
    ring = F.col("__jump").isNotNull()
    solved = state.select(
        F.col("__doc").alias(doc), F.col("__id").alias(section_id),
        F.when(~ring, F.size("__path")).alias("level"), F.when(~ring, F.col("__path")).alias("path"), F.col("__out").alias("dropped"),
        F.when(~ring, F.col("__n")).alias("subtree_sections"), F.when(~ring, F.col("__x")).alias("subtree_excluded"),
    )
    read = Window.partitionBy(doc, F.col("path").isNull()).orderBy("path")
    return named.join(solved, [doc, section_id]).withColumn("preorder", F.when(F.col("path").isNotNull(), F.row_number().over(read)))


def _doubled(state: DataFrame) -> DataFrame:
    """Rows that knew their ancestors and descendants up to a distance know those up to twice as far."""
    climbing = state.where(F.col("__jump").isNotNull())
    above = state.select("__doc", F.col("__id").alias("__jump"), F.col("__jump").alias("__next"), F.col("__out").alias("__out2"), F.col("__path").alias("__path2"))
    moved = climbing.join(above, ["__doc", "__jump"]).select(
        "__doc", "__id", F.col("__next").alias("__jump"), (F.col("__out") | F.col("__out2")).alias("__out"),
        F.concat("__path2", "__path").alias("__path"), "__n", "__x")
    # Rows at the top stay out of the first join: a null key would bring all of them into one task.
    both = moved.unionByName(state.where(F.col("__jump").isNull()))
    sums = climbing.groupBy("__doc", F.col("__jump").alias("__id")).agg(F.sum("__n").alias("__n2"), F.sum("__x").alias("__x2"))
    return both.join(sums, ["__doc", "__id"], "left").select(
        "__doc", "__id", "__jump", "__out", "__path",
        (F.col("__n") + F.coalesce("__n2", F.lit(0))).alias("__n"), (F.col("__x") + F.coalesce("__x2", F.lit(0))).alias("__x"))


def document_stats(resolved: DataFrame, doc: str = "paper_id") -> DataFrame:
    """Sections of all levels per document: total, excluded, retained, rate; sections on rings do not count."""
    sums = resolved.where(F.col("level") == 1).groupBy(doc).agg(
        F.sum("subtree_sections").alias("total_sections"), F.sum("subtree_excluded").alias("excluded_sections"))
    return sums.select(
        doc, "total_sections", "excluded_sections", (F.col("total_sections") - F.col("excluded_sections")).alias("retained_sections"),
        F.round(F.col("excluded_sections") / F.col("total_sections"), 6).alias("exclusion_rate"))


def outline(resolved: DataFrame, doc: str = "paper_id") -> DataFrame:
    """Kept sections with their place in reading order, from 1."""
    kept = resolved.where(~F.col("dropped") & F.col("preorder").isNotNull())
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("preorder")))


def nested_documents(resolved: DataFrame, doc: str = "paper_id", title: str = "title", paragraphs: str = "paragraphs") -> DataFrame:
    """``(doc, sections)`` for ``chunking.chunk_documents``: kept sections in reading order, subsections after their parent's text."""
    kept = resolved.where(~F.col("dropped") & F.col("preorder").isNotNull())
    section = F.struct("preorder", F.col(title).alias("title"), F.col(paragraphs).alias("paragraphs"))
    listed = kept.groupBy(doc).agg(F.sort_array(F.collect_list(section)).alias("__s"))
    return listed.select(doc, F.transform("__s", lambda s: F.struct(s["title"].alias("title"), s["paragraphs"].alias("paragraphs"))).alias("sections"))
