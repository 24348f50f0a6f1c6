"""Which texts hold which passages, without comparing every pair.

A text that holds a passage holds all byte windows of it.  Each passage is looked up by one of
them, the one the corpus has least often by a sketch of fixed size, so a passage that begins with
common words is not looked up by these.  Texts stay where they are: their scan hands on only
windows that pass a bit filter of the anchors.  Candidates are then compared as whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from paperloom import kernels
from paperloom.session import broadcast_if_small, cut_lineage

WIDEST = 32  # bytes of a window; shorter passages have the next smaller power of two
SKETCH_BITS = 16
BITS_PER_PASSAGE = 16
FILTER_BITS = (1 << 12, 1 << 26)  # a filter beyond the greatest size lets more windows pass, none fewer


def _grams_of(df: DataFrame, run, id_col: str) -> DataFrame:
    schema = T.StructType().add(id_col, df.schema[id_col].dataType).add("width", T.IntegerType()).add("gram", T.LongType())
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    return df.mapInArrow(run(arrow), schema)


def corpus_counts(texts: DataFrame, passages: DataFrame) -> dict[int, np.ndarray]:
    """Corpus frequencies by width and bucket; the buckets of the passages only, at most ``6 * 2**SKETCH_BITS`` numbers."""
    wanted: dict[int, list[int]] = {}
    for row in passages.mapInArrow(kernels.passage_buckets(WIDEST, SKETCH_BITS), "width int, bucket int").distinct().collect():
        wanted.setdefault(row["width"], []).append(row["bucket"])
    buckets = {width: np.array(sorted(at)) for width, at in wanted.items()}
    counts = {width: np.zeros(1 << SKETCH_BITS, np.int64) for width in buckets}
    counted = texts.mapInArrow(kernels.bucket_counts(buckets, SKETCH_BITS), "width int, bucket int, n long")
    for row in counted.groupBy("width", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["width"]][row["bucket"]] = row["n"]
    return counts


def bit_filter(anchors: DataFrame, n: int) -> np.ndarray:
    """One bit per anchor, as 64-bit words; its size follows the number of anchors up to a limit."""
    size = FILTER_BITS[0]
    while size < min(n * BITS_PER_PASSAGE, FILTER_BITS[1]):
        size *= 2
    place = F.col("gram").bitwiseAND(F.lit(size - 1))  # the size is a power of two
    words = anchors.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(gram & 63 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def contains_join(docs: DataFrame, passages: DataFrame, *, doc_id: str, doc_text: str, passage_id: str, passage_text: str) -> DataFrame:
    """Exact substring join: the distinct ``(doc_id, passage_id)``.

    Null texts and null or empty passages have no partner, nor have rows without an id.
    """
    texts = docs.where(F.col(doc_text).isNotNull()).select(doc_id, F.col(doc_text).alias("__text"))
    asked = passages.where(F.length(passage_text) > 0).select(passage_id, F.col(passage_text).alias("__passage"))
    counts = corpus_counts(texts.select("__text"), asked)
    anchors = cut_lineage(_grams_of(asked, lambda schema: kernels.rarest_grams(counts, WIDEST, SKETCH_BITS, schema), passage_id))
    words = bit_filter(anchors, anchors.count())
    hits = _grams_of(texts, lambda schema: kernels.filtered_grams(sorted(counts), words, schema), doc_id)
    pairs = hits.join(broadcast_if_small(anchors), ["width", "gram"]).select(doc_id, passage_id).distinct()
    near = texts.join(broadcast_if_small(pairs), doc_id).join(asked, passage_id)
    return near.where(F.contains("__text", F.col("__passage"))).select(doc_id, passage_id).distinct()
