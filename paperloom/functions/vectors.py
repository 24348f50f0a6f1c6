"""Dense and multi-vector arithmetic over ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of element products, in double precision."""
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of unequal length or without length."""
    scale = norm(a) * norm(b)
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.size(a) != F.size(b), F.lit(0.0))
        .when(scale == 0, F.lit(0.0))
        .otherwise(dot(a, b) / scale)
    )


def has_dimension(vec: Column, dim: int) -> Column:
    """The type does not carry the dimension, so scans check it."""
    return vec.isNotNull() & (F.size(vec) == dim)


def max_similarity(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: best document token per query token, negatives add nothing."""
    return F.aggregate(
        query_tokens,
        F.lit(0.0),
        lambda acc, q: acc
        + F.greatest(
            F.lit(0.0),
            F.coalesce(F.array_max(F.transform(doc_tokens, lambda d: cosine(q, d))), F.lit(0.0)),
        ),
    )


def top_weights(weights: Column, k: int) -> Column:
    """The ``k`` largest entries of a ``map<key,double>``; ties keep map order."""
    indexed = F.transform(
        F.map_entries(weights),
        lambda e, i: F.struct((-e["value"]).alias("neg"), i.alias("pos"), e["key"].alias("key"), e["value"].alias("value")),
    )
    best = F.slice(F.array_sort(indexed), 1, k)
    return F.map_from_entries(F.transform(best, lambda e: F.struct(e["key"], e["value"])))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two ``map<key,double>`` columns over shared keys."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.aggregate(
        shared,
        F.lit(0.0),
        lambda acc, key: acc + F.element_at(a, key) * F.element_at(b, key),
    )
