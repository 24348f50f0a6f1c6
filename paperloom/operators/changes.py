"""Keyed data changes over immutable files: each returns the table after the change.

Writers put the result into a new folder and switch over, see ``sources.store``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(incoming: DataFrame, key: Sequence[str], version: str | None = None) -> DataFrame:
    """One row per key, the newest version; ``max_by`` combines map-side, so a hot key stays cheap.

    Versions are told apart by their number and then by the JSON form of the row, since
    maps (sparse vectors) have no order of their own.
    """
    rest = [c for c in incoming.columns if c not in key]
    payload = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    form = F.to_json(payload)
    age = F.struct(F.col(version), form) if version else form
    best = incoming.groupBy(*key).agg(F.max_by(payload, age).alias("__row"))
    return best.select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in incoming.columns])


def upsert(target: DataFrame, incoming: DataFrame, key: Sequence[str], version: str | None = None) -> DataFrame:
    """Incoming rows replace target rows with the same key; the newest version wins among them.

    Only the incoming side is aggregated.  The target takes part in an anti join
    on the keys, which is a broadcast when the change set is small.
    """
    fresh = latest(incoming.select(*target.columns), key, version)
    return target.join(fresh.select(*key), list(key), "left_anti").select(*target.columns).unionByName(fresh)


def insert_ignore(target: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows whose key is new; an existing row always stays.

    The keys already there are found from the target's side, where a small change
    set can be broadcast, instead of shuffling the target's keys.
    """
    fresh = latest(incoming.select(*target.columns), key)
    there = target.select(*key).join(fresh.select(*key), list(key), "left_semi")
    return target.unionByName(fresh.join(there, list(key), "left_anti"))


def update(target: DataFrame, changes: DataFrame, key: Sequence[str], *, touched: str | None = None, now: Column | None = None) -> DataFrame:
    """Non-null values of ``changes`` overwrite; rows hit get a new ``touched`` stamp."""
    fields = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"__new_{c}") for c in fields], F.lit(True).alias("__hit"))
    joined = target.join(renamed, list(key), "left")
    out = []
    for c in target.columns:
        if c in fields:
            out.append(F.coalesce(f"__new_{c}", c).alias(c))
        elif c == touched:
            stamp = F.current_timestamp() if now is None else now
            out.append(F.when(F.col("__hit"), stamp).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def delete(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key), list(key), "left_anti")


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, parent_key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Delete parents and the child rows that reference them."""
    gone = keys.select(F.col(parent_key).alias(child_key))
    return delete(parents, keys, [parent_key]), children.join(gone, child_key, "left_anti")


def deleted_count(target: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*key), list(key), "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def whitelisted(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the allowed columns the input has, in the allowed order."""
    return df.select(*[c for c in allowed if c in df.columns])


def vector_rows(chunks: DataFrame) -> DataFrame:
    """Rows for the vector store: only vectors that are there, empty ones become null, rows without any are left out."""
    kinds = [c for c in ("dense", "dense_second", "sparse", "token_embeddings") if c in chunks.columns]
    present = [F.when(F.size(c) > 0, F.col(c)).alias(c) for c in kinds]
    rows = chunks.select("chunk_id", "paper_id", *present)
    return rows.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in kinds]))


def parse_vector(raw: Column) -> Column:
    """Vectors stored as JSON text."""
    return F.from_json(raw, "array<double>")


def parse_sparse(raw: Column) -> Column:
    """Sparse vectors stored either as ``{indices, values}`` or as ``{token: weight}`` JSON."""
    pair = F.from_json(raw, "struct<indices:array<int>,values:array<double>>")
    plain = F.from_json(raw, "map<string,double>")
    as_map = F.transform_keys(plain, lambda k, _: k.try_cast("int"))
    return F.when(F.contains(raw, F.lit('"indices"')), F.map_from_arrays(pair["indices"], pair["values"])).otherwise(as_map)


def migrate(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Store-to-store copy: unpack vectors, drop rows without any, skip ids already there."""
    rows = chunks.select(
        "chunk_id",
        "paper_id",
        parse_vector(F.col("dense_json")).alias("dense"),
        parse_sparse(F.col("sparse_json")).alias("sparse"),
    )
    rows = vector_rows(rows)
    return rows if existing is None else rows.join(existing.select("chunk_id"), "chunk_id", "left_anti")


def migration_check(source: DataFrame, target: DataFrame) -> DataFrame:
    """Passes when the target holds at least as many rows as the source."""
    a = source.agg(F.count(F.lit(1)).alias("source_count")).withColumn("__one", F.lit(1))
    b = target.agg(F.count(F.lit(1)).alias("target_count")).withColumn("__one", F.lit(1))
    return a.join(b, "__one").drop("__one").withColumn("passed", F.col("target_count") >= F.col("source_count"))


def keyword_changes(keywords: DataFrame, *, add: Mapping[str, Sequence[str]] | None = None, remove: Sequence[str] = ()) -> DataFrame:
    """Keyword table ``(category, keyword)`` after additions and removals, lower-cased and trimmed."""
    gone = [k.lower().strip() for k in remove]
    kept = keywords.where(~F.lower("keyword").isin(gone)) if gone else keywords
    if not add:
        return kept
    entries = [F.struct(F.lit(c).alias("category"), F.lit(k.lower().strip()).alias("keyword")) for c, ks in add.items() for k in ks]
    fresh = keywords.sparkSession.range(1).select(F.explode(F.array(*entries)).alias("e")).select("e.category", "e.keyword")
    fresh = fresh.dropDuplicates(["keyword"]).join(kept.select(F.lower("keyword").alias("keyword")), "keyword", "left_anti")
    return kept.unionByName(fresh.select("category", "keyword"))


def keyword_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an edit did: ``category, keyword, action`` (added, removed) per keyword that came or went."""
    def pairs(df: DataFrame, mark: str) -> DataFrame:
        return df.select("category", F.lower(F.trim("keyword")).alias("keyword")).distinct().withColumn(mark, F.lit(True))

    both = pairs(before, "was").join(pairs(after, "is"), ["category", "keyword"], "full_outer")
    changed = both.where(F.col("was").isNull() | F.col("is").isNull())
    return changed.select("category", "keyword", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("action"))


def keyword_stats(keywords: DataFrame) -> DataFrame:
    return keywords.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
