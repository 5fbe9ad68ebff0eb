"""Keyed tables: newest row per key, upserts, deletes that cascade, snapshot diffs.

Everything is an aggregation per key or an equi-join; nothing is ordered
globally and every aggregation combines before its shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order per key; nulls are least, ties go to the greatest remaining columns."""
    rest = [c for c in df.columns if c not in key and c not in order]
    top = df.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c not in key])


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with the rows of changes in place of, or beside, those of the same key."""
    return base.join(changes.select(*key), key, "left_anti").unionByName(changes)


def remove(base: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return base.join(keys.select(*key).distinct(), key, "left_anti")


def same(columns: list[str], left: str = "b", right: str = "a") -> Column:
    """Whether all columns agree, null with null."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], compare: list[str]) -> DataFrame:
    """key, change (added, removed, modified) of the rows that differ between two snapshots."""
    b = before.select(*key, F.struct(*compare).alias("b"), F.lit(True).alias("in_b"))
    a = after.select(*key, F.struct(*compare).alias("a"), F.lit(True).alias("in_a"))
    both = b.join(a, key, "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(~same(compare), "modified")
    return both.select(*key, change.alias("change")).filter(F.col("change").isNotNull())


def relation_delta(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, delta (added, removed) between two sets of relations; repeated relations count once."""
    b, a = before.select(*key).distinct(), after.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("delta", F.lit("added")).unionByName(b.join(a, key, "left_anti").withColumn("delta", F.lit("removed")))


def field_diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key, change, changed_fields: add, delete, unchanged, move (path), rename (name) or modify."""
    b = before.select(*key, F.struct(*fields).alias("b"), F.lit(True).alias("in_b"))
    a = after.select(*key, F.struct(*fields).alias("a"), F.lit(True).alias("in_a"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")), F.lit(f)) for f in fields]))
    both = b.join(a, key, "full_outer").withColumn("changed", F.when(F.col("in_b") & F.col("in_a"), changed).otherwise(F.array().cast("array<string>")))
    has = lambda *names: F.arrays_overlap("changed", F.array(*map(F.lit, names)))
    kind = (
        F.when(F.col("in_b").isNull(), "add").when(F.col("in_a").isNull(), "delete").when(F.size("changed") == 0, "unchanged")
        .when(has("file_path"), "move").when(has("name", "qualified_name"), "rename").otherwise("modify")
    )
    return both.select(*key, kind.alias("change"), F.array_join("changed", ",").alias("changed_fields"))


def claim(base: DataFrame, claims: DataFrame, key: list[str], owner: str) -> DataFrame:
    """base with the owner that claims(key, owner) name; claims of unknown keys change nothing, of several on a key the greatest owner counts."""
    one = claims.groupBy(*key).agg(F.max(owner).alias("_owner"))
    return base.join(one, key, "left").withColumn(owner, F.coalesce("_owner", owner)).select(*base.columns)


def clear(df: DataFrame) -> DataFrame:
    """The table without its rows, schema kept; nothing of it is read."""
    return df.sparkSession.createDataFrame([], df.schema)
