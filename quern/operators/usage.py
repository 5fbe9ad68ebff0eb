"""Roll-ups and windows of metered usage facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut


def iso_week(ts: Column) -> Column:
    """ISO year and week as yyyyww."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.weekofyear(ts)).cast("int")


def local_date(ts: Column, offset_minutes: int) -> Column:
    """The calendar date of a UTC time in a zone that many minutes from UTC."""
    return F.to_date(ts + F.expr(f"INTERVAL '{offset_minutes}' MINUTE"))


def top_shares(df: DataFrame, group: str, item: str, amount: str, k: int) -> DataFrame:
    """The k items of the greatest amount per group with their share of the group in percent, one decimal; ties by item."""
    sums = df.groupBy(group, item).agg(F.sum(amount).alias(amount))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(amount), item))
    total = F.sum(amount).over(Window.partitionBy(group))
    ranked = sums.select(group, item, amount, place.alias("place"), F.round(F.try_divide(F.col(amount) * 100.0, total), 1).alias("percent"))
    return ranked.filter(F.col("place") <= k)


def guarded_ratio(part: Column, whole: Column, least: int) -> Column:
    """part / whole where whole is at least least, else null."""
    return F.when(whole >= least, part / whole)


def sliding(df: DataFrame, ts: str, length: str, slide: str, keys: list[str], **aggregates: Column) -> DataFrame:
    """Aggregates per sliding window and keys; start is the window's begin."""
    w = F.window(ts, length, slide)
    return df.groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("start"), *keys, *aggregates)


def anchored_fold(df: DataFrame, key: str, ts: str, amount: str, window_seconds: int) -> DataFrame:
    """Rolling total anchored at first use: an amount within the window of the anchor is added, a later one begins anew.

    key, anchor, total after the key's last row. Each row points at the first
    one that a window beginning at it no longer holds; the anchors are what
    the first row reaches along these pointers, found by pointer doubling in
    logarithmically many rounds, so no key's rows are collected.
    """
    micros = F.unix_micros(ts)
    rows = cut(df.groupBy(key, micros.alias("at")).agg(F.sum(amount).alias("amount")))
    # Rows and the ends of their windows in one falling order: the row last seen is the first one beyond an end. One step per row.
    ends = rows.select(key, "at", (F.col("at") + window_seconds * 1_000_000).alias("place"), F.lit(0).alias("is_row"))
    line = ends.unionByName(rows.select(key, "at", F.col("at").alias("place"), F.lit(1).alias("is_row")))
    falling = Window.partitionBy(key).orderBy(F.desc("place"), F.desc("is_row")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("is_row") == 1, F.col("at")), ignorenulls=True).over(falling)
    hops = cut(line.select(key, "at", "is_row", seen.alias("next")).filter("is_row = 0 and next is not null").drop("is_row"))
    reached = cut(rows.groupBy(key).agg(F.min("at").alias("at")))
    n = reached.count()
    while True:
        reached = cut(reached.unionByName(reached.join(hops, [key, "at"]).select(key, F.col("next").alias("at"))).distinct())
        if (now := reached.count()) == n:
            break
        n = now
        hops = cut(hops.alias("a").join(hops.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.next") == F.col("b.at"))).select(F.col(f"a.{key}").alias(key), F.col("a.at").alias("at"), F.col("b.next").alias("next")))
    last = reached.groupBy(key).agg(F.max("at").alias("anchor"))
    return rows.join(last, key).filter(F.col("at") >= F.col("anchor")).groupBy(key).agg(F.timestamp_micros(F.max("anchor")).alias("anchor"), F.sum("amount").alias("total"))
