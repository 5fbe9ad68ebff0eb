"""Windows over the rows of a session: paging, turns, budgets, cuts, transcripts.

Rows are numbered and summed with window functions over a session; for
sessions of any size use quern.functions.ranking.numbered, which splits a hot
group over ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_before(df: DataFrame, order: list[str], cursor: tuple | None, limit: int) -> DataFrame:
    """The limit rows before the cursor in the order given, oldest first, with more: whether others precede them."""
    if cursor is not None:
        df = df.filter(_precedes(order, cursor))
    top = df.orderBy(*[F.desc(c) for c in order]).limit(limit + 1)
    # At most limit + 1 rows are numbered here.
    place = F.row_number().over(Window.orderBy(*[F.desc(c) for c in order]))
    some = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("_place", place).withColumn("more", some > limit).filter(F.col("_place") <= limit).drop("_place")


def _precedes(order: list[str], cursor: tuple) -> Column:
    """Whether a row comes before the cursor, as comparisons that can be pushed to the scan."""
    less, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, cursor):
        less = less | (equal & (F.col(name) < F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return less


def encode_cursor(*parts: Column) -> Column:
    """An opaque, URL-safe cursor."""
    text = F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]))
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/\n\r", "-_"), F.lit("="))


def decode_cursor(cursor: Column, schema: str) -> Column:
    body = F.translate(cursor, "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    return F.from_json(F.decode(F.unbase64(padded), "utf-8"), schema)


def turns(df: DataFrame, group: str, order: list[str], opens: Column) -> DataFrame:
    """df with turn: how many rows that open a turn came up to the row (0 before the first)."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("turn", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def suffix_sum(group: str, order: list[str], amount: Column) -> Column:
    """Sum of the amount from the row to the end of its group."""
    return F.sum(amount).over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))


def tail_within(df: DataFrame, group: str, order: list[str], amount: Column, budget: int) -> DataFrame:
    """The newest rows of each group whose amounts together stay within the budget, up to the first that doesn't fit."""
    return df.withColumn("_used", suffix_sum(group, order, amount)).filter(F.col("_used") <= budget).drop("_used")


def window_text(df: DataFrame, group: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The newest texts of each group up to the budget of characters; the oldest one kept is cut at its end."""
    size = F.length(text)
    used = df.withColumn("_before", suffix_sum(group, order, size) - size)
    return used.filter(F.col("_before") < budget).withColumn("kept", F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


def prune_candidates(df: DataFrame, group: str, order: list[str], opens: Column, amount: Column, keep_turns: int, protect: int, least: int) -> DataFrame:
    """Rows older than the newest keep_turns turns and than the protected amount, of groups where they add up to more than least."""
    later = Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_turns", F.sum(F.when(opens, 1).otherwise(0)).over(later)).withColumn("_amount", F.when(F.col("_turns") >= keep_turns, amount).otherwise(0))
    rows = rows.withColumn("_used", F.sum("_amount").over(later)).withColumn("_old", (F.col("_turns") >= keep_turns) & (F.col("_used") > protect))
    freed = F.sum(F.when(F.col("_old"), F.col("_amount")).otherwise(0)).over(Window.partitionBy(group))
    return rows.withColumn("_freed", freed).filter(F.col("_old") & (F.col("_freed") > least)).drop("_turns", "_amount", "_used", "_old", "_freed")


def since_last(df: DataFrame, group: str, order: list[str], boundary: Column) -> DataFrame:
    """The rows of each group from its last boundary row on; all rows of groups without one."""
    rows = df.withColumn("_boundary", boundary)
    marks = rows.filter("_boundary").groupBy(group).agg(F.max(F.struct(*order)).alias("_from"))
    return rows.join(marks, group, "left").filter(F.col("_from").isNull() | (F.struct(*order) >= F.col("_from"))).drop("_from", "_boundary")


def sequence_gaps(df: DataFrame, group: str, seq: str) -> DataFrame:
    """group, whole: whether the group's numbers are consecutive, each once; null numbers make it broken."""
    # Repeated numbers are counted per number first, so a group of any size combines before and after the shuffle.
    each = df.groupBy(group, seq).agg(F.count(F.lit(1)).alias("_times"))
    run = (F.max("_times") == 1) & (F.count(seq) == F.count(F.lit(1))) & (F.max(seq) - F.min(seq) + 1 == F.count(seq))
    return each.groupBy(group).agg(F.coalesce(run, F.lit(False)).alias("whole"))
