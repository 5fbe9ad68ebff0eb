"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row in its group, from 0.

    Rows are range-partitioned by group and order, numbered within a range, and
    shifted by the sizes of the group's earlier ranges; a hot group spans many
    ranges. Rows must differ in group and order to have a fixed place.
    """
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    local = ranged.withColumn("_at", F.row_number().over(inside) - 1)
    return local.join(sizes, [*group, "_range"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_shift", "_range")
