"""Partition counts for work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores.

    For parsers and encoders, whose time per row is far above that of moving
    the row: a scan of few, large or compressed files would leave cores idle.
    A scan that already fills the cores isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
