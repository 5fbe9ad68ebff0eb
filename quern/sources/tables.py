"""Readers of the columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; the schema comes from the footer, columns and filters are pushed down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_timestamps(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as TIMESTAMP, so that watermarks and windows accept them (session zone UTC)."""
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_timestamps(table(spark, sf_dir, "events"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_timestamps(table(spark, sf_dir, "orders"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_timestamps(table(spark, sf_dir, "lineitem"))
