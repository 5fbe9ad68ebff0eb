"""File sources and sinks: scans with ignore rules, line logs, partitioned JSON, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Role of a file by the first rule that its lower-case path matches.
ROLES = [
    ("dependency_manifest", r"(?:^|/)(?:package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.(?:toml|lock)|go\.(?:mod|sum)|requirements\.txt|pyproject\.toml|poetry\.lock|pipfile(?:\.lock)?|gemfile(?:\.lock)?|composer\.(?:json|lock)|pom\.xml|build\.gradle(?:\.kts)?)$"),
    ("generated", r"(?:^|/)(?:generated|__generated__|dist|build)/|\.(?:gen|generated|min)\.[a-z]+$"),
    ("test", r"(?:^|/)(?:tests?|__tests__|specs?)/|[._-](?:test|spec)\.[a-z0-9]+$"),
    ("docs", r"(?:^|/)docs?/|\.(?:md|mdx|rst|adoc|txt)$"),
    ("api_route", r"(?:^|/)(?:routes?|api|server)/"),
    ("config", r"(?:^|/)(?:[tj]sconfig\.json|[a-z]+\.config\.[cm]?[jt]s)$"),
    ("source", r"\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts|rs|go|py|java|kt|swift)$"),
]


def file_role(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(role)) for role, p in ROLES], F.lit("unknown"))


def scan(spark: SparkSession, root: str, globs: list[str], ignore: list[str], most_bytes: int | None = None) -> DataFrame:
    """path (within root), modified, length of the files under root that match a glob and no ignore pattern; contents aren't read."""
    found = None
    for g in globs:
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", g).load(root).select("path", "modificationTime", "length")
        found = one if found is None else found.unionByName(one)
    inside = found.select(F.regexp_replace("path", f"^.*?{root.strip('/')}", "").alias("path"), F.col("modificationTime").alias("modified"), "length").distinct()
    for pattern in ignore:
        inside = inside.filter(~F.col("path").rlike(pattern))
    return inside.filter(F.col("length") <= most_bytes) if most_bytes else inside


def lift_metrics(lines: DataFrame, key: list[str], order: str, line: str, schema: str, *more: Column) -> DataFrame:
    """Per key the newest value of each field of its "_metric:" JSON lines, with further aggregates."""
    mark = "_metric:"
    body = F.from_json(F.when(F.startswith(line, F.lit(mark)), F.expr(f"substr({line}, {len(mark) + 1})")), schema)
    rows = lines.withColumn("_m", body)
    fields = rows.schema["_m"].dataType.names
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col(f"_m.{f}").isNotNull(), F.struct(order, F.col(f"_m.{f}").alias("v"))))["v"].alias(f) for f in fields], *more)


def partitioned_json(df: DataFrame, folder: str, by: list[str]) -> DataFrame:
    """Write df as JSON lines in one folder per value of the columns, and read it back with its schema."""
    # Rebalancing gathers a value's rows into few files and splits a hot value over several tasks.
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).json(folder)
    return df.sparkSession.read.schema(df.schema).json(folder)


def csv_round_trip(df: DataFrame, folder: str) -> DataFrame:
    """Write df as CSV with quotes doubled within quotes, and read it back with its schema."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, no, line of every line of a text column."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line"))


def running_delta(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with delta to the row before; for tables of one row per period."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy(order)))
