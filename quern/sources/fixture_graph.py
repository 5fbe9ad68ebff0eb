"""A property graph over the star-schema tables: nodes and edges as DataFrames, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import table

NODES_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, r_name || '/index.ts' AS file_path, CAST(r_regionkey AS BIGINT) AS k FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'class', n_name, r_name || '::' || n_name, r_name || '/' || n_name || '.ts', n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer:' || c_custkey, 'method', c_name, n_name || '::' || c_name, r_name || '/' || n_name || '.ts', c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'function', s_name, n_name || '::' || s_name, CASE WHEN s_suppkey % 5 = 0 THEN 'tests/' ELSE '' END || r_name || '/' || n_name || '.ts', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part:' || p_partkey, 'field', p_name, p_type || '::' || p_name, 'parts/' || p_brand || '.ts', p_partkey FROM part),
"""
EDGES_SQL = """
edges AS (
  SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS kind FROM nation
  UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'supplier:' || l_suppkey, 'calls' FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'references' FROM lineitem)
"""
GRAPH_SQL = NODES_SQL + EDGES_SQL


def _id(kind: str, key: str):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, name, qualified_name, file_path, k."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat("r_name", F.lit("/"), "n_name", F.lit(".ts"))
    qualified = lambda a, b: F.concat(F.col(a), F.lit("::"), F.col(b))
    long = lambda c: F.col(c).cast("long").alias("k")
    named = lambda df, kind, label, key, name, q, file: df.select(_id(kind, key).alias("id"), F.lit(label).alias("kind"), F.col(name).alias("name"), q.alias("qualified_name"), file.alias("file_path"), long(key))
    supplier_path = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "tests/").otherwise(""), path)
    return (
        named(region, "region", "module", "r_regionkey", "r_name", F.col("r_name"), F.concat("r_name", F.lit("/index.ts")))
        .unionByName(named(place, "nation", "class", "n_nationkey", "n_name", qualified("r_name", "n_name"), path))
        .unionByName(named(table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")), "customer", "method", "c_custkey", "c_name", qualified("n_name", "c_name"), path))
        .unionByName(named(table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")), "supplier", "function", "s_suppkey", "s_name", qualified("n_name", "s_name"), supplier_path))
        .unionByName(named(table(spark, d, "part"), "part", "field", "p_partkey", "p_name", qualified("p_type", "p_name"), F.concat(F.lit("parts/"), "p_brand", F.lit(".ts"))))
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, kind."""
    link = lambda df, a, ak, b, bk, kind: df.select(_id(a, ak).alias("source"), _id(b, bk).alias("target"), F.lit(kind).alias("kind"))
    sold = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    ordered = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(sold, F.col("o_orderkey") == F.col("l_orderkey"))
    return (
        link(table(spark, d, "nation"), "region", "n_regionkey", "nation", "n_nationkey", "contains")
        .unionByName(link(table(spark, d, "customer"), "nation", "c_nationkey", "customer", "c_custkey", "contains"))
        .unionByName(link(table(spark, d, "supplier"), "nation", "s_nationkey", "supplier", "s_suppkey", "contains"))
        .unionByName(link(ordered.select("o_custkey", "l_suppkey").distinct(), "customer", "o_custkey", "supplier", "l_suppkey", "calls"))
        .unionByName(link(sold.select("l_suppkey", "l_partkey").distinct(), "supplier", "l_suppkey", "part", "l_partkey", "references"))
    )
