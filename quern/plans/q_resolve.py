"""Resolution, keyed-table and source/sink queries."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import keyed, resolve
from quern.plans.checkpoints import ensure_dir
from quern.plans.registry import registry
from quern.sources import files
from quern.sources.tables import events, lineitem, orders, table

QUERIES, ORACLE, query = registry()

LANGUAGE = ("typescript", "python", "go")

_SYM = """
sym AS (SELECT 'p' || p_partkey AS id, p_name AS name, p_type || '::' || p_name AS qualified_name, 'src/' || lower(p_type) || '/' || p_brand || '.ts' AS file_path, CASE p_partkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS language,
  CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'struct' ELSE 'field' END AS kind, p_partkey % 2 = 0 AS is_exported, CAST(p_partkey % 1000 AS INTEGER) AS start_line FROM part),
ref AS (SELECT 'r' || p_partkey AS ref_id, p_name AS name, 'src/' || lower(p_type) || '/' || replace(p_brand, '1', '2') || '.ts' AS file_path, CASE p_size % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS language,
  CASE p_size % 3 WHEN 0 THEN 'calls' WHEN 1 THEN 'instantiates' ELSE 'decorates' END AS kind, p_size AS line FROM part),
dirs AS (SELECT ref_id, id, r.file_path = s.file_path AS own, CASE WHEN split_part(r.file_path, '/', 2) = split_part(s.file_path, '/', 2) THEN 2 ELSE 1 END AS shared,
  r.language = s.language AS lang, r.kind AS rk, s.kind AS sk, is_exported, start_line, line FROM ref r JOIN sym s USING (name)),
scored AS (SELECT *, least(shared * 15, 80) + CASE WHEN own THEN 100 ELSE 0 END + CASE WHEN lang THEN 50 ELSE -80 END + CASE WHEN rk = 'calls' AND sk = 'function' THEN 25 WHEN rk = 'instantiates' AND sk IN ('class', 'struct') THEN 25 WHEN rk = 'decorates' AND sk = 'function' THEN 25 WHEN rk = 'decorates' AND sk = 'class' THEN 15 ELSE 0 END
  + CASE WHEN is_exported THEN 10 ELSE 0 END + CASE WHEN own AND start_line > 0 THEN greatest(0.0, 20 - abs(start_line - line) / 10.0) ELSE 0 END AS score FROM dirs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, id) AS p, count(*) OVER (PARTITION BY ref_id) AS n FROM scored)
"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return _symbols(table(spark, d, "part"))


def _symbols(parts: DataFrame, *more) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return parts.select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat("p_type", F.lit("::"), "p_name").alias("qualified_name"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_brand", F.lit(".ts")).alias("file_path"),
        F.element_at(F.array(*map(F.lit, LANGUAGE)), (k % 3 + 1).cast("int")).alias("language"), F.element_at(F.array(*map(F.lit, ("function", "class", "struct", "field"))), size % 4 + 1).alias("kind"), (k % 2 == 0).alias("is_exported"), (k % 1000).cast("int").alias("start_line"), *more,
    )


def refs(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        F.concat(F.lit("r"), k.cast("string")).alias("ref_id"), F.col("p_name").alias("name"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("1"), F.lit("2")), F.lit(".ts")).alias("file_path"),
        F.element_at(F.array(*map(F.lit, LANGUAGE)), size % 3 + 1).alias("language"), F.element_at(F.array(*map(F.lit, ("calls", "instantiates", "decorates"))), size % 3 + 1).alias("kind"), size.alias("line"),
    )


@query("resolve_e6_best_match", f"WITH {_SYM} SELECT ref_id, id, round(CAST(score AS DOUBLE), 4) AS score, n FROM ranked WHERE p = 1")
def e6(spark, d):
    return _e6(refs(spark, d), symbols(spark, d))


def _e6(asked, sym):
    return resolve.best_match(asked, sym).select("ref_id", "id", F.round("score", 4).alias("score"), "n")


@query("resolve_e3_exact_name", f"WITH {_SYM} SELECT ref_id, id, CAST(CASE WHEN n = 1 THEN CASE WHEN lang THEN 0.9 ELSE 0.5 END WHEN least(shared * 15, 80) >= 30 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence FROM ranked WHERE p = 1 AND (n = 1 OR score > -1)")
def e3(spark, d):
    return resolve.by_name(refs(spark, d), symbols(spark, d)).select("ref_id", "id", "confidence")


@query("resolve_e2_file_path", "WITH f AS (SELECT DISTINCT 'f:' || path AS id, regexp_extract(path, '[^/]*$') AS name, path AS file_path FROM source_files), r AS (SELECT DISTINCT 'r:' || path AS ref_id, regexp_extract(path, '[^/]*/[^/]*$') AS name FROM source_files WHERE path LIKE '%/%/%'), m AS (SELECT ref_id, f.id, f.file_path = r.name AS exact, ends_with(f.file_path, r.name) AS ends FROM r JOIN f ON f.name = regexp_extract(r.name, '[^/]*$')) SELECT ref_id, coalesce(min(id) FILTER (exact), min(id) FILTER (ends), CASE WHEN count(*) = 1 THEN min(id) END) AS id, CAST(CASE WHEN bool_or(exact) THEN 0.95 WHEN bool_or(ends) THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence FROM m GROUP BY 1")
def e2(spark, d):
    f = table(spark, d, "source_files").select("path").distinct()
    asked = f.filter(F.col("path").rlike("/.*/")).select(F.concat(F.lit("r:"), "path").alias("ref_id"), F.regexp_extract("path", "[^/]*/[^/]*$", 0).alias("name"))
    return resolve.by_path(asked, f.select(F.concat(F.lit("f:"), "path").alias("id"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file_path"))).select("ref_id", "id", "confidence")


@query("resolve_e4_qualified", f"WITH {_SYM}, q AS (SELECT 'q' || p_partkey AS ref_id, p_type || '::' || p_name AS name FROM part), m AS (SELECT q.ref_id, s.id, s.qualified_name = q.name AS exact, ends_with(s.qualified_name, '::' || q.name) AS ends FROM q JOIN sym s ON s.name = split_part(q.name, '::', 2)) SELECT * FROM (SELECT ref_id, CASE WHEN count(*) FILTER (exact) = 1 THEN min(id) FILTER (exact) ELSE min(id) FILTER (ends) END AS id FROM m GROUP BY 1) WHERE id IS NOT NULL")
def e4(spark, d):
    return _e4(table(spark, d, "part"), symbols(spark, d))


def _e4(parts, sym):
    asked = parts.select(F.concat(F.lit("q"), F.col("p_partkey").cast("string")).alias("ref_id"), F.concat("p_type", F.lit("::"), "p_name").alias("name"))
    return resolve.by_qualified(asked, sym).select("ref_id", "id")


@query("resolve_e8_lower_name", "WITH s AS (SELECT 'c' || c_custkey AS id, lower(c_name) AS low, CASE c_custkey % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS lang FROM customer), r AS (SELECT 'r' || c_custkey AS ref_id, lower(c_name) AS low, 'python' AS lang FROM customer) SELECT ref_id, id, CAST(CASE WHEN r.lang = s.lang THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence FROM r JOIN s USING (low)")
def e8(spark, d):
    c = table(spark, d, "customer")
    return _e8(c, c)


def _e8(c, chosen):
    sym = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("class").alias("kind"), F.element_at(F.array(*map(F.lit, LANGUAGE)), (F.col("c_custkey") % 3 + 1).cast("int")).alias("language"))
    asked = chosen.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("ref_id"), F.upper("c_name").alias("name"), F.lit("python").alias("language"))
    return resolve.by_lower_name(asked, sym).select("ref_id", "id", "confidence")


def _ladder(spark, d):
    """The ladder over the parts' symbols and references, with methods of the brands as classes and dotted references to them."""
    p, k, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    brand, step = F.replace("p_brand", F.lit("#"), F.lit("")), F.concat(F.lit("step"), size.cast("string"))
    # One pass gives a part's three symbols: itself, its method and the brand's class.
    of = lambda own, method, class_: F.when(F.col("mark") == "p", own).when(F.col("mark") == "m", method).otherwise(class_)
    sym = _symbols(p.withColumn("mark", F.explode(F.array(*map(F.lit, "pmk")))), "mark", brand.alias("brand"), step.alias("step"), k.cast("string").alias("no"))
    sym = sym.withColumns({"id": F.concat("mark", "no"), "name": of(F.col("name"), F.col("step"), F.col("brand")), "qualified_name": of(F.col("qualified_name"), F.concat("brand", F.lit("::"), "step"), F.col("brand")), "kind": of(F.col("kind"), F.lit("method"), F.lit("class"))}).drop("mark", "brand", "step", "no")
    receiver = F.element_at(F.array(brand, F.lower(brand), F.concat(F.lit("my"), brand), F.lit("it")), (k % 4 + 1).cast("int"))
    dotted = p.withColumn("name", F.concat(receiver, F.lit("."), step)).select(F.concat(F.lit("d"), k.cast("string")).alias("ref_id"), "name", F.lit("src/main.ts").alias("file_path"), F.element_at(F.array(*map(F.lit, LANGUAGE)), (k % 3 + 1).cast("int")).alias("language"), F.lit("calls").alias("kind"), size.alias("line"), F.when(k % 4 == 3, brand).alias("receiver_type"))
    return resolve.resolve(refs(spark, d).unionByName(dotted, allowMissingColumns=True), sym)


@query("resolve_e1_ladder")
def e1(spark, d):
    return _ladder(spark, d)


@query("resolve_a26_by_method")
def a26(spark, d):
    return _ladder(spark, d).groupBy("by").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("resolve_e9_arbitration", "WITH o AS (SELECT o_custkey AS ref_id, o_orderkey AS id, round((o_orderkey % 97) / 100.0, 2) AS c, CAST(o_orderkey % 4 AS INTEGER) AS s FROM orders), a AS (SELECT ref_id, coalesce(min((s, id, c)) FILTER (c >= 0.9), min((-c, s, id, c))) IS NULL AS x FROM o GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN c >= 0.9 THEN 0 ELSE 1 END, CASE WHEN c >= 0.9 THEN s END, CASE WHEN c >= 0.9 THEN id END, c DESC, s, id) AS p FROM o) SELECT ref_id, id, CAST(c AS DOUBLE) AS confidence, s AS strategy FROM w WHERE p = 1")
def e9(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("ref_id"), F.col("o_orderkey").alias("id"), F.round((F.col("o_orderkey") % 97) / 100.0, 2).alias("confidence"), (F.col("o_orderkey") % 4).cast("int").alias("strategy"))
    return resolve.arbitrate(o)


@query("resolve_e10_edge_creation", f"WITH {_SYM} SELECT ref_id AS source, id AS target, CASE WHEN rk = 'calls' AND sk = 'class' THEN 'instantiates' ELSE rk END AS kind FROM ranked WHERE p = 1")
def e10(spark, d):
    return _e10(refs(spark, d), symbols(spark, d))


def _e10(asked, sym):
    hit = resolve.best_match(asked, sym).join(asked.select("ref_id", F.col("kind").alias("rk")), "ref_id").join(sym.select("id", F.col("kind").alias("sk")), "id")
    return hit.select(F.col("ref_id").alias("source"), F.col("id").alias("target"), F.when((F.col("rk") == "calls") & (F.col("sk") == "class"), "instantiates").otherwise(F.col("rk")).alias("kind"))


@query("resolve_e12_first_family", "WITH a AS (SELECT DISTINCT o_custkey AS source, l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 45), b AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.08) SELECT source, target, CAST(min(f) AS INTEGER) AS family FROM (SELECT *, 0 AS f FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL")
def e12(spark, d):
    both = orders(spark, d).join(lineitem(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), "l_quantity", "l_discount")
    return resolve.first_family([both.filter("l_quantity > 45"), both.filter("l_discount > 0.08")])


@query("resolve_e22_event_channels", "WITH r AS (SELECT DISTINCT s_nationkey AS ch, s_suppkey AS target FROM supplier), e AS (SELECT DISTINCT c_nationkey AS ch, c_custkey AS source FROM customer WHERE c_acctbal > 9000), ok AS (SELECT ch FROM r GROUP BY 1 HAVING count(*) <= 5), ok2 AS (SELECT ch FROM e GROUP BY 1 HAVING count(*) <= 5) SELECT source, target, ch AS channel FROM e JOIN r USING (ch) WHERE ch IN (SELECT ch FROM ok) AND ch IN (SELECT ch FROM ok2) AND source <> target")
def e22(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_nationkey").alias("channel"), F.col("s_suppkey").alias("id"))
    e = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("channel"), F.col("c_custkey").alias("id"))
    return resolve.channel_edges(r, e, 5)


@query("resolve_e25_stub_impl", "WITH s AS (SELECT DISTINCT l_suppkey AS owner, l_partkey % 50 AS m FROM lineitem), c AS (SELECT DISTINCT o_custkey AS owner, l_partkey % 50 AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey), p AS (SELECT s.owner AS stub, c.owner AS impl, count(*) AS met FROM s JOIN c USING (m) GROUP BY ALL), n AS (SELECT owner, count(*) AS need FROM s GROUP BY 1) SELECT stub, impl FROM p JOIN n ON n.owner = stub WHERE met = need AND stub <> impl")
def e25(spark, d):
    return _e25(lineitem(spark, d), spark, d)


def _e25(lines, spark, d):
    s = lines.select(F.col("l_suppkey").alias("owner"), (F.col("l_partkey") % 50).alias("method"))
    c = orders(spark, d).join(lineitem(spark, d), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("owner"), (F.col("l_partkey") % 50).alias("method"))
    return resolve.containing_sets(s, c)


@query("resolve_e26_tag_references", r"""WITH t AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '<([a-z]+)[ >]', 1)) AS tag FROM source_files WHERE language = 'xml') SELECT a.path AS source, a.tag FROM t a JOIN (SELECT tag FROM t GROUP BY 1 HAVING count(*) > 1) USING (tag)""")
def e26(spark, d):
    tags = table(spark, d, "source_files").filter("language = 'xml'").select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("content", F.lit("<([a-z]+)[ >]"), F.lit(1))).alias("tag")).distinct()
    return tags.join(tags.groupBy("tag").count().filter("count > 1").select("tag"), "tag", "left_semi").select("source", "tag")


@query("resolve_e14_field_diff", """WITH b AS (SELECT c_custkey, c_name AS name, c_mktsegment AS file_path, CAST(floor(c_acctbal) AS BIGINT) AS sig FROM customer WHERE c_custkey % 10 <> 1), a AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN c_name || 'x' ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 4 THEN 'MOVED' ELSE c_mktsegment END AS file_path, CAST(floor(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 10 = 5 THEN 1 ELSE 0 END AS sig FROM customer WHERE c_custkey % 10 <> 2),
j AS (SELECT c_custkey, b.name IS NULL AS nb, a.name IS NULL AS na, concat_ws(',', CASE WHEN b.name <> a.name THEN 'name' END, CASE WHEN b.file_path <> a.file_path THEN 'file_path' END, CASE WHEN b.sig <> a.sig THEN 'sig' END) AS changed_fields FROM b FULL JOIN a USING (c_custkey))
SELECT c_custkey, CASE WHEN nb THEN 'add' WHEN na THEN 'delete' WHEN changed_fields = '' THEN 'unchanged' WHEN contains(changed_fields, 'file_path') THEN 'move' WHEN contains(changed_fields, 'name') THEN 'rename' ELSE 'modify' END AS change, changed_fields FROM j""")
def e14(spark, d):
    before, after = snapshots(spark, d)
    return keyed.field_diff(before, after, ["c_custkey"], ["name", "qualified_name", "file_path", "sig"])


def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 10
    sig = F.floor("c_acctbal").cast("long")
    before = c.filter(k != 1).select("c_custkey", F.col("c_name").alias("name"), F.lit("q").alias("qualified_name"), F.col("c_mktsegment").alias("file_path"), sig.alias("sig"))
    after = c.filter(k != 2).select("c_custkey", F.when(k == 3, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")).alias("name"), F.lit("q").alias("qualified_name"), F.when(k == 4, "MOVED").otherwise(F.col("c_mktsegment")).alias("file_path"), (sig + F.when(k == 5, 1).otherwise(0)).alias("sig"))
    return before, after


@query("tables_u5_snapshot_diff", "SELECT c_custkey, CASE c_custkey % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'modified' END AS change FROM customer WHERE c_custkey % 10 IN (1, 2, 3, 4, 5)")
def u5(spark, d):
    before, after = snapshots(spark, d)
    return keyed.snapshot_diff(before, after, ["c_custkey"], ["name", "file_path", "sig"])


@query("tables_u7_stale_by_hash", "SELECT c_custkey FROM customer WHERE c_custkey % 10 IN (3, 4, 5)")
def u7(spark, d):
    before, after = (s.select("c_custkey", F.sha2(F.concat_ws("|", "name", "file_path", F.col("sig").cast("string")), 256).alias("hash")) for s in snapshots(spark, d))
    return before.join(after.withColumnRenamed("hash", "now"), "c_custkey").filter("hash <> now").select("c_custkey")


@query("tables_u8_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN c_name || 'x' ELSE c_name END AS name FROM customer")
def u8(spark, d):
    before, after = snapshots(spark, d)
    return keyed.upsert(before, after, ["c_custkey"]).select("c_custkey", "name")


@query("tables_s6_store_extraction", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def s6(spark, d):
    """Rows whose hash is unchanged are kept, the others replaced; of the new ones only those whose parent exists."""
    before, after = (s.withColumn("hash", F.xxhash64("name", "file_path", "sig")) for s in snapshots(spark, d))
    fresh = after.join(before.select("c_custkey", "hash"), ["c_custkey", "hash"], "left_anti")
    stored = keyed.upsert(before, fresh, ["c_custkey"])
    parents = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").join(stored.select("c_custkey"), "c_custkey", "left_semi").join(parents, "c_nationkey", "left_semi").select("c_custkey")


@query("tables_s7_import_without_orphans", "SELECT DISTINCT id, session_id FROM agent_message WHERE session_id IN (SELECT id FROM agent_session)")
def s7(spark, d):
    return table(spark, d, "agent_message").join(table(spark, d, "agent_session").select(F.col("id").alias("session_id")), "session_id", "left_semi").dropDuplicates(["id", "session_id"]).select("id", "session_id")


@query("tables_d1_insert_or_replace", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def d1(spark, d):
    o = orders(spark, d).select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("latest"))
    return keyed.newest(o, ["o_custkey"], ["o_orderdate"]).select("o_custkey", "latest")


@query("tables_d2_append_keeps_repeats", "SELECT l_suppkey, 2 * count(*) AS n FROM lineitem GROUP BY 1")
def d2(spark, d):
    li = lineitem(spark, d).select("l_suppkey")
    return li.unionAll(li).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("tables_d3_cascade_delete", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1")
def d3(spark, d):
    gone = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = keyed.remove(orders(spark, d).select("o_orderkey", "o_custkey"), gone, ["o_custkey"])
    lines = lineitem(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    return o.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("tables_d4_latest_semantics", "SELECT DISTINCT path, project_id, max(updated_at) OVER (PARTITION BY path, project_id) AS updated_at FROM file_semantics")
def d4(spark, d):
    return keyed.newest(table(spark, d, "file_semantics").select("path", "project_id", "updated_at"), ["path", "project_id"], ["updated_at"])


@query("tables_d5_delete_by_composite_key", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_orderkey, l_partkey, l_suppkey) NOT IN (SELECT (l_orderkey, l_partkey, l_suppkey) FROM lineitem WHERE l_quantity > 25)")
def d5(spark, d):
    li = lineitem(spark, d)
    key = ["l_orderkey", "l_partkey", "l_suppkey"]
    return keyed.remove(li.select(*key).distinct(), li.filter("l_quantity > 25"), key)


@query("tables_d6_monotone_soft_delete", "SELECT o_orderkey, greatest(CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) + 1, 883612800000) AS updated FROM orders WHERE o_orderstatus = 'F'")
def d6(spark, d):
    return orders(spark, d).filter("o_orderstatus = 'F'").select("o_orderkey", F.greatest(F.unix_millis("o_orderdate") + 1, F.lit(883_612_800_000)).alias("updated"))


@query("tables_d7_usage_counters", "SELECT user_id, count(DISTINCT event_type) AS used FROM events GROUP BY 1")
def d7(spark, d):
    return events(spark, d).select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("used"))


@query("tables_d8_scope_reset", """WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT o_orderkey, o_custkey IN (FROM c) AS gone FROM orders), l AS (SELECT coalesce(gone, false) AS gone FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey)
SELECT 'customer' AS t, count(*) FILTER (c_mktsegment IS NOT DISTINCT FROM 'BUILDING') AS deleted, count(*) FILTER (c_mktsegment IS DISTINCT FROM 'BUILDING') AS remaining FROM customer
UNION ALL SELECT 'orders', count(*) FILTER (gone), count(*) FILTER (NOT gone) FROM o UNION ALL SELECT 'lineitem', count(*) FILTER (gone), count(*) FILTER (NOT gone) FROM l""")
def d8(spark, d):
    """A segment's customers go with their orders and lines; what each table loses and keeps."""
    c = table(spark, d, "customer")
    scope = c.filter("c_mktsegment = 'BUILDING'")
    o, li = orders(spark, d), lineitem(spark, d)
    gone = o.join(scope.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    steps = [("customer", c, scope, "c_custkey"), ("orders", o, gone, "o_orderkey"), ("lineitem", li, gone.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")]
    parts = []
    for name, rows, keys, key in steps:
        left = keyed.remove(rows, keys, [key])
        both = rows.select(F.lit(1).alias("n"), F.lit(0).alias("kept")).unionByName(left.select(F.lit(0).alias("n"), F.lit(1).alias("kept")))
        parts.append(both.agg(F.coalesce(F.sum("n") - F.sum("kept"), F.lit(0)).alias("deleted"), F.coalesce(F.sum("kept"), F.lit(0)).alias("remaining")).select(F.lit(name).alias("t"), "deleted", "remaining"))
    return reduce(DataFrame.unionByName, parts)


@query("tables_d9_clear", "SELECT 'nation' AS t, count(*) AS deleted, 0 AS remaining FROM nation UNION ALL SELECT 'supplier', count(*), 0 FROM supplier")
def d9(spark, d):
    """Tables written, cleared with their schema kept, and read again."""
    parts = []
    for name in ("nation", "supplier"):
        rows, folder = table(spark, d, name), _scratch(spark)
        keyed.clear(rows).write.parquet(folder)
        left = spark.read.parquet(folder)
        assert left.schema == rows.schema or left.columns == rows.columns
        parts.append(rows.agg(F.count(F.lit(1)).alias("deleted")).join(F.broadcast(left.agg(F.count(F.lit(1)).cast("int").alias("remaining")))).select(F.lit(name).alias("t"), "deleted", "remaining"))
    return reduce(DataFrame.unionByName, parts)


@query("tables_d10_metadata_upsert", "SELECT event_type AS key, max_by(event_id, event_id) AS value FROM events GROUP BY 1")
def d10(spark, d):
    return keyed.newest(events(spark, d).select(F.col("event_type").alias("key"), F.col("event_id").alias("value")), ["key"], ["value"])


@query("tables_u3_ranked_union", "SELECT id, max(s) AS score FROM (SELECT p_partkey AS id, p_size AS s FROM part WHERE p_size > 20 UNION ALL SELECT p_partkey, 30 FROM part WHERE p_partkey % 3 = 0) GROUP BY 1")
def u3(spark, d):
    p = table(spark, d, "part")
    both = p.filter("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("s")).unionByName(p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), F.lit(30).alias("s")))
    return both.groupBy("id").agg(F.max("s").alias("score"))


@query("io_s1_file_scan")
def s1(spark, d):
    """Files of the folder that aren't ignored, by name pattern and size."""
    return files.scan(spark, d, ["*.parquet"], [r"(?:^|/)[._]", r"/embeddings\.parquet"]).select("path", "length")


@query("io_s9_metric_lift", """SELECT user_id, CAST(max_by(CAST(props->>'$.k' AS INTEGER), event_id) AS INTEGER) AS k, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def s9(spark, d):
    lines = events(spark, d).select("user_id", "event_id", "event_type", F.concat(F.lit("_metric:"), "props").alias("line"))
    return files.lift_metrics(lines, ["user_id"], "event_id", "line", "k int", F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"))


def _scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


@query("io_s10_partitioned_json", "SELECT event_type AS model, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY ALL")
def s10(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("model"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "value")
    back = files.partitioned_json(e, _scratch(spark), ["model", "day"])
    return back.groupBy("model", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("io_s11_csv", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND text <> ''")
def s11(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    return files.csv_round_trip(docs, _scratch(spark)).select("doc_id", F.sha2("text", 256).alias("hash"))


@query("io_s12_stats_table", "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1) SELECT '| ' || month || ' | ' || n || ' | ' || coalesce(n - lag(n) OVER (ORDER BY month), 0) || ' |' AS line FROM m")
def s12(spark, d):
    m = orders(spark, d).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    delta = F.coalesce(F.col("n") - F.lag("n").over(Window.orderBy("month")), F.lit(0))
    return m.select(F.concat(F.lit("| "), "month", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), delta.cast("string"), F.lit(" |")).alias("line"))


@query("io_s13_key_range", "SELECT DISTINCT path FROM source_files WHERE starts_with(path, 'src/') AND path > 'src/c' AND path < 'src/p'")
def s13(spark, d):
    return table(spark, d, "source_files").filter(F.startswith("path", F.lit("src/")) & (F.col("path") > "src/c") & (F.col("path") < "src/p")).select("path").distinct()


@query("io_p16_file_roles", r"""SELECT DISTINCT path, CASE WHEN regexp_matches(lower(path), '(?:^|/)(?:generated|__generated__|dist|build)/|\.(?:gen|generated|min)\.[a-z]+$') THEN 'generated' WHEN regexp_matches(lower(path), '(?:^|/)(?:tests?|__tests__|specs?)/|[._-](?:test|spec)\.[a-z0-9]+$') THEN 'test' WHEN regexp_matches(lower(path), '(?:^|/)docs?/|\.(?:md|mdx|rst|adoc|txt)$') THEN 'docs' WHEN regexp_matches(lower(path), '(?:^|/)(?:routes?|api|server)/') THEN 'api_route'
WHEN regexp_matches(lower(path), '\.(?:js|jsx|mjs|cjs|ts|tsx|mts|cts|rs|go|py|java|kt|swift)$') THEN 'source' ELSE 'unknown' END AS role FROM source_files""")
def p16(spark, d):
    return table(spark, d, "source_files").select("path").distinct().select("path", files.file_role(F.col("path")).alias("role"))
