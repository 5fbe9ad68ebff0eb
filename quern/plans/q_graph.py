"""Graph queries over the fixture graph (sources.fixture_graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import graph, keyed
from quern.plans.registry import registry
from quern.sources.fixture_graph import EDGES_SQL, GRAPH_SQL, NODES_SQL, edges, nodes
from quern.sources.tables import events, lineitem, orders, table

QUERIES, ORACLE, query = registry()


def start(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _reach(seed: str, depth: int, step: str, kinds: str = "true") -> str:
    """SQL of a bounded traversal: (id, least depth)."""
    return f"""b AS (SELECT '{seed}' AS id, 0 AS depth UNION SELECT {step.split("=")[1].strip()} AS id, b.depth + 1 FROM b JOIN edges ON {step.split("=")[0].strip()} = b.id WHERE b.depth < {depth} AND {kinds}),
r AS (SELECT id, min(depth) AS depth FROM b GROUP BY id)"""


OUT, IN = "source = target", "target = source"
DEP = "kind IN ('calls', 'references', 'imports')"


@query("graph_g1_bfs_out", f"WITH RECURSIVE {EDGES_SQL}, {_reach('region:0', 3, OUT)} SELECT id, depth FROM r")
def g1(spark, d):
    return graph.bfs(edges(spark, d), start(spark, "region:0"), 3).select("id", "depth")


@query("graph_g1_bfs_tree", f"WITH RECURSIVE {EDGES_SQL}, {_reach('customer:0', 2, OUT)} SELECT r.id, min(e.source) AS parent FROM r JOIN edges e ON e.target = r.id JOIN r p ON p.id = e.source AND p.depth = r.depth - 1 WHERE e.kind <> 'contains' GROUP BY 1")
def g1_tree(spark, d):
    return graph.bfs(edges(spark, d), start(spark, "customer:0"), 2).filter("depth > 0").select("id", "parent")


@query("graph_g2_reachable", f"WITH RECURSIVE {EDGES_SQL}, {_reach('nation:3', 4, OUT)} SELECT id FROM r")
def g2(spark, d):
    return graph.bfs(edges(spark, d), start(spark, "nation:3"), 4).select("id")


@query("graph_g3_callers", f"WITH RECURSIVE {EDGES_SQL}, {_reach('part:0', 2, IN, DEP)} SELECT id, depth FROM r WHERE depth > 0")
def g3(spark, d):
    return graph.callers(edges(spark, d), start(spark, "part:0"), 2).select("id", "depth")


@query("graph_g4_callees", f"WITH RECURSIVE {EDGES_SQL}, {_reach('customer:7', 2, OUT, DEP)} SELECT id, depth FROM r WHERE depth > 0")
def g4(spark, d):
    return graph.callees(edges(spark, d), start(spark, "customer:7"), 2).select("id", "depth")


@query("graph_g5_call_graph", f"""WITH {EDGES_SQL} SELECT 'supplier:1' AS id, 'focal' AS side UNION ALL SELECT DISTINCT source, 'caller' FROM edges WHERE target = 'supplier:1' AND {DEP} UNION ALL SELECT DISTINCT target, 'callee' FROM edges WHERE source = 'supplier:1' AND {DEP}""")
def g5(spark, d):
    return graph.call_graph(edges(spark, d), start(spark, "supplier:1"), 1)


@query("graph_g6_type_hierarchy", f"WITH {EDGES_SQL} SELECT DISTINCT source AS id, 'below' AS side FROM edges WHERE target = 'nation:3' AND kind = 'contains' UNION ALL SELECT DISTINCT target, 'above' FROM edges WHERE source = 'nation:3' AND kind = 'contains'")
def g6(spark, d):
    return graph.type_hierarchy(edges(spark, d), start(spark, "nation:3"), ["contains"])


@query("graph_g7_usages", f"WITH {GRAPH_SQL} SELECT e.source, e.kind, n.name FROM edges e JOIN nodes n ON n.id = e.source WHERE e.target = 'supplier:2'")
def g7(spark, d):
    used = graph.adjacency(edges(spark, d), "in").filter("src = 'supplier:2'")
    return used.join(nodes(spark, d).select(F.col("id").alias("dst"), "name"), "dst").select(F.col("dst").alias("source"), "kind", "name")


@query("graph_g8_impact_radius", f"""WITH RECURSIVE {EDGES_SQL}, a AS (SELECT 'part:0' AS id, 0 AS depth), l1 AS (SELECT DISTINCT source AS id FROM edges WHERE target = 'part:0'), l2 AS (SELECT DISTINCT source AS id FROM edges JOIN l1 ON target = l1.id WHERE source NOT IN (SELECT id FROM l1)),
m2 AS (SELECT DISTINCT target AS id FROM edges JOIN l2 ON source = l2.id AND kind = 'contains' AND l2.id LIKE 'nation:%' WHERE target NOT IN (SELECT id FROM l2) AND target NOT IN (SELECT id FROM l1))
SELECT id, depth FROM a UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 2 FROM m2""")
def g8(spark, d):
    return graph.impact_radius(nodes(spark, d), edges(spark, d), start(spark, "part:0"), 2, ["class"])


@query("graph_g9_ancestors", f"WITH {EDGES_SQL} SELECT c.target AS start, c.source AS id, 1 AS depth FROM edges c WHERE c.target IN ('customer:5', 'supplier:6') AND c.kind = 'contains' UNION ALL SELECT c.target, r.source, 2 FROM edges c JOIN edges r ON r.target = c.source AND r.kind = 'contains' WHERE c.target IN ('customer:5', 'supplier:6') AND c.kind = 'contains'")
def g9(spark, d):
    return graph.ancestors(edges(spark, d), start(spark, "customer:5", "supplier:6"))


@query("graph_g10_children", f"WITH {EDGES_SQL} SELECT target AS id FROM edges WHERE source = 'nation:1' AND kind = 'contains'")
def g10(spark, d):
    return edges(spark, d).filter("source = 'nation:1' AND kind = 'contains'").select(F.col("target").alias("id"))


@query("graph_g11_shortest_path", f"WITH {EDGES_SQL} SELECT 0 AS step, 'customer:0' AS id UNION ALL SELECT 1, min(e.target) FROM edges e JOIN edges f ON e.target = f.source AND f.target = 'part:0' WHERE e.source = 'customer:0' UNION ALL SELECT 2, 'part:0'")
def g11(spark, d):
    return graph.shortest_path(edges(spark, d), "customer:0", "part:0")


@query("graph_g12_context", f"""WITH {EDGES_SQL} SELECT 'nation:4' AS id, (SELECT count(*) FROM edges WHERE target = 'nation:4' AND kind = 'contains') AS parents, (SELECT count(*) FROM edges WHERE source = 'nation:4' AND kind = 'contains') AS children, (SELECT count(*) FROM edges WHERE 'nation:4' IN (source, target) AND kind <> 'contains') AS refs""")
def g12(spark, d):
    both = graph.adjacency(edges(spark, d), "in").filter("src = 'nation:4'").withColumn("side", F.lit("in")).unionByName(graph.adjacency(edges(spark, d), "out").filter("src = 'nation:4'").withColumn("side", F.lit("out")))
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    return both.agg(n("side = 'in' AND kind = 'contains'").alias("parents"), n("side = 'out' AND kind = 'contains'").alias("children"), n("kind <> 'contains'").alias("refs")).withColumn("id", F.lit("nation:4"))


@query("graph_g13_file_dependencies", f"WITH {GRAPH_SQL} SELECT DISTINCT a.file_path AS from_file, b.file_path AS to_file FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path")
def g13(spark, d):
    return graph.file_dependencies(nodes(spark, d), edges(spark, d))


_TRANS = "tr AS (SELECT DISTINCT event_type AS src, nxt AS dst FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL AND nxt <> event_type)"


@query("graph_g14_cycles", f"""WITH RECURSIVE {_TRANS}, p AS (SELECT [src, dst] AS path FROM tr WHERE src < dst UNION ALL SELECT list_append(path, dst) FROM p JOIN tr ON src = path[-1] WHERE dst > path[1] AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS cycle FROM p JOIN tr ON src = path[-1] AND dst = path[1]""")
def g14(spark, d):
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    moves = events(spark, d).select(F.col("event_type").alias("src"), nxt.alias("dst")).filter("dst IS NOT NULL AND dst <> src").distinct()
    return graph.simple_cycles(moves).select(F.array_join("cycle", ">").alias("cycle"))


@query("graph_g15_dead_code", f"WITH {NODES_SQL} used AS (SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem WHERE l_quantity >= 49) SELECT id FROM nodes WHERE kind = 'field' AND k % 2 = 1 AND id NOT IN (SELECT id FROM used)")
def g15(spark, d):
    sold = lineitem(spark, d).filter("l_quantity >= 49").select(F.lit("").alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("references").alias("kind")).distinct()
    return graph.dead_code(nodes(spark, d).withColumn("is_exported", F.col("k") % 2 == 0), sold, ["field"]).select("id")


@query("graph_g16_call_chains", f"WITH {EDGES_SQL} SELECT c.source || '>' || c.target || '>' || r.target AS chain, 3 AS length FROM edges c JOIN edges r ON c.target = r.source AND r.kind = 'references' WHERE c.source IN ('customer:1', 'customer:2') AND c.kind = 'calls' ORDER BY chain LIMIT 20")
def g16(spark, d):
    return graph.call_chains(edges(spark, d), start(spark, "customer:1", "customer:2"), 6, 3, 20)


RELATION = {"calls": ("Calls", "CalledBy"), "imports": ("Imports", "ImportedBy"), "references": ("Uses", "UsedBy"), "contains": ("Contains", "ContainedBy")}


@query("graph_g17_relation_names", f"WITH {EDGES_SQL} SELECT CASE kind WHEN 'calls' THEN 'Calls' WHEN 'references' THEN 'Uses' ELSE 'Contains' END AS outgoing, CASE kind WHEN 'calls' THEN 'CalledBy' WHEN 'references' THEN 'UsedBy' ELSE 'ContainedBy' END AS incoming, count(*) AS n FROM edges GROUP BY ALL")
def g17(spark, d):
    name = lambda i: F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in RELATION.items()])
    return edges(spark, d).groupBy(name(0).alias("outgoing"), name(1).alias("incoming")).agg(F.count(F.lit(1)).alias("n"))


@query("graph_g18_field_relations", f"WITH {GRAPH_SQL} SELECT CASE WHEN e.kind = 'contains' THEN 'ParentOf' WHEN e.kind = 'calls' THEN 'Calls' WHEN e.kind = 'references' AND n.kind IN ('field', 'property') THEN 'Uses' END AS relation, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.target GROUP BY 1")
def g18(spark, d):
    kinds = nodes(spark, d).select(F.col("id").alias("target"), F.col("kind").alias("to_kind"))
    named = F.when(F.col("kind") == "contains", "ParentOf").when(F.col("kind") == "calls", "Calls").when((F.col("kind") == "references") & F.col("to_kind").isin("field", "property"), "Uses")
    return edges(spark, d).join(kinds, "target").groupBy(named.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("graph_g19_outgoing", f"WITH {EDGES_SQL} SELECT target, kind FROM edges WHERE source = 'supplier:3' AND kind IN ('references')")
def g19(spark, d):
    return edges(spark, d).filter("source = 'supplier:3' AND kind IN ('references')").select("target", "kind")


@query("graph_g20_incoming", f"WITH {EDGES_SQL} SELECT source, kind FROM edges WHERE target = 'supplier:3'")
def g20(spark, d):
    return edges(spark, d).filter("target = 'supplier:3'").select("source", "kind")


@query("graph_a1_stats", f"WITH {GRAPH_SQL} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def a1(spark, d):
    count = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes(spark, d), "node").unionByName(count(edges(spark, d), "edge"))


@query("graph_a2_totals", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def a2(spark, d):
    both = nodes(spark, d).select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(edges(spark, d).select(F.lit(0), F.lit(1)))
    return both.agg(F.sum("n").alias("nodes"), F.sum("e").alias("edges"))


@query("graph_a3_dominant_file", f"""WITH {GRAPH_SQL}, c AS (SELECT b.file_path, count(*) AS n FROM edges e JOIN nodes b ON b.id = e.target WHERE e.kind = 'references' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 2) SELECT max(file_path) FILTER (n = m) AS file_path, m AS n, min(n) AS runner_up FROM (SELECT *, max(n) OVER () AS m FROM c) GROUP BY m HAVING m >= 20""")
def a3(spark, d):
    at = nodes(spark, d).select(F.col("id").alias("target"), "file_path")
    counts = edges(spark, d).filter("kind = 'references'").join(at, "target").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return graph.top_group(counts, "file_path", 20, 1.0)


@query("graph_a4_top_share", f"""WITH {GRAPH_SQL}, c AS (SELECT file_path, count(*) AS n FROM nodes WHERE NOT starts_with(file_path, 'tests/') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20), t AS (SELECT *, sum(n) OVER () AS total FROM c) SELECT file_path, n FROM t WHERE n >= 3 AND n * 1.0 / total >= 0.05""")
def a4(spark, d):
    low = F.col("file_path").rlike(r"(?i)(?:^|/)(?:tests?|__tests?__|spec)/")
    top = nodes(spark, d).filter(~low).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(20)
    # Twenty rows at most meet in this window.
    return top.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).filter((F.col("n") >= 3) & (F.col("n") / F.col("total") >= 0.05)).select("file_path", "n")


@query("graph_a5_mode_after_limit", f"""WITH {GRAPH_SQL}, l AS (SELECT e.source, b.file_path FROM edges e JOIN nodes b ON b.id = e.target WHERE e.kind = 'contains' ORDER BY e.source, e.target LIMIT 500) SELECT file_path, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1""")
def a5(spark, d):
    at = nodes(spark, d).select(F.col("id").alias("target"), "file_path")
    limited = edges(spark, d).filter("kind = 'contains'").join(at, "target").orderBy("source", "target").limit(500)
    return limited.groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file_path").limit(1)


@query("graph_a17_module_structure", f"WITH {GRAPH_SQL} SELECT regexp_extract(file_path, '^(.*)/', 1) AS dir, string_agg(DISTINCT file_path, ',' ORDER BY file_path) AS files FROM nodes GROUP BY 1")
def a17(spark, d):
    return nodes(spark, d).select(F.regexp_extract("file_path", "^(.*)/", 1).alias("dir"), "file_path").distinct().groupBy("dir").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ",").alias("files"))


@query("graph_a18_metrics", f"WITH {GRAPH_SQL}, o AS (SELECT source AS id, count(*) AS n_out, count(*) FILTER (kind = 'calls') AS calls, count(*) FILTER (kind = 'contains') AS children FROM edges GROUP BY 1), i AS (SELECT target AS id, count(*) AS n_in, count(*) FILTER (kind = 'calls') AS callers FROM edges GROUP BY 1) SELECT id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(calls, 0) AS calls, coalesce(callers, 0) AS callers, coalesce(children, 0) AS children FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)")
def a18(spark, d):
    return graph.node_metrics(nodes(spark, d), edges(spark, d))


@query("graph_a21_symbol_counts", f"WITH {GRAPH_SQL} SELECT file_path, count(DISTINCT lower(name)) AS symbols FROM nodes GROUP BY 1")
def a21(spark, d):
    return nodes(spark, d).select("file_path", F.lower("name").alias("n")).distinct().groupBy("file_path").agg(F.count(F.lit(1)).alias("symbols"))


@query("graph_p7_filtered_subgraph", f"WITH {GRAPH_SQL}, f AS (SELECT id FROM nodes WHERE kind IN ('function', 'field') AND k % 3 = 0) SELECT source, target FROM edges WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f)")
def p7(spark, d):
    return graph.induced(edges(spark, d), nodes(spark, d).filter("kind IN ('function', 'field') AND k % 3 = 0")).select("source", "target")


@query("graph_p8_induced_edges", f"WITH {EDGES_SQL}, f AS (SELECT id FROM (VALUES ('nation:1'), ('customer:1'), ('supplier:1'), ('supplier:20'), ('part:1'), ('region:1')) v(id)) SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM f) AND target IN (SELECT id FROM f) AND kind IN ('contains', 'calls')")
def p8(spark, d):
    return graph.induced(edges(spark, d), start(spark, "nation:1", "customer:1", "supplier:1", "supplier:20", "part:1", "region:1"), ["contains", "calls"]).select("source", "target", "kind")


@query("graph_p9_range_intersection", "WITH p AS (SELECT l_suppkey AS f, l_orderkey, l_linenumber, epoch(l_shipdate) // 86400 AS a, epoch(l_shipdate) // 86400 + CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE l_suppkey = 1) SELECT l_orderkey, l_linenumber, b - a AS span FROM p WHERE a <= 10000 AND b >= 9900 ORDER BY ALL")
def p9(spark, d):
    a = F.floor(F.unix_seconds("l_shipdate") / 86400)
    rows = lineitem(spark, d).filter("l_suppkey = 1").select("l_orderkey", "l_linenumber", a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b"))
    return rows.filter("a <= 10000 AND b >= 9900").select("l_orderkey", "l_linenumber", (F.col("b") - F.col("a")).alias("span"))


@query("graph_p19_file_nodes", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE file_path = 'parts/Brand#2.ts' ORDER BY k % 1000, id")
def p19(spark, d):
    return nodes(spark, d).filter("file_path = 'parts/Brand#2.ts'").orderBy(F.col("k") % 1000, "id").select("id")


@query("graph_p20_by_kind", f"WITH {GRAPH_SQL} SELECT id, qualified_name FROM nodes WHERE kind = 'class'")
def p20(spark, d):
    return nodes(spark, d).filter("kind = 'class'").select("id", "qualified_name")


@query("graph_p21_exported", f"WITH {GRAPH_SQL} SELECT id FROM nodes WHERE file_path = 'parts/Brand#4.ts' AND k % 2 = 0")
def p21(spark, d):
    return nodes(spark, d).filter("file_path = 'parts/Brand#4.ts' AND k % 2 = 0").select("id")


@query("graph_p22_distinct_names", f"WITH {GRAPH_SQL} SELECT DISTINCT name FROM nodes")
def p22(spark, d):
    return nodes(spark, d).select("name").distinct()


@query("graph_p23_refs_of_files", f"WITH {GRAPH_SQL} SELECT e.source, e.target FROM edges e JOIN nodes n ON n.id = e.source WHERE n.file_path IN ('AFRICA/NATION_0.ts', 'ASIA/NATION_2.ts') AND e.kind = 'calls'")
def p23(spark, d):
    inside = nodes(spark, d).filter(F.col("file_path").isin("AFRICA/NATION_0.ts", "ASIA/NATION_2.ts")).select(F.col("id").alias("source"))
    return edges(spark, d).filter("kind = 'calls'").join(inside, "source", "left_semi").select("source", "target")


@query("graph_j1_same_file_edges", f"WITH {GRAPH_SQL} SELECT a.file_path, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.file_path = b.file_path GROUP BY 1")
def j1(spark, d):
    at = nodes(spark, d).select("id", "file_path")
    both = edges(spark, d).join(at.select(F.col("id").alias("source"), F.col("file_path").alias("f")), "source").join(at.select(F.col("id").alias("target"), "file_path"), "target")
    return both.filter("f = file_path").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query("graph_j2_route_manifest", f"WITH {GRAPH_SQL} SELECT r.name AS route, h.name AS handler FROM nodes r JOIN edges e ON e.source = r.id AND e.kind IN ('contains') JOIN nodes h ON h.id = e.target WHERE r.kind = 'class' AND h.kind = 'function'")
def j2(spark, d):
    n = nodes(spark, d)
    r = n.filter("kind = 'class'").select(F.col("id").alias("source"), F.col("name").alias("route"))
    h = n.filter("kind = 'function'").select(F.col("id").alias("target"), F.col("name").alias("handler"))
    return edges(spark, d).filter("kind = 'contains'").join(r, "source").join(h, "target").select("route", "handler")


@query("graph_j9_point_lookup", f"WITH {GRAPH_SQL} SELECT id, name FROM nodes WHERE id IN ('part:1', 'part:2', 'gone:1')")
def j9(spark, d):
    return nodes(spark, d).join(start(spark, "part:1", "part:2", "gone:1"), "id").select("id", "name")


@query("graph_j10_endpoint_check", f"WITH {GRAPH_SQL}, k AS (SELECT id FROM nodes WHERE k % 7 <> 0) SELECT source, target FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) AND kind = 'contains'")
def j10(spark, d):
    return graph.induced(edges(spark, d).filter("kind = 'contains'"), nodes(spark, d).filter("k % 7 <> 0")).select("source", "target")


@query("graph_j11_name_prefilter", f"WITH {GRAPH_SQL}, names AS (SELECT DISTINCT name FROM nodes), refs AS (SELECT p_name || '.call' AS ref FROM part UNION SELECT 'zz' || s_name FROM supplier) SELECT ref FROM refs WHERE split_part(ref, '.', 1) IN (SELECT name FROM names) OR ref IN (SELECT name FROM names)")
def j11(spark, d):
    refs = table(spark, d, "part").select(F.concat("p_name", F.lit(".call")).alias("ref")).unionByName(table(spark, d, "supplier").select(F.concat(F.lit("zz"), "s_name").alias("ref"))).distinct()
    candidates = refs.withColumn("name", F.explode(F.array_distinct(F.array(F.substring_index("ref", ".", 1), F.col("ref")))))
    return candidates.join(nodes(spark, d).select("name"), "name", "left_semi").select("ref").distinct()


_HALF = "SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE {} GROUP BY ALL"


@query("graph_j14_relation_delta", f"WITH b AS ({_HALF.format('year(l_shipdate) < 1998')}), a AS ({_HALF.format('year(l_shipdate) >= 1998')}) SELECT l_partkey, l_suppkey, 'added' AS delta FROM a ANTI JOIN b USING (l_partkey, l_suppkey) UNION ALL SELECT l_partkey, l_suppkey, 'removed' FROM b ANTI JOIN a USING (l_partkey, l_suppkey)")
def j14(spark, d):
    li = lineitem(spark, d).select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("y"))
    return keyed.relation_delta(li.filter("y < 1998"), li.filter("y >= 1998"), ["l_partkey", "l_suppkey"])


#: Fixed value: callbacks that are taken of one channel, at most.
CHANNEL_CAP = 40


@query("graph_j16_registrar_dispatcher", f"WITH p AS (SELECT s_suppkey, c_custkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, c_custkey) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_suppkey <> c_custkey) SELECT s_suppkey, c_custkey FROM p WHERE n <= {CHANNEL_CAP}")
def j16(spark, d):
    # Of the pairs in order the first ones lie within as many rows, and one for the excluded pair, of either side, so no group's pairs are all built.
    first = lambda df, group, key: df.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(key))).filter(F.col("n") <= CHANNEL_CAP + 1).select(group, key)
    pairs = first(table(spark, d, "supplier"), "s_nationkey", "s_suppkey").join(first(table(spark, d, "customer"), "c_nationkey", "c_custkey"), F.col("s_nationkey") == F.col("c_nationkey")).filter("s_suppkey <> c_custkey")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey", "c_custkey"))
    return pairs.withColumn("n", place).filter(F.col("n") <= CHANNEL_CAP).select("s_suppkey", "c_custkey")


@query("graph_j17_override_join", f"""WITH m AS (SELECT p_partkey, p_name, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS c FROM part), b AS (SELECT c, p_name, max(p_partkey) AS base FROM m GROUP BY ALL),
r AS (SELECT s.p_partkey AS sub, base, row_number() OVER (PARTITION BY s.c ORDER BY s.p_partkey) AS n FROM m s JOIN b ON b.c = s.c + 1 AND b.p_name = s.p_name) SELECT sub, base FROM r WHERE n <= {CHANNEL_CAP}""")
def j17(spark, d):
    """Methods (parts) that override one of the same name in the base class (the next brand); of equal names in a class the last counts."""
    m = table(spark, d, "part").select("p_partkey", "p_name", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("c"))
    base = m.groupBy((F.col("c") - 1).alias("c"), "p_name").agg(F.max("p_partkey").alias("base"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("sub"))
    return m.withColumnRenamed("p_partkey", "sub").join(base, ["c", "p_name"]).withColumn("n", place).filter(F.col("n") <= CHANNEL_CAP).select("sub", "base")


@query("graph_j19_tightest_enclosing", """WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS sid, l_suppkey AS key, epoch(l_shipdate) // 86400 AS a, epoch(l_shipdate) // 86400 + CAST(l_quantity AS BIGINT) AS b FROM lineitem), p AS (SELECT o_orderkey AS pid, o_custkey % 100 AS key, epoch(o_orderdate) // 86400 AS pt FROM orders)
SELECT pid, max(a) AS start FROM p JOIN s ON s.key = p.key AND a <= pt AND pt <= b GROUP BY pid""")
def j19(spark, d):
    day = lambda c: F.floor(F.unix_seconds(c) / 86400)
    spans = lineitem(spark, d).select(F.col("l_suppkey").alias("key"), day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("stop"), day("l_shipdate").alias("sid"))
    points = orders(spark, d).select(F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % 100).alias("key"), day("o_orderdate").alias("at"))
    return graph.enclosing(spans, points, "key", 32).select("pid", F.col("sid").alias("start"))


def order_spans(spark, d):
    day = F.floor(F.unix_seconds("o_orderdate") / 86400)
    return orders(spark, d).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("key"), day.alias("start"), (day + 7).alias("stop"))


def line_spans(spark, d):
    day = F.floor(F.unix_seconds("l_shipdate") / 86400)
    return lineitem(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("key"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("stop")).distinct()


@query("graph_j20_overlap", """WITH l AS (SELECT o_orderkey AS id, o_custkey % 100 AS key, epoch(o_orderdate) // 86400 AS a, epoch(o_orderdate) // 86400 + 7 AS b FROM orders), r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS key, epoch(l_shipdate) // 86400 AS a, epoch(l_shipdate) // 86400 + CAST(l_quantity AS BIGINT) AS b FROM lineitem)
SELECT l.id AS lid, r.id AS rid FROM l JOIN r ON l.key = r.key AND l.a <= r.b AND r.a <= l.b""")
def j20(spark, d):
    return graph.overlapping(order_spans(spark, d), line_spans(spark, d), "key", 32)


@query("graph_j23_parents", "SELECT DISTINCT n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def j23(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi").select("n_nationkey")


@query("graph_j21_right_then_left", "SELECT n_name, c_custkey, s_suppkey FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 WHERE c_acctbal > 9500")
def j21(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 9000")
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").filter("c_acctbal > 9500").select("n_name", "c_custkey", "s_suppkey")


@query("graph_j26_disabled_anti", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def j26(spark, d):
    off = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(off, "s_nationkey", "left_anti").select("s_suppkey")


@query("graph_w7_per_file_cap", f"""WITH {GRAPH_SQL}, r AS (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 ELSE 2 END, id) AS n, count(*) OVER (PARTITION BY file_path) AS c FROM nodes) SELECT id FROM r WHERE n <= greatest(5, CAST(floor(c * 0.2) AS BIGINT))""")
def w7(spark, d):
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy(F.when(F.col("kind") == "class", 0).when(F.col("kind") == "function", 1).otherwise(2), "id"))
    size = F.count(F.lit(1)).over(Window.partitionBy("file_path"))
    return nodes(spark, d).withColumn("n", rank).withColumn("c", size).filter(F.col("n") <= F.greatest(F.lit(5), F.floor(F.col("c") * F.lit(0.2).cast("decimal(2,1)")))).select("id")


@query("graph_w8_flag_cap", f"WITH {GRAPH_SQL}, r AS (SELECT id, row_number() OVER (PARTITION BY starts_with(file_path, 'tests/') ORDER BY id) AS n, starts_with(file_path, 'tests/') AS low FROM nodes WHERE kind = 'function') SELECT id FROM r WHERE NOT low OR n <= 15")
def w8(spark, d):
    low = F.col("file_path").startswith("tests/")
    n = F.row_number().over(Window.partitionBy("low").orderBy("id"))
    return nodes(spark, d).filter("kind = 'function'").withColumn("low", low).withColumn("n", n).filter("NOT low OR n <= 15").select("id")


@query("graph_u11_edge_dedupe", f"WITH {EDGES_SQL} SELECT DISTINCT source, target, kind FROM edges WHERE kind = 'calls'")
def u11(spark, d):
    e = edges(spark, d).filter("kind = 'calls'")
    return e.unionByName(e).dropDuplicates(["source", "target", "kind"])


@query("graph_b1_blast_radius", f"WITH {GRAPH_SQL} SELECT e.target AS symbol, count(DISTINCT n.id) AS dependents, count(DISTINCT n.file_path) FILTER (n.k % 5 = 0) AS test_files FROM edges e JOIN nodes n ON n.id = e.source WHERE e.kind <> 'contains' AND e.target LIKE 'supplier:%' GROUP BY 1")
def b1(spark, d):
    users = nodes(spark, d).select(F.col("id").alias("source"), "file_path", (F.col("k") % 5 == 0).alias("test"))
    dep = edges(spark, d).filter("kind <> 'contains' AND target LIKE 'supplier:%'").join(users, "source")
    return dep.groupBy(F.col("target").alias("symbol")).agg(F.countDistinct("source").alias("dependents"), F.countDistinct(F.when(F.col("test"), F.col("file_path"))).alias("test_files"))


@query("graph_e35_smallest_touched", "WITH n AS (SELECT c_custkey AS id, c_nationkey AS f, c_custkey % 1000 AS a, c_custkey % 1000 + c_custkey % 37 AS b FROM customer), t AS (SELECT * FROM n WHERE a <= 520 AND b >= 500) SELECT id FROM t x WHERE NOT EXISTS (SELECT 1 FROM t y WHERE y.f = x.f AND y.id <> x.id AND y.a >= x.a AND y.b <= x.b AND (y.b - y.a) < (x.b - x.a))")
def e35(spark, d):
    a = F.col("c_custkey") % 1000
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("f"), a.alias("a"), (a + F.col("c_custkey") % 37).alias("b")).filter("a <= 520 AND b >= 500")
    inner = n.select("f", F.col("id").alias("i"), F.col("a").alias("ia"), F.col("b").alias("ib"))
    return n.join(inner, (n.f == inner.f) & (F.col("i") != F.col("id")) & (F.col("ia") >= F.col("a")) & (F.col("ib") <= F.col("b")) & (F.col("ib") - F.col("ia") < F.col("b") - F.col("a")), "left_anti").select("id")
