"""Star joins, extraction, retrieval steps and re-export chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import keyed, resolve, search
from quern.plans.checkpoints import cut
from quern.plans.registry import registry
from quern.sources import extract
from quern.sources.fixture_graph import GRAPH_SQL, NODES_SQL, edges, nodes
from quern.sources.tables import lineitem, orders, table

QUERIES, ORACLE, query = registry()
_N = NODES_SQL.rstrip().rstrip(",")


@query("join_j5_star_lookup", """SELECT o_orderkey, c_name, n.n_name, r_name, s_suppkey, p_partkey, x.n_name AS never FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation n ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN supplier ON s_suppkey = o_orderkey % 200 AND s_acctbal > 0 LEFT JOIN part ON p_partkey = o_orderkey AND p_size > 25 LEFT JOIN nation x ON false WHERE o_orderstatus = 'P'""")
def j5(spark, d):
    o = orders(spark, d).filter("o_orderstatus = 'P'").select("o_orderkey", "o_custkey")
    star = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    p = table(spark, d, "part").filter("p_size > 25").select("p_partkey")
    wide = star.join(s, F.col("s_suppkey") == F.col("o_orderkey") % 200, "left").join(p, F.col("p_partkey") == F.col("o_orderkey"), "left")
    return wide.select("o_orderkey", "c_name", "n_name", "r_name", "s_suppkey", "p_partkey", F.lit(None).cast("string").alias("never"))


@query("join_j6_composite_key", "SELECT DISTINCT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey AND p_size = CAST(l_quantity AS INTEGER) WHERE o_orderstatus IN ('O', 'P')")
def j6(spark, d):
    o, p = orders(spark, d).filter("o_orderstatus IN ('O', 'P')").select("o_orderkey"), table(spark, d, "part").select("p_partkey", "p_size")
    li = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    return li.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("q") == F.col("p_size"))).join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber").distinct()


@query("join_j8_sampled_ids", "SELECT DISTINCT c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 3)")
def j8(spark, d):
    ids = table(spark, d, "customer").filter("c_custkey % 50 = 3").select(F.col("c_custkey").alias("id"))
    c = table(spark, d, "customer").join(ids, F.col("c_custkey") == F.col("id"), "left_semi")
    return c.join(orders(spark, d).select("o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_name").distinct()


@query("join_j22_constant_key", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = 7 LEFT JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey = 7")
def j22(spark, d):
    """The inner join on a constant is an equi-join on it, so no product is built."""
    n = table(spark, d, "nation").filter("n_nationkey = 7")
    s = table(spark, d, "supplier").filter("s_nationkey = 7")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("join_j24_masked_listing", "SELECT c_custkey, substr(c_name, 1, 3) || '...' || right(c_name, 4) AS masked FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR c_acctbal > 9000")
def j24(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.filter("r_name = 'ASIA' OR c_acctbal > 9000").select("c_custkey", F.concat(F.substring("c_name", 1, 3), F.lit("..."), F.expr("right(c_name, 4)")).alias("masked"))


@query("join_j25_left_identity", "SELECT c_custkey, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def j25(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left").select("c_custkey", "s_name")


@query("join_j29_latest_of", "SELECT n_name, max_by(c_name, (o_orderdate, o_orderkey)) AS latest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j29(spark, d):
    last = orders(spark, d).groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("o"))
    c = last.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.max_by("c_name", "o").alias("latest"))


@query("io_s4_symbols", extract.symbols_sql())
def s4(spark, d):
    return extract.symbols(table(spark, d, "source_files"))


@query("resolve_e34_hunks", "SELECT doc_id AS doc, 1 AS old_start, CAST(doc_id AS INTEGER) AS old_lines, 2 AS new_start, 1 AS new_lines FROM documents UNION ALL SELECT doc_id, 9, 1, 7, 3 FROM documents")
def e34(spark, d):
    """Hunk ranges of diffs made of the documents' ids."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("--- a\n+++ b\n@@ -1,"), F.col("doc_id").cast("string"), F.lit(" +2 @@ x\n-a\n+b\n@@ -9 +7,3 @@\n")).alias("patch"))
    return extract.hunks(docs)


@query("resolve_e7_proximity", "WITH f AS (SELECT DISTINCT path FROM source_files), r AS (SELECT min(path) AS p FROM f) SELECT path, CAST(least(15 * CASE WHEN split_part(path, '/', 1) <> split_part(p, '/', 1) OR NOT contains(path, '/') THEN 0 WHEN len(string_split(path, '/')) < 3 OR split_part(path, '/', 2) <> split_part(p, '/', 2) OR len(string_split(p, '/')) < 3 THEN 1 WHEN len(string_split(path, '/')) < 4 OR len(string_split(p, '/')) < 4 OR split_part(path, '/', 3) <> split_part(p, '/', 3) THEN 2 ELSE 3 END, 80) AS INTEGER) AS points FROM f, r")
def e7(spark, d):
    f = table(spark, d, "source_files").select("path").distinct()
    first = f.agg(F.min("path").alias("p"))
    a, b = resolve.directories(F.col("path")), resolve.directories(F.col("p"))
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    return f.join(F.broadcast(first)).select("path", resolve.proximity(run["n"]).alias("points"))


@query("resolve_e33_reexport_chain", "WITH RECURSIVE r AS (SELECT o_custkey AS a, o_custkey // 2 AS b FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1), c AS (SELECT a AS start, b AS place, 1 AS hops FROM r UNION ALL SELECT c.start, r.b, hops + 1 FROM c JOIN r ON r.a = c.place) SELECT start, arg_max(place, hops) AS definition, max(hops) AS hops FROM c GROUP BY 1")
def e33(spark, d):
    """Follow re-exports to the definition; pointers double, so a chain takes logarithmically many rounds and a circle ends."""
    hops = cut(orders(spark, d).filter("o_custkey % 3 <> 0").select(F.col("o_custkey").alias("a"), F.expr("o_custkey div 2").alias("b")).distinct())
    one = hops.groupBy("a").agg(F.min("b").alias("b"))  # a module re-exports a name from one place
    chain = cut(one.select(F.col("a").alias("start"), F.col("b").alias("at"), F.lit(1).alias("hops")))
    ends = -1
    while True:
        ahead = chain.select(F.col("start").alias("at"), F.col("at").alias("far"), F.col("hops").alias("more"))
        chain = cut(chain.join(ahead, "at", "left").select("start", F.coalesce("far", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
        open_ = chain.join(one.select(F.col("a").alias("at")), "at", "left_semi").count()
        if open_ in (0, ends):  # those that stay open go round in a circle
            break
        ends = open_
    return chain.join(one.select(F.col("a").alias("at")), "at", "left_anti").select("start", F.col("at").alias("definition"), "hops")


@query("search_x17_imports_to_definitions", f"WITH {GRAPH_SQL}, hits AS (SELECT id, kind, CAST(k % 7 AS INTEGER) AS score FROM nodes WHERE kind IN ('class', 'function')) SELECT id, max(score) AS score FROM (SELECT id, score FROM hits WHERE kind <> 'class' UNION ALL SELECT e.target, h.score FROM hits h JOIN edges e ON e.source = h.id AND e.kind = 'contains' WHERE h.kind = 'class') GROUP BY 1")
def x17(spark, d):
    hits = nodes(spark, d).filter("kind IN ('class', 'function')").select("id", "kind", (F.col("k") % 7).cast("int").alias("score"))
    followed = hits.filter("kind = 'class'").join(edges(spark, d).filter("kind = 'contains'").select(F.col("source").alias("id"), "target"), "id").select(F.col("target").alias("id"), "score")
    return hits.filter("kind <> 'class'").select("id", "score").unionByName(followed).groupBy("id").agg(F.max("score").alias("score"))


@query("search_a27_term_hits", f"WITH {_N}, t AS (SELECT * FROM (VALUES ('red', 3), ('widget', 2), ('ring', 1)) v(term, s)), h AS (SELECT id, count(*) AS hits, max(s) AS top FROM nodes JOIN t ON contains(lower(name), term) GROUP BY 1) SELECT id, hits, CAST(top + 5 * (hits - 1) AS BIGINT) AS score FROM h")
def a27(spark, d):
    terms = {"red": 3, "widget": 2, "ring": 1}
    met = F.array_compact(F.array(*[F.when(F.contains(F.lower("name"), F.lit(t)), F.lit(s)) for t, s in terms.items()]))
    n = nodes(spark, d).select("id", met.alias("m")).filter(F.size("m") > 0)
    return n.select("id", F.size("m").cast("long").alias("hits"), (F.array_max("m") + 5 * (F.size("m") - 1)).cast("long").alias("score"))


@query("search_x20_fuzzy_paths")
def x20(spark, d):
    """Paths that hold the letters of the query in order, closest first; the ranking is our own."""
    q = "srclease"
    f = table(spark, d, "source_files").select("path").distinct()
    return f.filter(F.lower("path").rlike(".*".join(q))).select("path", F.levenshtein(F.lower("path"), F.lit(q)).alias("distance")).orderBy("distance", "path").limit(50)


@query("search_x16_hybrid_retrieval")
def x16(spark, d):
    """Exact names, words and substrings of a question united, test files and single hits dampened, best of each file kept."""
    n = search.with_search_text(nodes(spark, d))
    question = "where is NATION_3 and the red widget"
    words = [w for w in search._plain_terms(question)]
    parts = [search.exact_names(n, ["NATION_3", "red widget"], 40).withColumn("score", F.col("score") * 2), search.bm25(n, "red widget NATION_3", 40)] + [search.by_substring(n, w, 40).withColumn("score", F.lit(1.0)) for w in words]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p.select("id", "score"))
    scored = united.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("hits")).join(n, "id")
    boosted = F.col("score") * F.when(F.col("hits") > 1, 1 + 0.5 * (F.col("hits") - 1)).otherwise(0.6) * F.when(T.is_test_file(F.col("file_path")), 0.3).otherwise(1.0)
    ranked = scored.select("id", "file_path", F.round(boosted, 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    return ranked.withColumn("place", place).filter("place <= 5").orderBy(F.desc("score"), "id").limit(30).select("id", "score")


@query("text_f7_extraction_validation", r"""SELECT session_id, item->>'$.kind' AS kind, count(*) AS kept FROM (SELECT m.session_id, CASE WHEN json_type(x.item) = 'VARCHAR' AND json_valid(x.item->>'$') THEN CAST(x.item->>'$' AS JSON) ELSE x.item END AS item FROM (SELECT DISTINCT session_id, payload FROM memory_stage1_output WHERE json_valid(payload) AND json_type(payload->'$.items') = 'ARRAY') m, unnest(CAST(m.payload->'$.items' AS JSON[])) AS x(item))
WHERE json_type(item) = 'OBJECT' AND trim(coalesce(item->>'$.text', '')) <> '' GROUP BY ALL""")
def f7(spark, d):
    """Items of extractions whose cleaned, redacted text is neither empty nor still a secret."""
    rows = table(spark, d, "memory_stage1_output").select("session_id", "payload").distinct().filter(F.try_parse_json("payload").isNotNull())
    body = F.get_json_object("payload", "$.items")
    items = F.explode(F.from_json(F.when(F.startswith(body, F.lit("[")) & F.get_json_object("payload", "$.items[0]").isNotNull(), body), "array<string>"))
    item = rows.filter(F.col("payload").rlike(r'"items"\s*:\s*\[')).select("session_id", items.alias("i")).filter(F.startswith("i", F.lit("{")))
    cleaned = T.clean_text(T.redact_secrets(F.get_json_object("i", "$.text")), 2000)
    return item.select("session_id", F.get_json_object("i", "$.kind").alias("kind"), cleaned.alias("t")).filter((F.col("t") != "") & ~T.contains_secret(F.col("t"))).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("kept"))


@query("usage_f15_anchored_month", """WITH a AS (SELECT user_id, min(ts) AS anchor, max(ts) AS now FROM events GROUP BY 1), b AS (SELECT user_id, now, anchor, make_date(year(now), month(now), 1) AS m FROM a),
s AS (SELECT user_id, now, anchor, m, m + to_days(CAST(least(day(anchor), day(last_day(m))) - 1 AS INTEGER)) AS this, date_add(m, INTERVAL '-1' MONTH) AS pm FROM b)
SELECT user_id, strftime(CASE WHEN this <= now THEN this ELSE pm + to_days(CAST(least(day(anchor), day(last_day(CAST(pm AS DATE)))) - 1 AS INTEGER)) END, '%Y-%m-%d') AS start FROM s""")
def f15(spark, d):
    """The begin of the month, counted from the day of a user's first use, that holds the last use; days are clamped to month ends."""
    from quern.sources.tables import events

    a = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("anchor"), F.max("ts").alias("now"))
    clamp = lambda first: F.make_date(F.year(first), F.month(first), F.least(F.day("anchor"), F.day(F.last_day(first))))
    this = F.trunc("now", "month")
    start = F.when(clamp(this) <= F.col("now"), clamp(this)).otherwise(clamp(F.add_months(this, -1)))
    return a.select("user_id", F.date_format(start, "yyyy-MM-dd").alias("start"))


_LIVE = "time_archived IS NULL AND id IS NOT NULL"


@query("join_j27_live_rows", f"SELECT DISTINCT s.project_id, s.id, m.id AS message_id FROM agent_session s JOIN agent_message m ON m.session_id = s.id WHERE s.{_LIVE.replace('AND id', 'AND s.id')}")
def j27(spark, d):
    """Rows that aren't archived with the rows that hang on them."""
    s = table(spark, d, "agent_session").filter(_LIVE).select("project_id", "id").distinct()
    return s.join(table(spark, d, "agent_message").select(F.col("session_id").alias("id"), F.col("id").alias("message_id")), "id").select("project_id", "id", "message_id").distinct()


@query("join_j28_live_rows_second_table", "SELECT DISTINCT s.project_id, o.session_id, o.rollout_slug FROM agent_session s JOIN memory_stage1_output o ON o.session_id = s.id WHERE s.time_archived IS NULL AND o.source_deleted_at IS NULL")
def j28(spark, d):
    o = table(spark, d, "memory_stage1_output").filter("source_deleted_at IS NULL").select(F.col("session_id").alias("id"), "rollout_slug")
    s = table(spark, d, "agent_session").filter("time_archived IS NULL").select("project_id", "id")
    return s.join(o, "id").select("project_id", F.col("id").alias("session_id"), "rollout_slug").distinct()


@query("join_j30_groups_of_a_member", "SELECT DISTINCT c_name, s_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'P'")
def j30(spark, d):
    o = orders(spark, d).filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = lineitem(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    keys = o.join(li, "o_orderkey").select("c_custkey", "s_suppkey").distinct()
    return keys.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("c_name", "s_name").distinct()


@query("join_j31_member_group_plan", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_acctbal > 0")
def j31(spark, d):
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, d, "customer").filter("c_acctbal > 0").join(place, "c_nationkey").select("c_custkey", "n_name", "r_name")


@query("join_j32_group_of_member", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal >= 0")
def j32(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal >= 0").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return table(spark, d, "nation").join(s, "n_nationkey").select("n_name", "s_suppkey")


@query("join_j33_left_identity", "SELECT s_suppkey, c_name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_mktsegment = 'MACHINERY'")
def j33(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("s_suppkey"), "c_name")
    return table(spark, d, "supplier").join(c, "s_suppkey", "left").select("s_suppkey", "c_name")


@query("join_j34_exists", "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS found FROM nation")
def j34(spark, d):
    hit = table(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "nation").join(hit, "n_nationkey", "left").select("n_nationkey", F.coalesce("hit", F.lit(False)).alias("found"))


@query("join_j35_invitee", "SELECT c_custkey, s_suppkey, n_name FROM customer JOIN supplier ON s_suppkey = c_custkey JOIN nation ON n_nationkey = 3 WHERE c_nationkey = 3")
def j35(spark, d):
    """The join on a constant is an equi-join on that constant's column, of one row."""
    c = table(spark, d, "customer").filter("c_nationkey = 3").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_suppkey"), "c_custkey")
    return c.join(table(spark, d, "nation").filter("n_nationkey = 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "s_suppkey", "n_name")


@query("search_u4_merged_filters", f"WITH {_N} SELECT id FROM nodes WHERE kind IN ('class', 'field', 'function')")
def u4(spark, d):
    """Kinds written in the query beside those of the options."""
    asked = search.parse_query("kind:function kind:class", {"function", "class", "field"}, set())
    return nodes(spark, d).filter(F.col("kind").isin(*search.merged_filter(asked.kinds, ["field", "function"]))).select("id")


_WORDS = "SELECT item_id, list_distinct(regexp_extract_all(lower(item_text), '[a-z]{3,}')) AS ws FROM eval_item WHERE item_text IS NOT NULL"


@query("search_x18_term_groups", f"""WITH RECURSIVE t AS (SELECT item_id, list_transform(list_sort(list_transform(ws, lambda w: (-length(w), w))), lambda x: x[2]) AS rest FROM ({_WORDS})),
g AS (SELECT item_id, rest, CAST([] AS VARCHAR[]) AS grp, 0 AS no FROM t
  UNION ALL SELECT item_id, list_filter(rest, lambda x: NOT (contains(rest[1], x) OR contains(x, rest[1]))), list_filter(rest, lambda x: contains(rest[1], x) OR contains(x, rest[1])), no + 1 FROM g WHERE len(rest) > 0)
SELECT item_id, no, array_to_string(grp, ' ') AS terms FROM g WHERE no > 0""")
def x18(spark, d):
    words = F.regexp_extract_all(F.lower("item_text"), F.lit("[a-z]{3,}"), F.lit(0))
    items = table(spark, d, "eval_item").filter("item_text IS NOT NULL")
    return items.select("item_id", F.posexplode(search.term_groups(words)).alias("no", "g")).select("item_id", (F.col("no") + 1).alias("no"), F.array_join("g", " ").alias("terms"))


@query("resolve_e15_patch_signals", r"""WITH p AS (SELECT DISTINCT project_id, path, CASE WHEN size % 2 = 0 THEN '+' ELSE '-' END AS mark, content FROM source_files WHERE content IS NOT NULL AND size IS NOT NULL), q AS (SELECT project_id, path, mark || replace(content, chr(10), chr(10) || mark) AS patch FROM p)
SELECT project_id, path, kind, change FROM q, (VALUES ('import_statement', 'added', '(?m)^\+\s*(?:import(?:\s|["''{*])|from\s+.+\s+import\s)'), ('import_statement', 'removed', '(?m)^-\s*(?:import(?:\s|["''{*])|from\s+.+\s+import\s)'), ('export_boundary', 'added', '(?m)^\+export(?:\s|\{|\*)'), ('export_boundary', 'removed', '(?m)^-export(?:\s|\{|\*)')) s(kind, change, p) WHERE regexp_matches(patch, s.p)""")
def e15(spark, d):
    """Files as patches that add or remove all of their lines."""
    mark = F.when(F.col("size") % 2 == 0, "+").otherwise("-")
    files = table(spark, d, "source_files").filter("content IS NOT NULL AND size IS NOT NULL").select("project_id", "path", mark.alias("mark"), "content").distinct()
    patch = F.concat("mark", F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), "mark")))
    return files.select("project_id", "path", F.explode(search.patch_signals(patch)).alias("s")).select("project_id", "path", "s.kind", "s.change")


@query("tables_r4_claim_owner", "WITH s AS (SELECT aggregate_id, max(seq) AS seq FROM sync_event WHERE aggregate_id IS NOT NULL GROUP BY 1), c AS (SELECT aggregate_id, max(split_part(type, '.', 1)) AS o FROM sync_event WHERE seq % 2 = 0 GROUP BY 1) SELECT s.aggregate_id, seq, coalesce(o, 'none') AS owner_id FROM s LEFT JOIN c USING (aggregate_id)")
def r4(spark, d):
    """The newest sequence number of each aggregate with the owner that claimed it last."""
    e = table(spark, d, "sync_event").filter("aggregate_id IS NOT NULL")
    newest = e.groupBy("aggregate_id").agg(F.max("seq").alias("seq")).withColumn("owner_id", F.lit("none"))
    return keyed.claim(newest, e.filter("seq % 2 = 0").select("aggregate_id", F.substring_index("type", ".", 1).alias("owner_id")), ["aggregate_id"], "owner_id")


@query("io_s5_references", extract.references_sql())
def s5(spark, d):
    return extract.references(table(spark, d, "source_files"))


@query("resolve_e13_import_targets")
def e13(spark, d):
    f = table(spark, d, "source_files")
    return resolve.import_targets(extract.references(f).filter("kind = 'imports'"), f)
