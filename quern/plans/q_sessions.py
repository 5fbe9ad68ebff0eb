"""Session, message and event-log queries over the agent tables, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.ranking import numbered
from quern.operators import keyed, sessions
from quern.plans.registry import registry
from quern.sources.tables import events, orders, table

QUERIES, ORACLE, query = registry()


def _json(path: str):
    return F.get_json_object("data", path)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Newest valid message rows: id, session_id, t, role, cost in thousandths, input and output tokens."""
    one = keyed.newest(table(spark, d, "agent_message").select("id", "session_id", "time_created", "time_updated", "data"), ["id"], ["time_updated"])
    ok = one.filter(F.try_parse_json("data").isNotNull() & F.col("data").startswith("{"))
    role = F.lower(F.trim(_json("$.role")))
    number = lambda p: F.coalesce(_json(p).cast("long"), F.lit(0))
    return ok.select("id", "session_id", F.col("time_created").alias("t"), role.alias("role"), F.coalesce(F.round(_json("$.cost").cast("double") * 1000).cast("long"), F.lit(0)).alias("cost"), number("$.tokens.input").alias("input"), number("$.tokens.output").alias("output"), F.length("data").alias("size"), _json("$.modelID").alias("model"))


_M = """
m0 AS (SELECT id, max_by(struct_pack(session_id, t := time_created, data), time_updated) AS r FROM agent_message GROUP BY id),
m AS (SELECT id, r.session_id AS session_id, r.t AS t, lower(trim(r.data->>'$.role')) AS role, coalesce(CAST(round(CAST(r.data->>'$.cost' AS DOUBLE) * 1000) AS BIGINT), 0) AS cost, coalesce(CAST(r.data->>'$.tokens.input' AS BIGINT), 0) AS input,
  coalesce(CAST(r.data->>'$.tokens.output' AS BIGINT), 0) AS output, length(r.data) AS size, r.data->>'$.modelID' AS model FROM m0 WHERE json_valid(r.data) AND r.data[1] = '{')
"""


@query("session_s8_scans", f"WITH {_M} SELECT session_id, count(*) AS n, min(t) AS first, max(t) AS last FROM m GROUP BY 1")
def s8(spark, d):
    return messages(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("session_a14_rollup", f"""WITH {_M}, s AS (SELECT session_id, count(*) AS n, sum(cost) AS cost, sum(input) AS i, sum(output) AS o FROM m GROUP BY 1)
SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, median(i + o) AS median_tokens, round(avg(i + o), 4) AS mean_tokens FROM s""")
def a14(spark, d):
    per = messages(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum("input").alias("i"), F.sum("output").alias("o"))
    tokens = F.col("i") + F.col("o")
    return per.agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("messages"), F.sum("cost").alias("cost"), F.sum("i").alias("input"), F.sum("o").alias("output"), F.median(tokens).alias("median_tokens"), F.round(F.avg(tokens), 4).alias("mean_tokens"))


@query("session_a14_tools", """WITH p AS (SELECT id, max_by(data, time_updated) AS data FROM message_part GROUP BY id) SELECT data->>'$.tool' AS tool, count(*) AS n FROM p WHERE json_valid(data) AND data->>'$.type' = 'tool' GROUP BY 1""")
def a14_tools(spark, d):
    parts = keyed.newest(table(spark, d, "message_part").select("id", "time_updated", F.when(F.try_parse_json("data").isNotNull() & (_json("$.type") == "tool"), _json("$.tool")).alias("tool")), ["id"], ["time_updated"])
    return parts.filter(F.col("tool").isNotNull()).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


@query("session_w11_model_median", f"WITH {_M} SELECT model, median(input) AS median_input, CAST(sum(output) AS BIGINT) AS output FROM m WHERE model IS NOT NULL GROUP BY 1")
def w11(spark, d):
    return messages(spark, d).filter(F.col("model").isNotNull()).groupBy("model").agg(F.median("input").alias("median_input"), F.sum("output").alias("output"))


@query("session_a28_context_breakdown", f"""WITH {_M}, c AS (SELECT session_id, role, CAST(ceil(sum(size) / 4.0) AS BIGINT) AS tokens FROM m WHERE role IN ('user', 'assistant') GROUP BY ALL),
t AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS est FROM c), s AS (SELECT session_id, role, CAST(CASE WHEN est > 200 THEN floor(tokens * 200 / est) ELSE tokens END AS BIGINT) AS tokens FROM t)
SELECT session_id, role, tokens, round(tokens * 100.0 / 200, 1) AS percent FROM s WHERE tokens > 0""")
def a28(spark, d):
    per = messages(spark, d).filter(F.col("role").isin("user", "assistant")).groupBy("session_id", "role").agg(F.ceil(F.sum("size") / 4.0).cast("long").alias("tokens"))
    estimate = F.sum("tokens").over(Window.partitionBy("session_id"))
    scaled = per.withColumn("est", estimate).withColumn("tokens", F.when(F.col("est") > 200, F.floor(F.col("tokens") * 200 / F.col("est"))).otherwise(F.col("tokens")))
    return scaled.filter("tokens > 0").select("session_id", "role", "tokens", F.round(F.col("tokens") * 100.0 / 200, 1).alias("percent"))


@query("session_a29_last_assistant", f"""WITH {_M} SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, max_by(id, (t, id)) FILTER (output > 0) AS last_id, round(max_by(input, (t, id)) FILTER (output > 0) * 100.0 / 200000, 2) AS percent FROM m WHERE role = 'assistant' GROUP BY 1""")
def a29(spark, d):
    last = F.max(F.when(F.col("output") > 0, F.struct("t", "id", "input")))
    per = messages(spark, d).filter("role = 'assistant'").groupBy("session_id").agg(F.sum("cost").alias("cost"), last.alias("l"))
    return per.select("session_id", "cost", F.col("l.id").alias("last_id"), F.round(F.col("l.input") * 100.0 / 200000, 2).alias("percent"))


@query("session_a30_change_summary", """SELECT project_id, CAST(sum(coalesce(summary_additions, 0)) AS BIGINT) AS additions, CAST(sum(coalesce(summary_deletions, 0)) AS BIGINT) AS deletions, count(summary_additions) AS changed, arg_min(slug, (time_created, id, slug)) AS first, arg_max(slug, (time_created, id, slug)) AS last FROM agent_session WHERE slug IS NOT NULL GROUP BY 1""")
def a30(spark, d):
    key = F.struct("time_created", "id", "slug")
    return table(spark, d, "agent_session").filter(F.col("slug").isNotNull()).groupBy("project_id").agg(
        F.sum(F.coalesce("summary_additions", F.lit(0))).alias("additions"), F.sum(F.coalesce("summary_deletions", F.lit(0))).alias("deletions"), F.count("summary_additions").alias("changed"), F.min_by("slug", key).alias("first"), F.max_by("slug", key).alias("last")
    )


@query("session_p10_listing", "SELECT id, title FROM (SELECT DISTINCT id, title, time_updated, project_id, parent_id, path, time_archived FROM agent_session) WHERE project_id = (SELECT min(project_id) FROM agent_session WHERE project_id <> '') AND (parent_id IS NULL OR parent_id = '') AND title ILIKE '%the%' AND time_archived IS NULL")
def p10(spark, d):
    s = table(spark, d, "agent_session").select("id", "title", "time_updated", "project_id", "parent_id", "path", "time_archived").distinct()
    first = s.filter("project_id <> ''").agg(F.min("project_id").alias("project_id"))
    return s.join(F.broadcast(first), "project_id", "left_semi").filter((F.col("parent_id").isNull() | (F.col("parent_id") == "")) & F.col("title").ilike("%the%") & F.col("time_archived").isNull()).select("id", "title")


@query("session_p11_global_listing", "SELECT s.id, coalesce(f.files, 0) AS files FROM (SELECT DISTINCT id, project_id FROM agent_session) s LEFT JOIN (SELECT project_id, count(DISTINCT path) AS files FROM source_files GROUP BY 1) f ON s.project_id = f.project_id")
def p11(spark, d):
    files = table(spark, d, "source_files").select("project_id", "path").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))
    return table(spark, d, "agent_session").select("id", "project_id").distinct().join(files, "project_id", "left").select("id", F.coalesce("files", F.lit(0)).alias("files"))


@query("session_p12_scope", "SELECT id, workspace_id FROM agent_session WHERE (workspace_id IS NULL OR workspace_id = 'wrk_0397') AND time_archived IS NULL")
def p12(spark, d):
    return table(spark, d, "agent_session").filter((F.col("workspace_id").isNull() | F.col("workspace_id").eqNullSafe("wrk_0397")) & F.col("time_archived").isNull()).select("id", "workspace_id")


@query("session_p13_pending", "SELECT session_id, generated_at FROM memory_stage1_output WHERE usage_count = 0 OR usage_count IS NULL OR source_updated_at > generated_at OR source_deleted_at > generated_at")
def p13(spark, d):
    return table(spark, d, "memory_stage1_output").filter("usage_count = 0 OR usage_count IS NULL OR source_updated_at > generated_at OR source_deleted_at > generated_at").select("session_id", "generated_at")


@query("session_j4_candidates", """WITH s AS (SELECT id, max(time_updated) AS updated FROM agent_session GROUP BY id), o AS (SELECT session_id, max(source_updated_at) AS seen FROM memory_stage1_output GROUP BY 1), e AS (SELECT aggregate_id, max(seq) AS seq FROM sync_event GROUP BY 1)
SELECT s.id FROM s JOIN (SELECT DISTINCT session_id FROM agent_message) m ON m.session_id = s.id LEFT JOIN o ON o.session_id = s.id LEFT JOIN e ON e.aggregate_id = s.id WHERE s.updated > greatest(coalesce(o.seen, 0), coalesce(e.seq, 0))""")
def j4(spark, d):
    s = table(spark, d, "agent_session").groupBy("id").agg(F.max("time_updated").alias("updated"))
    o = table(spark, d, "memory_stage1_output").groupBy(F.col("session_id").alias("id")).agg(F.max("source_updated_at").alias("seen"))
    e = table(spark, d, "sync_event").groupBy(F.col("aggregate_id").alias("id")).agg(F.max("seq").alias("seq"))
    talked = table(spark, d, "agent_message").select(F.col("session_id").alias("id"))
    return s.join(talked, "id", "left_semi").join(o, "id", "left").join(e, "id", "left").filter(F.col("updated") > F.greatest(F.coalesce("seen", F.lit(0)), F.coalesce("seq", F.lit(0)))).select("id")


@query("session_j13_hydration", """WITH m AS (SELECT DISTINCT id FROM agent_message), p AS (SELECT DISTINCT message_id, id FROM message_part) SELECT m.id AS message_id, count(p.id) AS parts, string_agg(p.id, ',' ORDER BY p.id) AS part_ids FROM m LEFT JOIN p ON p.message_id = m.id GROUP BY 1""")
def j13(spark, d):
    parts = table(spark, d, "message_part").select(F.col("message_id").alias("mid"), F.col("id").alias("pid")).distinct()
    m = table(spark, d, "agent_message").select(F.col("id").alias("mid")).distinct()
    hydrated = m.join(parts, "mid", "left").groupBy("mid").agg(F.count("pid").alias("parts"), F.array_sort(F.collect_list("pid")).alias("ids"))
    return hydrated.select(F.col("mid").alias("message_id"), "parts", F.when(F.col("parts") > 0, F.array_join("ids", ",")).alias("part_ids"))


@query("session_j12_garbage", "SELECT DISTINCT content_hash FROM source_files WHERE content_hash NOT IN (SELECT content_hash FROM file_semantics WHERE content_hash IS NOT NULL)")
def j12(spark, d):
    return table(spark, d, "source_files").select("content_hash").distinct().join(table(spark, d, "file_semantics").select("content_hash"), "content_hash", "left_anti")


@query("session_a25_compaction", """SELECT s.project_id, count(DISTINCT s.content_hash) AS hashes FROM source_files s WHERE s.content_hash NOT IN (SELECT content_hash FROM file_semantics WHERE confidence = 'high' AND content_hash IS NOT NULL) GROUP BY 1""")
def a25(spark, d):
    protected = table(spark, d, "file_semantics").filter("confidence = 'high'").select("content_hash")
    return table(spark, d, "source_files").select("project_id", "content_hash").distinct().join(protected, "content_hash", "left_anti").groupBy("project_id").agg(F.count(F.lit(1)).alias("hashes"))


@query("session_w1_tail", f"""WITH {_M}, u AS (SELECT id, session_id, sum(size) OVER (PARTITION BY session_id ORDER BY t DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM m) SELECT id, session_id FROM u WHERE used <= 2000""")
def w1(spark, d):
    return sessions.tail_within(messages(spark, d), "session_id", ["t", "id"], F.col("size"), 2000).select("id", "session_id")


@query("session_w2_prune", f"""WITH {_M}, a AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS turns FROM m WINDOW w AS (PARTITION BY session_id ORDER BY t DESC, id DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN turns >= 2 THEN size ELSE 0 END AS amt FROM a), c AS (SELECT *, sum(amt) OVER (PARTITION BY session_id ORDER BY t DESC, id DESC ROWS UNBOUNDED PRECEDING) AS used FROM b),
e AS (SELECT *, turns >= 2 AND used > 600 AS old FROM c), f AS (SELECT *, sum(CASE WHEN old THEN amt ELSE 0 END) OVER (PARTITION BY session_id) AS freed FROM e) SELECT id FROM f WHERE old AND freed > 300""")
def w2(spark, d):
    return sessions.prune_candidates(messages(spark, d), "session_id", ["t", "id"], F.col("role") == "user", F.col("size"), 2, 600, 300).select("id")


@query("session_w3_turns", f"""WITH {_M} SELECT id, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn FROM m""")
def w3(spark, d):
    return sessions.turns(messages(spark, d), "session_id", ["t", "id"], F.col("role") == "user").select("id", "turn")


@query("session_w4_transcript", """WITH p AS (SELECT id, max_by(struct_pack(session_id, t := time_created, data), time_updated) AS r FROM message_part GROUP BY id), x AS (SELECT id, r.session_id AS s, r.t AS t, r.data->>'$.text' AS text FROM p WHERE json_valid(r.data) AND r.data->>'$.type' = 'text'),
y AS (SELECT *, sum(length(text)) OVER (PARTITION BY s ORDER BY t DESC, id DESC ROWS UNBOUNDED PRECEDING) - length(text) AS before FROM x WHERE trim(text) <> '')
SELECT id, s AS session_id, sha256(substr(text, 1, CAST(2000 - before AS INTEGER))) AS kept FROM y WHERE before < 2000""")
def w4(spark, d):
    parts = table(spark, d, "message_part").select("id", "session_id", "time_created", "time_updated", F.when(F.try_parse_json("data").isNotNull() & (_json("$.type") == "text"), _json("$.text")).alias("text"))
    said = keyed.newest(parts, ["id"], ["time_updated"]).filter(F.trim("text") != "").select("id", "session_id", F.col("time_created").alias("t"), "text")
    return sessions.window_text(said, "session_id", ["t", "id"], "text", 2000).select("id", "session_id", F.sha2("kept", 256).alias("kept"))


@query("session_w5_since_compaction", f"""WITH {_M}, c AS (SELECT session_id, max((t, id)) AS mark FROM m WHERE input > 60000 GROUP BY 1) SELECT m.id FROM m LEFT JOIN c USING (session_id) WHERE c.mark IS NULL OR (m.t, m.id) >= c.mark""")
def w5(spark, d):
    return sessions.since_last(messages(spark, d), "session_id", ["t", "id"], F.col("input") > 60000).select("id")


@query("session_w10_sequence_check", """WITH o AS (SELECT DISTINCT aggregate_id, seq FROM sync_event) SELECT aggregate_id, max(seq) - min(seq) + 1 = count(*) AS whole FROM o GROUP BY 1""")
def w10(spark, d):
    return sessions.sequence_gaps(table(spark, d, "sync_event").select("aggregate_id", "seq").distinct(), "aggregate_id", "seq")


@query("session_r2_replay_verdicts", """WITH o AS (SELECT id, aggregate_id, seq, received_at, max(seq) OVER (PARTITION BY aggregate_id ORDER BY received_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM sync_event)
SELECT id, aggregate_id, seq, CASE WHEN seq <= coalesce(latest, -1) THEN 'ignored' WHEN seq = coalesce(latest, -1) + 1 THEN 'applied' ELSE 'gap' END AS verdict FROM o""")
def r2(spark, d):
    w = Window.partitionBy("aggregate_id").orderBy("received_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.coalesce(F.max("seq").over(w), F.lit(-1))
    verdict = F.when(F.col("seq") <= latest, "ignored").when(F.col("seq") == latest + 1, "applied").otherwise("gap")
    return table(spark, d, "sync_event").select("id", "aggregate_id", "seq", verdict.alias("verdict"))


@query("session_r3_ordered_batches", "SELECT id, aggregate_id, seq - min(seq) OVER (PARTITION BY aggregate_id) AS at FROM (SELECT DISTINCT id, aggregate_id, seq FROM sync_event)")
def r3(spark, d):
    e = table(spark, d, "sync_event").select("id", "aggregate_id", "seq").distinct()
    first = e.groupBy("aggregate_id").agg(F.min("seq").alias("first"))
    return e.join(first, "aggregate_id").select("id", "aggregate_id", (F.col("seq") - F.col("first")).alias("at"))


@query("session_r5_versioned_types", "SELECT regexp_replace(type, '\\.[0-9]+$', '') AS type, max(CAST(regexp_extract(type, '([0-9]+)$', 1) AS INTEGER)) AS latest, count(*) AS n FROM sync_event GROUP BY 1")
def r5(spark, d):
    return table(spark, d, "sync_event").groupBy(F.regexp_replace("type", r"\.[0-9]+$", "").alias("type")).agg(F.max(F.regexp_extract("type", "([0-9]+)$", 1).cast("int")).alias("latest"), F.count(F.lit(1)).alias("n"))


@query("session_r6_late_children", """WITH del AS (SELECT aggregate_id, max(seq) AS gone FROM sync_event WHERE type LIKE 'session.deleted%' GROUP BY 1) SELECT DISTINCT e.id, e.aggregate_id FROM sync_event e JOIN del USING (aggregate_id) WHERE e.type LIKE 'message.%' AND e.seq > del.gone
AND NOT EXISTS (SELECT 1 FROM sync_event c WHERE c.aggregate_id = e.aggregate_id AND c.type LIKE 'session.created%' AND c.seq > del.gone AND c.seq < e.seq)""")
def r6(spark, d):
    e = table(spark, d, "sync_event").select("id", "aggregate_id", "seq", "type")
    gone = e.filter(F.col("type").startswith("session.deleted")).groupBy("aggregate_id").agg(F.max("seq").alias("gone"))
    again = e.filter(F.col("type").startswith("session.created")).join(gone, "aggregate_id").filter("seq > gone").groupBy("aggregate_id").agg(F.min("seq").alias("again"))
    late = e.filter(F.col("type").startswith("message.")).join(gone, "aggregate_id").filter("seq > gone").join(again, "aggregate_id", "left").filter(F.col("again").isNull() | (F.col("again") >= F.col("seq")))
    return late.select("id", "aggregate_id").distinct()


@query("session_r7_publish_by_type", "SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS typed FROM events GROUP BY 1")
def r7(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "error", 1)).alias("typed"))


@query("session_r26_history_chunks", "SELECT aggregate_id, seq, id, CAST(floor((row_number() OVER (PARTITION BY aggregate_id ORDER BY seq, id) - 1) / 10) AS INTEGER) AS chunk FROM (SELECT DISTINCT aggregate_id, seq, id FROM sync_event)")
def r26(spark, d):
    e = table(spark, d, "sync_event").select("aggregate_id", "seq", "id").distinct()
    return numbered(e, ["aggregate_id"], ["seq", "id"], "n").select("aggregate_id", "seq", "id", F.floor(F.col("n") / 10).cast("int").alias("chunk"))


@query("session_u1_latest_wins", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def u1(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("session_u2_log_compaction", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def u2(spark, d):
    e = events(spark, d).select("user_id", "event_type", "event_id", "value")
    snapshot = keyed.newest(e.filter("event_id < 5000"), ["user_id", "event_type"], ["event_id"])
    return keyed.newest(snapshot.unionByName(e.filter("event_id >= 5000")), ["user_id", "event_type"], ["event_id"]).drop("event_id")


@query("session_t1_keyset_page", "SELECT o_orderkey, true AS more FROM (SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 0) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)")
def t1(spark, d):
    o = orders(spark, d).select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"), "o_orderkey")
    return sessions.page_before(o, ["at", "o_orderkey"], ("1998-01-01 00:00:00", 0), 25).select("o_orderkey", "more")


@query("session_t2_cursor_round_trip", "SELECT o_orderkey AS id, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS at FROM orders")
def t2(spark, d):
    c = sessions.encode_cursor(F.unix_millis("o_orderdate"), F.col("o_orderkey"))
    back = orders(spark, d).select(c.alias("cursor")).select(sessions.decode_cursor(F.col("cursor"), "p0 long, p1 long").alias("p"))
    return back.select(F.col("p.p1").alias("id"), F.col("p.p0").alias("at"))


@query("session_t3_all_pages", "SELECT o_custkey, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1) / 5) AS INTEGER) AS page FROM orders")
def t3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return orders(spark, d).select("o_custkey", "o_orderkey", F.floor((F.row_number().over(w) - 1) / 5).cast("int").alias("page"))


@query("session_t4_offset_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def t4(spark, d):
    return orders(spark, d).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(100).limit(50).select("o_orderkey")


@query("session_t6_seeded_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 100")
def t6(spark, d):
    """100 customers in the order of a seeded hash: a sample that doesn't depend on the order of rows."""
    return table(spark, d, "customer").orderBy(F.md5(F.concat(F.lit("42:"), F.col("c_custkey").cast("string"))), "c_custkey").limit(100).select("c_custkey", "c_name")


@query("session_t8_first_eligible", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def t8(spark, d):
    return orders(spark, d).filter("o_orderstatus = 'O'").orderBy(F.asc_nulls_first("o_orderpriority"), F.asc_nulls_first("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query("session_t9_job_listing", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderstatus, o_orderkey LIMIT 100")
def t9(spark, d):
    return orders(spark, d).orderBy(F.desc("o_orderdate"), "o_orderstatus", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus")


@query("session_t10_latest", "SELECT id FROM (SELECT DISTINCT id, created_at FROM audit_run) ORDER BY created_at DESC, id DESC LIMIT 20")
def t10(spark, d):
    return table(spark, d, "audit_run").select("id", "created_at").distinct().orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id")


@query("session_t11_key_order", "SELECT user_id, event_type, max(event_id) AS latest FROM events GROUP BY ALL ORDER BY 1, 2")
def t11(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.max("event_id").alias("latest")).orderBy("user_id", "event_type")


@query("session_f26_partial_patch", """WITH o AS (SELECT DISTINCT aggregate_id, seq, data FROM sync_event WHERE type LIKE 'session.%')
SELECT aggregate_id, max_by(data->>'$.info.title', seq) FILTER (json_exists(data, '$.info.title')) AS title, bool_or(json_exists(data, '$.info.share')) AS shared FROM o GROUP BY 1""")
def f26(spark, d):
    """The newest present value per field; a field that is present and null overwrites, an absent one doesn't."""
    e = table(spark, d, "sync_event").filter(F.col("type").startswith("session.")).select("aggregate_id", "seq", "data").distinct()
    keys = F.coalesce(F.json_object_keys(F.get_json_object("data", "$.info")), F.array().cast("array<string>"))
    title, share = F.array_contains(keys, "title"), F.array_contains(keys, "share")
    newest_title = F.max(F.when(title, F.struct("seq", F.get_json_object("data", "$.info.title").alias("v"))))
    return e.groupBy("aggregate_id").agg(newest_title.alias("t"), F.max(share).alias("shared")).select("aggregate_id", F.col("t.v").alias("title"), "shared")


@query("session_f27_json_explode", """SELECT r.id, j.o->>'$.id' AS obligation, j.o->>'$.risk' AS risk FROM (SELECT DISTINCT id, obligations_json FROM audit_run WHERE json_valid(obligations_json) AND json_type(obligations_json) = 'ARRAY') r, unnest(CAST(r.obligations_json AS JSON[])) AS j(o)""")
def f27(spark, d):
    """An array of objects in a JSON column as rows."""
    runs = table(spark, d, "audit_run").select("id", "obligations_json").distinct().filter(F.try_parse_json("obligations_json").isNotNull())
    items = F.from_json("obligations_json", "array<struct<id:string,risk:string>>")
    return runs.filter(F.col("obligations_json").startswith("[")).select("id", F.explode(items).alias("o")).select("id", F.col("o.id").alias("obligation"), F.col("o.risk").alias("risk"))
