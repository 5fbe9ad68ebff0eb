"""Queries of the general data problems (1, 3, 5, 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import change_feed, hierarchy, nested_records, schema_drift
from quern.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(table(spark, d, "dump_record")).select("dump_file", "change", "old_path", "new_path").distinct()


def _typed_table(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        lines = table(spark, d, "dump_record")
        typed = schema_drift.unify(lines)
        return typed[entity] if entity in typed else lines.select("exporter", "dump_file", "line_no").limit(0)

    return query


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records in the one shape of their entity: the typed row as JSON."""
    keys = ["exporter", "dump_file", "line_no"]
    typed = schema_drift.unify(table(spark, d, "dump_record"))
    one = lambda e, df: df.select(F.lit(e).alias("entity"), *keys, F.to_json(F.struct(*[df["`" + c.replace("`", "``") + "`"] for c in df.columns[len(keys) :]])).alias("record"))
    return reduce(DataFrame.unionByName, [one(e, df) for e, df in typed.items()])


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the typed tables: entity, field, cast_to and the names it had."""
    lines = table(spark, d, "dump_record")
    _, lifespans = schema_drift.catalogue(lines)
    named = schema_drift.aliases(schema_drift.cut(schema_drift.changes(lines)), schema_drift.cut(lifespans))
    return schema_drift.casts(named).select("entity", "field", "cast_to", F.array_join("paths", ",").alias("paths"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return change_feed.apply_changes(table(spark, d, "sync_event")).select("aggregate_id", "record_id", "last_seq")


def p3_state(spark: SparkSession, d: str) -> DataFrame:
    return change_feed.apply_changes(table(spark, d, "sync_event"), payload=True)


def p3_retained(spark: SparkSession, d: str) -> DataFrame:
    """What the feed leaves for later changes: the highest tombstone of each key and the writes above it."""
    kept = change_feed.retained(table(spark, d, "sync_event"), payload=False)
    return kept.select("aggregate_id", "seq", "op", F.coalesce("pid", "mid", "sid").alias("record_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = hierarchy.nested_sets(hierarchy.latest_links(table(spark, d, "agent_session")))
    return nodes.select(F.col("id").alias("session_id"), "state", "root_id", "depth", "path")


def _trees(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.nested_sets(hierarchy.latest_links(table(spark, d, "agent_session")))


def p5_ranges(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d).filter(F.col("state") == hierarchy.TREE).select(F.col("id").alias("session_id"), "root_id", "depth", "descendants")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All sessions below each session, by its nested-set range."""
    return hierarchy.descendants(_trees(spark, d)).select(F.col("ancestor").alias("session_id"), F.col("descendant").alias("descendant_id"), "steps")


def p5_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All sessions above each archived session, by the ranges that hold it."""
    archived = table(spark, d, "agent_session").filter(F.col("time_archived").isNotNull()).select("id")
    return hierarchy.ancestors(_trees(spark, d), archived).select(F.col("descendant").alias("session_id"), F.col("ancestor").alias("ancestor_id"), "steps")


#: (table, id, json column, version column or None)
NESTED = [
    ("message_part", "id", "data", "time_updated"),
    ("audit_run", "id", "obligations_json", None),
    ("audit_run", "id", "payload_json", None),
    ("memory_stage1_output", "session_id", "payload", None),
]


def _nested(spark: SparkSession, d: str, every: bool) -> DataFrame:
    parts = []
    for name, id_col, json_col, version in NESTED:
        df = table(spark, d, name).filter(F.col(id_col).isNotNull())
        # Doubled records go before they are taken apart; those with a version have one row each.
        df = nested_records.latest_json(df, id_col, version, json_col, not every) if version else df.select(id_col, json_col).distinct()
        flat = (nested_records.nodes if every else nested_records.flatten)(df, id_col, json_col)
        flat = flat if version or every else flat.distinct()
        parts.append(flat.select(F.lit(name).alias("table_name"), F.lit(json_col).alias("column_name"), *flat.columns))
    return reduce(DataFrame.unionByName, parts)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _nested(spark, d, False).drop("schema_path")


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all child tables, named by table_name, column_name and schema_path."""
    return _nested(spark, d, True)


def p6_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Rows, records and columns of each child table."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("members")))))
    rows = p6_tables(spark, d).groupBy("table_name", "column_name", "schema_path")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("row_id").alias("records"), F.array_join(names, ",").alias("columns"))


QUERIES = {
    "p1_found": p1_found,
    "p1_unified": p1_unified,
    "p1_message": _typed_table("message"),
    "p1_part": _typed_table("part"),
    "p1_file_semantics": _typed_table("file_semantics"),
    "p1_casts": p1_casts,
    "p3_found": p3_found,
    "p3_state": p3_state,
    "p3_retained": p3_retained,
    "p5_found": p5_found,
    "p5_ranges": p5_ranges,
    "p5_descendants": p5_descendants,
    "p5_ancestors": p5_ancestors,
    "p6_found": p6_found,
    "p6_tables": p6_tables,
    "p6_catalogue": p6_catalogue,
}

_OPS = """
ops AS (
  SELECT aggregate_id, seq, regexp_replace(type, '\\.[0-9]+$', '') AS op,
         coalesce(data->>'$.sessionID', data->>'$.info.sessionID', data->>'$.part.sessionID') AS sid,
         coalesce(data->>'$.messageID', data->>'$.part.messageID', data->>'$.info.id') AS mid,
         coalesce(data->>'$.partID', data->>'$.part.id') AS pid,
         row_number() OVER (PARTITION BY aggregate_id, seq ORDER BY received_at, id) AS rn
  FROM sync_event WHERE aggregate_id IS NOT NULL AND seq IS NOT NULL),
o AS (SELECT * FROM ops WHERE rn = 1),
s AS (
  SELECT aggregate_id, sid, max(w) AS last_seq, min(w) FILTER (op = 'session.created') AS birth FROM (
    SELECT o.*, seq AS w, coalesce((SELECT max(t.seq) FROM o t WHERE t.aggregate_id = o.aggregate_id AND t.sid = o.sid AND t.op = 'session.deleted'), -1) AS tomb
    FROM o WHERE op IN ('session.created', 'session.updated')) WHERE w > tomb GROUP BY ALL HAVING birth IS NOT NULL),
m AS (
  SELECT x.aggregate_id, x.mid, max(x.seq) AS last_seq, min(x.seq) AS birth
  FROM o x JOIN s ON x.aggregate_id = s.aggregate_id AND x.sid = s.sid AND x.seq > s.birth
  LEFT JOIN (SELECT aggregate_id, mid, max(seq) AS tomb FROM o WHERE op = 'message.removed' GROUP BY ALL) t ON t.aggregate_id = x.aggregate_id AND t.mid = x.mid
  WHERE x.op = 'message.updated' AND x.seq > coalesce(t.tomb, -1) GROUP BY ALL),
p AS (
  SELECT x.aggregate_id, x.pid, max(x.seq) AS last_seq
  FROM o x JOIN m ON x.aggregate_id = m.aggregate_id AND x.mid = m.mid AND x.seq > m.birth
  LEFT JOIN (SELECT aggregate_id, pid, max(seq) AS tomb FROM o WHERE op = 'message.part.removed' GROUP BY ALL) t ON t.aggregate_id = x.aggregate_id AND t.pid = x.pid
  WHERE x.op = 'message.part.updated' AND x.seq > coalesce(t.tomb, -1) GROUP BY ALL)
"""

def _unwrapped(sql: str) -> str:
    """sql with unwrapped(x) written out: the JSON that a text holds, if that is an object or array, else x."""
    while (at := sql.find("unwrapped(")) >= 0:
        end, depth = at + len("unwrapped("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[at + len("unwrapped(") : end - 1]
        text = f"({x})->>'$'"
        sql = f"{sql[:at]}CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({text}, '^[ \\t\\r\\n]*[{{\\[]') AND json_valid({text}) THEN CAST({text} AS JSON) ELSE {x} END{sql[end:]}"
    return sql


# Every node of a record with its path; text that holds an object or array counts as that value.
_NODES = """
j AS (SELECT 'message_part' AS table_name, 'data' AS column_name, id AS row_id, max_by(struct_pack(data), time_updated).data AS t FROM message_part WHERE id IS NOT NULL GROUP BY id
      UNION SELECT 'audit_run', 'obligations_json', id, obligations_json FROM audit_run WHERE id IS NOT NULL
      UNION SELECT 'audit_run', 'payload_json', id, payload_json FROM audit_run WHERE id IS NOT NULL
      UNION SELECT 'memory_stage1_output', 'payload', session_id, payload FROM memory_stage1_output WHERE session_id IS NOT NULL),
n AS (
  SELECT table_name, column_name, row_id, '' AS parent_path, '' AS path, '' AS schema_path, false AS element, unwrapped(CAST(t AS JSON)) AS v, 0 AS level
  FROM j WHERE json_valid(t)
  UNION ALL
  SELECT table_name, column_name, row_id, CASE WHEN element AND json_type(v) = 'OBJECT' THEN path ELSE parent_path END,
         CASE WHEN json_type(v) = 'ARRAY' THEN path || '[' || k || ']' WHEN path = '' THEN k ELSE path || '.' || k END,
         CASE WHEN json_type(v) = 'ARRAY' THEN schema_path || '[]' WHEN schema_path = '' THEN k ELSE schema_path || '.' || k END,
         json_type(v) = 'ARRAY', unwrapped(x), level + 1
  FROM n, (SELECT key AS k, value AS x FROM json_each(n.v)) e WHERE json_type(n.v) IN ('OBJECT', 'ARRAY'))
"""

_TREE = """
s AS (SELECT id, nullif(max_by(struct_pack(parent_id), time_updated).parent_id, '') AS p FROM agent_session WHERE id IS NOT NULL GROUP BY id),
l AS (SELECT s.id, k.id AS p FROM s LEFT JOIN s k ON s.p = k.id),
t AS (SELECT id, id AS root_id, 0 AS depth, id AS path FROM l WHERE p IS NULL
      UNION ALL SELECT l.id, t.root_id, t.depth + 1, t.path || '/' || l.id FROM l JOIN t ON l.p = t.id),
up AS (SELECT id, p AS a FROM l WHERE p IS NOT NULL AND id NOT IN (SELECT id FROM t)
       UNION SELECT up.id, l.p FROM up JOIN l ON up.a = l.id)
"""

ORACLE = {
    "p6_found": f"""WITH RECURSIVE {_NODES}
SELECT DISTINCT table_name, column_name, row_id, parent_path, path AS child_path FROM n WHERE element AND json_type(v) = 'OBJECT'""",
    "p6_catalogue": f"""WITH RECURSIVE {_NODES},
t AS (SELECT *, CASE WHEN json_type(v) = 'OBJECT' THEN list_filter(json_keys(v), lambda k: json_type(unwrapped(v->('$."' || k || '"'))) NOT IN ('OBJECT', 'ARRAY')) END AS ks
      FROM n WHERE level = 0 OR element OR json_type(v) IN ('OBJECT', 'ARRAY'))
SELECT table_name, column_name, schema_path, count(*) AS n_rows, count(DISTINCT row_id) AS records, coalesce(list_sort(list_distinct(flatten(list(ks)))).array_to_string(','), '') AS columns
FROM t GROUP BY ALL""",
    "p3_found": f"WITH {_OPS} SELECT aggregate_id, sid AS record_id, last_seq FROM s UNION ALL SELECT aggregate_id, mid, last_seq FROM m UNION ALL SELECT aggregate_id, pid, last_seq FROM p",
    "p3_state": f"""WITH {_OPS},
b AS (SELECT aggregate_id, seq, CASE WHEN op LIKE 'message.part.%' THEN data->'$.part' ELSE data->'$.info' END AS payload
      FROM (SELECT *, regexp_replace(type, '\\.[0-9]+$', '') AS op, row_number() OVER (PARTITION BY aggregate_id, seq ORDER BY received_at, id) AS rn FROM sync_event) WHERE rn = 1),
r AS (SELECT aggregate_id, 'session' AS kind, sid AS record_id, NULL AS parent_id, last_seq FROM s
      UNION ALL SELECT m.aggregate_id, 'message', m.mid, o.sid, last_seq FROM m JOIN o ON m.aggregate_id = o.aggregate_id AND o.seq = m.last_seq
      UNION ALL SELECT p.aggregate_id, 'part', p.pid, o.mid, last_seq FROM p JOIN o ON p.aggregate_id = o.aggregate_id AND o.seq = p.last_seq)
SELECT r.aggregate_id, kind, record_id, parent_id, last_seq, CAST(payload AS VARCHAR) AS payload FROM r JOIN b ON r.aggregate_id = b.aggregate_id AND b.seq = r.last_seq""",
    "p3_retained": f"""WITH {_OPS},
k AS (SELECT aggregate_id, seq, op, CASE WHEN op LIKE 'session.%' THEN 's' WHEN op LIKE 'message.part.%' THEN 'p' ELSE 'm' END AS kind,
      CASE WHEN op LIKE 'session.%' THEN sid WHEN op LIKE 'message.part.%' THEN pid ELSE mid END AS record_id, sid, mid
      FROM o WHERE op IN ('session.created', 'session.updated', 'session.deleted', 'message.updated', 'message.removed', 'message.part.updated', 'message.part.removed')),
f AS (SELECT aggregate_id, kind, record_id, max(seq) AS top FROM k WHERE op IN ('session.deleted', 'message.removed', 'message.part.removed') GROUP BY ALL)
SELECT k.aggregate_id, seq, op, k.record_id FROM k LEFT JOIN f ON k.aggregate_id = f.aggregate_id AND k.kind = f.kind AND k.record_id = f.record_id
LEFT JOIN f u ON k.aggregate_id = u.aggregate_id AND ((k.kind = 'm' AND u.kind = 's' AND u.record_id = k.sid) OR (k.kind = 'p' AND u.kind = 'm' AND u.record_id = k.mid))
WHERE k.record_id IS NOT NULL AND CASE WHEN op IN ('session.deleted', 'message.removed', 'message.part.removed') THEN seq = f.top ELSE seq > coalesce(f.top, -1) AND seq > coalesce(u.top, -1) END""",
    "p5_found": f"""WITH RECURSIVE {_TREE}
SELECT id AS session_id, 'tree' AS state, root_id, CAST(depth AS INTEGER) AS depth, path FROM t
UNION ALL SELECT id, CASE WHEN bool_or(a = id) THEN 'on_cycle' ELSE 'below_cycle' END, '', -1, '' FROM up GROUP BY id""",
    "p5_ranges": f"""WITH RECURSIVE {_TREE}
SELECT x.id AS session_id, x.root_id, CAST(x.depth AS INTEGER) AS depth, count(y.id) AS descendants
FROM t x LEFT JOIN t y ON y.root_id = x.root_id AND starts_with(y.path, x.path || '/') GROUP BY ALL""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}
SELECT x.id AS session_id, y.id AS descendant_id, y.depth - x.depth AS steps FROM t x JOIN t y ON y.root_id = x.root_id AND starts_with(y.path, x.path || '/')""",
    "p5_ancestors": f"""WITH RECURSIVE {_TREE}
SELECT y.id AS session_id, x.id AS ancestor_id, y.depth - x.depth AS steps FROM t x JOIN t y ON y.root_id = x.root_id AND starts_with(y.path, x.path || '/')
WHERE y.id IN (SELECT id FROM agent_session WHERE time_archived IS NOT NULL)""",
}
ORACLE = {k: _unwrapped(v) for k, v in ORACLE.items()}
