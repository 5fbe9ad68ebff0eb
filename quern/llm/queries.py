"""Queries of the training-text problems (2, 4, 7, 8, 9, 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import conversations, invalid_source, leakage, provenance, sentences, tokenization
from quern.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.kept_turns(table(spark, d, "agent_message"), table(spark, d, "message_part"), table(spark, d, "agent_session")).select("session_id", "turn_no", "message_id")


def p4_conversations(spark: SparkSession, d: str) -> DataFrame:
    _, verdicts = conversations.conversations(table(spark, d, "agent_message"), table(spark, d, "message_part"))
    return verdicts.select("session_id", "messages", "speaking", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.invalid_files(table(spark, d, "source_files"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return invalid_source.error_rates(table(spark, d, "source_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "source_files")).filter(F.col("reason") != "").select("project_id", "path")


def p7_provenance(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "source_files"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenization.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items, with the documents that hold them and the longest passage."""
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("match_words").alias("longest"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leakage.clean(docs, leakage.leaks(docs, table(spark, d, "eval_item"))).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p4_found": p4_found,
    "p4_conversations": p4_conversations,
    "p7_found": p7_found,
    "p7_provenance": p7_provenance,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
}

_BASE = """
m AS (SELECT id, max_by(struct_pack(session_id, time_created, data), time_updated) AS r FROM agent_message WHERE id IS NOT NULL GROUP BY id),
j AS (SELECT id, nullif(r.session_id, '') AS session_id, r.time_created AS t, CASE WHEN json_valid(r.data) AND json_type(r.data) = 'OBJECT' THEN r.data::JSON END AS d FROM m),
p AS (SELECT id, max_by(struct_pack(message_id, data), time_updated) AS r FROM message_part WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT r.message_id AS mid, CASE WHEN json_valid(r.data) AND json_type(r.data) = 'OBJECT' THEN r.data::JSON END AS d FROM p),
speak AS (SELECT DISTINCT mid FROM k WHERE d->>'type' = 'text' AND coalesce(d->>'synthetic', '') <> 'true' AND coalesce(d->>'ignored', '') <> 'true' AND regexp_matches(d->>'text', '[^\\s\\pZ\\pC]')),
x AS (SELECT id, session_id, t, CASE WHEN lower(trim(d->>'role')) IN ('user', 'assistant') THEN lower(trim(d->>'role')) ELSE '' END AS role, d->>'parentID' AS parent,
      coalesce(json_type(d->'error') <> 'NULL', false) AS failed, id IN (SELECT mid FROM speak WHERE mid IS NOT NULL) AS speaks FROM j),
a AS (SELECT x.*, u.id IS NOT NULL AS placed FROM x LEFT JOIN x u ON x.parent = u.id AND u.role = 'user' AND x.session_id = u.session_id AND (u.t, u.id) < (x.t, x.id) WHERE x.role = 'assistant'),
ok AS (SELECT DISTINCT parent AS id FROM a WHERE placed AND speaks AND NOT failed),
v AS (SELECT session_id, count(*) AS messages, count(*) FILTER (speaks) AS speaking, CASE
   WHEN bool_or(role = '') THEN 'broken' WHEN arg_min(role, (t, id)) <> 'user' THEN 'no opening'
   WHEN bool_or(id IN (SELECT id FROM a WHERE NOT placed)) THEN 'stray reply' WHEN bool_or(role = 'user' AND NOT speaks) THEN 'empty message'
   WHEN bool_or(role = 'user' AND id NOT IN (SELECT id FROM ok)) THEN 'no reply' ELSE '' END AS reason FROM x GROUP BY session_id)
"""

_LEAKS = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '\\p{Cf}+', '', 'g'))), '[\\p{L}\\p{M}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, array_to_string(ws[i:i + 11], ' ') AS gram FROM w, unnest(range(1, len(ws) - 10)) t(i)),
v AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(item_text, '\\p{Cf}+', '', 'g'))), '[\\p{L}\\p{M}\\p{N}]+') AS ws FROM eval_item WHERE item_text IS NOT NULL),
h AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 11], ' ') AS gram FROM v, unnest(range(1, len(ws) - 10)) t(i)),
f AS (SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram))
""".replace("\\\\", "\\")

ORACLE = {
    "p4_found": f"""WITH {_BASE} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY t, id) - 1 AS INTEGER) AS turn_no, id AS message_id FROM x
WHERE speaks AND session_id IN (SELECT session_id FROM v WHERE reason = '') AND session_id IN (SELECT id FROM agent_session)""",
    "p4_conversations": f"WITH {_BASE} SELECT session_id, messages, speaking, reason FROM v",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM f",
    "p9_clean": f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)",
}
