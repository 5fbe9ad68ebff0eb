"""Conversations from message rows (problem 4).

A message belongs to its session; one without belongs where the message that
it replies to does, and a reply to one without takes that along. So sessions
and messages without identifier are the nodes, and replies in which either
side lacks the identifier the links, of which connected components are found
by alternating large-star and small-star joins; messages with an identifier
never enter the loop. The data has no links but sessions and replies (quotes
have no field). Each conversation is then ordered and validated with
aggregates per key only.

Defined results: of repeated ids the row with the greatest version counts;
null ids are dropped; data that is no JSON object makes its conversation
broken; equal times are ordered by id; a message that replies into another
session doesn't merge the two, but breaks its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ranking import numbered
from quern.operators.components import components
from quern.plans.checkpoints import cut

#: A character that is neither white space, control, format nor unassigned.
VISIBLE = r"[^\s\p{Z}\p{C}]"


def _json(col: str, path: str) -> Column:
    return F.get_json_object(col, path)


def _filled(col: str) -> Column:
    return F.when(F.col(col) != "", F.col(col))


def latest_messages(messages: DataFrame) -> DataFrame:
    """id, session_id, t, role ('' if not user or assistant), parent, failed."""
    is_object = F.try_parse_json("data").isNotNull() & F.ltrim("data").startswith("{")
    role = F.lower(F.regexp_replace(_json("data", "$.role"), r"^\s+|\s+$", ""))
    fields = F.struct(
        F.col("time_updated").alias("v"), _filled("session_id").alias("session_id"), F.col("time_created").alias("t"),
        F.when(is_object & role.isin("user", "assistant"), role).otherwise(F.lit("")).alias("role"),
        F.when(is_object, _json("data", "$.parentID")).alias("parent"),
        F.coalesce(is_object & _json("data", "$.error").isNotNull(), F.lit(False)).alias("failed"),
    )
    return messages.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(fields).alias("m")).select("id", "m.session_id", "m.t", "m.role", "m.parent", "m.failed")


def speaking_ids(parts: DataFrame) -> DataFrame:
    """message ids (mid) with a text part that shows something; only flags are shuffled, not texts."""
    true = lambda path: F.coalesce(_json("data", path) == "true", F.lit(False))
    says = F.coalesce((_json("data", "$.type") == "text") & ~true("$.synthetic") & ~true("$.ignored") & _json("data", "$.text").rlike(VISIBLE), F.lit(False))
    newest = parts.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(F.col("time_updated").alias("v"), F.col("message_id").alias("mid"), says.alias("says"))).alias("p"))
    return newest.filter("p.says").select(F.col("p.mid").alias("mid")).distinct()


def conversations(messages: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, verdicts): every message with its conversation and speaks; one verdict per conversation.

    verdicts: conversation, session_id, messages, speaking, reason ('' if it is whole).
    """
    base = latest_messages(messages).join(speaking_ids(parts).withColumn("id", F.col("mid")).select("id", F.lit(True).alias("speaks")), "id", "left").withColumn("speaks", F.coalesce("speaks", F.lit(False)))
    base = cut(base)
    # A session's node sorts before its messages', so that it is the centre of their star from the first round on.
    base = base.withColumn("node", F.coalesce(F.concat(F.lit("a"), F.col("session_id")), F.concat(F.lit("m"), F.col("id"))))
    lost, parents = F.col("session_id").isNull(), base.select(F.col("id").alias("parent"), F.col("node").alias("v"))
    replies = base.filter(F.col("parent").isNotNull())
    up = replies.filter(lost).select("parent", F.col("node").alias("u")).join(parents, "parent")
    down = replies.filter(~lost).select("parent", F.col("node").alias("u")).join(parents.filter(F.col("v").startswith("m")), "parent")
    label = cut(components(up.unionByName(down).select("u", "v"))).withColumnRenamed("component", "found")
    rows = base.join(label, "node", "left").withColumn("conversation", F.coalesce("found", "node")).drop("found", "node")

    place = lambda p: F.struct(F.col(f"{p}t"), F.col(f"{p}id"))
    users = rows.filter("role = 'user'").select(F.col("id").alias("parent"), F.col("t").alias("u_t"), F.col("id").alias("u_id"), F.col("conversation").alias("u_conversation"))
    answers = rows.filter("role = 'assistant'").join(users, "parent", "left")
    answers = answers.withColumn("placed", F.coalesce((F.col("conversation") == F.col("u_conversation")) & (place("u_") < place("")), F.lit(False)))
    answered = answers.filter(F.col("placed") & F.col("speaks") & ~F.col("failed")).select(F.col("parent").alias("id")).distinct().withColumn("answered", F.lit(True))
    bad_answers = answers.groupBy("conversation").agg(F.max((~F.col("placed")).cast("int")).alias("stray"))
    turns = rows.join(answered, "id", "left").groupBy("conversation").agg(
        F.max("session_id").alias("session_id"), F.count(F.lit(1)).alias("messages"), F.sum(F.col("speaks").cast("long")).alias("speaking"),
        F.max((F.col("role") == "").cast("int")).alias("odd"), F.min(F.struct("t", "id", "role"))["role"].alias("first"),
        F.max(((F.col("role") == "user") & ~F.col("speaks")).cast("int")).alias("silent"),
        F.max(((F.col("role") == "user") & F.col("answered").isNull()).cast("int")).alias("unanswered"),
    )
    verdicts = turns.join(bad_answers, "conversation", "left").select(
        "conversation", "session_id", "messages", "speaking",
        F.when(F.col("odd") == 1, F.lit("broken")).when(F.col("first") != "user", F.lit("no opening")).when(F.coalesce("stray", F.lit(0)) == 1, F.lit("stray reply"))
        .when(F.col("silent") == 1, F.lit("empty message")).when(F.col("unanswered") == 1, F.lit("no reply")).otherwise(F.lit("")).alias("reason"),
    )
    return rows, verdicts


def kept_turns(messages: DataFrame, parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, turn_no, message_id, role of the speaking messages of whole, known sessions."""
    rows, verdicts = conversations(messages, parts)
    stored = sessions.select(F.col("id").alias("session_id")).filter("session_id <> ''").distinct()
    keep = verdicts.filter("reason = ''").join(stored, "session_id", "left_semi").select("conversation", F.col("session_id").alias("kept"))
    said = rows.filter("speaks").join(keep, "conversation").select(F.col("kept").alias("session_id"), "t", F.col("id").alias("message_id"), "role")
    return numbered(said, ["session_id"], ["t", "message_id"], "turn_no").select("session_id", "turn_no", "message_id", "role")
