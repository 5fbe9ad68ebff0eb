"""State of a table after a feed of inserts, updates and deletes (general problem 3).

The fold is commutative: each key keeps its highest tombstone and the highest
write above it, so rows may come late, twice or in any order and partial
aggregation runs before every shuffle. Nothing is sorted by time and no group
is collected.

A record stands at the end exactly if its last operation is a write and its
parent stands and was born before that write; its birth is the first write
above its highest tombstone and above the birth of its parent. Both are
maxima or minima per key, taken level by level (session, message, part).

Feeds that come in pieces: retained gives the operations that a later change
may still need (each key's highest tombstone and the writes above it and above
its parent's; writes whose parent isn't known yet wait here), and takes the
operations retained before. live of what is retained is the table. Pieces in
any order and split give what the whole feed gives, with one exception: a
delivery of a tombstone's own aggregate and seq that comes in a later piece,
though received earlier and with other contents, can't bring back what that
tombstone had removed.

Defined results: rows with null aggregate, null seq or data without the ids of
their operation change nothing; of rows with the same aggregate and seq the
one received first counts (null received_at last, then the smaller id); an
empty feed gives an empty state; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut

SESSION, MESSAGE, PART = "session", "message", "part"


def _json(path: str) -> Column:
    return F.get_json_object("data", path)


#: Columns by which the first delivery of a place is known, and those of an operation.
DELIVERY = ["late", "received_at", "id"]
OPERATION = ["op", "sid", "mid", "pid"]


def operations(events: DataFrame, payload: bool = False) -> DataFrame:
    """Feed rows as operations: aggregate_id, seq, late, received_at, id, op, sid, mid, pid[, payload]."""
    op = F.regexp_replace("type", r"\.[0-9]+$", "")
    sid = F.coalesce(_json("$.sessionID"), _json("$.info.sessionID"), _json("$.part.sessionID"))
    own = F.coalesce(_json("$.info.id"), sid)
    is_message, is_part = op.startswith("message.") & ~op.startswith("message.part."), op.startswith("message.part.")
    body = [F.when(is_part, _json("$.part")).otherwise(_json("$.info")).alias("payload")] if payload else []
    return events.filter(F.col("aggregate_id").isNotNull() & F.col("seq").isNotNull()).select(
        "aggregate_id", "seq", F.col("received_at").isNull().alias("late"), "received_at", "id", op.alias("op"),
        F.when(op.startswith("session."), own).otherwise(sid).alias("sid"),
        F.when(is_message, F.coalesce(_json("$.messageID"), _json("$.info.id"))).when(is_part, F.coalesce(_json("$.messageID"), _json("$.part.messageID"))).alias("mid"),
        F.when(is_part, F.coalesce(_json("$.partID"), _json("$.part.id"))).alias("pid"),
        *body,
    )


def first_delivered(ops: DataFrame) -> DataFrame:
    """One operation per aggregate and seq, that of the first delivery; rows of a base table (seq below 0) are one per record."""
    fields = [c for c in ops.columns if c not in ("aggregate_id", "seq")]
    record = F.when(F.col("seq") < 0, F.coalesce("pid", "mid", "sid"))
    kept = ops.groupBy("aggregate_id", "seq", record.alias("record")).agg(F.min(F.struct(*fields)).alias("e"))
    return kept.select("aggregate_id", "seq", *[f"e.{c}" for c in fields])


def fold_level(writes: DataFrame, tombs: DataFrame, key: list[str], parent: DataFrame | None, parent_key: list[str], extra: list[str]) -> DataFrame:
    """Standing records of one level: key, birth, last_seq and the extra columns of the last write.

    writes: key, parent_key, seq, opens (may it begin a life), extra; tombs: key, seq;
    parent: parent_key, birth.
    """
    floors = tombs.groupBy(*key).agg(F.max("seq").alias("floor"))
    above = writes
    if parent is not None:
        above = above.join(parent.select(*parent_key, F.col("birth").alias("since")), parent_key).filter(F.col("seq") > F.col("since")).drop("since")
    above = above.join(floors, key, "left").filter(F.col("floor").isNull() | (F.col("seq") > F.col("floor")))
    carried = list(dict.fromkeys([*parent_key, *extra]))
    carried = [c for c in carried if c not in key]
    born = above.groupBy(*key).agg(
        F.min(F.when(F.col("opens"), F.col("seq"))).alias("birth"),
        F.max(F.struct("seq", *carried)).alias("last"),
    )
    return born.filter(F.col("birth").isNotNull()).select(*key, "birth", F.col("last.seq").alias("last_seq"), *[f"last.{c}" for c in carried])


#: Places of base rows before all changes; a parent comes before its children.
BASE_SEQ = {SESSION: -3, MESSAGE: -2, PART: -1}


def base_operations(base: DataFrame, payload: bool) -> DataFrame:
    """Rows of a table before the feed (aggregate_id, kind, record_id, parent_id[, payload]) as its first writes."""
    kind, rid, up = F.col("kind"), F.col("record_id"), F.col("parent_id")
    seq = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in BASE_SEQ.items()]).cast("long")
    op = F.when(kind == SESSION, "session.created").when(kind == MESSAGE, "message.updated").otherwise("message.part.updated")
    delivery = [F.lit(False).alias("late"), F.lit(None).alias("received_at"), F.lit(None).alias("id")]
    ids = [F.when(kind == SESSION, rid).when(kind == MESSAGE, up).alias("sid"), F.when(kind == MESSAGE, rid).when(kind == PART, up).alias("mid"), F.when(kind == PART, rid).alias("pid")]
    return base.filter(kind.isin(*BASE_SEQ)).select("aggregate_id", seq.alias("seq"), *delivery, op.alias("op"), *ids, *(["payload"] if payload else []))


WRITES = {SESSION: ["session.created", "session.updated"], MESSAGE: ["message.updated"], PART: ["message.part.updated"]}
TOMBS = {SESSION: "session.deleted", MESSAGE: "message.removed", PART: "message.part.removed"}


def _of_op(by_kind: dict[str, Column]) -> Column:
    """The value for the kind of record that an operation is about, null for other operations."""
    return F.coalesce(*[F.when(F.col("op").isin(*WRITES[k], TOMBS[k]), v) for k, v in by_kind.items()])


def retained(events: DataFrame, before: DataFrame | None = None, base: DataFrame | None = None, payload: bool = True) -> DataFrame:
    """The operations that a later change may still need; before: those retained after the feed so far."""
    ops = operations(events, payload)
    for more in (before, base_operations(base, payload) if base is not None else None):
        ops = ops if more is None else ops.unionByName(more)
    kind = _of_op({k: F.lit(k) for k in WRITES})
    key = _of_op({SESSION: F.col("sid"), MESSAGE: F.col("mid"), PART: F.col("pid")})
    # A part names its session too, but hangs on its message.
    up_kind, up = _of_op({MESSAGE: F.lit(SESSION), PART: F.lit(MESSAGE)}), _of_op({MESSAGE: F.col("sid"), PART: F.col("mid")})
    ops = cut(first_delivered(ops).withColumns({"kind": kind, "key": key, "up_kind": up_kind, "up": up}).filter("key is not null"))
    tomb = F.col("op").isin(*TOMBS.values())
    floors = ops.filter(tomb).groupBy("aggregate_id", "kind", "key").agg(F.max("seq").alias("floor"))
    above = floors.select("aggregate_id", F.col("kind").alias("up_kind"), F.col("key").alias("up"), F.col("floor").alias("up_floor"))
    kept = ops.join(floors, ["aggregate_id", "kind", "key"], "left").join(above, ["aggregate_id", "up_kind", "up"], "left")
    alive = (F.col("floor").isNull() | (F.col("seq") > F.col("floor"))) & (F.col("up_floor").isNull() | (F.col("seq") > F.col("up_floor")))
    extra = ["payload"] if payload else []
    return kept.filter(F.when(tomb, F.col("seq") == F.col("floor")).otherwise(alive)).select("aggregate_id", "seq", *DELIVERY, *OPERATION, *extra)


def live(ops: DataFrame, payload: bool = False) -> DataFrame:
    """Records that stand after the operations: aggregate_id, kind, record_id, parent_id, last_seq[, payload]."""
    extra = ["payload"] if payload else []

    def of(rows: DataFrame, key: list[str], parents: list[str], opens: Column) -> DataFrame:
        rows = reduce(lambda d, c: d.filter(F.col(c).isNotNull()), dict.fromkeys([*key, *parents]), rows)
        return rows.select(*dict.fromkeys([*key, *parents, "seq", *extra]), opens.alias("opens"))

    s_key, m_key, p_key = ["aggregate_id", "sid"], ["aggregate_id", "mid"], ["aggregate_id", "pid"]
    writes = lambda kind: ops.filter(F.col("op").isin(*WRITES[kind]))
    tombs = lambda kind: ops.filter(F.col("op") == TOMBS[kind])
    sessions = fold_level(of(writes(SESSION), s_key, [], F.col("op") == "session.created"), tombs(SESSION), s_key, None, [], extra)
    messages = fold_level(of(writes(MESSAGE), m_key, s_key, F.lit(True)), tombs(MESSAGE), m_key, sessions, s_key, extra)
    parts = fold_level(of(writes(PART), p_key, m_key, F.lit(True)), tombs(PART), p_key, messages, m_key, extra)
    out = lambda df, kind, rid, parent: df.select("aggregate_id", F.lit(kind).alias("kind"), F.col(rid).alias("record_id"), parent.alias("parent_id"), "last_seq", *extra)
    return (
        out(sessions.filter(F.col("last_seq") >= F.col("birth")), SESSION, "sid", F.lit(None).cast("string"))
        .unionByName(out(messages, MESSAGE, "mid", F.col("sid")))
        .unionByName(out(parts, PART, "pid", F.col("mid")))
    )


def apply_changes(events: DataFrame, payload: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Records that exist after all changes: aggregate_id, kind, record_id, parent_id, last_seq[, payload].

    base: the records of a table before the feed; those that no change touched keep a negative last_seq.
    """
    ops = first_delivered(operations(events, payload)).drop(*DELIVERY)
    if base is not None:
        ops = ops.unionByName(base_operations(base, payload).drop(*DELIVERY))
    return live(cut(ops), payload)
