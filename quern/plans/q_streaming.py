"""Streaming forms of the window, session and stateful queries; each has the oracle of its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.q_usage import _E, minute, usage_facts
from quern.plans.registry import registry
from quern.streaming import replay, stateful

QUERIES, ORACLE, query = registry()


def facts(spark, d):
    return usage_facts(replay.read(spark, d, "events"))


@query("stream_a22_window_counts", f"WITH {_E} SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(cost) AS BIGINT) AS cost FROM e GROUP BY ALL")
def windows(spark, d):
    agg = facts(spark, d).withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    emitted = replay.run(agg.select(F.col("w.start").alias("start"), "event_type", "n", "cost"), "update")
    return replay.last_of(emitted, ["start", "event_type"]).select(minute("start").alias("start"), "event_type", "n", "cost")


@query("stream_r8_sessions")
def sessions(spark, d):
    """Closed sessions (gap two hours) per user; those still open when the stream ends aren't emitted."""
    agg = facts(spark, d).withWatermark("ts", "10 minutes").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return replay.run(agg.select("user_id", F.col("w.start").alias("start"), "events"), "append").select("user_id", minute("start").alias("start"), "events")


@query("stream_r10_rolling_budget", f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, ts, cost, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e),
f AS (SELECT user_id, n, ts AS anchor, cost AS total FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, CASE WHEN o.ts - f.anchor >= INTERVAL 24 HOUR THEN o.ts ELSE f.anchor END, CASE WHEN o.ts - f.anchor >= INTERVAL 24 HOUR THEN o.cost ELSE f.total + o.cost END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, strftime(max_by(anchor, n), '%Y-%m-%d %H:%M:%S') AS anchor, max_by(total, n) AS total FROM f GROUP BY user_id""")
def rolling(spark, d):
    folded = stateful.rolling_budget(facts(spark, d).select("user_id", F.unix_micros("ts").alias("at"), "cost"), 86_400)
    return replay.last_of(replay.run(folded, "update"), ["user_id"]).select("user_id", minute(F.timestamp_micros("anchor")).alias("anchor"), "total")


@query("stream_r2_replay_check", """WITH RECURSIVE o AS (SELECT aggregate_id, seq, row_number() OVER (PARTITION BY aggregate_id ORDER BY received_at, seq) AS n FROM sync_event WHERE seq IS NOT NULL AND received_at IS NOT NULL),
f AS (SELECT DISTINCT aggregate_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS latest, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS ignored, CAST(0 AS BIGINT) AS gaps FROM o
  UNION ALL SELECT o.aggregate_id, o.n, CASE WHEN seq = latest + 1 THEN seq ELSE latest END, applied + CASE WHEN seq = latest + 1 THEN 1 ELSE 0 END, ignored + CASE WHEN seq <= latest THEN 1 ELSE 0 END, gaps + CASE WHEN seq > latest + 1 THEN 1 ELSE 0 END
  FROM f JOIN o ON o.aggregate_id IS NOT DISTINCT FROM f.aggregate_id AND o.n = f.n + 1)
SELECT aggregate_id, max_by(latest, n) AS latest, max_by(applied, n) AS applied, max_by(ignored, n) AS ignored, max_by(gaps, n) AS gaps FROM f GROUP BY 1""")
def check(spark, d):
    rows = replay.read(spark, d, "sync_event").select("aggregate_id", "seq", F.unix_micros("received_at").alias("received"))
    return replay.last_of(replay.run(stateful.replay_check(rows), "update"), ["aggregate_id"])


@query("stream_r21_sticky_choice", """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS n FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, '' AS choice, CAST(-1 AS BIGINT) AS upto FROM o
  UNION ALL SELECT o.user_id, o.n, CASE WHEN t >= upto THEN event_type ELSE choice END, t + 86400000000 FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, max_by(choice, n) AS choice, max_by(upto, n) AS until FROM f GROUP BY 1""")
def sticky(spark, d):
    rows = facts(spark, d).select("user_id", F.unix_micros("ts").alias("at"), F.col("event_type").alias("choice"))
    return replay.last_of(replay.run(stateful.sticky(rows, 86_400), "update"), ["user_id"])


@query("stream_r7_typed_channel", "SELECT event_id FROM events WHERE event_type = 'error'")
def typed(spark, d):
    return replay.run(facts(spark, d).filter("event_type = 'error'").select("event_id"), "append").select("event_id")


@query("stream_r1_dedupe", "SELECT DISTINCT aggregate_id, seq FROM sync_event")
def dedupe(spark, d):
    rows = replay.read(spark, d, "sync_event").select("aggregate_id", "seq", "received_at").withWatermark("received_at", "400 days")
    return replay.run(rows.dropDuplicatesWithinWatermark(["aggregate_id", "seq"]).select("aggregate_id", "seq"), "append").select("aggregate_id", "seq")


@query("stream_u1_latest_wins", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def latest(spark, d):
    agg = replay.read(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    return replay.last_of(replay.run(agg, "update"), ["user_id", "event_type"])
