"""Usage roll-ups, pivots, windows and alerts over events (user = workspace, event_type = model, value in cents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import usage
from quern.plans.registry import registry
from quern.sources.tables import events, lineitem, orders, table

QUERIES, ORACLE, query = registry()

_E = "e AS (SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS cost, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


def usage_facts(e: DataFrame) -> DataFrame:
    """Events as usage: cost in cents, k from the properties."""
    return e.select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cost"), F.get_json_object("props", "$.k").cast("int").alias("k"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return usage_facts(events(spark, d))


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def minute(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("usage_a6_daily_cost", f"WITH {_E} SELECT strftime(ts - INTERVAL 300 MINUTE, '%Y-%m-%d') AS day, event_type, k % 4 AS plan, CAST(sum(cost) AS BIGINT) AS cost FROM e GROUP BY ALL")
def a6(spark, d):
    f = facts(spark, d)
    return f.groupBy(day(usage.local_date(F.col("ts"), -300)).alias("day"), "event_type", (F.col("k") % 4).alias("plan")).agg(F.sum("cost").alias("cost"))


@query("usage_a7_weekly_spend", f"WITH {_E} SELECT user_id, CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS week, CAST(sum(cost) AS BIGINT) AS cost FROM e GROUP BY ALL")
def a7(spark, d):
    return facts(spark, d).groupBy("user_id", usage.iso_week(F.col("ts")).alias("week")).agg(F.sum("cost").alias("cost"))


@query("usage_a8_complement_spend", f"WITH {_E} SELECT CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS week, CAST(sum(cost) FILTER (k < 50) AS BIGINT) AS plan, CAST(sum(cost) FILTER (k IS NULL OR k >= 50) AS BIGINT) AS other FROM e GROUP BY ALL")
def a8(spark, d):
    in_plan = F.coalesce(F.col("k") < 50, F.lit(False))
    return facts(spark, d).groupBy(usage.iso_week(F.col("ts")).alias("week")).agg(F.sum(F.when(in_plan, F.col("cost"))).alias("plan"), F.sum(F.when(~in_plan, F.col("cost"))).alias("other"))


@query("usage_a9_top_models", f"""WITH {_E}, s AS (SELECT user_id, event_type, CAST(sum(cost) AS BIGINT) AS cost FROM e GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY cost DESC, event_type) AS INTEGER) AS place, round(cost * 100.0 / sum(cost) OVER (PARTITION BY user_id), 1) AS percent FROM s) SELECT * FROM r WHERE place <= 3""")
def a9(spark, d):
    return usage.top_shares(facts(spark, d), "user_id", "event_type", "cost", 3)


@query("usage_a10_weekly_tokens", f"""WITH {_E} SELECT CAST(isoyear(ts) * 100 + weekofyear(ts) AS INTEGER) AS week, coalesce(CAST(sum(k) AS BIGINT), 0) AS input, coalesce(CAST(sum(k) FILTER (event_type = 'view') AS BIGINT), 0) AS cache_read,
coalesce(CAST(sum(k) FILTER (event_type = 'click') AS BIGINT), 0) + coalesce(CAST(sum(k) FILTER (event_type = 'none') AS BIGINT), 0) AS output FROM e GROUP BY ALL""")
def a10(spark, d):
    part = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("k"))), F.lit(0))
    return facts(spark, d).groupBy(usage.iso_week(F.col("ts")).alias("week")).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("input"), part("view").alias("cache_read"), (part("click") + part("none")).alias("output"))


WEEKS = [202401, 202402, 202403, 202404, 202405]


@query("usage_a11_week_pivot", "WITH " + _E + " SELECT event_type, " + ", ".join(f"CAST(sum(cost) FILTER (isoyear(ts) * 100 + weekofyear(ts) = {w}) AS BIGINT) AS w{w}" for w in WEEKS) + ", round(sum(cost) / 5.0, 2) AS per_week FROM e GROUP BY event_type")
def a11(spark, d):
    by = facts(spark, d).withColumn("week", usage.iso_week(F.col("ts"))).groupBy("event_type").pivot("week", WEEKS).agg(F.sum("cost"))
    total = sum((F.coalesce(F.col(str(w)), F.lit(0)) for w in WEEKS), F.lit(0))
    return by.select("event_type", *[F.col(str(w)).alias(f"w{w}") for w in WEEKS], F.round(total / 5.0, 2).alias("per_week"))


@query("usage_a12_grand_total", f"WITH {_E}, s AS (SELECT user_id, sum(cost) AS c FROM e GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS total, round(coalesce(sum(c) / nullif(count(*), 0), 0), 2) AS average FROM s")
def a12(spark, d):
    per = facts(spark, d).groupBy("user_id").agg(F.sum("cost").alias("c"))
    return per.agg(F.sum("c").alias("total"), F.round(F.coalesce(F.try_divide(F.sum("c"), F.count(F.lit(1))), F.lit(0.0)), 2).alias("average"))


@query("usage_a13_daily_rollup", f"""WITH {_E}, r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(cost) AS BIGINT) AS cost FROM e WHERE ts >= (SELECT max(ts) FROM e) - INTERVAL 28 DAY GROUP BY 1)
SELECT * FROM r UNION ALL SELECT 'TOTAL', NULL, NULL, CAST(sum(cost) AS BIGINT) FROM r""")
def a13(spark, d):
    f = facts(spark, d)
    now = f.agg(F.max("ts").alias("now"))
    recent = f.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 28 DAYS"))
    cube = recent.rollup(day("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"), F.sum("k").alias("tokens"), F.sum("cost").alias("cost"))
    total = F.col("day").isNull()
    return cube.select(F.coalesce("day", F.lit("TOTAL")).alias("day"), F.when(~total, F.col("requests")).alias("requests"), F.when(~total, F.col("tokens")).alias("tokens"), "cost")


@query("usage_a15_running_usage", f"WITH {_E} SELECT event_id, CAST(sum(cost) OVER w AS BIGINT) AS total, cost AS last, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def a15(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return facts(spark, d).select("event_id", F.sum("cost").over(w).alias("total"), F.col("cost").alias("last"), F.count(F.lit(1)).over(w).alias("n"))


@query("usage_a16_status_histogram", "SELECT o_orderpriority AS scope, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS live, count(*) FILTER (o_orderstatus = 'F') AS deleted, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'O') AS BIGINT) AS open_cents FROM orders GROUP BY 1")
def a16(spark, d):
    dead = F.col("o_orderstatus") == "F"
    return orders(spark, d).groupBy(F.col("o_orderpriority").alias("scope")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~dead, 1)).alias("live"), F.count(F.when(dead, 1)).alias("deleted"), F.sum(F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") * 100).cast("long"))).alias("open_cents")
    )


@query("usage_a20_daily_delta", """WITH s AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1)
SELECT day, total, total - lag(total) OVER (ORDER BY day) AS delta FROM s""")
def a20(spark, d):
    daily = lineitem(spark, d).groupBy(day("l_shipdate").alias("day")).agg(F.sum("l_quantity").cast("long").alias("total"))
    # One row per day: the ordered window has as many rows as the calendar has days.
    return daily.select("day", "total", (F.col("total") - F.lag("total").over(Window.orderBy("day"))).alias("delta"))


_WIN = """g AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) - INTERVAL 1 DAY FROM events), (SELECT max(ts) FROM events), INTERVAL {slide} HOUR)) AS start)"""


@query("usage_a22_error_rate", f"""WITH {_E}, {_WIN.format(slide=2)} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, user_id % 5 AS model, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed,
round(CASE WHEN count(*) >= 20 THEN count(*) FILTER (event_type = 'error') / count(*) END, 6) AS rate FROM g JOIN e ON ts >= start AND ts < start + INTERVAL 6 HOUR GROUP BY ALL""")
def a22(spark, d):
    f = facts(spark, d).withColumn("model", F.col("user_id") % 5)
    w = usage.sliding(f, "ts", "6 hours", "2 hours", ["model"], total=F.count(F.lit(1)), failed=F.count(F.when(F.col("event_type") == "error", 1)))
    return w.select(minute("start").alias("start"), "model", "total", "failed", F.round(usage.guarded_ratio(F.col("failed"), F.col("total"), 20), 6).alias("rate"))


@query("usage_a23_two_sums_ratio", f"""WITH {_E}, {_WIN.format(slide=4)} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(cost) FILTER (event_type = 'view') AS BIGINT) AS viewed, CAST(sum(cost) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS shown,
round(CASE WHEN sum(cost) FILTER (event_type IN ('view', 'click')) >= 25000 THEN sum(cost) FILTER (event_type = 'view') / sum(cost) FILTER (event_type IN ('view', 'click')) END, 6) AS ratio FROM g JOIN e ON ts >= start AND ts < start + INTERVAL 12 HOUR GROUP BY ALL""")
def a23(spark, d):
    of = lambda *t: F.sum(F.when(F.col("event_type").isin(*t), F.col("cost")))
    w = usage.sliding(facts(spark, d), "ts", "12 hours", "4 hours", [], viewed=of("view"), shown=of("view", "click"))
    return w.select(minute("start").alias("start"), "viewed", "shown", F.round(usage.guarded_ratio(F.col("viewed"), F.col("shown"), 25000), 6).alias("ratio"))


@query("usage_a24_day_over_day", f"""WITH {_E}, c AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM e GROUP BY 1)
SELECT strftime(a.start, '%Y-%m-%d %H:%M:%S') AS start, a.n AS now, b.n AS before, round((a.n - b.n) * 100.0 / b.n, 4) AS increase FROM c a JOIN c b ON b.start = a.start - INTERVAL 24 HOUR WHERE (a.n - b.n) * 100.0 / b.n >= 10""")
def a24(spark, d):
    counts = facts(spark, d).groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")
    past = counts.select((F.col("start") + F.expr("INTERVAL 24 HOURS")).alias("start"), F.col("n").alias("before"))
    up = F.col("increase")
    return counts.join(past, "start").withColumn("increase", (F.col("n") - F.col("before")) * 100.0 / F.col("before")).filter(up >= 10).select(minute("start").alias("start"), F.col("n").alias("now"), "before", F.round(up, 4).alias("increase"))


@query("usage_p17_json_predicate", f"WITH {_E} SELECT user_id, count(*) AS n FROM e WHERE k IS NULL OR k <> 7 GROUP BY 1")
def p17(spark, d):
    k = F.get_json_object("props", "$.k")
    return events(spark, d).filter(k.isNull() | (k != "7")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("usage_p18_recent_days", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def p18(spark, d):
    return events(spark, d).filter(F.col("ts") >= F.expr("TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS")).select("event_id")


@query("usage_r8_debounced_batches", f"""WITH {_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS events, count(DISTINCT event_type) AS paths FROM s GROUP BY user_id, b""")
def r8(spark, d):
    f = facts(spark, d)
    w = f.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("events"), F.size(F.collect_set("event_type")).cast("long").alias("paths"))
    return w.select("user_id", minute("a").alias("first_seen"), minute("b").alias("last_seen"), "events", "paths")


@query("usage_r9_batch_builder", f"""WITH {_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM g)
SELECT user_id, event_type AS path, max_by(cost, ts) AS latest, count(*) AS seen FROM s GROUP BY user_id, b, event_type""")
def r9(spark, d):
    f = facts(spark, d)
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    run = F.sum("new").over(Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    batches = f.withColumn("new", F.when(gap < 7_200_000_000, 0).otherwise(1)).withColumn("b", run)
    return batches.groupBy("user_id", "b", "event_type").agg(F.max_by("cost", "ts").alias("latest"), F.count(F.lit(1)).alias("seen")).select("user_id", F.col("event_type").alias("path"), "latest", "seen")


@query("usage_r10_rolling_budget", f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, ts, cost, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e),
f AS (SELECT user_id, n, ts AS anchor, cost AS total FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, CASE WHEN o.ts - f.anchor >= INTERVAL 24 HOUR THEN o.ts ELSE f.anchor END, CASE WHEN o.ts - f.anchor >= INTERVAL 24 HOUR THEN o.cost ELSE f.total + o.cost END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, strftime(max_by(anchor, n), '%Y-%m-%d %H:%M:%S') AS anchor, max_by(total, n) AS total FROM f GROUP BY user_id""")
def r10(spark, d):
    f = usage.anchored_fold(facts(spark, d), "user_id", "ts", "cost", 86_400)
    return f.select("user_id", minute("anchor").alias("anchor"), "total")


@query("usage_r11_weekly_budget", f"WITH {_E} SELECT event_id, CAST(sum(cost) OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e")
def r11(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("week", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return facts(spark, d).select("event_id", F.sum("cost").over(w).alias("used"))


@query("usage_r12_monthly_budget", f"WITH {_E} SELECT event_id, CAST(sum(cost) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM e")
def r12(spark, d):
    w = Window.partitionBy("user_id", F.date_trunc("month", "ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return facts(spark, d).select("event_id", F.sum("cost").over(w).alias("used"))


@query("usage_r17_daily_counter", f"""WITH {_E}, c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM e GROUP BY ALL)
SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS lifetime FROM c""")
def r17(spark, d):
    counts = facts(spark, d).groupBy("user_id", day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("lifetime", F.sum("n").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


@query("usage_r18_minute_counter", f"WITH {_E} SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, count(*) AS n FROM e GROUP BY ALL")
def r18(spark, d):
    return facts(spark, d).groupBy("user_id", minute(F.date_trunc("minute", "ts")).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("usage_r19_minute_tokens", f"WITH {_E} SELECT event_type, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, CAST(sum(k) AS BIGINT) AS tokens FROM e GROUP BY ALL")
def r19(spark, d):
    return facts(spark, d).groupBy("event_type", minute(F.window("ts", "1 minute")["start"]).alias("minute")).agg(F.sum("k").alias("tokens"))


@query("usage_r20_lifetime_trial", f"WITH {_E} SELECT event_id FROM (SELECT event_id, sum(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM e) WHERE used < 500")
def r20(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return facts(spark, d).withColumn("used", F.sum("k").over(w)).filter("used < 500").select("event_id")


@query("usage_r27_alert_windows", f"""WITH {_E}, {_WIN.format(slide=2)} SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (event_type = 'error') AS failed FROM g JOIN e ON ts >= start AND ts < start + INTERVAL 6 HOUR GROUP BY ALL HAVING count(*) FILTER (event_type = 'error') >= 20""")
def r27(spark, d):
    w = usage.sliding(facts(spark, d), "ts", "6 hours", "2 hours", [], failed=F.count(F.when(F.col("event_type") == "error", 1)))
    return w.filter("failed >= 20").select(minute("start").alias("start"), "failed")


@query("usage_u10_counter_upsert", f"WITH {_E} SELECT user_id, event_type, CAST(sum(k) AS BIGINT) AS count FROM e GROUP BY ALL")
def u10(spark, d):
    f = facts(spark, d)
    base = f.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.sum("k").alias("count"))
    more = f.filter("event_id % 2 = 1").groupBy("user_id", "event_type").agg(F.sum("k").alias("count"))
    return base.unionByName(more).groupBy("user_id", "event_type").agg(F.sum("count").alias("count"))


@query("usage_f14_week_bounds", "SELECT DISTINCT strftime(date_trunc('week', ts), '%Y-%m-%d') AS start, strftime(date_trunc('week', ts) + INTERVAL 7 DAY, '%Y-%m-%d') AS stop FROM events")
def f14(spark, d):
    start = F.date_trunc("week", "ts")
    return events(spark, d).select(day(start).alias("start"), day(start + F.expr("INTERVAL 7 DAYS")).alias("stop")).distinct()


@query("usage_f20_iso_week_start", f"WITH {_E}, w AS (SELECT DISTINCT CAST(isoyear(ts) AS INTEGER) AS y, CAST(weekofyear(ts) AS INTEGER) AS n FROM e) SELECT y * 100 + n AS week, strftime(date_trunc('week', make_date(y, 1, 4)) + to_days(7 * (n - 1)), '%Y-%m-%d') AS start FROM w")
def f20(spark, d):
    week = usage.iso_week(F.col("ts"))
    weeks = events(spark, d).select(week.alias("week")).distinct()
    first = F.date_trunc("week", F.make_date((F.col("week") / 100).cast("int"), F.lit(1), F.lit(4)))
    return weeks.select("week", day(F.date_add(first, (F.col("week") % 100 - 1) * 7)).alias("start"))


@query("usage_f21_seconds_to_next_day", "SELECT event_id, CAST(ceil((86400000 - (epoch_us(ts) // 1000) % 86400000) / 1000.0) AS BIGINT) AS wait FROM events")
def f21(spark, d):
    return events(spark, d).select("event_id", F.ceil((86_400_000 - F.unix_millis("ts") % 86_400_000) / 1000).alias("wait"))


@query("usage_j7_join_plan", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def j7(spark, d):
    return table(spark, d, "customer").filter("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
