"""Streams drained over the events table, each against its batch twin in SQL: windows that the watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.plans.base import query
from recollect.streaming import flows as Z
from recollect.streaming import nudges as N


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
    GROUP BY CAST(ts AS DATE), event_type HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def z_tumbling_windows(spark, d):
    out = Z.drain(Z.windowed(Z.events(spark, d)))
    return out.select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT CAST(s AS VARCHAR) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events)
    WHERE s + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) GROUP BY 1, 2""")
def z_sliding_windows(spark, d):
    out = Z.drain(Z.windowed(Z.events(spark, d), "2 days", "1 day"))
    return out.select(F.col("w.start").cast("string").alias("start"), "event_type", "n")


@query("""SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)) GROUP BY 1""")  # fmt: skip
def z_session_windows(spark, d):
    out = Z.drain(Z.session_windows(Z.events(spark, d)))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def z6_dedup_within_watermark(spark, d):
    return Z.drain(Z.deduplicated(Z.events(spark, d), ["user_id", "event_type"])).select("user_id", "event_type")


@query("""SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'signup')""")
def z4_capture_gate(spark, d):
    needs = lambda kind: F.when(kind == "view", 1).when(kind.isin("click", "signup"), 2).otherwise(4)
    return Z.drain(Z.gated(Z.events(spark, d), "metadata", needs)).select("event_id", "event_type")


@query("""SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'purchase') AS saves, count(*) FILTER (after) > 6 AS nudge FROM
    (SELECT *, row_number() OVER w > coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 END * k) OVER (PARTITION BY user_id), 0) AS after FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
     WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1""")  # fmt: skip
def z3_session_activity(spark, d):
    out = Z.drain(Z.activity(Z.events(spark, d)))
    return out.groupBy("user_id").agg(F.max_by(F.struct("calls", "saves", "nudge"), "calls").alias("v")).select("user_id", "v.*")


@query("""SELECT user_id, CAST(due AS VARCHAR) AS due FROM (SELECT user_id, ref + INTERVAL 6 HOUR AS due, lead(ref) OVER (PARTITION BY user_id ORDER BY ref) AS next, is_save,
      (SELECT count(*) FROM events c WHERE c.user_id = r.user_id AND c.event_type <> 'purchase' AND c.ts <= r.ref + INTERVAL 6 HOUR) AS early,
      (SELECT max(date_trunc('second', ts)) FROM events c WHERE c.user_id = r.user_id) AS last
      FROM (SELECT user_id, ref, bool_or(save) AS is_save FROM (SELECT user_id, date_trunc('second', ts) AS ref, true AS save FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT user_id, date_trunc('second', min(ts)), false FROM events GROUP BY 1) GROUP BY 1, 2) r)
    WHERE (next IS NULL OR next > due) AND (is_save OR early > 5) AND (due <= (SELECT max(ts) - INTERVAL 2 DAY FROM events) OR due < last) GROUP BY 1, 2""")  # fmt: skip
def z3_idle_nudges(spark, d):
    """When each user was to be reminded to save: six hours after a save, or after many first calls, with none since. Four batches in order of time."""
    e = Z.table_events(spark, d).withColumn("ts", F.date_trunc("second", "ts"))
    first, last = e.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    part = F.least(F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1)), F.lit(3))
    out = Z.drain(N.nudges(Z.staged(e.withColumn("part", part), "part")))
    return out.select("user_id", F.col("due").cast("string").alias("due"))
