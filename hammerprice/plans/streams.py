"""Batch twins of the streaming operators: the same functions on a bounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..registry import query, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def stream_tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = streaming.daily(_events(spark, sf_dir), ["event_type"], "ts", "value")
    return d.select("event_type", F.to_date("window.start").alias("day"), "n", "low", "high")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start_at, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streaming.sessions(_events(spark, sf_dir), ["user_id"], "ts")
    return s.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start_at"), "n")


@query("""WITH d AS (SELECT event_type, unnest(list_transform(range(7), lambda k: CAST(ts AS DATE) - CAST(k AS INT))) AS start_day FROM events) SELECT event_type, start_day, count(*) AS n FROM d GROUP BY 1, 2""")
def stream_sliding_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streaming.sliding(_events(spark, sf_dir), ["event_type"], "ts", "value")
    return s.select("event_type", F.to_date("window.start").alias("start_day"), "n")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' AND value > 40 THEN 1 ELSE 0 END AS hard, CAST(floor(value) AS INT) % 5 AS soft FROM events),
g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER o >= 3600000000, false) AS rested FROM e WINDOW o AS (PARTITION BY user_id ORDER BY ts, hard, soft)),
r AS (SELECT *, sum(rested::INT) OVER (PARTITION BY user_id ORDER BY ts, hard, soft) AS run, CASE WHEN hard > 0 THEN 2 WHEN soft >= 3 THEN 1 END AS sign FROM g),
l AS (SELECT *, last_value(sign IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, hard, soft ROWS UNBOUNDED PRECEDING) AS last, lag(sign) OVER (PARTITION BY user_id, run ORDER BY ts, hard, soft) AS before FROM r)
SELECT event_id, CASE WHEN last = 2 THEN 'Cooldown' WHEN sign = 1 THEN 'Elevated' ELSE 'Normal' END AS state, CASE sign WHEN 2 THEN 'hard_challenge_signal' WHEN 1 THEN 'soft_risk_cluster' ELSE CASE WHEN before = 1 THEN 'clean_pass_after_elevated' END END AS reason FROM l""")
def risk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk state of each user after each of their events; an hour without one starts anew."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", ((F.col("event_type") == "error") & (F.col("value") > 40)).cast("int").alias("hard"), (F.floor("value").cast("int") % 5).alias("soft"))
    return streaming.risk_states(e, "user_id", "ts", "hard", "soft", "1 hour").select("event_id", "state", "reason")
