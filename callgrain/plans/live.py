"""Queries over streams, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.plans.registry import query
from callgrain.sources.records import Versions
from callgrain.sources.stores import scratch
from callgrain.streaming import operators as op
from callgrain.streaming import ordered

HOURS = """w AS (SELECT user_id, value, ts, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start_ts FROM events)"""


@query(f"""WITH {HOURS} SELECT user_id, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS start_ts, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY user_id, start_ts""")
def q_stream_windows(spark, sf_dir):
    rows = op.collected(op.sliding(op.events_stream(spark, sf_dir, ended=True), "2 hours", "1 hour", "1 hour"), "append")
    return rows.select("user_id", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), "n", F.round("total", 2).alias("total"))


@query("""WITH RECURSIVE r AS (SELECT user_id AS call_id, event_id, value / (1 + value) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
e AS (SELECT call_id, event_id, n, s AS smoothed FROM r WHERE n = 1 UNION ALL SELECT r.call_id, r.event_id, r.n, 0.4 * r.s + 0.6 * e.smoothed FROM e JOIN r ON r.call_id = e.call_id AND r.n = e.n + 1)
SELECT call_id, event_id, n, round(smoothed, 6) AS smoothed FROM e""")
def q_stream_ema(spark, sf_dir):
    events = op.events_stream(spark, sf_dir, ended=True)
    scores = events.select(F.col("user_id").alias("call_id"), "event_id", "t", (F.col("value") / (1 + F.col("value"))).alias("score"))
    rows = op.collected(ordered.smoothed(scores, "1 hour", idle_s=400 * 86400))
    return rows.select("call_id", "event_id", "n", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def q_stream_sessions(spark, sf_dir):
    return op.collected(op.sessions(op.events_stream(spark, sf_dir, ended=True), "6 hours", "1 hour"), "append").select("user_id", "n")


@query()
def q_stream_challenges(spark, sf_dir):
    """Sessions of the stand-in events: a sign-up starts one for three days, all else answers; views say no digits."""
    events, value = op.events_stream(spark, sf_dir, ended=True), F.col("value")
    rows = events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("response_id"), "t", F.when(F.col("event_type") == "signup", "start").otherwise("response").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "handset").otherwise("relay").alias("channel"), F.when(F.col("event_type") == "error", "wrong").alias("said"), (value / 10).alias("speech_s"), F.when(F.col("event_type") != "view", value / 200).alias("identity"),
    )
    return op.collected(ordered.challenges(rows, "1 hour", ttl_s=3 * 86400, keep_s=86400))


@query("SELECT event_id, round(value / (1 + value) * (1 + event_id % 2), 6) AS score, (1 + event_id % 2)::INT AS version FROM events")
def q_stream_hot_swap(spark, sf_dir):
    """Events come in two files, and between them another version is made the active one: each is scored by its own."""
    top = scratch(spark)
    events, versions = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value"), Versions(spark, f"{top}/models")
    for n in (0, 1):
        versions.add(0)
        versions.activate(n + 1)
        events.filter(F.col("event_id") % 2 == n).write.parquet(f"{top}/in/{n}")
        stream = spark.readStream.schema(events.schema).parquet(f"{top}/in/*")
        rows = op.swapped(stream, f"{top}/out", versions.current, lambda v: lambda batch: batch.withColumn("score", F.col("value") / (1 + F.col("value")) * v))
    return rows.select("event_id", F.round("score", 6).alias("score"), "version")
