"""Streams over the event facts: budgets, limits, alerts and batched sinks.

A query here reads the event table as a stream, runs it to the end of what there is, and gives the sink's table, so
that a stream and its batch form can be held against each other. State lives in the state store, by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from millrace.plans.registry import query
from millrace.sources.lake import Lake
from millrace.sources.scratch import shared_dir
from millrace.streaming import folds
from millrace.streaming.audit import AuditTrail

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def events(lake: Lake) -> DataFrame:
    """The events as a stream, with the columns of ``usage`` and a timestamp that a watermark accepts."""
    schema = lake.table("events").schema
    stream = lake.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{lake.sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("int")
    return stream.select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("feature"), F.greatest(F.lit(1), k).cast("long").alias("units"), "value", F.col("ts").cast("timestamp").alias("at")
    )


def finished(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Run a stream over all available input into files, and read those. State is in RocksDB, which holds more than an
    executor's memory."""
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/millrace/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, folds.PROVIDER)
    try:
        out = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        out.format("parquet").option("path", f"{base}/out").start().awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


#: A key without a row for so long is forgotten by folds that have no window of their own.
FORGET_S = 90 * 86400


@query(None)
def stream_usage_budget(lake: Lake, limit: int = 120, window_s: int = 3600) -> DataFrame:
    """Requests admitted or denied per user and feature against a sliding window, in which denied ones don't count."""
    schema = "id long, user_id long, feature string, units long, allowed boolean"
    return finished(folds.folded(events(lake), ["user_id", "feature"], folds.Budget(limit, window_s), schema))


@query(None)
def stream_fixed_window_limit(lake: Lake, limit: int = 3, window_s: int = 86400) -> DataFrame:
    """A counter per user that starts with the first request and resets a window after it."""
    return finished(folds.folded(events(lake), ["user_id"], folds.Window(limit, window_s), "id long, user_id long, allowed boolean"))


@query(None)
def stream_ip_backoff(lake: Lake, base_s: int = 60, most_s: int = 3600) -> DataFrame:
    """Errors as violations: the n-th blocks for base 2^(n-1) seconds, at most an hour; requests meanwhile are refused."""
    schema = "id long, user_id long, refused boolean, violations long"
    return finished(folds.folded(events(lake), ["user_id"], folds.Backoff(base_s, most_s, FORGET_S), schema))


#: Requests a minute by what is asked for.
PRESETS = {"signup": 5, "purchase": 10, "error": 30, "click": 60, "view": 120}


@query(None)
def stream_ip_presets(lake: Lake, per_minute: dict[str, int] | None = None, base_s: int = 60, most_s: int = 3600) -> DataFrame:
    """Requests per user and preset: over the preset's limit in a minute is a violation, and the n-th blocks for
    base 2^(n-1) seconds, at most an hour."""
    limits = PRESETS if per_minute is None else per_minute
    rows = events(lake).withColumnRenamed("feature", "preset")
    schema = "id long, user_id long, preset string, allowed boolean, violations long"
    return finished(folds.folded(rows, ["user_id", "preset"], folds.Preset(limits, base_s, most_s, FORGET_S), schema))


@query(
    """WITH h AS (SELECT event_type AS feature, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(greatest(1, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INT)) AS BIGINT) AS units, ts FROM events)
SELECT feature, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM h
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"""
)
def stream_hourly_usage(lake: Lake) -> DataFrame:
    """Closed hourly windows of each feature, ten minutes after their end."""
    hourly = events(lake).withWatermark("at", "10 minutes").groupBy(F.window("at", "1 hour"), "feature").agg(F.count("*").alias("n"), F.sum("units").alias("units"))
    out = finished(hourly.select("feature", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "units"))
    return out


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)"""
)
def stream_sessions(lake: Lake) -> DataFrame:
    """Closed sessions of a user, six hours without an event apart."""
    session = events(lake).withWatermark("at", "0 seconds").groupBy(F.session_window("at", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return finished(session.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"))


@query(
    """WITH s AS (SELECT event_id AS id, 'repo' || (event_id % 20) AS repo, CAST(least(100, greatest(0, floor(value + 0.5))) AS INT) AS health, ts FROM events),
l AS (SELECT *, lag(health) OVER (PARTITION BY repo ORDER BY ts, id) AS before FROM s)
SELECT id, repo, health, before - health AS fall FROM l WHERE before - health >= 10"""
)
def stream_score_drop(lake: Lake, least: int = 10) -> DataFrame:
    """Scores that fall against the last one seen of their repository."""

    health = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("value") + 0.5))).cast("int")
    scores = events(lake).select("id", F.concat(F.lit("repo"), F.col("id") % 20).alias("repo"), health.alias("health"), "at")
    return finished(folds.folded(scores, ["repo"], folds.Fall(least, FORGET_S), "id long, repo string, health long, fall long"))


@query("SELECT event_id AS id, user_id, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity FROM events")
def stream_audit_batch(lake: Lake) -> DataFrame:
    """Audit rows by two paths: critical ones at once, the rest every second here (five in service)."""
    rows = events(lake).select("id", "user_id", F.when(F.col("feature") == "error", "critical").otherwise("info").alias("severity"))
    trail = AuditTrail(rows, f"{shared_dir(lake.spark)}/millrace/audit-{uuid.uuid4().hex}", every="1 second").start()
    try:
        return trail.settle().read()
    finally:
        trail.stop()
