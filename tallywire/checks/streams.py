"""Checks of the streaming forms: each runs over the whole events file and is read back from its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.checks.base import DAY, HOUR, check, table, utc
from tallywire.checks.ordered import wrap_sql
from tallywire.plans.scoring import Limits
from tallywire.session import checkpoint_root
from tallywire.streaming.carry import merged_metrics, stream_metrics
from tallywire.streaming.timers import ROCKSDB, stream_silence
from tallywire.streaming.windows import (
    close_windows,
    start,
    stream_first_seen,
    stream_window_counters,
    stream_window_totals,
)

D = "epoch_us(ts) // 86400000000 * 86400000000"


def run_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.withColumn("ts", utc("ts"))


def captured_stream(spark, sf_dir):
    i = F.col("event_id")
    return event_stream(spark, sf_dir).select(
        F.lit("c").alias("capture_id"),
        "event_type",
        "user_id",
        "ts",
        i.alias("frame_no"),
        "value",
        (i % 1500 + 64).alias("frame_bytes"),
        (F.col("event_type") == "view").alias("is_multicast"),
        (i % 4).alias("ecn"),
        F.lit(None).cast("string").alias("kind"),
        F.col("event_type").alias("protocol"),
    )


CLOSED = f"(SELECT max(epoch_us(ts)) FROM events) - 86400000000 >= {D} + 86400000000"


@check(
    "stream_window_counts",
    f"""SELECT CAST({D} AS BIGINT) AS window_start, event_type, CAST(count(*) AS BIGINT) AS packets,
  CAST(sum(event_id % 1500 + 64) AS BIGINT) AS bytes, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS multicast_packets,
  CAST(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS ecn_marks FROM events WHERE {CLOSED} GROUP BY 1, 2""",
)
def _stream_window_counts(spark, sf_dir):
    folder = run_folder(spark)
    out = stream_window_counters(captured_stream(spark, sf_dir), "1 day", ["event_type"], seconds=DAY)
    start(out, f"{folder}/out", f"{folder}/ck").awaitTermination()
    names = ["packets", "bytes", "multicast_packets", "ecn_marks"]
    return spark.read.parquet(f"{folder}/out").select(F.unix_micros("window_start").alias("window_start"), "event_type", *names)


@check("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _stream_first_seen(spark, sf_dir):
    folder = run_folder(spark)
    out = stream_first_seen(captured_stream(spark, sf_dir), ["user_id", "event_type"], "60 days")
    start(out.select("user_id", "event_type", "ts"), f"{folder}/out", f"{folder}/ck").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type")


def metrics_of_stream(spark: SparkSession, sf_dir: str, prune: float) -> DataFrame:
    folder = run_folder(spark)
    rows = captured_stream(spark, sf_dir).withColumns(
        {
            "rtp_seq": F.col("frame_no") % 65536,
            "rtp_ts": F.col("frame_no") * 240,
            "rtp_ssrc": F.col("event_type"),
            "clock_hz": F.lit(48000.0),
        }
    )
    stream_metrics(
        rows, f"{folder}/out", f"{folder}/state", f"{folder}/ck", ["user_id"], seconds=DAY, gap_ms=12 * HOUR * 1000, prune=prune
    ).awaitTermination()
    out = merged_metrics(spark.read.parquet(f"{folder}/out"), ["user_id"])
    return out.withColumn("window_start", F.unix_micros("window_start"))


@check(
    "stream_metrics",
    f"""
WITH s AS (SELECT user_id, {D} AS w, epoch_us(ts) AS t, ts, event_id, event_type, event_id % 65536 AS seq FROM events),
p AS (SELECT *, lag(seq) OVER o AS ps, lag(event_type) OVER o AS pe, lag(t) OVER o AS pt FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN ps IS NOT NULL THEN {wrap_sql('seq - ps - 1', 16)} END AS delta FROM p)
SELECT user_id, CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS received, CAST(sum(event_id % 1500 + 64) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reorders,
  CAST(sum(CASE WHEN t - pt > 43200000000 THEN 1 ELSE 0 END) AS BIGINT) AS gap_events,
  CAST(sum(CASE WHEN pe <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS ssrc_changes, CAST(max(t - pt) AS BIGINT) AS max_iat_us FROM d GROUP BY 1, 2""",
)
def _stream_metrics(spark, sf_dir):
    return metrics_of_stream(spark, sf_dir, 90 * DAY)


# The same with pruning: a user who was silent for two whole days when the Window began starts afresh.
@check(
    "stream_metrics_sessions",
    f"""
WITH s AS (SELECT user_id, {D} AS w, epoch_us(ts) AS t, ts, event_id, event_type, event_id % 65536 AS seq FROM events),
p AS (SELECT *, lag(seq) OVER o AS ps, lag(event_type) OVER o AS pe, lag(t) OVER o AS pt FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, pt IS NOT NULL AND floor((w - pt) / 1000000.0) < 172800 AS goes_on FROM p),
d AS (SELECT *, CASE WHEN goes_on THEN {wrap_sql('seq - ps - 1', 16)} END AS delta FROM f)
SELECT user_id, CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS received, CAST(sum(event_id % 1500 + 64) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reorders,
  CAST(sum(CASE WHEN goes_on AND t - pt > 43200000000 THEN 1 ELSE 0 END) AS BIGINT) AS gap_events,
  CAST(sum(CASE WHEN goes_on AND pe <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS ssrc_changes,
  CAST(max(CASE WHEN goes_on THEN t - pt END) AS BIGINT) AS max_iat_us FROM d GROUP BY 1, 2""",
)
def _stream_metrics_sessions(spark, sf_dir):
    return metrics_of_stream(spark, sf_dir, 2 * DAY)


# Transitions of users over closed Windows: dead after 2 days, pruned after 4 (or while the watermark allows).
@check(
    "stream_silence",
    f"""
WITH a AS (SELECT user_id, {D} AS w, max(epoch_us(ts)) AS last FROM events WHERE {CLOSED} GROUP BY 1, 2),
mark AS (SELECT max(epoch_us(ts)) - 86400000000 AS m FROM events),
n AS (SELECT *, lead(w) OVER (PARTITION BY user_id ORDER BY w) AS nxt, lag(last) OVER (PARTITION BY user_id ORDER BY w) AS before FROM a),
t AS (SELECT *, ((last + 172800000000) // 86400000000 + 1) * 86400000000 AS dead_at, (last + 431999999999) // 86400000000 * 86400000000 AS prune_at,
        coalesce(nxt, (SELECT m FROM mark)) AS stop FROM n)
SELECT user_id, CAST(w + 86400000000 AS BIGINT) AS at_us, 'live' AS state FROM t
  WHERE before IS NULL OR (before + 431999999999) // 86400000000 * 86400000000 <= w
UNION ALL SELECT user_id, CAST(dead_at AS BIGINT), 'dead' FROM t WHERE dead_at <= stop
UNION ALL SELECT user_id, CAST(prune_at AS BIGINT), 'pruned' FROM t WHERE prune_at <= stop""",
)
def _stream_silence(spark, sf_dir):
    folder = run_folder(spark)
    closed = stream_window_totals(captured_stream(spark, sf_dir), "1 day", ["user_id"], {}, seconds=DAY)
    rules = [("dead", 2 * DAY, True), ("pruned", 4 * DAY, False)]
    out = stream_silence(closed, ["user_id"], "user_id bigint", rules, DAY)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)  # read when the stream starts; the caller's session stays as it was
    try:
        start(out, f"{folder}/out", f"{folder}/ck").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{folder}/out")


@check(
    "stream_health",
    f"""
WITH a AS (SELECT {D} AS w, user_id, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS bad FROM events WHERE {CLOSED} GROUP BY 1, 2)
SELECT CAST(w AS BIGINT) AS window_start, CAST(100.0 - least(sum(CASE WHEN bad > 0 THEN 5.0 ELSE 0 END), 20.0) AS DOUBLE) AS score FROM a GROUP BY 1""",
)
def _stream_health(spark, sf_dir):
    folder = run_folder(spark)
    bad = {"dscp_viol": F.sum((F.col("value") > 100).cast("bigint"))}
    closed = stream_window_totals(captured_stream(spark, sf_dir), "1 day", ["user_id"], bad, seconds=DAY)
    close_windows(closed, f"{folder}/out", f"{folder}/ck", ["user_id"], Limits()).awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.unix_micros("window_start").alias("window_start"), "score")
