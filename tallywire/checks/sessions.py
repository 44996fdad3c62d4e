"""Checks of sessions (a key that comes back after silence starts afresh) and of the whole report over two captures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, HOUR, ORDER, check, events, us
from tallywire.checks.frames import synth_frames
from tallywire.checks.ordered import wrap_sql
from tallywire.operators.sequence import tcp_retransmissions
from tallywire.plans.health import stream_windows
from tallywire.plans.network import network_report
from tallywire.session import checkpoint_root

SILENCE = 6 * HOUR

_ROWS = f"""
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 * 3600000000 AS w, event_id % 65536 AS seq,
    (event_id * 31 % 997) * 48 AS rtp FROM events),
p AS (SELECT *, lag(seq) OVER o AS pseq, lag(us) OVER o AS pus, lag(rtp) OVER o AS prtp FROM s WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
f AS (SELECT *, pus IS NULL OR floor((w - pus) / 1000000.0) >= {SILENCE} AS fresh FROM p)"""


def _bursts(spark, sf_dir):
    i = F.col("event_id")
    return events(spark, sf_dir).withColumns(
        {"rtp_seq": i % 65536, "rtp_ts": (i * 31 % 997) * 48, "clock_hz": F.lit(48000.0), "ptime_ms": F.lit(1.0)}
    )


@check(
    "seq_session_restart",
    _ROWS
    + f""",
d AS (SELECT *, CASE WHEN NOT fresh THEN {wrap_sql('seq - pseq - 1', 16)} END AS delta FROM f)
SELECT user_id, CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS received,
  CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS lost, CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reorders,
  CAST(sum(CASE WHEN NOT fresh AND us - pus > 3600000000 THEN 1 ELSE 0 END) AS BIGINT) AS gap_events
FROM d GROUP BY user_id, w""",
)
def _seq_session_restart(spark, sf_dir):
    out = stream_windows(_bursts(spark, sf_dir), ["user_id"], ORDER, chunk=CHUNK, gap_ms=HOUR * 1000.0, prune=SILENCE)
    return out.select("user_id", us("window_start"), "received", "lost", "reorders", "gap_events")


# A seventh of the jitter: sums of whole microseconds would often end in a tie of the rounding.
@check(
    "jitter_session",
    _ROWS
    + f""",
n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS life,
  lead(w) OVER (PARTITION BY user_id ORDER BY us, event_id) AS next,
  CASE WHEN NOT fresh THEN abs((us - pus) / 1e6 - {wrap_sql('rtp - prtp', 32)} / 48000.0) END AS d FROM f),
l AS (SELECT *, list(d) FILTER (d IS NOT NULL) OVER (PARTITION BY user_id, life ORDER BY us, event_id) AS ds FROM n)
SELECT user_id, CAST(w AS BIGINT) AS window_start,
  round(1000 * list_reduce(list_concat([0.0], coalesce(ds, [])), lambda j, d: j + (d - j) / 16) / 7, 3) AS jitter_seventh
FROM l WHERE next IS NULL OR next <> w""",
)
def _jitter_session(spark, sf_dir):
    out = stream_windows(_bursts(spark, sf_dir), ["user_id"], ORDER, chunk=CHUNK, prune=SILENCE)
    return out.select("user_id", us("window_start"), F.round(F.col("jitter_ms") / 7, 3).alias("jitter_seventh"))


# The same ports are used again after two hours of silence; sequence numbers then start anywhere.
@check(
    "tcp_port_reuse",
    """
WITH s AS (SELECT user_id, event_id, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 * 3600000000 AS w, event_id * 37 % 5000 AS seq FROM events),
p AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS pus FROM s),
n AS (SELECT *, sum(CASE WHEN floor((w - pus) / 1000000.0) >= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS life FROM p),
t AS (SELECT *, row_number() OVER o AS rn, max(seq) OVER (PARTITION BY user_id, life ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM n WINDOW o AS (PARTITION BY user_id, life ORDER BY us, event_id))
SELECT user_id, CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
  CAST(sum(CASE WHEN seq < top AND rn > 2 THEN 1 ELSE 0 END) AS BIGINT) AS retransmissions FROM t GROUP BY user_id, w""",
)
def _tcp_port_reuse(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("tcp_seq", F.col("event_id") * 37 % 5000)
    out = tcp_retransmissions(ev, ["user_id"], ORDER, "tcp_seq", None, 32, CHUNK, ["window_start"], prune=2 * HOUR)
    return out.select("user_id", us("window_start"), "packets", "retransmissions")


# Two captures of different length; traffic is counted before the selection, and no capture has Windows after its end.
@check(
    "report_windows",
    """
WITH e AS (SELECT event_id, epoch_us(ts) AS us, 100 + event_id % 900 AS size FROM events),
a AS (SELECT 'c' AS capture_id, * FROM e UNION ALL
  SELECT 'd', * FROM e WHERE event_id % 3 = 0 AND us < (SELECT min(us) + (max(us) - min(us)) // 4 FROM e))
SELECT capture_id, CAST(us // 86400000000 * 86400000000 AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
  CAST(sum(size) AS BIGINT) AS bytes FROM a GROUP BY 1, 2""",
)
def _report_windows(spark, sf_dir):
    frames = synth_frames(spark, sf_dir).withColumn("wire_len", (100 + F.col("frame_no") % 900).cast("int"))
    span = frames.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    quarter = F.timestamp_micros(F.expr("unix_micros(a) + (unix_micros(b) - unix_micros(a)) div 4"))
    second = frames.where((F.col("frame_no") % 3 == 0) & (F.col("ts") < span.select(quarter).scalar()))
    both = frames.unionByName(second.withColumn("capture_id", F.lit("d")))
    root = f"{checkpoint_root(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    report = network_report(both, root, ["audio"], seconds=DAY).report
    return report.select("capture_id", us("window_start"), "traffic.packets", "traffic.bytes")
