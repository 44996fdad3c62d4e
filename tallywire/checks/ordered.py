"""Checks of the ordered per-stream metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, HOUR, ORDER, check, events, table, us
from tallywire.functions.arith import block
from tallywire.operators.bitrate import elapsed_bitrate
from tallywire.operators.sequence import loss_rates, seq_gaps, tcp_retransmissions, ts_discontinuity, value_changes
from tallywire.operators.timing import (
    final_jitter,
    iat_stats,
    infer_step,
    jitter_ewma,
    latest_bitrate,
    presence_stats,
    rate_buckets,
    tcp_payload_estimate,
    timing_regularity,
)

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as packets of a connection, in chunks of a month of shipping: no task gets all lines of a large order."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", *LINE_ORDER)
    df = df.withColumn("l_shipdate", F.timestamp_seconds(F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * DAY))
    return df.withColumn("chunk", F.year("l_shipdate") * 12 + F.month("l_shipdate"))


def wrap_sql(x: str, bits: int) -> str:
    half, full = 1 << (bits - 1), 1 << bits
    return f"((((({x}) + {half}) % {full}) + {full}) % {full} - {half})"


def _gaps_sql(bits: int) -> str:
    return f"""
WITH s AS (SELECT l_orderkey, l_linenumber AS seq, lag(l_linenumber) OVER (PARTITION BY l_orderkey
             ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS prev FROM lineitem),
d AS (SELECT l_orderkey, CASE WHEN prev IS NOT NULL THEN {wrap_sql('seq - prev - 1', bits)} END AS delta FROM s)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS received,
       CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS lost,
       CAST(sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS BIGINT) AS reorders
FROM d GROUP BY l_orderkey"""


@check("seq_gaps", _gaps_sql(16))
def _seq_gaps(spark, sf_dir):
    return seq_gaps(lineitem(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "l_linenumber", 16, ["chunk"], []).select(
        "l_orderkey", "received", "lost", "reorders"
    )


@check("seq_gaps_wrap3", _gaps_sql(3))
def _seq_gaps_wrap3(spark, sf_dir):
    return seq_gaps(lineitem(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "l_linenumber", 3, ["chunk"], []).select(
        "l_orderkey", "received", "lost", "reorders"
    )


# An 8-bit counter per user that sometimes skips: event_id * 3 mod 256 within the user's own stream.
@check(
    "seq_gaps_8",
    f"""
WITH s AS (SELECT user_id, (event_id * 3) % 256 AS seq,
             lag((event_id * 3) % 256) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
d AS (SELECT user_id, CASE WHEN prev IS NOT NULL THEN {wrap_sql('seq - prev - 1', 8)} END AS delta FROM s)
SELECT user_id, CAST(count(*) AS BIGINT) AS received,
       CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS lost FROM d GROUP BY user_id""",
)
def _seq_gaps_8(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumn("seq", F.col("event_id") * 3 % 256)
    return seq_gaps(ev, ["user_id"], ORDER, "seq", 8, CHUNK, []).select("user_id", "received", "lost")


def _typed_seq(spark, sf_dir):
    # Each type's own counter: type rows lie event_id apart, so the id itself is a counter with many gaps.
    ev = events(spark, sf_dir, HOUR).withColumn("seq", F.col("event_id") % 65536)
    return seq_gaps(ev, ["event_type"], ORDER, "seq", 16, CHUNK, ["window_start"])


_TYPED = f"""
WITH s AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS window_start, event_id % 65536 AS seq,
             lag(event_id % 65536) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev FROM events),
d AS (SELECT *, CASE WHEN prev IS NOT NULL THEN {wrap_sql('seq - prev - 1', 16)} END AS delta FROM s),
w AS (SELECT event_type, window_start, count(*) AS received,
        sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS lost,
        sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS reorders FROM d GROUP BY event_type, window_start),
l AS (SELECT *, sum(received) OVER (PARTITION BY event_type ORDER BY window_start) AS lr,
        sum(lost) OVER (PARTITION BY event_type ORDER BY window_start) AS ll FROM w)"""


@check(
    "loss_pct_running",
    _TYPED
    + """
SELECT event_type, CAST(window_start AS BIGINT) AS window_start, CAST(lr AS BIGINT) AS lifetime_received,
       CAST(ll AS BIGINT) AS lifetime_lost, round(ll * 100.0 / (lr + ll), 6) AS lifetime_loss_pct FROM l""",
)
def _loss_pct_running(spark, sf_dir):
    out = loss_rates(_typed_seq(spark, sf_dir), ["event_type"])
    return out.select(
        "event_type",
        us("window_start"),
        "lifetime_received",
        "lifetime_lost",
        F.round("lifetime_loss_pct", 6).alias("lifetime_loss_pct"),
    )


@check(
    "seq_window",
    f"""
WITH s AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS window_start, event_id % 8 AS seq,
             lag(event_id % 8) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
d AS (SELECT *, CASE WHEN prev IS NOT NULL THEN {wrap_sql('seq - prev - 1', 3)} END AS delta FROM s),
w AS (SELECT user_id, window_start, count(*) AS received,
        sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS lost,
        sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS reorders FROM d GROUP BY user_id, window_start)
SELECT user_id, CAST(window_start AS BIGINT) AS window_start, CAST(received AS BIGINT) AS received,
       CAST(lost AS BIGINT) AS lost, CAST(reorders AS BIGINT) AS reorders,
       round(lost * 100.0 / (received + lost), 6) AS loss_pct,
       round(reorders * 100.0 / (received + lost), 6) AS reorder_pct FROM w""",
)
def _seq_window(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumn("seq", F.col("event_id") % 8)
    out = loss_rates(seq_gaps(ev, ["user_id"], ORDER, "seq", 3, CHUNK, ["window_start"]), ["user_id"])
    return out.select(
        "user_id",
        us("window_start"),
        "received",
        "lost",
        "reorders",
        F.round("loss_pct", 6).alias("loss_pct"),
        F.round("reorder_pct", 6).alias("reorder_pct"),
    )


@check(
    "iat_stats",
    """
WITH s AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS window_start, event_type,
             epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS iat FROM events)
SELECT user_id, CAST(window_start AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
       CAST(max(CASE WHEN event_type <> 'view' THEN iat END) AS BIGINT) AS max_iat_us,
       CAST(sum(CASE WHEN event_type <> 'view' AND iat > 21600000000 THEN 1 ELSE 0 END) AS BIGINT) AS gap_events
FROM s GROUP BY user_id, window_start""",
)
def _iat_stats(spark, sf_dir):
    known = F.col("event_type") != "view"
    out = iat_stats(
        events(spark, sf_dir, DAY), ["user_id"], ORDER, "ts", 6 * HOUR * 1000, known, CHUNK, ["window_start"]
    )
    return out.select("user_id", us("window_start"), "packets", "max_iat_us", "gap_events")


# The tiny offset settles exact rounding ties alike on both sides.
@check(
    "ewma_jitter",
    """
WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) AS us, event_id * 259 AS media FROM events),
p AS (SELECT *, lag(us) OVER w AS pus, lag(media) OVER w AS pm FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT user_id, ts, event_id, CASE WHEN pus IS NULL THEN 0.0
        ELSE abs((us - pus) / 1000000.0 - (media - pm)) END AS d FROM p),
l AS (SELECT user_id, count(*) AS n, list(d ORDER BY ts, event_id) AS ds FROM d GROUP BY user_id)
SELECT user_id, CAST(n AS BIGINT) AS packets,
       round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), ds[2:]), lambda j, x: j + (x - j) / 16.0) + 1.37e-8, 4) AS jitter FROM l""",
)
def _ewma_jitter(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumn("media", F.col("event_id") * 259)
    out = final_jitter(jitter_ewma(ev, ["user_id"], ORDER, "ts", "media", F.lit(1.0), 32, CHUNK), ["user_id"], CHUNK)
    return out.select("user_id", "packets", F.round(F.col("jitter") + 1.37e-8, 4).alias("jitter"))


@check(
    "step_discontinuity",
    f"""
WITH s AS (SELECT event_type, epoch_us(ts) // 3600000000 * 3600000000 AS window_start, (event_id * 240) % 4294967296 AS t,
             lag((event_id * 240) % 4294967296) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p, value FROM events),
d AS (SELECT *, CASE WHEN p IS NOT NULL THEN {wrap_sql('t - p', 32)} END AS step FROM s)
SELECT event_type, CAST(window_start AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
       CAST(sum(CASE WHEN value > 5 AND (step < 960 * 0.5 OR step > 960 * 1.5) THEN 1 ELSE 0 END) AS BIGINT) AS ts_disc
FROM d GROUP BY event_type, window_start""",
)
def _step_discontinuity(spark, sf_dir):
    ev = events(spark, sf_dir, HOUR).withColumns(
        {
            "t": F.col("event_id") * 240 % (1 << 32),
            "clock_hz": F.lit(48000.0),
            "ptime_ms": F.lit(20.0),
        }
    )
    out = ts_discontinuity(
        ev, ["event_type"], ORDER, "t", confirmed=F.col("value") > 5, chunk=CHUNK, keep=["window_start"]
    )
    return out.select("event_type", us("window_start"), "packets", "ts_disc")


@check(
    "infer_step_mode",
    """
WITH known(step, clock_hz, ptime_ms) AS (VALUES (48, 48000.0, 1.0), (24, 48000.0, 0.5), (96, 48000.0, 2.0),
  (192, 48000.0, 4.0), (384, 48000.0, 8.0), (480, 48000.0, 10.0), (960, 48000.0, 20.0), (12, 48000.0, 0.25),
  (6, 48000.0, 0.125), (441, 44100.0, 10.0), (882, 44100.0, 20.0)),
s AS (SELECT user_id, ts, event_id, (event_id // 150 * 6) AS t,
        lag(event_id // 150 * 6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
d AS (SELECT user_id, t - p AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
      FROM s WHERE t - p > 0),
c AS (SELECT user_id, i // 8 AS batch, step, count(*) AS n FROM d GROUP BY user_id, i // 8, step),
m AS (SELECT user_id, batch, step, sum(n) OVER (PARTITION BY user_id, batch) AS size,
        row_number() OVER (PARTITION BY user_id, batch ORDER BY n DESC, step) AS r FROM c),
h AS (SELECT m.user_id, m.batch, m.step, k.clock_hz, k.ptime_ms,
        row_number() OVER (PARTITION BY m.user_id ORDER BY m.batch) AS r
      FROM m JOIN known k ON m.step = k.step WHERE m.r = 1 AND m.size = 8)
SELECT user_id, CAST(batch AS BIGINT) AS batch, CAST(step AS BIGINT) AS step, CAST(clock_hz AS DOUBLE) AS clock_hz,
       CAST(ptime_ms AS DOUBLE) AS ptime_ms FROM h WHERE r = 1""",
)
def _infer_step_mode(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumn("t", block("event_id", 150) * 6)
    return infer_step(ev, ["user_id"], ORDER, "t", 32, 8, CHUNK)


@check(
    "value_changes",
    """
WITH s AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS window_start, event_type,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, CAST(window_start AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
       CAST(sum(CASE WHEN prev <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS changes
FROM s GROUP BY user_id, window_start""",
)
def _value_changes(spark, sf_dir):
    out = value_changes(events(spark, sf_dir, DAY), ["user_id"], ORDER, "event_type", CHUNK, ["window_start"])
    return out.select("user_id", us("window_start"), "packets", "changes")


@check(
    "rate_buckets",
    """
SELECT event_type, CAST(epoch_us(ts) // 3600000000 * 3600000000 AS BIGINT) AS bucket_start,
       CAST(sum(event_id % 1500) AS BIGINT) AS bytes,
       CAST(floor(sum(event_id % 1500) * 8 / 3600.0) AS BIGINT) AS bitrate_bps
FROM events GROUP BY 1, 2""",
)
def _rate_buckets(spark, sf_dir):
    out = rate_buckets(events(spark, sf_dir), ["event_type"], "ts", F.col("event_id") % 1500, HOUR)
    return out.select("event_type", us("bucket_start"), "bytes", "bitrate_bps")


@check(
    "latest_bitrate",
    """
WITH b AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, sum(greatest(event_id % 1500 - 40, 0)) AS bytes
           FROM events GROUP BY 1, 2)
SELECT user_id, CAST(floor(arg_max(bytes, h) * 8 / 3600.0) AS BIGINT) AS bitrate_bps FROM b GROUP BY user_id""",
)
def _latest_bitrate(spark, sf_dir):
    size = tcp_payload_estimate(F.col("event_id") % 1500)
    return latest_bitrate(rate_buckets(events(spark, sf_dir), ["user_id"], "ts", size, HOUR), ["user_id"])


_CV = """
WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS iat
           FROM events),
r AS (SELECT user_id, CAST(iat AS DOUBLE) AS iat, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
      FROM s WHERE iat > 0),
c AS (SELECT user_id, count(*) AS samples, stddev_pop(iat) / avg(iat) AS cv FROM r WHERE r <= 64 GROUP BY user_id)"""


@check(
    "cv_regularity",
    _CV
    + """
SELECT user_id, CAST(samples AS BIGINT) AS samples, CASE WHEN samples >= 16 THEN round(cv, 6) END AS cv,
       CASE WHEN samples >= 16 AND cv < 0.85 THEN 'metronomic' WHEN samples >= 16 AND cv > 1.05 THEN 'noisy' END AS regularity
FROM c""",
)
def _cv_regularity(spark, sf_dir):
    # Poisson arrivals have a coefficient near 1, so the band is moved there.
    out = timing_regularity(events(spark, sf_dir, DAY), ["user_id"], "ts", CHUNK, low=0.85, high=1.05)
    return out.select("user_id", "samples", F.round("cv", 6).alias("cv"), "regularity")


@check(
    "presence_stats",
    """
WITH s AS (SELECT user_id, event_id, event_type,
             epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS iat FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS packets, CAST(sum(event_id % 1500) AS BIGINT) AS bytes,
       CAST(max(iat) AS BIGINT) AS max_iat_us, bool_or(event_type = 'error' AND event_id % 7 = 0) AS rtp_seen
FROM s GROUP BY user_id""",
)
def _presence_stats(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumns(
        {
            "payload_len": F.col("event_id") % 1500,
            "rtp_seq": F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), F.col("event_id")),
        }
    )
    out = presence_stats(ev, ["user_id"], ORDER, chunk=CHUNK, keep=[])
    return out.select("user_id", "packets", "bytes", "max_iat_us", "rtp_seen")


@check(
    "running_max_regress",
    """
WITH s AS (SELECT l_orderkey, l_partkey AS seq, l_quantity,
  max(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS packets,
       CAST(sum(CASE WHEN seq < top AND rn > 2 AND l_quantity > 5 THEN 1 ELSE 0 END) AS BIGINT) AS retransmissions
FROM s GROUP BY l_orderkey""",
)
def _running_max_regress(spark, sf_dir):
    return tcp_retransmissions(
        lineitem(spark, sf_dir), ["l_orderkey"], LINE_ORDER, "l_partkey", F.col("l_quantity") <= 5, 32, ["chunk"]
    )


# One key has two thirds of all rows; sizes may be null.
@check(
    "elapsed_bitrate",
    """
WITH RECURSIVE p AS (SELECT CASE WHEN event_id % 3 > 0 THEN 0 ELSE user_id % 7 END AS k, epoch_us(ts) AS us, event_id,
    CASE WHEN event_id % 11 = 0 THEN 0 ELSE 60 + event_id % 1400 END AS size FROM events),
c AS (SELECT k, us, event_id, sum(size) OVER (PARTITION BY k ORDER BY us, event_id) AS upto FROM p),
n AS MATERIALIZED (SELECT k, us, arg_min(upto, event_id) AS upto FROM c GROUP BY 1, 2),
nx AS MATERIALIZED (SELECT a.k, a.us, b.us AS next FROM (SELECT k, us, us + 5400000000 AS due FROM n) a ASOF JOIN n b ON b.k = a.k AND a.due < b.us),
s AS (SELECT k, min(us) AS us, NULL::BIGINT AS prev FROM n GROUP BY k
  UNION ALL SELECT s.k, nx.next, s.us FROM s JOIN nx ON nx.k = s.k AND nx.us = s.us),
r AS (SELECT s.k, s.us, s.us - s.prev AS elapsed, n.upto - coalesce(lag(CASE WHEN s.prev IS NOT NULL THEN n.upto END) OVER (PARTITION BY s.k ORDER BY s.us), 0) AS bytes, s.prev
  FROM s JOIN n ON n.k = s.k AND n.us = s.us)
SELECT k, us AS ts, CAST(bytes AS BIGINT) AS bytes, CAST(elapsed AS BIGINT) AS elapsed_us,
  CAST(floor(CAST(bytes AS DOUBLE) * 8.0 / (CAST(elapsed AS DOUBLE) / 1e6)) AS BIGINT) AS bitrate_bps FROM r WHERE prev IS NOT NULL""",
)
def _elapsed_bitrate(spark, sf_dir):
    i = F.col("event_id")
    ev = events(spark, sf_dir, 6 * HOUR).withColumn("k", F.when(i % 3 > 0, 0).otherwise(F.col("user_id") % 7))
    size = F.when(i % 11 != 0, 60 + i % 1400)
    return elapsed_bitrate(ev, ["k"], ORDER, size=size, chunk=CHUNK, seconds=1.5 * HOUR, fan=4).select("k", us("ts"), "bytes", "elapsed_us", "bitrate_bps")
