"""Checks of diagnostics, penalties, score and report sections, on events as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, HOUR, ORDER, check, events, table, us
from tallywire.checks.ordered import wrap_sql
from tallywire.checks.windowed import counters
from tallywire.operators.enrich import device_registry
from tallywire.operators.windows import densify, distinct_per_group
from tallywire.plans.health import health_report, stream_windows, with_silence
from tallywire.plans.report import window_report
from tallywire.plans.scoring import (
    Limits,
    device_list,
    health_score,
    infrastructure_deductions,
    order_streams,
    penalties,
    session_verdict,
    stream_diagnostics,
    unhealthy_only,
    worst_streams,
)

LIMITS = Limits(gap_events=1, dead_secs=3 * HOUR)
H = "epoch_us(ts) // 3600000000 * 3600000000"


def typed(spark, sf_dir):
    """Events as streams: key = event type, Window = one hour, wrong marks on values above 150."""
    return events(spark, sf_dir, HOUR).select(
        "event_type", *ORDER, *CHUNK, (F.col("value") > 150).alias("dscp_viol")
    )


def typed_streams(spark, sf_dir):
    ev = typed(spark, sf_dir)
    rows = stream_windows(ev, ["event_type"], ORDER, chunk=CHUNK, gap_ms=2 * HOUR * 1000)
    last = ev.select(F.max("window_start")).scalar()
    return with_silence(rows, ["event_type"], last, seconds=HOUR, dead=3 * HOUR, prune=24 * HOUR)


def hours(spark, sf_dir):
    return densify(typed(spark, sf_dir).select("window_start").distinct(), [], seconds=HOUR)


def report(spark, sf_dir):
    return health_report(typed_streams(spark, sf_dir), hours(spark, sf_dir), ["event_type"], limits=LIMITS)


_STREAMS = f"""
WITH r AS (SELECT event_type AS k, {H} AS w, epoch_us(ts) AS t, value,
             epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS iat FROM events),
a AS (SELECT k, w, max(t) AS last, sum(CASE WHEN iat > 7200000000 THEN 1 ELSE 0 END) AS gaps,
        sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS dscp FROM r GROUP BY 1, 2),
hi AS (SELECT max(w) AS hi, min(w) AS lo FROM a),
n AS (SELECT *, coalesce(lead(w) OVER (PARTITION BY k ORDER BY w) - 3600000000, (SELECT hi FROM hi)) AS stop FROM a),
g AS (SELECT k, last, gaps, dscp, w AS w0, unnest(generate_series(w, stop, 3600000000)) AS w FROM n),
s AS (SELECT k, w, last, CASE WHEN w = w0 THEN gaps ELSE 0 END AS gaps, CASE WHEN w = w0 THEN dscp ELSE 0 END AS dscp FROM g
      WHERE w = w0 OR (w - last) // 1000000 < 86400),
v AS (SELECT * FROM s WHERE (w + 3600000000 - last) // 1000000 < 86400),
d AS (SELECT k, w, 'signal_gap' AS code, CAST(gaps AS DOUBLE) AS value, 10.0 AS deduction, false AS critical FROM v WHERE gaps >= 1
  UNION ALL SELECT k, w, 'dscp', dscp, 5.0, false FROM v WHERE dscp > 0
  UNION ALL SELECT k, w, 'dead', (w + 3600000000 - last) / 1000000.0, 30.0, true FROM v WHERE w + 3600000000 - last > 10800000000),
p AS (SELECT w, code, count(*) AS n, least(sum(deduction), CASE code WHEN 'dscp' THEN 20.0 ELSE 1e9 END) AS deduction FROM d GROUP BY 1, 2),
hrs AS (SELECT unnest(generate_series(lo, hi, 3600000000)) AS w FROM hi),
b AS (SELECT w, deduction, CASE code WHEN 'dead' THEN '1silent: ' WHEN 'signal_gap' THEN '2signal gaps: ' ELSE '3incorrect DSCP: ' END || n AS bullet FROM p),
h AS (SELECT hrs.w, greatest(0.0, 100.0 - coalesce(sum(b.deduction), 0)) AS score,
        coalesce(string_agg(substr(bullet, 2), '; ' ORDER BY bullet), '') AS summary FROM hrs LEFT JOIN b ON hrs.w = b.w GROUP BY 1)"""


@check(
    "diagnostics_long",
    _STREAMS
    + """
SELECT k AS event_type, CAST(w AS BIGINT) AS window_start, code, round(CAST(value AS DOUBLE), 6) AS value,
       CAST(deduction AS DOUBLE) AS deduction, critical FROM d""",
)
def _diagnostics_long(spark, sf_dir):
    out = stream_diagnostics(typed_streams(spark, sf_dir), ["event_type", "window_start"], LIMITS)
    return out.select(
        "event_type", us("window_start"), "code", F.round("value", 6).alias("value"), "deduction", "critical"
    )


@check(
    "capped_penalties",
    _STREAMS
    + """
SELECT CAST(w AS BIGINT) AS window_start, code, CAST(n AS BIGINT) AS n, CAST(deduction AS DOUBLE) AS deduction FROM p""",
)
def _capped_penalties(spark, sf_dir):
    out = penalties(stream_diagnostics(typed_streams(spark, sf_dir), ["event_type", "window_start"], LIMITS))
    return out.select(us("window_start"), "code", "n", "deduction")


@check("health_score", _STREAMS + "SELECT CAST(w AS BIGINT) AS window_start, CAST(score AS DOUBLE) AS score, summary FROM h")
def _health_score(spark, sf_dir):
    return report(spark, sf_dir).select(us("window_start"), "score", F.array_join("summary", "; ").alias("summary"))


@check(
    "summary_bullets",
    _STREAMS + "SELECT CAST(w AS BIGINT) AS window_start, substr(bullet, 2) AS bullet FROM b",
)
def _summary_bullets(spark, sf_dir):
    return report(spark, sf_dir).select(us("window_start"), F.explode("summary").alias("bullet"))


@check(
    "unhealthy_windows",
    _STREAMS
    + f""" SELECT CAST(w AS BIGINT) AS window_start, CAST(score AS DOUBLE) AS score FROM h
WHERE summary <> '' OR w IN (SELECT {H} FROM events WHERE value > 120)""",
)
def _unhealthy_windows(spark, sf_dir):
    missing = events(spark, sf_dir).where(F.col("value") > 120)
    return unhealthy_only(report(spark, sf_dir), missing).select(us("window_start"), "score")


@check(
    "last_window_verdict",
    _STREAMS + "SELECT CAST(max(w) AS BIGINT) AS last_window, arg_max(score, w) >= 100 AS healthy FROM h",
)
def _last_window_verdict(spark, sf_dir):
    return session_verdict(report(spark, sf_dir)).select(us("last_window"), "healthy")


_INFRA = f"""
WITH f AS (SELECT {H} AS w, event_type AS code, user_id % 3 AS scope, count(*) AS n FROM events GROUP BY 1, 2, 3),
m AS (SELECT w, CASE code WHEN 'view' THEN 'ecn' WHEN 'click' THEN 'eee' WHEN 'error' THEN 'grandmaster_changed'
        WHEN 'signup' THEN 'tcp_critical' ELSE 'tcp_retransmissions' END AS code, n FROM f),
x AS (SELECT w, CASE code WHEN 'tcp_critical' THEN 'tcp_quality' ELSE code END AS code, n,
        CASE code WHEN 'ecn' THEN 2.0 * n WHEN 'eee' THEN 15.0 * n WHEN 'grandmaster_changed' THEN 10.0 * least(n, 3)
                  WHEN 'tcp_critical' THEN 15.0 * n ELSE 0.5 * n END AS d FROM m),
p AS (SELECT w, code, sum(n) AS n, least(sum(d), CASE code WHEN 'ecn' THEN 20.0 WHEN 'eee' THEN 30.0
        WHEN 'tcp_retransmissions' THEN 10.0 ELSE 1e9 END) AS deduction FROM x GROUP BY 1, 2)"""


def infrastructure(spark, sf_dir):
    kind = F.col("event_type")
    code = (
        F.when(kind == "view", "ecn")
        .when(kind == "click", "eee")
        .when(kind == "error", "grandmaster_changed")
        .when(kind == "signup", "tcp_critical")
        .otherwise("tcp_retransmissions")
    )
    ev = events(spark, sf_dir).select("window_start", code.alias("code"), (F.col("user_id") % 3).alias("scope"))
    factors = ev.groupBy("window_start", "code", "scope").agg(F.count(F.lit(1)).alias("n"))
    none = events(spark, sf_dir).where("event_type = 'none'").select("window_start", F.lit("x").alias("code"), F.lit(0.0).alias("deduction"))
    return penalties(none, infrastructure_deductions(factors))


@check(
    "infrastructure_penalties",
    _INFRA + "SELECT CAST(w AS BIGINT) AS window_start, code, CAST(n AS BIGINT) AS n, CAST(deduction AS DOUBLE) AS deduction FROM p",
)
def _infrastructure_penalties(spark, sf_dir):
    return infrastructure(spark, sf_dir).select(us("window_start"), "code", "n", "deduction")


@check(
    "infrastructure_score",
    _INFRA
    + "SELECT CAST(w AS BIGINT) AS window_start, CAST(greatest(0.0, 100.0 - sum(deduction)) AS DOUBLE) AS score FROM p GROUP BY 1",
)
def _infrastructure_score(spark, sf_dir):
    rows = infrastructure(spark, sf_dir)
    windows = events(spark, sf_dir).select("window_start").distinct()
    return health_score(rows, windows).select(us("window_start"), "score")


_RTP = f"""
WITH s AS (SELECT user_id AS k, epoch_us(ts) // 86400000000 * 86400000000 AS w, epoch_us(ts) AS t, ts, event_id, value,
  event_id % 65536 AS seq, (event_id * 240) % 4294967296 AS rtp, event_type AS ssrc FROM events),
p AS (SELECT *, lag(seq) OVER o AS pseq, lag(rtp) OVER o AS prtp, lag(ssrc) OVER o AS pssrc, lag(t) OVER o AS pt FROM s
      WINDOW o AS (PARTITION BY k ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN pseq IS NOT NULL THEN {wrap_sql('seq - pseq - 1', 16)} END AS delta,
        CASE WHEN prtp IS NOT NULL THEN {wrap_sql('rtp - prtp', 32)} END AS step FROM p),
m AS (SELECT k, w, count(*) AS received, sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS lost,
  sum(CASE WHEN delta < 0 THEN 1 ELSE 0 END) AS reorders,
  sum(CASE WHEN value > 5 AND (step < 480 OR step > 1440) THEN 1 ELSE 0 END) AS ts_disc,
  sum(CASE WHEN pssrc <> ssrc THEN 1 ELSE 0 END) AS ssrc_changes,
  sum(CASE WHEN t - pt > 43200000000 THEN 1 ELSE 0 END) AS gap_events, max(t - pt) AS max_iat_us,
  sum(event_id % 1500 + 64) AS bytes, max(t) AS last_us FROM d GROUP BY 1, 2)"""


def rtp_streams(spark, sf_dir):
    i = F.col("event_id")
    ev = events(spark, sf_dir, DAY).select(
        "user_id",
        *ORDER,
        *CHUNK,
        (i % 65536).alias("rtp_seq"),
        (i * 240 % (1 << 32)).alias("rtp_ts"),
        F.col("event_type").alias("rtp_ssrc"),
        F.lit(48000.0).alias("clock_hz"),
        F.lit(20.0).alias("ptime_ms"),
        (F.col("value") > 5).alias("clock_confirmed"),
        (i % 1500 + 64).alias("frame_bytes"),
    )
    return stream_windows(ev, ["user_id"], ORDER, chunk=CHUNK, gap_ms=12 * HOUR * 1000)


@check(
    "stream_windows",
    _RTP
    + """
SELECT k AS user_id, CAST(w AS BIGINT) AS window_start, CAST(received AS BIGINT) AS received, CAST(lost AS BIGINT) AS lost,
  CAST(reorders AS BIGINT) AS reorders, CAST(ts_disc AS BIGINT) AS ts_disc, CAST(ssrc_changes AS BIGINT) AS ssrc_changes,
  CAST(gap_events AS BIGINT) AS gap_events, CAST(max_iat_us AS BIGINT) AS max_iat_us, CAST(bytes AS BIGINT) AS bytes,
  CAST(last_us AS BIGINT) AS last_ts FROM m""",
)
def _stream_windows(spark, sf_dir):
    rows = rtp_streams(spark, sf_dir)
    names = ["received", "lost", "reorders", "ts_disc", "ssrc_changes", "gap_events", "max_iat_us", "bytes"]
    return rows.select("user_id", us("window_start"), *names, us("last_ts"))


# Jitter is a multiple of a negative power of two, so exact rounding ties occur; a tiny offset settles them alike.
@check(
    "window_jitter",
    """
WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) AS t, event_id * 240 AS rtp, epoch_us(ts) // 86400000000 * 86400000000 AS w FROM events),
d AS (SELECT *, coalesce(abs((t - lag(t) OVER o) / 1000000.0 - (rtp - lag(rtp) OVER o) / 48000.0), 0) AS d,
        row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, list(CAST(d AS DOUBLE) ORDER BY rn) AS ds FROM d GROUP BY 1),
e AS (SELECT user_id, w, max(rn) AS n FROM d GROUP BY 1, 2)
SELECT e.user_id, CAST(w AS BIGINT) AS window_start,
  round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), ds[2:n]), lambda j, x: j + (x - j) / 16.0) * 1000.0 + 1.37e-7, 3) AS jitter_ms
FROM e JOIN l ON e.user_id = l.user_id""",
)
def _window_jitter(spark, sf_dir):
    return rtp_streams(spark, sf_dir).select("user_id", us("window_start"), F.round(F.col("jitter_ms") + 1.37e-7, 3).alias("jitter_ms"))


_FAMILY = "CASE user_id % 5 WHEN 0 THEN 'AES67' WHEN 1 THEN 'Dante' WHEN 2 THEN 'NDI' WHEN 3 THEN 'ST2110' ELSE 'AVB' END"


@check(
    "ranked_order",
    f"SELECT DISTINCT user_id, {_FAMILY} AS family, CAST(user_id % 5 + 1 AS BIGINT) AS group_rank FROM events",
)
def _ranked_order(spark, sf_dir):
    u = F.col("user_id") % 5
    fam = F.when(u == 0, "AES67").when(u == 1, "Dante").when(u == 2, "NDI").when(u == 3, "ST2110").otherwise("AVB")
    streams = events(spark, sf_dir).select("user_id", fam.alias("family")).distinct()
    return order_streams(streams, ["user_id"])


@check(
    "worst_streams",
    f"""
WITH m AS (SELECT user_id, {H} AS w, sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS v FROM events GROUP BY 1, 2)
SELECT user_id, CAST(count(*) * 5.0 AS DOUBLE) AS deduction, CAST(count(*) AS BIGINT) AS conditions FROM m WHERE v > 0
GROUP BY 1 ORDER BY deduction DESC, user_id LIMIT 10""",
)
def _worst_streams(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("user_id", "window_start").agg(F.count_if(F.col("value") > 100).alias("dscp_viol"))
    return worst_streams(stream_diagnostics(rows, ["user_id", "window_start"]), ["user_id"], 10)


@check(
    "device_list",
    """
WITH reg AS (SELECT c_nationkey AS k, max(c_custkey) AS last_seen FROM customer GROUP BY 1),
fl AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000),
lv AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000),
tx AS (SELECT s_nationkey AS k, count(DISTINCT s_suppkey % 7) AS n FROM supplier GROUP BY 1)
SELECT reg.k AS src_ip, CAST(last_seen AS BIGINT) AS last_seen, CASE WHEN lv.k IS NOT NULL THEN 'live'
  WHEN fl.k IS NOT NULL THEN 'flagged' ELSE 'verified' END AS state, CAST(coalesce(tx.n, 0) AS BIGINT) AS tx_flows
FROM reg LEFT JOIN fl ON reg.k = fl.k LEFT JOIN lv ON reg.k = lv.k LEFT JOIN tx ON reg.k = tx.k""",
)
def _device_list(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("src_ip"), F.col("c_custkey").alias("ts"), F.col("c_name").alias("name")
    )
    s = table(spark, sf_dir, "supplier").withColumn("src_ip", F.col("s_nationkey"))
    flows = distinct_per_group(s.withColumn("port", F.col("s_suppkey") % 7), ["src_ip"], ["port"], "tx_flows")
    out = device_list(
        device_registry([c]), s.where(F.col("s_acctbal") < 3000), s.where(F.col("s_acctbal") > 8000), flows
    )
    return out.select("src_ip", "last_seen", "state", "tx_flows")


@check(
    "window_report",
    _STREAMS
    + f""",
c AS (SELECT {H} AS w, count(*) AS packets, sum(event_id % 1500 + 64) AS bytes FROM events GROUP BY 1),
l AS (SELECT {H} AS w, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2),
t AS (SELECT w, sum(n) AS n, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS labels FROM l GROUP BY 1)
SELECT CAST(h.w AS BIGINT) AS window_start, CAST(h.score AS DOUBLE) AS score, CAST(c.packets AS BIGINT) AS packets, CAST(c.bytes AS BIGINT) AS bytes,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_streams, t.labels FROM h LEFT JOIN c ON h.w = c.w LEFT JOIN t ON h.w = t.w""",
)
def _window_report(spark, sf_dir):
    capture = F.lit("c").alias("capture_id")
    counts = counters(spark, sf_dir)
    labels = distinct_per_group(
        events(spark, sf_dir).select(capture, "window_start", F.col("event_type").alias("protocol"), "user_id"),
        ["capture_id", "window_start", "protocol"],
        ["user_id"],
    )
    out = window_report(counts, report(spark, sf_dir).withColumn("capture_id", F.lit("c")), labels)
    shown = F.transform("streams", lambda s: F.concat(s["protocol"], F.lit("="), s["streams"].cast("string")))
    return out.select(
        us("window_start"), "score", "traffic.packets", "traffic.bytes", "n_streams", F.array_join(shown, ",").alias("labels")
    )
