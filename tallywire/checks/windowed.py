"""Checks of the per-Window aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, HOUR, ORDER, check, events, us
from tallywire.operators.sequence import connection_quality
from tallywire.operators.windows import (
    bandwidth,
    conflicting_senders,
    consecutive_true,
    densify,
    distinct_per_group,
    missing_evidence,
    per_window_last,
    qos_status,
    querier_state,
    silence_states,
    spike,
    sync_conflict,
    unverified_spans,
    version_mismatch,
    window_counters,
)

BY = ["capture_id"]


def captured(spark, sf_dir, seconds=HOUR):
    """Events as packets of one capture: sizes, marks and addresses follow from the id."""
    return events(spark, sf_dir, seconds).withColumns(
        {
            "capture_id": F.lit("c"),
            "frame_bytes": F.col("event_id") % 1500 + 64,
            "is_multicast": F.col("event_type") == "view",
            "ecn": F.col("event_id") % 4,
            "kind": F.when(F.col("event_id") % 11 == 0, "pause").when(F.col("event_id") % 13 == 0, "pfc"),
            "src_ip": F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
        }
    )


H = "epoch_us(ts) // 3600000000 * 3600000000"
D = "epoch_us(ts) // 86400000000 * 86400000000"


def counters(spark, sf_dir):
    return window_counters(
        captured(spark, sf_dir),
        BY,
        retransmission=F.col("event_type") == "error",
        dispatched=F.col("event_type") != "click",
    )


@check(
    "window_counters",
    f"""
SELECT CAST({H} AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
  CAST(sum(event_id % 1500 + 64) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS multicast_packets,
  CAST(sum(CASE WHEN event_type = 'view' THEN event_id % 1500 + 64 ELSE 0 END) AS BIGINT) AS multicast_bytes,
  CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS unicast_packets,
  CAST(sum(CASE WHEN event_type <> 'view' THEN event_id % 1500 + 64 ELSE 0 END) AS BIGINT) AS unicast_bytes,
  CAST(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS ecn_marks,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS retransmissions,
  CAST(sum(CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pause_frames,
  CAST(sum(CASE WHEN event_id % 13 = 0 AND event_id % 11 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS pfc_frames,
  CAST(sum(CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END) AS BIGINT) AS dispatched
FROM events GROUP BY 1""",
)
def _window_counters(spark, sf_dir):
    return counters(spark, sf_dir).drop("capture_id").withColumn("window_start", F.unix_micros("window_start"))


@check(
    "rate_threshold",
    f"""
WITH c AS (SELECT {H} AS w, sum(event_id % 1500 + 64) AS b,
             sum(CASE WHEN event_type = 'view' THEN event_id % 1500 + 64 ELSE 0 END) AS m FROM events GROUP BY 1),
q AS (SELECT min({H}) AS first FROM events WHERE event_type = 'signup' AND value > 200)
SELECT CAST(w AS BIGINT) AS window_start, round(b * 8 / 3600.0 / 1000000.0, 9) AS mbps,
       round(m * 8 / 3600.0 / 1000000.0, 9) AS multicast_mbps,
       m * 8 / 3600.0 / 1000000.0 > 0.000004 AND coalesce((SELECT first FROM q) > w, true) AS high_multicast FROM c""",
)
def _rate_threshold(spark, sf_dir):
    queries = captured(spark, sf_dir).where((F.col("event_type") == "signup") & (F.col("value") > 200))
    out = bandwidth(counters(spark, sf_dir), queries, BY, seconds=HOUR, limit_mbps=0.000004)
    return out.select(
        us("window_start"),
        F.round("mbps", 9).alias("mbps"),
        F.round("multicast_mbps", 9).alias("multicast_mbps"),
        "high_multicast",
    )


@check(
    "distinct_by_group",
    f"""SELECT CAST({D} AS BIGINT) AS window_start, event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS streams
FROM events GROUP BY 1, 2""",
)
def _distinct_by_group(spark, sf_dir):
    out = distinct_per_group(events(spark, sf_dir, DAY), ["window_start", "event_type"], ["user_id"])
    return out.select(us("window_start"), "event_type", "streams")


@check(
    "tx_flow_count",
    """SELECT user_id, CAST(count(DISTINCT event_type || ':' || (event_id % 40)) AS BIGINT) AS tx_flows
FROM events WHERE event_type <> 'error' GROUP BY user_id""",
)
def _tx_flow_count(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type") != "error").withColumn("port", F.col("event_id") % 40)
    return distinct_per_group(ev, ["user_id"], ["event_type", "port"], "tx_flows")


def dense_counts(spark, sf_dir):
    counts = distinct_per_group(captured(spark, sf_dir), ["capture_id", "window_start"], ["user_id"])
    return densify(counts, BY, seconds=HOUR).na.fill(0, ["streams"])


DENSE_SQL = f"""
WITH c AS (SELECT {H} AS w, count(DISTINCT user_id) AS n FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(w) FROM c), (SELECT max(w) FROM c), 3600000000)) AS w),
d AS (SELECT g.w, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.w = c.w)"""


@check(
    "trailing_spike",
    DENSE_SQL
    + """,
t AS (SELECT w, n, count(*) OVER p AS k, sum(n) OVER p AS s FROM d WINDOW p AS (ORDER BY w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT CAST(w AS BIGINT) AS window_start, CAST(n AS BIGINT) AS streams,
       CAST(CASE WHEN k = 3 THEN s // 3 END AS BIGINT) AS trailing_mean,
       coalesce(k = 3 AND s // 3 > 0 AND n > s // 3 * 2, false) AS spike FROM t""",
)
def _trailing_spike(spark, sf_dir):
    out = spike(dense_counts(spark, sf_dir), by=BY)
    return out.select(us("window_start"), "streams", "trailing_mean", "spike")


@check(
    "consecutive_true",
    DENSE_SQL
    + """,
r AS (SELECT w, n, row_number() OVER (ORDER BY w) AS rn, n > 12 AS ok FROM d),
i AS (SELECT *, coalesce(max(CASE WHEN NOT ok THEN rn END) OVER (ORDER BY w), 0) AS since FROM r)
SELECT CAST(w AS BIGINT) AS window_start, CAST(CASE WHEN ok THEN rn - since ELSE 0 END AS BIGINT) AS run,
       ok AND rn - since >= 2 AS held FROM i""",
)
def _consecutive_true(spark, sf_dir):
    out = consecutive_true(dense_counts(spark, sf_dir), F.col("streams") > 12, 2, BY)
    return out.select(us("window_start"), "run", "held")


# A user is a source from its first row on; errors and purchases prove it alive for 12 hours.
@check(
    "unverified_keys",
    """
WITH ev AS (SELECT user_id, epoch_us(ts) AS t, event_type FROM events),
k AS (SELECT user_id, min(t) // 86400000000 * 86400000000 + 86400000000 AS first_end FROM ev GROUP BY user_id),
lastw AS (SELECT max(t) // 86400000000 * 86400000000 + 86400000000 AS last_end FROM ev),
g AS (SELECT user_id, unnest(generate_series(first_end, (SELECT last_end FROM lastw), 86400000000)) AS e FROM k),
x AS (SELECT g.user_id, g.e, max(ev.t) AS last FROM g LEFT JOIN ev ON ev.user_id = g.user_id
        AND ev.event_type IN ('error', 'purchase') AND ev.t < g.e GROUP BY 1, 2),
m AS (SELECT user_id, e, coalesce(e - last < 43200000000, false) AS alive FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS rn FROM m),
s AS (SELECT *, rn - coalesce(max(CASE WHEN alive THEN rn END) OVER (PARTITION BY user_id ORDER BY e), 0) AS run FROM r)
SELECT user_id, CAST(e AS BIGINT) AS window_end FROM s WHERE run >= 3""",
)
def _unverified_keys(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumn("src", F.col("user_id"))
    proof = ev.where(F.col("event_type").isin("error", "purchase"))
    sources = ev.select("src", "ts")
    last = ev.select(F.max("window_start")).scalar()
    spans = unverified_spans(sources, proof.select("src", "ts"), last, "src", "ts", DAY, 12 * HOUR, 3)
    each = F.explode(F.sequence(F.unix_micros("from_end"), F.unix_micros("to_end"), F.lit(DAY * 1_000_000).cast("bigint")))
    return spans.select(F.col("src").alias("user_id"), each.alias("window_end"))


@check(
    "multi_senders",
    f"""
WITH q AS (SELECT DISTINCT {H} AS w, '10.0.0.' || (user_id % 250) AS src_ip FROM events WHERE event_type = 'signup'),
a AS (SELECT DISTINCT {H} AS w FROM events WHERE event_type = 'view'),
n AS (SELECT w, count(*) AS c FROM q GROUP BY w HAVING count(*) >= 2)
SELECT CAST(q.w AS BIGINT) AS window_start, q.src_ip, CAST(n.c AS BIGINT) AS senders
FROM q JOIN n ON q.w = n.w WHERE q.w IN (SELECT w FROM a)""",
)
def _multi_senders(spark, sf_dir):
    ev = captured(spark, sf_dir)
    out = conflicting_senders(ev.where(F.col("event_type") == "signup"), ev.where(F.col("event_type") == "view"), BY)
    return out.select(us("window_start"), "src_ip", "senders")


@check(
    "sync_conflict",
    f"""
WITH s AS (SELECT user_id % 4 AS domain, {D} AS w, user_id % 10 AS sender,
             arg_max(CASE WHEN event_id % 5 = 4 THEN 255 ELSE event_id % 5 END, event_id) AS stratum
           FROM events WHERE event_type = 'click' GROUP BY 1, 2, 3)
SELECT CAST(domain AS BIGINT) AS domain, CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS senders,
       CAST(sum(CASE WHEN stratum = 0 THEN 1 ELSE 0 END) AS BIGINT) AS preferred,
       CASE WHEN sum(CASE WHEN stratum = 0 THEN 1 ELSE 0 END) >= 2 THEN 'error' ELSE 'warn' END AS level
FROM s GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def _sync_conflict(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).where(F.col("event_type") == "click").withColumns(
        {
            "domain": F.col("user_id") % 4,
            "sender": F.col("user_id") % 10,
            "stratum": F.when(F.col("event_id") % 5 < 4, F.col("event_id") % 5),
        }
    )
    out = sync_conflict(ev, ["domain", "window_start"], "sender", "stratum", ORDER)
    return out.select("domain", us("window_start"), "senders", "preferred", "level")


# General queries are the signups of low value; multicast is active in Windows with a view.
@check(
    "interval_silence",
    f"""
WITH q AS (SELECT {H} AS w, epoch_us(ts) AS t, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) // 1000000 AS i,
             event_id FROM events WHERE event_type = 'signup' AND value < 20),
p AS (SELECT w, max(t) AS last, arg_max(i, event_id) AS i FROM q GROUP BY w),
g AS (SELECT {H} AS w, bool_or(event_type = 'view') AS active FROM events GROUP BY 1),
j AS (SELECT g.w, g.active, last_value(p.last IGNORE NULLS) OVER o AS last, last_value(p.i IGNORE NULLS) OVER o AS i
      FROM g LEFT JOIN p ON g.w = p.w WINDOW o AS (ORDER BY g.w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, last IS NULL OR (w + 3600000000 - last) // 1000000 > coalesce(i * 2 + 10, 9000) AS absent FROM j)
SELECT CAST(w AS BIGINT) AS window_start, CAST(i AS BIGINT) AS interval_secs, coalesce(i > 3600, false) AS slow_queries,
       absent AS querier_absent, absent AND active AS penalised FROM s""",
)
def _interval_silence(spark, sf_dir):
    ev = captured(spark, sf_dir)
    windows = ev.groupBy(*BY, "window_start").agg(F.max(F.col("event_type") == "view").alias("active_multicast"))
    queries = ev.where((F.col("event_type") == "signup") & (F.col("value") < 20))
    out = querier_state(
        queries, windows, BY, "ts", ORDER, chunk=CHUNK, seconds=HOUR, advisory=3600, default_silence=9000
    )
    return out.select(us("window_start"), "interval_secs", "slow_queries", "querier_absent", "penalised")


@check(
    "state_and_event",
    f"""
WITH q AS (SELECT {H} AS w, arg_max(2 + user_id % 2, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1),
r AS (SELECT DISTINCT {H} AS w FROM events WHERE event_type = 'click'),
b AS (SELECT coalesce(q.w, r.w) AS w, q.v, r.w IS NOT NULL AS v3 FROM q FULL JOIN r ON q.w = r.w),
l AS (SELECT w, v3, last_value(v IGNORE NULLS) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM b)
SELECT CAST(w AS BIGINT) AS window_start, CAST(v AS BIGINT) AS querier_version FROM l WHERE v3 AND v = 2""",
)
def _state_and_event(spark, sf_dir):
    ev = captured(spark, sf_dir).withColumn("version", F.lit(2) + F.col("user_id") % 2)
    out = version_mismatch(
        ev.where(F.col("event_type") == "signup"), ev.where(F.col("event_type") == "click"), BY, order=ORDER
    )
    return out.select(us("window_start"), F.col("querier_version").cast("bigint").alias("querier_version"))


@check(
    "missing_evidence",
    f"""
WITH w AS (SELECT user_id, {D} AS w, bool_or(event_type = 'click') AS dev, bool_or(event_type = 'error') AS ptp,
             bool_or(event_type = 'signup') AS q FROM events GROUP BY 1, 2),
r AS (SELECT user_id, w, bool_or(dev) OVER o AS dev, bool_or(ptp) OVER o AS ptp, bool_or(q) OVER o AS q FROM w
      WINDOW o AS (PARTITION BY user_id ORDER BY w))
SELECT user_id, CAST(w AS BIGINT) AS window_start FROM r WHERE dev AND NOT ptp AND NOT q""",
)
def _missing_evidence(spark, sf_dir):
    flags = events(spark, sf_dir, DAY).groupBy("user_id", "window_start").agg(
        F.max(F.col("event_type") == "click").alias("device"),
        F.max(F.col("event_type") == "error").alias("ptp"),
        F.max(F.col("event_type") == "signup").alias("query"),
    )
    out = missing_evidence(flags, F.col("device"), [F.col("ptp"), F.col("query")], ["user_id"])
    return out.select("user_id", us("window_start"))


@check(
    "qos_status",
    f"""
WITH s AS (SELECT {H} AS w, user_id, sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS v FROM events GROUP BY 1, 2)
SELECT CAST(w AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS streams,
       CAST(sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad,
       CASE WHEN sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) = 0 THEN 'ok' ELSE 'violations' END AS qos FROM s GROUP BY 1""",
)
def _qos_status(spark, sf_dir):
    per = events(spark, sf_dir).groupBy("window_start", "user_id").agg(
        F.sum((F.col("value") > 150).cast("bigint")).alias("dscp_viol")
    )
    out = qos_status(per, ["window_start"])
    return out.select(us("window_start"), "streams", "bad", "qos")


# Dead after 2 days, pruned after 4; every Window end until then is classified.
@check(
    "silence_state",
    """
WITH a AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS w, max(epoch_us(ts)) AS last FROM events GROUP BY 1, 2),
hi AS (SELECT max(w) AS hi FROM a),
n AS (SELECT *, lead(w) OVER (PARTITION BY user_id ORDER BY w) AS nxt FROM a),
g AS (SELECT user_id, last, unnest(generate_series(w, coalesce(nxt - 86400000000, (SELECT hi FROM hi)), 86400000000)) AS w FROM n),
s AS (SELECT user_id, w, last, (w + 86400000000 - last) AS silent,
        (w - last) AS before FROM g)
SELECT user_id, CAST(w AS BIGINT) AS window_start, CAST(last AS BIGINT) AS last_ts,
       CASE WHEN silent // 1000000 >= 345600 THEN 'pruned' WHEN silent > 172800000000 THEN 'dead' ELSE 'live' END AS state
FROM s WHERE NOT (before // 1000000 >= 345600)""",
)
def _silence_state(spark, sf_dir):
    ev = events(spark, sf_dir, DAY)
    last = ev.select(F.max("window_start")).scalar()
    out = silence_states(
        per_window_last(ev, ["user_id"]),
        ["user_id"],
        seconds=DAY,
        dead=2 * DAY,
        prune=4 * DAY,
        until=last,
    )
    return out.select("user_id", us("window_start"), us("last_ts"), "state")


@check(
    "session_restart",
    """
WITH a AS (SELECT user_id, epoch_us(ts) // 86400000000 * 86400000000 AS w, max(epoch_us(ts)) AS last, count(*) AS n
           FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(last) OVER (PARTITION BY user_id ORDER BY w) AS before FROM a),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR (w - before) // 1000000 >= 86400 THEN 1 ELSE 0 END)
          OVER (PARTITION BY user_id ORDER BY w) AS session FROM p)
SELECT user_id, CAST(session AS BIGINT) AS session, CAST(min(w) AS BIGINT) AS first_window,
       CAST(sum(n) AS BIGINT) AS packets FROM s GROUP BY 1, 2""",
)
def _session_restart(spark, sf_dir):
    active = per_window_last(events(spark, sf_dir, DAY), ["user_id"])
    states = silence_states(active, ["user_id"], seconds=DAY, dead=DAY, prune=DAY)
    out = states.join(active.select("user_id", "window_start", "packets"), ["user_id", "window_start"])
    return out.groupBy("user_id", "session").agg(
        F.min(F.unix_micros("window_start")).alias("first_window"), F.sum("packets").alias("packets")
    )


@check(
    "tiered_quality",
    """
WITH c AS (SELECT user_id, sum(CASE WHEN event_type = 'error' AND value > 100 THEN 1 ELSE 0 END) AS rst,
             sum(CASE WHEN event_type = 'signup' AND value > 100 THEN 1 ELSE 0 END) AS fin,
             sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS retx FROM events GROUP BY 1)
SELECT user_id, CASE WHEN rst > 0 OR fin >= 2 THEN 'terminated' WHEN retx > 10 THEN 'critical'
                     WHEN retx > 2 THEN 'degrading' ELSE 'healthy' END AS quality FROM c""",
)
def _tiered_quality(spark, sf_dir):
    kind, high = F.col("event_type"), F.col("value") > 100
    per = events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if((kind == "error") & high).alias("rst"),
        F.count_if((kind == "signup") & high).alias("fin"),
        F.count_if(kind == "view").alias("retx"),
    )
    return per.select("user_id", connection_quality(F.col("rst"), F.col("fin"), F.col("retx")).alias("quality"))
