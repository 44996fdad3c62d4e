"""Checks of state over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, HOUR, ORDER, check, events, us
from tallywire.operators.state import (
    alerts,
    clock_sessions,
    clock_state,
    clock_status,
    dependent_reset,
    entity_events,
    entity_registry,
    first_seen,
    path_delay,
    rearm_dedup,
)

H = "epoch_us(ts) // 3600000000 * 3600000000"


# A user is a clock domain; signups and clicks name a grandmaster, all rows keep the clock alive for six hours.
def clock_rows(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    return events(spark, sf_dir, HOUR).select(
        F.col("user_id").alias("domain"),
        *ORDER,
        *CHUNK,
        F.when(kind == "signup", "gm-a").when(kind == "click", F.concat(F.lit("gm-"), (i % 3).cast("string"))).alias(
            "grandmaster_id"
        ),
        (i % 4).alias("message_type"),
        F.when(i % 7 != 0, F.concat(F.lit("c"), (i % 50).cast("string"))).alias("clock_id"),
        (i % 3000 - 1500).alias("correction_ns"),
        F.when(kind == "view", (i * 7919) % 2000001 - 1000000).alias("path_delay_ns"),
        (F.col("value") > 40).alias("changed"),
    )


_CLOCK = f"""
WITH r AS (SELECT user_id, ts, event_id, epoch_us(ts) AS t, {H} AS w, event_id % 4 AS mt,
  CASE event_type WHEN 'signup' THEN 'gm-a' WHEN 'click' THEN 'gm-' || (event_id % 3) END AS gm,
  CASE WHEN event_id % 7 <> 0 THEN 'c' || (event_id % 50) END AS cid FROM events),
b AS (SELECT *, CASE WHEN coalesce(w - lag(t) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 21600000000, true)
        THEN 1 ELSE 0 END AS brk FROM r),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM b),
z AS (SELECT user_id, session, max(t) AS last, min(w) AS first_w, bool_or(gm IS NOT NULL) AS named FROM s GROUP BY 1, 2),
l AS (SELECT *, ((last + 21600000000) // 3600000000 + 1) * 3600000000 AS lost_at,
        coalesce(lead(first_w) OVER (PARTITION BY user_id ORDER BY session), (SELECT max(w) + 3600000000 FROM r)) AS stop FROM z)"""


@check(
    "state_transitions",
    _CLOCK
    + """,
g AS (SELECT user_id, session, t, gm, lag(gm) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS p FROM s WHERE gm IS NOT NULL)
SELECT user_id AS domain, CAST(t AS BIGINT) AS ts, CASE WHEN p IS NULL THEN 'detected' ELSE 'changed' END AS event, gm, p AS from_gm
FROM g WHERE p IS NULL OR p <> gm
UNION ALL SELECT user_id, CAST(lost_at AS BIGINT), 'lost', NULL, NULL FROM l WHERE named AND lost_at <= stop""",
)
def _state_transitions(spark, sf_dir):
    rows = clock_rows(spark, sf_dir)
    until = rows.select(F.max("window_start")).scalar()
    out = clock_state(rows, ["domain"], ORDER, chunk=CHUNK, seconds=HOUR, timeout=6 * HOUR, until=until)
    return out.select("domain", us("ts"), "event", "gm", "from_gm")


@check(
    "session_detect",
    _CLOCK
    + """
SELECT user_id AS domain, CAST(session AS BIGINT) AS session, CAST(first_w AS BIGINT) AS first_window,
       CAST(CASE WHEN lost_at <= stop THEN lost_at END AS BIGINT) AS lost_at FROM l""",
)
def _session_detect(spark, sf_dir):
    rows = clock_rows(spark, sf_dir)
    until = rows.select(F.max("window_start")).scalar()
    out = clock_sessions(rows, ["domain"], seconds=HOUR, timeout=6 * HOUR, until=until)
    return out.groupBy("domain", "session").agg(
        F.min(F.unix_micros("window_start")).alias("first_window"),
        F.max_by(F.unix_micros("lost_at"), "window_start").alias("lost_at"),
    )


@check(
    "clock_status",
    _CLOCK
    + """,
k AS (SELECT user_id, count(*) AS n, bool_or(mt = 0) AS sync, arg_max(cid, event_id) FILTER (WHERE cid IS NOT NULL) AS cid,
        arg_max(gm, event_id) FILTER (WHERE gm IS NOT NULL) AS gm, arg_max(session, event_id) FILTER (WHERE gm IS NOT NULL) AS gs,
        max(session) AS session, arg_max(event_id % 3000 - 1500, event_id) FILTER (WHERE mt = 0) AS corr FROM s GROUP BY 1),
j AS (SELECT k.*, k.gs IS NOT NULL AND k.gs = k.session AND NOT (l.lost_at <= l.stop) AS cur
      FROM k JOIN l ON k.user_id = l.user_id AND k.session = l.session)
SELECT user_id AS domain, CAST(n AS BIGINT) AS packets, CASE WHEN cur THEN 'valid' WHEN gs IS NOT NULL THEN 'lost'
  WHEN cid IS NULL THEN 'no_clock' WHEN sync THEN 'sync_only' ELSE 'peer_delay_only' END AS status, cid AS clock_id,
  CASE WHEN cur THEN gm END AS grandmaster_id, CAST(corr AS BIGINT) AS correction_ns, coalesce(abs(corr) > 1000, false) AS large_correction
FROM j""",
)
def _clock_status(spark, sf_dir):
    rows = clock_rows(spark, sf_dir)
    until = rows.select(F.max("window_start")).scalar()
    sessions = clock_sessions(rows, ["domain"], seconds=HOUR, timeout=6 * HOUR, until=until)
    return clock_status(rows, sessions, ["domain"], ORDER)


@check(
    "minmax_by_epoch",
    """
WITH r AS (SELECT user_id, event_type, abs((event_id * 7919) % 2000001 - 1000000) AS d,
  sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
m AS (SELECT user_id, epoch, min(d) AS lo, max(d) AS hi, count(*) AS n FROM r WHERE event_type = 'view' GROUP BY 1, 2)
SELECT user_id AS domain, CAST(epoch AS BIGINT) AS epoch, CAST(lo AS BIGINT) AS min_ns, CAST(hi AS BIGINT) AS max_ns,
  CAST(n AS BIGINT) AS samples, hi - lo > 100000 AS unstable, hi > 900000 AS too_many_hops, CAST(lo // 5000 AS BIGINT) AS hops FROM m""",
)
def _minmax_by_epoch(spark, sf_dir):
    rows = clock_rows(spark, sf_dir)
    return path_delay(rows, F.col("changed"), ["domain"], ORDER, CHUNK, unstable_ns=100_000, far_ns=900_000)


# Entities are users; errors depart, views discover, the rest announce. Valid times are in hours here.
def adp_rows(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir, HOUR).select(
        F.col("user_id").alias("entity_id"),
        *ORDER,
        *CHUNK,
        F.when(kind == "error", 1).when(kind == "view", 2).otherwise(0).alias("message_type"),
        (F.col("event_id") % 2).alias("available_index"),
        (F.col("event_id") % 31).alias("valid_time_secs"),
    )


_ADP = f"""
WITH r AS (SELECT user_id, ts, event_id, epoch_us(ts) AS t, {H} AS w, event_type = 'error' AS del, event_id % 2 AS idx,
             greatest(event_id % 31, 10) + 10 AS lim FROM events WHERE event_type <> 'view')"""


@check(
    "upsert_delete",
    _ADP
    + """,
p AS (SELECT *, lag(t) OVER o AS pt, lag(del) OVER o AS pdel, lag(idx) OVER o AS pidx, lag(lim) OVER o AS plim FROM r
      WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT *, coalesce(NOT pdel AND floor((w - pt) / 3600000000.0) < plim, false) AS alive FROM p),
e AS (SELECT *, CASE WHEN del AND alive THEN 'departed' WHEN del THEN NULL WHEN NOT alive THEN 'new' WHEN idx <> pidx THEN 'changed' END AS event FROM a)
SELECT user_id AS entity_id, event_id, event, CAST(idx AS BIGINT) AS available_index FROM e WHERE event IS NOT NULL""",
)
def _upsert_delete(spark, sf_dir):
    out = entity_events(adp_rows(spark, sf_dir), order=ORDER, chunk=CHUNK, unit=HOUR)
    return out.select("entity_id", "event_id", "event", "available_index")


@check(
    "entity_registry",
    _ADP
    + """,
l AS (SELECT user_id, arg_max(del, event_id) AS del, arg_max(idx, event_id) AS idx, arg_max(lim, event_id) AS lim, max(t) AS t FROM r GROUP BY 1)
SELECT user_id AS entity_id, CAST(idx AS BIGINT) AS available_index FROM l
WHERE NOT del AND ((SELECT max(epoch_us(ts)) FROM events) - t) // 3600000000 < lim""",
)
def _entity_registry(spark, sf_dir):
    rows = adp_rows(spark, sf_dir)
    out = entity_registry(rows, rows.select(F.max("ts")).scalar(), order=ORDER, unit=HOUR)
    return out.select("entity_id", "available_index")


@check(
    "rearm_dedup",
    f"""
WITH r AS (SELECT user_id, ts, event_id, event_type, epoch_us(ts) AS t, {H} AS w FROM events WHERE event_type IN ('signup', 'error')),
p AS (SELECT *, lag(event_type) OVER o AS pk, lag(t) OVER o AS pt FROM r WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id FROM p WHERE event_type = 'signup' AND (pt IS NULL OR pk = 'error' OR w - pt >= 86400000000)""",
)
def _rearm_dedup(spark, sf_dir):
    out = rearm_dedup(events(spark, sf_dir), ["user_id"], ORDER, "ts", "event_type", "signup", "error", chunk=CHUNK, ttl=DAY)
    return out.select("user_id", "event_id")


@check(
    "first_seen",
    "SELECT user_id, event_type, CAST(epoch_us(min(ts)) AS BIGINT) AS ts, arg_min(props, event_id) AS props FROM events GROUP BY 1, 2",
)
def _first_seen(spark, sf_dir):
    out = first_seen(events(spark, sf_dir), ["user_id", "event_type"], ORDER, ["props"])
    return out.select("user_id", "event_type", us("ts"), "props")


@check(
    "dependent_reset",
    f"""
WITH w AS (SELECT {H} AS w, bool_or(event_type = 'view') AS busy FROM events GROUP BY 1),
s AS (SELECT w, coalesce(sum(CASE WHEN busy THEN 0 ELSE 1 END) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM w),
e AS (SELECT user_id % 12 AS vlan, epoch_us(ts) AS t, {H} AS w FROM events WHERE event_type = 'click')
SELECT CAST(segment AS BIGINT) AS segment, vlan AS vlan_id, CAST(min(t) AS BIGINT) AS first_seen FROM e JOIN s ON e.w = s.w GROUP BY 1, 2""",
)
def _dependent_reset(spark, sf_dir):
    ev = events(spark, sf_dir).withColumns({"capture_id": F.lit("c"), "vlan_id": F.col("user_id") % 12})
    windows = ev.groupBy("capture_id", "window_start").agg(F.max(F.col("event_type") == "view").alias("busy"))
    out = dependent_reset(ev.where(F.col("event_type") == "click"), windows, ~F.col("busy"), ["vlan_id"])
    return out.select("segment", "vlan_id", us("first_seen"))


@check(
    "alerts_union",
    f"""
SELECT CAST({H} AS BIGINT) AS window_start, 'error' AS level, 'clock_lost' AS code, CAST(user_id AS VARCHAR) AS subject, CAST(1 AS BIGINT) AS rank
FROM events WHERE event_type = 'error' AND value > 100
UNION ALL SELECT CAST({H} AS BIGINT), 'warn', 'stream_spike', NULL, 3 FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) > 5
UNION ALL SELECT CAST({H} AS BIGINT), 'info', 'new_device', CAST(user_id AS VARCHAR), 15 FROM events WHERE event_type = 'signup' AND value > 200""",
)
def _alerts_union(spark, sf_dir):
    ev = events(spark, sf_dir)

    def tag(df, level, code):
        return df.withColumns({"level": F.lit(level), "code": F.lit(code)})

    subject = F.col("user_id").cast("string").alias("subject")
    lost = ev.where("event_type = 'error' AND value > 100").select("window_start", subject)
    many = ev.where("event_type = 'view'").groupBy("window_start").count().where("count > 5").select("window_start")
    new = ev.where("event_type = 'signup' AND value > 200").select("window_start", subject)
    out = alerts(tag(lost, "error", "clock_lost"), tag(many, "warn", "stream_spike"), tag(new, "info", "new_device"))
    return out.select(us("window_start"), "level", "code", "subject", "rank")
