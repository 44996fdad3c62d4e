"""Checks of joins and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, ORDER, check, events, table, us
from tallywire.operators.enrich import (
    announce_enrich,
    announced_no_flow,
    asof_latest,
    attribute_sender,
    backfill_name,
    bridged_networks,
    class_registry,
    device_registry,
    dropout_correlation,
    exclude_local,
    follower_census,
    label_sender,
    latest_declarations,
    leave_monitored,
    missing_clock,
    no_address_devices,
    refclk_check,
    relevant_segments,
    reservation_status,
    source_rollup,
    subnets,
    uncorrelated,
)

H = "epoch_us(ts) // 3600000000 * 3600000000"
Q = "epoch_us(ts) // 900000000 * 900000000"
QUARTER = 900


@check(
    "asof_enrich",
    """
SELECT p.event_id, p.user_id, a.props AS name, CAST(a.event_id AS BIGINT) AS announce_id
FROM (SELECT * FROM events WHERE event_type <> 'signup') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') a ON p.user_id = a.user_id AND p.ts >= a.ts""",
)
def _asof_enrich(spark, sf_dir):
    ev = events(spark, sf_dir, DAY)
    packets = ev.where(F.col("event_type") != "signup").select("event_id", "user_id", "ts", *CHUNK)
    said = ev.where(F.col("event_type") == "signup").withColumn("announce_id", F.col("event_id"))
    out = asof_latest(packets, said, ["user_id"], ORDER, CHUNK, {"name": "props", "announce_id": "announce_id"})
    return out.select("event_id", "user_id", "name", "announce_id")


# Port = user_id % 30, address = user_id % 5; every third announcement carries no address.
@check(
    "announce_enrich",
    """
WITH p AS (SELECT event_id, user_id % 30 AS port, user_id % 5 AS ip FROM events WHERE event_type <> 'signup'),
a AS (SELECT event_id AS aid, user_id % 30 AS port, CASE WHEN event_id % 3 <> 0 THEN user_id % 5 END AS ip, props AS name,
        CASE WHEN event_id % 4 <> 0 THEN event_id % 7 * 1000.0 END AS clock,
        CASE WHEN event_id % 2 = 0 THEN event_id % 128 END AS pt FROM events WHERE event_type = 'signup'),
m AS (SELECT p.event_id, a.* FROM p LEFT JOIN a ON p.port = a.port AND (a.ip IS NULL OR a.ip = p.ip) AND a.aid <= p.event_id)
SELECT event_id, arg_min(name, aid) AS session_name, CAST(arg_max(clock, aid) FILTER (WHERE clock > 0) AS DOUBLE) AS clock_hz,
       CAST(arg_max(pt, aid) FILTER (WHERE pt IS NOT NULL) AS BIGINT) AS expected_pt,
       coalesce(bool_or(clock > 0), false) AS clock_confirmed
FROM m GROUP BY event_id""",
)
def _announce_enrich(spark, sf_dir):
    ev = events(spark, sf_dir, DAY).withColumns({"dst_port": F.col("user_id") % 30, "dst_ip": F.col("user_id") % 5})
    packets = ev.where(F.col("event_type") != "signup").select("event_id", "dst_port", "dst_ip", "ts", *CHUNK)
    i = F.col("event_id")
    media = ev.where(F.col("event_type") == "signup").select(
        *ORDER,
        *CHUNK,
        F.col("dst_port").alias("port"),
        F.when(i % 3 != 0, F.col("dst_ip")).alias("connection_ip"),
        F.col("props").alias("session_name"),
        F.lit("L24/48000").alias("rtpmap"),
        F.when(i % 4 != 0, i % 7 * 1000.0).cast("double").alias("clock_hz"),
        F.lit(0.0).alias("ptime_ms"),
        F.lit(1).alias("channels"),
        F.when(i % 2 == 0, F.array(i % 128)).otherwise(F.array().cast("array<bigint>")).alias("payload_types"),
    )
    out = announce_enrich(packets, media, order=ORDER, chunk=CHUNK)
    return out.select(
        "event_id",
        "session_name",
        F.col("announced_clock_hz").alias("clock_hz"),
        F.col("announced_expected_pt").alias("expected_pt"),
        "clock_confirmed",
    )


@check(
    "backfill_first",
    """
WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'view' AND value > 150 THEN props END) AS name FROM events GROUP BY 1),
n AS (SELECT user_id, arg_min(props, ts) AS first FROM events WHERE event_type = 'signup' AND value > 20 GROUP BY 1)
SELECT s.user_id, coalesce(s.name, n.first) AS name FROM s LEFT JOIN n ON s.user_id = n.user_id""",
)
def _backfill_first(spark, sf_dir):
    ev = events(spark, sf_dir)
    named = F.when((F.col("event_type") == "view") & (F.col("value") > 150), F.col("props"))
    streams = ev.groupBy("user_id").agg(F.max(named).alias("name"))
    names = ev.where((F.col("event_type") == "signup") & (F.col("value") > 20))
    names = names.select("user_id", "ts", F.col("props").alias("name"))
    return backfill_name(streams, names, "user_id").select("user_id", "name")


@check(
    "registry_union",
    """
WITH u AS (SELECT c_nationkey AS k, CAST(c_custkey AS BIGINT) AS t, c_name AS name FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey, NULL FROM supplier
  UNION ALL SELECT n_nationkey, n_regionkey, NULL FROM nation)
SELECT CAST(k AS INTEGER) AS nation, CAST(min(t) AS BIGINT) AS first_seen, CAST(max(t) AS BIGINT) AS last_seen,
       arg_max(name, t) FILTER (WHERE name IS NOT NULL) AS name FROM u GROUP BY k""",
)
def _registry_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("t"), F.col("c_name").alias("name")
    )
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("t"))
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("bigint").alias("t")
    )
    return device_registry([c, s, n], "nation", "t")


# Devices are customers; orders are clock messages: order key mod 4 is the type, mod 3 the domain, mod 50 = 0 names a master.
_PTP = """
ptp AS (SELECT o_custkey AS src, o_orderdate AS ts, o_orderkey % 4 AS mt, o_orderkey % 3 AS domain,
          CASE WHEN o_orderkey % 50 = 0 THEN o_custkey END AS gm, o_orderkey FROM orders)"""


@check(
    "census_anti",
    f"""
WITH {_PTP},
f AS (SELECT DISTINCT src FROM ptp WHERE mt = 1 AND epoch_us((SELECT max(ts) FROM ptp)) - epoch_us(ts) < 86400000000 * 300),
m AS (SELECT domain, arg_max(src, epoch_us(ts) + src) AS gm FROM (SELECT * FROM ptp WHERE gm IS NOT NULL AND domain <> 0) GROUP BY domain),
g AS (SELECT arg_min(gm, domain) AS gm FROM m)
SELECT c_custkey AS src_ip FROM customer WHERE c_custkey NOT IN (SELECT src FROM f) AND c_custkey <> (SELECT gm FROM g)""",
)
def _census_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    ptp = o.select(
        F.col("o_custkey").alias("src_ip"),
        F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * DAY).alias("ts"),
        F.lit(1).alias("version"),
        (i % 4).alias("message_type"),
        (i % 3).alias("domain"),
        F.when((i % 50 == 0) & (i % 3 != 0), F.col("o_custkey")).alias("grandmaster_id"),
    )
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src_ip"))
    return follower_census(devices, ptp, ptp.select(F.max("ts")).scalar(), recent=300 * DAY)


@check(
    "shared_attribute",
    """
WITH l AS (SELECT user_id, arg_max(event_id % 40, event_id) AS mac, max(ts) AS last FROM events WHERE event_type = 'click' GROUP BY 1),
k AS (SELECT * FROM l WHERE (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last)) // 1000000 < 86400),
m AS (SELECT mac, count(*) AS n FROM k GROUP BY mac HAVING count(*) >= 2),
nm AS (SELECT mac, arg_min('user ' || user_id, user_id) AS name FROM k WHERE user_id % 2 = 0 GROUP BY mac)
SELECT k.mac, k.user_id, CAST(m.n AS BIGINT) AS addresses, nm.name
FROM k JOIN m ON k.mac = m.mac LEFT JOIN nm ON k.mac = nm.mac""",
)
def _shared_attribute(spark, sf_dir):
    ev = events(spark, sf_dir)
    conmon = ev.where(F.col("event_type") == "click").withColumn("mac", F.col("event_id") % 40)
    names = ev.where(F.col("user_id") % 2 == 0).select("user_id").distinct()
    names = names.withColumn("name", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    out = bridged_networks(conmon, names, ev.select(F.max("ts")).scalar(), "mac", "user_id", retain=DAY)
    return out.select("mac", "user_id", "addresses", "name")


_ADDR = """CASE WHEN c_custkey % 11 = 0 THEN '169.254.' || (c_custkey % 7) || '.' || (c_custkey % 250)
  ELSE '10.' || (c_custkey % 3) || '.' || (c_custkey % 7) || '.' || (c_custkey % 250) END"""


def customer_addresses(spark, sf_dir):
    k = F.col("c_custkey")

    def dotted(*parts):
        return F.concat_ws(".", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    ip = F.when(k % 11 == 0, dotted("169", "254", k % 7, k % 250)).otherwise(dotted("10", k % 3, k % 7, k % 250))
    return table(spark, sf_dir, "customer").select(k, ip.alias("src_ip"))


@check("mixed_population", f"SELECT DISTINCT {_ADDR} AS src_ip FROM customer WHERE c_custkey % 11 = 0")
def _mixed_population(spark, sf_dir):
    return no_address_devices(customer_addresses(spark, sf_dir))


@check(
    "subnet_split",
    f"""
WITH a AS (SELECT DISTINCT {_ADDR} AS ip FROM customer WHERE c_custkey % 11 <> 0)
SELECT split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0/24' AS subnet,
       CAST(count(*) AS BIGINT) AS devices FROM a GROUP BY 1""",
)
def _subnet_split(spark, sf_dir):
    return subnets(customer_addresses(spark, sf_dir))


# Sessions are parts, their media port is the size; suppliers are clock domains with a nation as grandmaster.
@check(
    "claimed_vs_actual",
    """
WITH st AS (SELECT DISTINCT l_linenumber * 3 AS port FROM lineitem WHERE l_quantity > 45),
s AS (SELECT s_suppkey // 2 AS domain, s_suppkey % 2 + 1 AS version, 'gm' || s_nationkey AS gm, s_acctbal > 2000 AS valid FROM supplier),
b AS (SELECT domain, arg_max(gm, version) AS gm, arg_max(valid, version) AS valid FROM s GROUP BY domain),
m AS (SELECT p_partkey, p_size AS port, 'gm' || (p_partkey % 25) AS gm, p_partkey % 60 AS domain FROM part),
j AS (SELECT m.*, b.gm AS active, b.valid FROM m LEFT JOIN b ON m.domain = b.domain WHERE port IN (SELECT port FROM st))
SELECT p_partkey, CASE WHEN valid IS NULL THEN 'no_ptp' ELSE 'mismatch' END AS status, active AS active_gm FROM j
WHERE valid IS NULL OR (valid AND active <> gm)""",
)
def _claimed_vs_actual(spark, sf_dir):
    streams = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 45)
    streams = streams.select((F.col("l_linenumber") * 3).alias("dst_port"))
    k = F.col("s_suppkey")
    state = table(spark, sf_dir, "supplier").select(
        F.floor(k / 2).cast("bigint").alias("domain"),
        (k % 2 + 1).alias("version"),
        F.concat(F.lit("gm"), F.col("s_nationkey").cast("string")).alias("grandmaster_id"),
        (F.col("s_acctbal") > 2000).alias("valid"),
    )
    p = F.col("p_partkey")
    media = table(spark, sf_dir, "part").select(
        p,
        F.col("p_size").alias("port"),
        F.concat(F.lit("gm"), (p % 25).cast("string")).alias("claimed_gm"),
        (p % 60).alias("claimed_domain"),
    )
    return refclk_check(media, state, streams, "p_partkey").select("p_partkey", "status", "active_gm")


_FAMILY = "CASE user_id % 4 WHEN 0 THEN 'AES67' WHEN 1 THEN 'ST2110' WHEN 2 THEN 'Dante' ELSE 'AVB' END"


@check(
    "requirement_anti",
    f"""
WITH o AS (SELECT DISTINCT {H} AS w, {_FAMILY} AS family FROM events WHERE event_type = 'view'),
need(family, clock) AS (VALUES ('AES67', 'ptpv2'), ('ST2110', 'ptpv2'), ('Dante', 'ptp'), ('AVB', 'gptp')),
c AS (SELECT {H} AS w, user_id % 2 + 1 AS version, user_id % 5 = 0 AS avb FROM events WHERE event_type = 'error' AND value > 30),
v AS (SELECT w, 'ptpv2' AS clock FROM c WHERE NOT avb AND version = 2 UNION SELECT w, 'ptp' FROM c WHERE NOT avb
      UNION SELECT w, 'gptp' FROM c WHERE avb)
SELECT CAST(o.w AS BIGINT) AS window_start, o.family, need.clock FROM o JOIN need ON o.family = need.family
WHERE o.family <> 'ST2110' AND NOT EXISTS (SELECT 1 FROM v WHERE v.w = o.w AND v.clock = need.clock)""",
)
def _requirement_anti(spark, sf_dir):
    ev = events(spark, sf_dir)
    streams = ev.where(F.col("event_type") == "view").withColumn("family", family())
    clocks = ev.where(F.col("event_type") == "error").select(
        "window_start",
        (F.col("user_id") % 2 + 1).alias("version"),
        F.when(F.col("user_id") % 5 == 0, "AVB").otherwise("PTP").alias("protocol_kind"),
        (F.col("value") > 30).alias("valid"),
    )
    out = missing_clock(streams, clocks, ["window_start"], ["AES67", "Dante", "AVB"])
    return out.select(us("window_start"), "family", "clock")


def family():
    u = F.col("user_id") % 4
    return F.when(u == 0, "AES67").when(u == 1, "ST2110").when(u == 2, "Dante").otherwise("AVB")


def _correlated(spark, sf_dir):
    ev = events(spark, sf_dir, QUARTER)
    ptp = ev.where(F.col("event_type") == "error").select(
        "window_start", (F.col("user_id") % 2 + 1).alias("version"), (F.col("value") > 30).alias("lost")
    )
    loss = ev.where(F.col("event_type") == "view").select("window_start", family().alias("family"), (F.col("event_id") % 3).alias("lost"))
    return dropout_correlation(ptp, loss)


_CORR = f"""
l AS (SELECT {Q} AS w, user_id % 2 + 1 AS version FROM events WHERE event_type = 'error' AND value > 30),
s AS (SELECT {Q} AS w, {_FAMILY} AS family FROM events WHERE event_type = 'view' AND event_id % 3 > 0),
x AS (SELECT DISTINCT l.w FROM l JOIN s ON l.w = s.w AND ((l.version = 1 AND s.family = 'Dante')
      OR (l.version = 2 AND s.family IN ('AES67', 'ST2110'))))"""


@check("correlated_windows", f"WITH {_CORR} SELECT CAST(w AS BIGINT) AS window_start FROM x")
def _correlated_windows(spark, sf_dir):
    return _correlated(spark, sf_dir).select(us("window_start"))


@check(
    "suppressed_singles",
    f"""WITH {_CORR}
SELECT event_id FROM events WHERE event_type = 'error' AND value > 30 AND {Q} NOT IN (SELECT w FROM x)""",
)
def _suppressed_singles(spark, sf_dir):
    alerts = events(spark, sf_dir, QUARTER).where((F.col("event_type") == "error") & (F.col("value") > 30))
    return uncorrelated(alerts, _correlated(spark, sf_dir)).select("event_id")


_DECL = """CASE event_id % 3 WHEN 0 THEN 'talker_advertise' WHEN 1 THEN 'talker_failed' ELSE 'listener' END"""


def declarations(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 3 == 0, "talker_advertise").when(i % 3 == 1, "talker_failed").otherwise("listener")
    return events(spark, sf_dir).where(F.col("event_type") == "click").select(
        F.col("user_id").alias("stream_id"),
        kind.alias("decl_type"),
        "ts",
        i.alias("frame_no"),
        (i % 8).alias("priority"),
        F.when(i % 3 == 1, i % 23).alias("failure_code"),
        F.when(i % 3 == 2, i % 5).alias("listener_state"),
    )


@check(
    "latest_per_key",
    f"""
SELECT user_id AS stream_id, {_DECL} AS decl_type, CAST(max(event_id) AS BIGINT) AS frame_no,
       CAST(arg_max(event_id % 8, event_id) AS BIGINT) AS priority FROM events WHERE event_type = 'click' GROUP BY 1, 2""",
)
def _latest_per_key(spark, sf_dir):
    return latest_declarations(declarations(spark, sf_dir)).select("stream_id", "decl_type", "frame_no", "priority")


@check(
    "status_join",
    """
WITH d AS (SELECT user_id, event_id, event_id % 3 AS k FROM events WHERE event_type = 'click'),
t AS (SELECT user_id, max(event_id) AS i FROM d WHERE k < 2 GROUP BY 1),
l AS (SELECT user_id, max(event_id) AS i FROM d WHERE k = 2 GROUP BY 1),
s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view')
SELECT s.user_id AS stream_id, CASE t.i % 3 WHEN 1 THEN 'failed' WHEN 0 THEN 'reserved' ELSE 'none' END AS status,
  CAST(t.i % 8 AS BIGINT) AS priority, CAST(CASE WHEN t.i % 3 = 1 THEN t.i % 23 END AS BIGINT) AS failure_code,
  CASE WHEN t.i % 3 = 1 THEN CASE t.i % 23 WHEN 1 THEN 'insufficient bandwidth' WHEN 2 THEN 'insufficient bridge resources'
    WHEN 3 THEN 'insufficient bandwidth for Traffic Class' WHEN 4 THEN 'StreamID already in use by another Talker'
    WHEN 5 THEN 'stream destination address already in use' WHEN 6 THEN 'stream pre-empted by a higher-rank stream'
    WHEN 7 THEN 'reported latency has changed' WHEN 8 THEN 'egress port is not AVB-capable'
    WHEN 9 THEN 'use a different destination address' WHEN 10 THEN 'out of MSRP resources' WHEN 11 THEN 'out of MMRP resources'
    WHEN 12 THEN 'cannot store destination address' WHEN 13 THEN 'requested priority is not an SR Class priority'
    WHEN 14 THEN 'MaxFrameSize too large for the media' WHEN 15 THEN 'max fan-in ports limit reached'
    WHEN 16 THEN 'changed FirstValue for a registered StreamID'
    WHEN 17 THEN 'VLAN blocked on this egress port (registration forbidden)'
    WHEN 18 THEN 'VLAN tagging disabled on this egress port' WHEN 19 THEN 'SR class priority mismatch'
    ELSE 'unknown failure' END END AS reason,
  CASE l.i % 5 WHEN 0 THEN 'ignore' WHEN 1 THEN 'asking failed' WHEN 2 THEN 'ready' WHEN 3 THEN 'ready failed' END AS listener,
  t.i IS NULL AS no_vlan
FROM s LEFT JOIN t ON s.user_id = t.user_id LEFT JOIN l ON s.user_id = l.user_id""",
)
def _status_join(spark, sf_dir):
    ev = events(spark, sf_dir)
    streams = ev.where(F.col("event_type") == "view").select(F.col("user_id").alias("stream_id"))
    return reservation_status(streams, declarations(spark, sf_dir), ev.where("event_type = 'none'"))


@check(
    "announced_no_flow",
    """SELECT c_nationkey AS src_ip, CAST(min(c_custkey) AS BIGINT) AS first_seen FROM customer
WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9700) GROUP BY 1""",
)
def _announced_no_flow(spark, sf_dir):
    devices = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("src_ip"), F.col("c_custkey").alias("first_seen")
    )
    flows = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 9700)
    return announced_no_flow(devices, flows.select(F.col("s_nationkey").alias("src_ip")), window="first_seen")


@check(
    "ranked_latest",
    """
WITH s AS (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN 'DVS' WHEN event_id % 13 = 0 THEN 'Via' ELSE 'Hardware' END AS class
           FROM events WHERE event_type = 'click')
SELECT user_id, arg_max(class, CASE WHEN class = 'Hardware' THEN 0 ELSE 1000000000000 END + event_id) AS class FROM s GROUP BY 1""",
)
def _ranked_latest(spark, sf_dir):
    i = F.col("event_id")
    cls = F.when(i % 9 == 0, "DVS").when(i % 13 == 0, "Via").otherwise("Hardware")
    seen = events(spark, sf_dir).where(F.col("event_type") == "click").withColumn("class", cls)
    return class_registry(seen, "user_id", order=ORDER)


@check(
    "leave_monitored",
    """SELECT event_id, user_id % 20 AS group_ip FROM events WHERE event_type = 'error'
AND user_id % 20 IN (SELECT event_id % 20 FROM events WHERE event_type = 'view' AND value > 150)""",
)
def _leave_monitored(spark, sf_dir):
    ev = events(spark, sf_dir)
    leaves = ev.where(F.col("event_type") == "error").select("event_id", (F.col("user_id") % 20).alias("group_ip"))
    streams = ev.where((F.col("event_type") == "view") & (F.col("value") > 150))
    out = leave_monitored(leaves, streams.select((F.col("event_id") % 20).alias("dst_ip")))
    return out.select("event_id", "group_ip")


@check(
    "label_sender",
    """SELECT l_orderkey, l_linenumber, l_suppkey AS src_ip, CASE WHEN s_suppkey IS NOT NULL AND l_linenumber % 2 = 0
  THEN 'AES67 (Dante: "' || s_name || '")' WHEN l_linenumber % 2 = 0 THEN 'AES67' ELSE 'Dante' END AS label
FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 1000) ON l_suppkey = s_suppkey""",
)
def _label_sender(spark, sf_dir):
    streams = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").alias("src_ip"),
        F.when(F.col("l_linenumber") % 2 == 0, "AES67").otherwise("Dante").alias("protocol"),
    )
    devices = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 1000)
    devices = devices.select(F.col("s_suppkey").alias("src_ip"), F.col("s_name").alias("name"))
    return label_sender(streams, devices).select("l_orderkey", "l_linenumber", "src_ip", "label")


def connections(spark, sf_dir):
    """Line items as TCP segments between two suppliers, pre-aggregated per connection."""
    q = F.when(F.col("retransmissions") > 10, "critical").when(F.col("retransmissions") > 2, "degrading").otherwise("healthy")
    return (
        segments(spark, sf_dir)
        .groupBy("src_ip", "dst_ip")
        .agg(F.sum("frame_bytes").alias("bitrate_bps"), F.count_if(F.col("l_returnflag") == "R").alias("retransmissions"))
        .withColumn("quality", q)
    )


def segments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_returnflag",
        F.col("l_suppkey").alias("src_ip"),
        (F.col("l_partkey") % 100).alias("dst_ip"),
        (F.col("l_orderkey") % 10 + 5950 + F.col("l_linenumber")).alias("src_port"),
        (F.col("l_partkey") % 1000 + 5000).alias("dst_port"),
        F.col("l_quantity").cast("bigint").alias("frame_bytes"),
    )


_SEG = """seg AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey AS s, l_partkey % 100 AS d,
  l_orderkey % 10 + 5950 + l_linenumber AS sp, l_partkey % 1000 + 5000 AS dp, CAST(l_quantity AS BIGINT) AS b FROM lineitem),
src AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 6000)"""


def sources(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_acctbal") > 6000).select(F.col("s_suppkey").alias("src_ip"))


@check(
    "either_end_rollup",
    f"""
WITH {_SEG},
c AS (SELECT s, d, sum(b) AS rate, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS retx FROM seg GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN retx > 10 THEN 2 WHEN retx > 2 THEN 1 ELSE 0 END AS rank FROM c)
SELECT k AS src_ip, CAST(count(*) AS BIGINT) AS connections, CAST(sum(rate) AS BIGINT) AS bitrate_bps,
       CAST(sum(retx) AS BIGINT) AS retransmissions,
       CASE max(rank) WHEN 2 THEN 'critical' WHEN 1 THEN 'degrading' ELSE 'healthy' END AS worst_quality
FROM src JOIN q ON q.s = k OR q.d = k GROUP BY k""",
)
def _either_end_rollup(spark, sf_dir):
    return source_rollup(connections(spark, sf_dir), sources(spark, sf_dir))


@check(
    "relevance_semi",
    f"""
WITH {_SEG}
SELECT l_orderkey, l_linenumber, s AS src_ip, d AS dst_ip FROM seg WHERE sp BETWEEN 5960 AND 5980 OR dp BETWEEN 5960 AND 5980
  OR s IN (SELECT k FROM src) OR d IN (SELECT k FROM src)""",
)
def _relevance_semi(spark, sf_dir):
    out = relevant_segments(segments(spark, sf_dir), sources(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "src_ip", "dst_ip")


@check(
    "attribute_sender",
    f"""
WITH {_SEG}
SELECT l_orderkey, l_linenumber, CASE WHEN s IN (SELECT k FROM src) THEN s WHEN d IN (SELECT k FROM src) THEN d END AS sender
FROM seg""",
)
def _attribute_sender(spark, sf_dir):
    return attribute_sender(segments(spark, sf_dir), sources(spark, sf_dir)).select("l_orderkey", "l_linenumber", "sender")


@check("exclude_local", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def _exclude_local(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 3 == 0).select(F.col("s_suppkey").alias("user_id"))
    return exclude_local(events(spark, sf_dir), own, "user_id").select("event_id", "user_id")
