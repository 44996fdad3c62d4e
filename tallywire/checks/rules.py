"""Checks of rule classification, predicates and the sender verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import CHUNK, DAY, ORDER, check, events, table, us
from tallywire.functions.addresses import address_class, ip_number
from tallywire.operators.chunks import with_last_known
from tallywire.operators.classify import (
    classify,
    control_plane_class,
    dscp_violation,
    is_software,
    packet_rules,
    pcp_advisory,
    protocol_label,
    pt_mismatch,
    select_protocols,
    sender_signals,
    sender_verdict,
    video_subtype,
)
from tallywire.operators.enrich import stream_defaults
from tallywire.operators.timing import timing_regularity
from tallywire.operators.windows import distinct_per_group

# Packets out of events: EtherType, protocol, ports, group and payload type follow from the ids.
_PKT = """
WITH k AS (SELECT event_id, user_id, ts, value, event_type,
  CASE event_id % 20 WHEN 0 THEN 8938 WHEN 1 THEN 35020 WHEN 2 THEN 34824 WHEN 3 THEN 35061 WHEN 4 THEN 8944 WHEN 5 THEN 35063 WHEN 6 THEN 34525 ELSE 2048 END AS et,
  CASE event_id % 11 WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE 17 END AS proto,
  4000 + (event_id * 37) % 20000 AS sp,
  CASE event_id % 13 WHEN 0 THEN 9875 WHEN 1 THEN 5353 WHEN 2 THEN 319 WHEN 3 THEN 8700 + event_id % 9 WHEN 4 THEN 4321 WHEN 5 THEN 14336 + event_id % 1000
    WHEN 6 THEN 38700 + event_id % 9 WHEN 7 THEN 28700 + event_id % 9 WHEN 8 THEN 61440 + event_id % 500 ELSE 5000 + event_id % 1000 END AS dp,
  CASE user_id % 5 WHEN 0 THEN 239 WHEN 1 THEN 239 WHEN 2 THEN 239 WHEN 3 THEN 224 ELSE 10 END AS ip1,
  CASE user_id % 5 WHEN 0 THEN 69 WHEN 1 THEN 255 WHEN 2 THEN 1 ELSE 0 END AS ip2,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 128 END AS pt, event_id % 3 = 0 AS probe FROM events),
c AS (SELECT *, CASE
  WHEN et = 8938 THEN 'msrp' WHEN et = 35020 THEN 'lldp' WHEN et = 34824 THEN 'flow_control' WHEN et = 35061 THEN 'mvrp'
  WHEN et = 8944 AND probe THEN 'adp' WHEN et = 8944 THEN 'avtp' WHEN et = 35063 AND NOT probe THEN 'ptp' WHEN et <> 2048 THEN NULL
  WHEN proto = 2 THEN 'igmp' WHEN proto = 6 THEN 'tcp' WHEN proto <> 17 THEN NULL
  WHEN dp = 9875 THEN CASE WHEN event_id % 2 = 0 THEN 'sap' END
  WHEN dp = 5353 OR sp = 5353 THEN CASE event_id % 3 WHEN 0 THEN 'dante_discovery' WHEN 1 THEN 'ndi_discovery' END
  WHEN dp BETWEEN 8700 AND 8708 AND probe THEN 'dante_conmon' WHEN sp IN (4440, 4455, 8700, 8800) OR dp IN (4440, 4455, 8700, 8800) THEN 'dante_control'
  WHEN dp BETWEEN 38700 AND 38708 OR dp BETWEEN 28700 AND 28708 OR dp BETWEEN 61440 AND 61951 OR sp = 4777 OR sp = 8751 THEN 'dante_control_plane'
  WHEN dp = 319 AND NOT probe THEN 'ptp'
  WHEN (ip1 = 239 AND ip2 = 255 AND dp = 4321) OR dp BETWEEN 14336 AND 15359 OR sp BETWEEN 14336 AND 15359 THEN 'dante_audio'
  WHEN pt IS NULL THEN NULL
  WHEN sp BETWEEN 5000 AND 6000 AND sp % 2 = 0 AND dp BETWEEN 5000 AND 6000 AND dp % 2 = 0 AND (pt IN (0, 8) OR pt >= 96) THEN 'dante_audio'
  WHEN ip1 = 239 AND ip2 = 255 AND dp BETWEEN 5000 AND 6000 AND dp % 2 = 0 THEN 'dante_audio'
  WHEN ip1 = 239 AND ip2 = 69 THEN 'aes67' WHEN ip1 = 239 THEN 'st2110' END AS kind FROM k)"""


def packets(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id") % 5
    third = i % 3
    et, proto, dp = i % 20, i % 11, i % 13
    fields = {
        "ethertype": F.when(et == 0, 0x22EA).when(et == 1, 0x88CC).when(et == 2, 0x8808).when(et == 3, 0x88F5).when(et == 4, 0x22F0)
        .when(et == 5, 0x88F7).when(et == 6, 0x86DD).otherwise(0x0800),
        "ip_proto": F.when(proto == 0, 2).when(proto == 1, 6).when(proto == 2, 1).otherwise(17),
        "src_port": 4000 + i * 37 % 20000,
        "dst_port": F.when(dp == 0, 9875).when(dp == 1, 5353).when(dp == 2, 319).when(dp == 3, 8700 + i % 9).when(dp == 4, 4321)
        .when(dp == 5, 14336 + i % 1000).when(dp == 6, 38700 + i % 9).when(dp == 7, 28700 + i % 9).when(dp == 8, 61440 + i % 500).otherwise(5000 + i % 1000),
        "dst_ip": F.when(u == 0, "239.69.0.1").when(u == 1, "239.255.0.1").when(u == 2, "239.1.0.1").when(u == 3, "224.0.0.1").otherwise("10.0.0.1"),
        "rtp_pt": F.when(i % 7 != 0, i % 128),
        "mdns": F.when(third == 0, "dante").when(third == 1, "ndi"),
    }
    df = events(spark, sf_dir, DAY).withColumns(fields).withColumn("dst_ip_num", ip_number(F.col("dst_ip")))
    probe = third == 0
    rules = packet_rules(entity=probe, conmon=probe, ptp=~probe, sap=i % 2 == 0, mdns_kind=F.col("mdns"))
    return classify(df, rules)


@check("classify_rules", _PKT + " SELECT event_id, kind FROM c")
def _classify_rules(spark, sf_dir):
    return packets(spark, sf_dir).select("event_id", "kind")


_LABEL = """CASE kind WHEN 'aes67' THEN 'AES67' WHEN 'dante_audio' THEN 'Dante' WHEN 'st2110' THEN CASE
  WHEN dp % 10 = 4 THEN '2110-20' WHEN dp % 10 = 6 THEN '2110-30' WHEN dp % 10 = 8 THEN '2110-40' WHEN pt BETWEEN 96 AND 107 THEN '2110-20'
  WHEN pt BETWEEN 108 AND 115 THEN '2110-30' WHEN pt BETWEEN 116 AND 127 THEN '2110-40' ELSE '2110-??' END END"""


@check("stream_labels", _PKT + f" SELECT event_id, {_LABEL} AS protocol FROM c WHERE kind IN ('aes67', 'dante_audio', 'st2110')")
def _stream_labels(spark, sf_dir):
    out = packets(spark, sf_dir).withColumn("protocol", protocol_label())
    return out.where(F.col("protocol").isNotNull()).select("event_id", "protocol")


@check(
    "select_groups",
    _PKT
    + """ SELECT event_id, kind FROM c WHERE kind IN ('st2110', 'ptp', 'igmp', 'sap', 'ndi_discovery', 'tcp', 'lldp', 'flow_control')""",
)
def _select_groups(spark, sf_dir):
    return select_protocols(packets(spark, sf_dir), ["video"]).select("event_id", "kind")


@check(
    "stream_counts",
    _PKT
    + f""" SELECT {_LABEL} AS protocol, CAST(epoch_us(ts) // 86400000000 * 86400000000 AS BIGINT) AS window_start,
  CAST(count(DISTINCT ip1 || '.' || ip2 || ':' || dp) AS BIGINT) AS streams FROM c WHERE kind IN ('aes67', 'dante_audio', 'st2110') GROUP BY 1, 2""",
)
def _stream_counts(spark, sf_dir):
    out = packets(spark, sf_dir).withColumn("protocol", protocol_label()).where(F.col("protocol").isNotNull())
    out = distinct_per_group(out, ["window_start", "protocol"], ["dst_ip", "dst_port"])
    return out.select("protocol", us("window_start"), "streams")


@check(
    "ip_class",
    """
WITH a AS (SELECT c_custkey AS k, CASE c_custkey % 9 WHEN 0 THEN '239.69.1.2' WHEN 1 THEN '239.255.1.2' WHEN 2 THEN '239.7.1.2' WHEN 3 THEN '225.1.1.1'
  WHEN 4 THEN '169.254.3.4' WHEN 5 THEN '172.31.0.9' WHEN 6 THEN '300.1.1.1' WHEN 7 THEN '10.0.0.' || (c_custkey % 256) ELSE '240.0.0.1' END AS ip FROM customer)
SELECT k AS c_custkey, CASE k % 9 WHEN 0 THEN 'aes67' WHEN 1 THEN 'dante' WHEN 2 THEN 'st2110' WHEN 3 THEN 'multicast' WHEN 4 THEN 'link_local'
  WHEN 5 THEN 'link_local' WHEN 6 THEN NULL ELSE 'unicast' END AS class FROM a""",
)
def _ip_class(spark, sf_dir):
    k = F.col("c_custkey") % 9
    texts = ["239.69.1.2", "239.255.1.2", "239.7.1.2", "225.1.1.1", "169.254.3.4", "172.31.0.9", "300.1.1.1"]
    ip = F.when(k == 8, "240.0.0.1").when(k == 7, F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string")))
    for n, text in enumerate(texts):
        ip = ip.when(k == n, text)
    number = ip_number(F.col("ip"))
    out = table(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip"))
    return out.select("c_custkey", F.when(number.isNotNull(), address_class(number)).alias("class"))


@check(
    "subtype_by_digit",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 10 = 4 THEN '2110-20' WHEN l_partkey % 10 = 6 THEN '2110-30'
  WHEN l_partkey % 10 = 8 THEN '2110-40' WHEN l_suppkey % 128 BETWEEN 96 AND 107 THEN '2110-20' WHEN l_suppkey % 128 BETWEEN 108 AND 115 THEN '2110-30'
  WHEN l_suppkey % 128 BETWEEN 116 AND 127 THEN '2110-40' ELSE '2110-??' END AS subtype FROM lineitem""",
)
def _subtype_by_digit(spark, sf_dir):
    kind = video_subtype(F.col("l_suppkey") % 128, F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("subtype"))


@check(
    "port_family",
    """
WITH p AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 38700 + event_id % 12 WHEN 1 THEN 28690 + event_id % 25 WHEN 2 THEN 8751 WHEN 3 THEN 8899
    WHEN 4 THEN 61400 + event_id % 600 WHEN 5 THEN 24440 + event_id % 20 ELSE 34300 + event_id % 400 END AS s,
  CASE event_id % 5 WHEN 0 THEN 38800 WHEN 1 THEN 8899 WHEN 2 THEN 61440 + event_id % 600 WHEN 3 THEN 4777 ELSE 80 END AS d FROM events)
SELECT event_id, CASE WHEN s BETWEEN 38700 AND 38708 OR d = 38800 OR d = 8899 THEN 'DVS'
  WHEN s BETWEEN 28700 AND 28708 OR s IN (24440, 24441, 24444, 24455) OR s BETWEEN 34336 AND 34600 OR d = 4777 THEN 'Via'
  WHEN s = 8751 OR d BETWEEN 61440 AND 61951 THEN 'Hardware' END AS class FROM p""",
)
def _port_family(spark, sf_dir):
    i = F.col("event_id")
    a, b = i % 7, i % 5
    src = (
        F.when(a == 0, 38700 + i % 12).when(a == 1, 28690 + i % 25).when(a == 2, 8751).when(a == 3, 8899)
        .when(a == 4, 61400 + i % 600).when(a == 5, 24440 + i % 20).otherwise(34300 + i % 400)
    )
    dst = F.when(b == 0, 38800).when(b == 1, 8899).when(b == 2, 61440 + i % 600).when(b == 3, 4777).otherwise(80)
    df = events(spark, sf_dir).select("event_id", src.alias("src_port"), dst.alias("dst_port"))
    return df.select("event_id", control_plane_class().alias("class"))


_PROTO5 = "CASE user_id % 5 WHEN 0 THEN 'AES67' WHEN 1 THEN 'Dante' WHEN 2 THEN '2110-20' WHEN 3 THEN '2110-30' ELSE 'NDI' END"
_DSCP = "CASE event_id % 5 WHEN 0 THEN 46 WHEN 1 THEN 34 WHEN 2 THEN 40 WHEN 3 THEN 0 ELSE 8 END"


def marked(spark, sf_dir):
    u, i = F.col("user_id") % 5, F.col("event_id")
    d = i % 5
    return events(spark, sf_dir).withColumns(
        {
            "protocol": F.when(u == 0, "AES67").when(u == 1, "Dante").when(u == 2, "2110-20").when(u == 3, "2110-30").otherwise("NDI"),
            "dscp": F.when(d == 0, 46).when(d == 1, 34).when(d == 2, 40).when(d == 3, 0).otherwise(8),
            "pcp": F.when(i % 3 > 0, i % 8),
            "ecn": i % 4,
        }
    )


@check(
    "qos_violation",
    f"""
WITH m AS (SELECT event_id, user_id, {_PROTO5} AS protocol, {_DSCP} AS dscp, user_id % 2 = 0 AS soft FROM events)
SELECT event_id, protocol, CAST(dscp AS INTEGER) AS dscp FROM m WHERE protocol <> 'NDI' AND dscp <> 46
  AND NOT (protocol = '2110-20' AND dscp IN (34, 40)) AND NOT (protocol = 'Dante' AND dscp = 0 AND soft)""",
)
def _qos_violation(spark, sf_dir):
    bad = dscp_violation(software=F.col("user_id") % 2 == 0)
    return marked(spark, sf_dir).where(bad).select("event_id", "protocol", "dscp")


@check(
    "pcp_advisory",
    f"""
WITH m AS (SELECT event_id, user_id, {_PROTO5} AS protocol, CASE WHEN event_id % 3 > 0 THEN event_id % 8 END AS pcp FROM events)
SELECT user_id, CAST(count(*) AS BIGINT) AS violations, CAST(arg_min(pcp, event_id) AS BIGINT) AS first_pcp FROM m
WHERE protocol IN ('AES67', '2110-20', '2110-30') AND pcp <> 6 GROUP BY user_id""",
)
def _pcp_advisory(spark, sf_dir):
    bad = marked(spark, sf_dir).where(pcp_advisory())
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("violations"), F.min_by("pcp", F.struct(*ORDER)).alias("first_pcp"))


# Priorities are declared by signups; tagged frames of the same stream are compared with the latest declaration.
@check(
    "pcp_mismatch",
    """
WITH p AS (SELECT f.event_id, f.user_id, f.event_id % 8 AS pcp, d.event_id % 8 AS declared FROM (SELECT * FROM events WHERE event_type <> 'signup' AND event_id % 3 > 0) f
  ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') d ON f.user_id = d.user_id AND f.ts >= d.ts)
SELECT user_id, CAST(count(*) AS BIGINT) AS violations, CAST(arg_min(pcp, event_id) AS BIGINT) AS first_pcp FROM p WHERE pcp <> declared GROUP BY 1""",
)
def _pcp_mismatch(spark, sf_dir):
    ev = events(spark, sf_dir, DAY)
    i = F.col("event_id")
    says = F.col("event_type") == "signup"
    rows = ev.select("user_id", *ORDER, *CHUNK, F.when(says, i % 8).alias("prio"), F.when(~says & (i % 3 > 0), i % 8).alias("pcp"))
    known = with_last_known(rows, ["user_id"], ORDER, CHUNK, {"declared": "prio"})
    bad = known.where(F.col("pcp") != F.col("declared"))
    return bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("violations"), F.min_by("pcp", F.struct(*ORDER)).alias("first_pcp"))


@check("ecn_marks", "SELECT user_id, CAST(sum(CASE WHEN event_id % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS ecn_marks FROM events GROUP BY 1")
def _ecn_marks(spark, sf_dir):
    return marked(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("ecn") == 3).alias("ecn_marks"))


@check(
    "type_mismatch",
    """
WITH m AS (SELECT f.event_id, f.user_id, f.event_id % 3 AS pt, d.event_id % 3 AS expected FROM (SELECT * FROM events WHERE event_type <> 'signup') f
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') d ON f.user_id = d.user_id AND f.ts >= d.ts)
SELECT user_id, CAST(sum(CASE WHEN pt <> expected THEN 1 ELSE 0 END) AS BIGINT) AS pt_mismatch FROM m GROUP BY 1""",
)
def _type_mismatch(spark, sf_dir):
    ev = events(spark, sf_dir, DAY)
    i, says = F.col("event_id"), F.col("event_type") == "signup"
    rows = ev.select("user_id", *ORDER, *CHUNK, says.alias("says"), (i % 3).alias("rtp_pt"), F.when(says, i % 3).alias("pt"))
    known = with_last_known(rows, ["user_id"], ORDER, CHUNK, {"expected_pt": "pt"}).where(~F.col("says"))
    return known.groupBy("user_id").agg(F.count_if(pt_mismatch()).alias("pt_mismatch"))


@check(
    "multi_signal_verdict",
    """
WITH s AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS iat FROM events),
r AS (SELECT user_id, CAST(iat AS DOUBLE) AS iat, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM s WHERE iat > 0),
c AS (SELECT user_id, count(*) AS n, stddev_pop(iat) / avg(iat) AS cv FROM r WHERE r <= 64 GROUP BY user_id),
t AS (SELECT user_id, min(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 128 - user_id % 2 * 64 END) AS ttl, arg_min(event_id % 3, event_id) AS dscp FROM events GROUP BY 1),
g AS (SELECT t.user_id, CASE t.user_id % 6 WHEN 0 THEN 'Hardware' WHEN 1 THEN 'DVS' WHEN 2 THEN 'Via' END AS cp,
  coalesce(n >= 16 AND cv < 0.85, false) AS steady, coalesce(n >= 16 AND cv > 1.05, false) AS noisy, ttl = 128 AS win, dscp = 0 AS unmarked FROM t LEFT JOIN c ON t.user_id = c.user_id)
SELECT user_id, CASE WHEN cp IS NOT NULL THEN cp WHEN steady THEN 'Hardware' WHEN noisy OR win OR unmarked THEN 'DVS' END AS class,
  CASE WHEN cp IS NOT NULL THEN 'confirmed' WHEN steady OR noisy OR win THEN 'inferred' WHEN unmarked THEN 'hint' END AS confidence,
  CAST(CASE WHEN cp = 'Hardware' THEN 1 + CAST(steady AS INT) WHEN cp IS NOT NULL THEN 1 + CAST(noisy AS INT) + CAST(win AS INT) + CAST(unmarked AS INT)
    WHEN steady THEN 1 WHEN noisy THEN 1 + CAST(win AS INT) + CAST(unmarked AS INT) WHEN win THEN 1 + CAST(unmarked AS INT) WHEN unmarked THEN 1 END AS INTEGER) AS signals,
  coalesce(cp IN ('DVS', 'Via') OR (cp IS NULL AND NOT steady AND (noisy OR win)), false) AS software FROM g""",
)
def _multi_signal_verdict(spark, sf_dir):
    ev = events(spark, sf_dir, DAY)
    i, u = F.col("event_id"), F.col("user_id")
    timing = timing_regularity(ev, ["user_id"], "ts", CHUNK, low=0.85, high=1.05)
    marks = ev.select(
        "user_id",
        *ORDER,
        F.when(i % 3 == 0, 255).otherwise(128 - u % 2 * 64).alias("ttl"),
        (i % 3).alias("dscp"),
        F.lit(None).cast("int").alias("pcp"),
        F.lit(1).alias("frame_bytes"),
    )
    rows = sender_signals(marks, ["user_id"], ORDER).join(timing, "user_id", "left")
    control = F.when(u % 6 == 0, "Hardware").when(u % 6 == 1, "DVS").when(u % 6 == 2, "Via")
    v = sender_verdict(control, F.col("regularity"), F.col("min_ttl"), F.col("first_dscp"))
    soft = is_software(control, F.col("regularity"), F.col("min_ttl"))
    out = rows.select("user_id", v.alias("v"), soft.alias("software"))
    return out.select("user_id", "v.class", "v.confidence", "v.signals", "software")


@check(
    "first_and_min",
    """SELECT user_id, CAST(min(event_id % 250 + 1) AS BIGINT) AS min_ttl, CAST(arg_min(event_id % 64, event_id) AS BIGINT) AS first_dscp,
  CAST(arg_min(event_id % 8, event_id) FILTER (WHERE event_id % 3 > 0 AND event_id % 8 <> 6) AS BIGINT) AS first_bad_pcp,
  CAST(max(event_id % 1500) AS BIGINT) AS max_bytes FROM events GROUP BY 1""",
)
def _first_and_min(spark, sf_dir):
    i = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "user_id", *ORDER, (i % 250 + 1).alias("ttl"), (i % 64).alias("dscp"), F.when(i % 3 > 0, i % 8).alias("pcp"), (i % 1500).alias("frame_bytes")
    )
    return sender_signals(rows, ["user_id"], ORDER)


@check(
    "dim_defaults",
    f"""
WITH s AS (SELECT user_id, {_PROTO5} AS protocol, max(CASE WHEN value > 150 THEN 96000.0 END) AS clock FROM events GROUP BY 1, 2)
SELECT user_id, CAST(coalesce(clock, CASE protocol WHEN '2110-20' THEN 90000.0 WHEN 'NDI' THEN 0.0 ELSE 48000.0 END) AS DOUBLE) AS clock_hz,
  CAST(CASE WHEN protocol IN ('2110-30', 'Dante') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS ptime_ms,
  CASE protocol WHEN 'AES67' THEN 'audio' WHEN '2110-20' THEN 'video' WHEN '2110-30' THEN 'audio' ELSE 'unknown' END AS media_type FROM s""",
)
def _dim_defaults(spark, sf_dir):
    said = F.max(F.when(F.col("value") > 150, 96000.0)).alias("clock_hz")
    streams = marked(spark, sf_dir).groupBy("user_id", "protocol").agg(said)
    return stream_defaults(streams).select("user_id", "clock_hz", "ptime_ms", "media_type")

