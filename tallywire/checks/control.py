"""Checks of the variable-length control messages, built from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywire.checks.base import check, events, table
from tallywire.checks.frames import hex_eui, num, raw
from tallywire.sources.tlv import (
    DANTE_NAME_SERVICES,
    igmp_v3_groups,
    lldp_eee,
    msrp_declarations,
    mvrp_vlans,
    service_name,
)


# Three records per report: a group with sources, a unicast address, a group with auxiliary data.
@check(
    "igmp_v3_groups",
    """
WITH g AS (SELECT event_id, '239.1.' || (event_id % 200) || '.' || (user_id % 200) AS group_ip, 0 AS o FROM events
  UNION ALL SELECT event_id, '239.69.0.' || (user_id % 250), 1 FROM events WHERE event_id % 5 <> 0)
SELECT event_id, group_ip FROM g""",
)
def _igmp_v3_groups(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    n = (i % 3).cast("int")
    first = F.concat(F.lit("0400"), num(n, 2), F.lit("ef01"), num(i % 200, 1), num(u % 200, 1), F.repeat(F.lit("0a000001"), n))
    last = F.concat(F.lit("04010000ef4500"), num(u % 250, 1), F.lit("00000000"))
    count = F.when(i % 5 == 0, "0002").otherwise("0003")
    payload = raw("220000000000", count, first, F.lit("040000000a000009"), last)
    out = igmp_v3_groups(events(spark, sf_dir).select(i, payload.alias("payload")))
    return out.select("event_id", F.explode("groups").alias("group_ip"))


_SID = "regexp_replace(printf('%016x', user_id * 65536 + event_id % 65536), '(..)(..)(..)(..)(..)(..)(....)', '\\1:\\2:\\3:\\4:\\5:\\6:\\7')"


@check(
    "msrp_declarations",
    f"""
SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'talker_advertise' ELSE 'talker_failed' END AS decl_type, {_SID} AS stream_id,
  {hex_eui('event_id', 6)} AS dest_mac, CAST(user_id % 4096 AS INTEGER) AS vlan_id, CAST(event_id % 1500 AS INTEGER) AS max_frame_size,
  CAST(event_id % 8 AS INTEGER) AS priority, CAST(CASE event_id % 2 WHEN 1 THEN event_id % 20 END AS INTEGER) AS failure_code,
  CAST(NULL AS INTEGER) AS listener_state FROM events
UNION ALL SELECT event_id, 'listener', {_SID}, NULL, NULL, NULL, NULL, NULL, CAST(event_id % 4 AS INTEGER) FROM events WHERE event_id % 3 > 0""",
)
def _msrp_declarations(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    sid = num(u * 65536 + i % 65536, 8)
    common = F.concat(sid, num(i, 6), num(F.lit(0xF000) + u % 4096, 2), num(i % 1500, 2), F.lit("0001"), num(i % 8 * 32, 1), F.lit("00000000"))
    failed = F.concat(common, F.lit("0011223344556677"), num(i % 20, 1))
    vectors = F.lit("00000000")
    talker = F.when(i % 2 == 0, F.concat(F.lit("0119001f"), F.lit("0001"), common, vectors)).otherwise(
        F.concat(F.lit("02220028"), F.lit("0001"), failed, vectors)
    )
    domain = F.lit("0404000a000106020002" + "00000000")
    listener = F.when(i % 3 > 0, F.concat(F.lit("0309000f"), F.lit("0001"), sid, num(i % 4, 1), vectors)).otherwise("")
    payload = raw("00", talker, domain, listener, "0000")
    out = msrp_declarations(events(spark, sf_dir).select(i, payload.alias("payload")))
    names = ["decl_type", "stream_id", "dest_mac", "vlan_id", "max_frame_size", "priority", "failure_code", "listener_state"]
    return out.select("event_id", *names)


@check(
    "mvrp_vlans",
    """
WITH v AS (SELECT event_id, unnest(generate_series(event_id % 4000 + 1, event_id % 4000 + 1 + event_id % 7)) AS vlan FROM events
  UNION SELECT event_id, user_id % 4096 FROM events WHERE user_id % 4096 > 0)
SELECT event_id, CAST(vlan AS INTEGER) AS vlan_id FROM v""",
)
def _mvrp_vlans(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    n = i % 7 + 1
    one = F.concat(num(n, 2), num(i % 4000 + 1, 2), F.repeat(F.lit("24"), F.ceil(n / 3).cast("int")))
    payload = raw("000102", one, "2000", "0001", num(u % 4096, 2), "6c", "00000000")
    out = mvrp_vlans(events(spark, sf_dir).select(i, payload.alias("payload")))
    return out.select("event_id", "vlan_id")


@check(
    "lldp_eee",
    f"""
SELECT s_suppkey, {hex_eui('s_suppkey', 6)} AS chassis_id, s_name AS port_id, CAST(s_suppkey % 3 AS INTEGER) AS tx_wake_us,
  CAST(s_suppkey % 5 AS INTEGER) AS rx_wake_us FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 3 > 0 OR s_suppkey % 5 > 0)""",
)
def _lldp_eee(spark, sf_dir):
    s = F.col("s_suppkey")
    name = F.hex(F.col("s_name"))
    oui = F.when(s % 7 == 0, "00120f01").otherwise("00120f05")
    payload = raw(
        "020704", num(s, 6), num(F.lit(0x0400) + F.length(name) / 2 + 1, 2), "05", name, "06020078",
        "fe0e", oui, num(s % 3, 2), num(s % 5, 2), "000000000000", "0000",
    )
    out = lldp_eee(table(spark, sf_dir, "supplier").select(s, payload.alias("payload")))
    return out.select("s_suppkey", "chassis_id", "port_id", "tx_wake_us", "rx_wake_us")


@check(
    "service_name",
    "SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE c_name END AS name FROM customer",
)
def _service_name(spark, sf_dir):
    k = F.col("c_custkey")

    def label(text):
        return F.concat(num(F.length(text), 1), F.hex(text))

    own, service = label(F.col("c_name")), label(F.lit("_netaudio-arc"))
    direct = F.concat(F.lit("000084000000000100000000"), own, service, label(F.lit("_udp")), F.lit("00"))
    target = F.concat(own, F.lit("c00c"))
    pointer = F.concat(
        F.lit("000084000001000100000000"), label(F.lit("_x")), F.lit("00000c0001"),
        F.lit("c00c000c000100000078"), num(F.length(target) / 2, 2), target,
    )
    payload = F.unhex(F.when(k % 3 == 0, direct).when(k % 3 == 1, pointer).otherwise(F.lit("000084000000000000000000")))
    return service_name(table(spark, sf_dir, "customer").select(k, payload.alias("payload")), DANTE_NAME_SERVICES).select("c_custkey", "name")
