"""Checks of the decoders: frames are built from table columns, the SQL side is the same arithmetic without bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywire.checks.base import check, events, table, us
from tallywire.functions.formats import clock_reference, describe_entity, format_eui

from tallywire.functions.lookups import (
    AVTP_SUBTYPES,
    CLOCK_ACCURACY,
    OTHER_ACCURACY,
    RESERVATION_FAILURES,
    UNKNOWN_FAILURE,
    UNKNOWN_SUBTYPE,
    case_of,
    lookup,
)
from tallywire.session import checkpoint_root
from tallywire.sources.decode import (
    decode_adp,
    decode_avtp,
    decode_conmon,
    decode_flow_control,
    decode_igmp,
    decode_ipv4,
    decode_l2,
    decode_l4,
    decode_packets,
    decode_ptp,
    decode_rtp,
)
from tallywire.sources.frames import read_frames, write_frames
from tallywire.sources.sdp import decode_sap, media_sections

def num(value: Column, n: int) -> Column:
    """`n` big-endian bytes of a number as hex text."""
    return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")


def raw(*parts: Column | str) -> Column:
    """Binary out of hex pieces."""
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def synth_frames(spark, sf_dir):
    """One frame per event: tags where id % 3 = 0 (two where id % 9 = 0), IP options where id % 5 = 0."""
    i, u = F.col("event_id"), F.col("user_id")
    src_mac = F.concat(F.lit("02"), num(i % (1 << 40), 5))
    tag = F.concat(F.lit("8100"), num((i % 8) * 8192 + i % 4096, 2))
    outer = F.concat(F.lit("88A8"), num((i % 7) * 8192 + 5, 2))
    tags = F.when(i % 9 == 0, F.concat(outer, tag)).when(i % 3 == 0, tag).otherwise("")
    proto = F.when(i % 4 == 1, 6).when(i % 4 == 2, 2).otherwise(17)
    opt = F.when(i % 5 == 0, "94040000").otherwise("")
    rtp = F.concat(
        F.when(i % 10 == 3, "40").otherwise("80"), num(i % 128 + F.when(i % 2 == 0, 128).otherwise(0), 1), num(i % 65536, 2),
        num(i * 240 % (1 << 32), 4), num(u * 1000003 % (1 << 32), 4), F.repeat(F.lit("ab"), (i % 20).cast("int")),
    )
    rtp_len = F.length(rtp) / 2
    udp = F.concat(num(4000 + i * 37 % 20000, 2), num(5000 + i % 1000, 2), num(rtp_len + 8, 2), F.lit("0000"), rtp)
    tcp = F.concat(
        num(4000 + i * 37 % 20000, 2), num(5000 + i % 1000, 2), num(i * 1460 % (1 << 32), 4), num(i * 7 % (1 << 32), 4),
        F.lit("50"), num(i % 8, 1), F.lit("ffff00000000"),
    )
    kind = F.when(i % 5 <= 1, "11").when(i % 5 == 2, "16").when(i % 5 == 3, "17").otherwise("22")
    igmp = F.concat(kind, F.lit("000000e0000001"), F.when(i % 5 == 1, "00000000").otherwise(""))
    body = F.when(proto == 6, tcp).when(proto == 2, igmp).otherwise(udp)
    total = F.length(body) / 2 + 20 + F.length(opt) / 2
    ip = F.concat(
        F.when(i % 5 == 0, "46").otherwise("45"), num(i % 256, 1), num(total, 2), F.lit("0000"),
        F.when(i % 17 == 0, "000a").otherwise("0000"), num(i % 250 + 1, 1), num(proto, 1), F.lit("0000"),
        F.lit("0a"), num(u % 3, 1), num(u % 7, 1), num(u % 250, 1), F.lit("ef"), num(i % 256, 1), num(u % 256, 1), num(i % 250, 1), opt,
    )
    pad = F.repeat(F.lit("00"), (i % 6).cast("int"))  # bytes after the IP packet, as on short Ethernet frames
    frame = raw("01005e000001", src_mac, tags, "0800", ip, body, pad)
    return events(spark, sf_dir).select(
        F.lit("c").alias("capture_id"), i.alias("frame_no"), "ts", F.length(frame).alias("wire_len"), frame.alias("frame")
    )


@check(
    "scan_frames",
    """SELECT event_id AS frame_no, CAST(epoch_us(ts) AS BIGINT) AS ts FROM events WHERE event_id % 3 <> 0""",
)
def _scan_frames(spark, sf_dir):
    folder = f"{checkpoint_root(spark).rstrip('/')}/frames-{uuid.uuid4().hex}"  # each call reads what it wrote
    write_frames(synth_frames(spark, sf_dir), folder, "errorifexists")
    scanned = read_frames(spark, folder).where(F.col("capture_id") == "c")
    return decode_l2(scanned).where(F.col("pcp").isNull()).select("frame_no", us("ts"))


_TAGS = "CASE WHEN event_id % 9 = 0 THEN 2 WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"


@check(
    "decode_l2",
    f"""SELECT event_id AS frame_no, '02:' || regexp_replace(printf('%010x', event_id), '(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5') AS src_mac,
  CAST(2048 AS INTEGER) AS ethertype, CAST(CASE {_TAGS} WHEN 2 THEN event_id % 7 WHEN 1 THEN event_id % 8 END AS INTEGER) AS pcp,
  CAST(14 + 4 * {_TAGS} AS INTEGER) AS l2_offset FROM events""",
)
def _decode_l2(spark, sf_dir):
    return decode_l2(synth_frames(spark, sf_dir)).select("frame_no", "src_mac", "ethertype", "pcp", "l2_offset")


_PROTO = "CASE event_id % 4 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 17 END"


@check(
    "decode_ipv4",
    f"""SELECT event_id AS frame_no, '10.' || (user_id % 3) || '.' || (user_id % 7) || '.' || (user_id % 250) AS src_ip,
  '239.' || (event_id % 256) || '.' || (user_id % 256) || '.' || (event_id % 250) AS dst_ip,
  CAST(((10 * 256 + user_id % 3) * 256 + user_id % 7) * 256 + user_id % 250 AS BIGINT) AS src_ip_num,
  CAST({_PROTO} AS INTEGER) AS ip_proto, CAST(event_id % 250 + 1 AS INTEGER) AS ttl,
  CAST(event_id % 256 // 4 AS INTEGER) AS dscp, CAST(event_id % 4 AS INTEGER) AS ecn FROM events""",
)
def _decode_ipv4(spark, sf_dir):
    out = decode_ipv4(decode_l2(synth_frames(spark, sf_dir)))
    return out.select("frame_no", "src_ip", "dst_ip", "src_ip_num", "ip_proto", "ttl", "dscp", "ecn")


@check(
    "decode_l4",
    f"""
WITH f AS (SELECT *, {_PROTO} AS p, event_id % 17 = 0 AS frag FROM events)
SELECT event_id AS frame_no,
  CAST(CASE WHEN p <> 2 AND NOT frag THEN 4000 + event_id * 37 % 20000 END AS INTEGER) AS src_port,
  CAST(CASE WHEN p <> 2 AND NOT frag THEN 5000 + event_id % 1000 END AS INTEGER) AS dst_port,
  CAST(CASE WHEN p = 6 AND NOT frag THEN event_id * 1460 % 4294967296 END AS BIGINT) AS tcp_seq,
  CAST(CASE WHEN p = 6 AND NOT frag THEN event_id * 7 % 4294967296 END AS BIGINT) AS tcp_ack,
  CASE WHEN p = 6 AND NOT frag THEN event_id % 2 = 1 END AS fin,
  CASE WHEN p = 6 AND NOT frag THEN event_id % 4 >= 2 END AS syn,
  CASE WHEN p = 6 AND NOT frag THEN event_id % 8 >= 4 END AS rst,
  CAST(CASE WHEN p = 17 AND NOT frag THEN 12 + event_id % 20 WHEN p = 2 THEN 8 + CASE WHEN event_id % 5 = 1 THEN 4 ELSE 0 END END AS INTEGER) AS payload_len
FROM f""",
)
def _decode_l4(spark, sf_dir):
    out = decode_l4(decode_ipv4(decode_l2(synth_frames(spark, sf_dir))))
    return out.select("frame_no", "src_port", "dst_port", "tcp_seq", "tcp_ack", "fin", "syn", "rst", "payload_len")


@check(
    "decode_packets",
    f"""
WITH f AS (SELECT *, {_PROTO} = 17 AND event_id % 17 <> 0 AND event_id % 10 <> 3 AS r FROM events)
SELECT event_id AS frame_no, CAST(CASE WHEN r THEN event_id % 128 END AS INTEGER) AS rtp_pt,
  CAST(CASE WHEN r THEN event_id % 65536 END AS INTEGER) AS rtp_seq, CAST(CASE WHEN r THEN event_id * 240 % 4294967296 END AS BIGINT) AS rtp_ts,
  CAST(CASE WHEN r THEN user_id * 1000003 % 4294967296 END AS BIGINT) AS rtp_ssrc FROM f""",
)
def _decode_packets(spark, sf_dir):
    return decode_packets(synth_frames(spark, sf_dir)).select("frame_no", "rtp_pt", "rtp_seq", "rtp_ts", "rtp_ssrc")


@check(
    "decode_rtp",
    """
WITH f AS (SELECT *, l_quantity <> 7 AND l_linenumber <> 5 AS r FROM lineitem)
SELECT l_orderkey, CAST(CASE WHEN r THEN l_partkey % 128 END AS INTEGER) AS rtp_pt,
  CAST(CASE WHEN r THEN l_orderkey % 65536 END AS INTEGER) AS rtp_seq,
  CAST(CASE WHEN r THEN l_orderkey * 960 % 4294967296 END AS BIGINT) AS rtp_ts, CAST(CASE WHEN r THEN l_suppkey END AS BIGINT) AS rtp_ssrc FROM f""",
)
def _decode_rtp(spark, sf_dir):
    o = F.col("l_orderkey")
    first = F.when(F.col("l_quantity") == 7, "C0").otherwise("80")
    ssrc = num(F.col("l_suppkey"), 4)
    ssrc = F.when(F.col("l_linenumber") == 5, F.substring(ssrc, 1, 6)).otherwise(ssrc)  # one byte short
    payload = raw(first, num(F.col("l_partkey") % 128, 1), num(o % 65536, 2), num(o * 960 % (1 << 32), 4), ssrc)
    out = decode_rtp(table(spark, sf_dir, "lineitem").select("l_orderkey", payload.alias("payload")))
    return out.select("l_orderkey", "rtp_pt", "rtp_seq", "rtp_ts", "rtp_ssrc")


@check(
    "decode_igmp",
    """SELECT event_id AS frame_no, CASE event_id % 5 WHEN 2 THEN 'join' WHEN 3 THEN 'leave' WHEN 4 THEN 'v3_report' ELSE 'query' END AS igmp_kind,
  CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 END AS INTEGER) AS igmp_version FROM events WHERE event_id % 4 = 2""",
)
def _decode_igmp(spark, sf_dir):
    out = decode_igmp(decode_l4(decode_ipv4(decode_l2(synth_frames(spark, sf_dir)))).where(F.col("ip_proto") == 2))
    return out.select("frame_no", "igmp_kind", "igmp_version")


def hex_eui(expr: str, n: int) -> str:
    """SQL for a number as n bytes of colon hex."""
    groups = "".join("(..)" for _ in range(n))
    return f"regexp_replace(printf('%0{2 * n}x', {expr}), '{groups}', '{':'.join(f'{chr(92)}{i + 1}' for i in range(n))}')"


# Version 2 where id % 3 > 0 (types 0-15, announce cut short where id % 40 = 11), else version 1.
def ptp_payloads(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    mtype = i % 16
    corr = (i * 7919) % 2000000 - 1000000
    corr_hex = F.substring(F.hex(corr * 65536 + i % 65536), -16, 16)
    corr_hex = F.lpad(corr_hex, 16, "0")
    head = F.concat(
        num(mtype, 1), F.lit("020000"), num(i % 256, 1), F.lit("000000"), corr_hex, F.lit("00000000"),
        num(i, 8), num(i % 65536, 2), num(i * 3 % 65536, 2), F.lit("00"), num(i % 256, 1),
    )
    accuracy = F.when(i % 64 < 16, F.lit(0x20) + i % 16).when(i % 64 < 20, F.lit(0xFE)).otherwise(i % 256)
    clock_class = F.when(i % 5 == 0, 6).when(i % 5 == 1, 135).when(i % 5 == 2, 255).otherwise(i % 200)
    tail = F.concat(F.repeat(F.lit("00"), 14), num(clock_class, 1), num(accuracy, 1), F.lit("000000"), num(u + 4096, 8), F.lit("000000"))
    v2 = F.concat(head, F.when(i % 40 == 11, "").otherwise(tail))
    control = i % 7
    name = F.when(i % 4 == 0, "5f44464c54").when(i % 4 == 1, "5f414c5431").when(i % 4 == 2, "5f414c5432").otherwise("5f414c5433")
    uuid = F.when(i % 11 == 0, "000000000000").otherwise(num(u + 256, 6))
    ident = F.when(i % 6 == 0, "47505300").when(i % 6 == 1, "41544f4d").otherwise("46520000")
    v1 = F.concat(
        F.lit("00010001"), name, F.repeat(F.lit("00"), 11), F.lit("0101"), num(i, 6), num(i % 65536, 2), num(i * 3 % 65536, 2),
        num(control, 1), num(i % 256, 1), F.repeat(F.lit("00"), 16), uuid, F.lit("0000000000"), num(i % 6, 1), ident,
    )
    payload = F.unhex(F.when(i % 3 > 0, v2).otherwise(v1))
    return events(spark, sf_dir).select(i, payload.alias("payload"))


_PTP_TYPES = """CASE event_id % 16 WHEN 0 THEN 'Sync' WHEN 1 THEN 'Delay_Req' WHEN 2 THEN 'P_Delay_Req' WHEN 3 THEN 'P_Delay_Resp'
  WHEN 8 THEN 'Follow_Up' WHEN 9 THEN 'Delay_Resp' WHEN 10 THEN 'P_Delay_Resp_Follow_Up' WHEN 11 THEN 'Announce' WHEN 12 THEN 'Signaling'
  WHEN 13 THEN 'Management' ELSE printf('Unknown(0x%X)', event_id % 16) END"""


@check(
    "decode_ptp",
    f"""
WITH f AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 1 END AS v, (event_id * 7919) % 2000000 - 1000000 AS corr,
  CASE WHEN event_id % 64 < 16 THEN 32 + event_id % 16 WHEN event_id % 64 < 20 THEN 254 ELSE event_id % 256 END AS acc,
  CASE event_id % 5 WHEN 0 THEN 6 WHEN 1 THEN 135 WHEN 2 THEN 255 ELSE event_id % 200 END AS cls FROM events),
g AS (SELECT *, CASE WHEN v = 2 THEN event_id % 16 ELSE CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 WHEN 3 THEN 9 WHEN 4 THEN 13 ELSE 255 END END AS t,
  v = 2 AND event_id % 16 = 11 AND event_id % 40 <> 11 AS ann, v = 1 AND event_id % 7 = 0 AND event_id % 11 <> 0 AS body FROM f)
SELECT event_id, CAST(v AS INTEGER) AS ptp_version, CAST(t AS INTEGER) AS ptp_type,
  CASE WHEN v = 2 THEN {_PTP_TYPES} ELSE CASE t WHEN 0 THEN 'Sync' WHEN 1 THEN 'Delay_Req' WHEN 8 THEN 'Follow_Up' WHEN 9 THEN 'Delay_Resp' WHEN 13 THEN 'Management' ELSE 'Unknown' END END AS ptp_name,
  CAST(CASE WHEN v = 2 THEN event_id % 256 ELSE event_id % 4 END AS INTEGER) AS ptp_domain,
  CASE WHEN v = 2 THEN {hex_eui('event_id', 8)} ELSE {hex_eui('event_id', 6)} END AS clock_id,
  CASE WHEN ann THEN {hex_eui('user_id + 4096', 8)} WHEN body THEN {hex_eui('user_id + 256', 6)} END AS grandmaster_id,
  CASE WHEN ann THEN CASE cls WHEN 6 THEN 'Primary reference — locked' WHEN 7 THEN 'Primary reference — free-running' WHEN 52 THEN 'Application-specific'
      WHEN 135 THEN 'Primary reference — holdover' WHEN 165 THEN 'Default' WHEN 187 THEN 'Slave-only' WHEN 255 THEN 'Slave-only' ELSE 'class=' || cls END
    || '  ' || CASE WHEN acc IN (32, 33) THEN '< 100 ns' WHEN acc IN (34, 35) THEN '< 1 µs' WHEN acc IN (36, 37) THEN '< 10 µs' WHEN acc IN (38, 39) THEN '< 100 µs'
      WHEN acc IN (40, 41) THEN '< 1 ms' WHEN acc = 254 THEN 'unknown precision' ELSE 'other' END
    WHEN body THEN CASE event_id % 6 WHEN 0 THEN 'Preferred grandmaster' WHEN 1 THEN 'Primary reference' WHEN 2 THEN 'Secondary reference' ELSE 'Stratum ' || (event_id % 6) END
    || CASE event_id % 6 WHEN 0 THEN '  GPS' WHEN 1 THEN '  ATOM' ELSE '' END END AS clock_quality,
  CAST(CASE WHEN v = 2 THEN corr END AS BIGINT) AS correction_ns, CAST(CASE WHEN v = 2 AND t IN (9, 3) THEN corr END AS BIGINT) AS path_delay_ns,
  CAST(event_id % 65536 AS INTEGER) AS ptp_port, CAST(event_id * 3 % 65536 AS INTEGER) AS ptp_sequence,
  CAST((event_id + 128) % 256 - 128 AS INTEGER) AS log_sync_interval, CAST(CASE WHEN body THEN event_id % 6 END AS INTEGER) AS stratum FROM g""",
)
def _decode_ptp(spark, sf_dir):
    return decode_ptp(ptp_payloads(spark, sf_dir)).drop("payload")


@check(
    "decode_avtp",
    """SELECT event_id, CAST(event_id % 128 AS INTEGER) AS avtp_subtype, CAST(event_id % 256 AS INTEGER) AS avtp_seq,
  CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN regexp_replace(printf('%016x', user_id * 65536 + event_id % 65536),
    '(..)(..)(..)(..)(..)(..)(....)', '\\1:\\2:\\3:\\4:\\5:\\6:\\7') END AS stream_id FROM events""",
)
def _decode_avtp(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    valid = F.when(i % 3 == 0, "80").otherwise("00")
    sid = num(u * 65536 + i % 65536, 8)
    sid = F.when(i % 5 == 0, F.substring(sid, 1, 14)).otherwise(sid)
    payload = raw(num(i % 128, 1), valid, num(i % 256, 1), "00", sid)
    return decode_avtp(events(spark, sf_dir).select(i, payload.alias("payload"))).drop("payload")


@check(
    "decode_adp",
    f"""
WITH f AS (SELECT *, event_id % 13 <> 0 AS ok FROM events)
SELECT event_id, CAST(CASE WHEN ok THEN event_id % 3 END AS INTEGER) AS adp_type, CAST(CASE WHEN ok THEN event_id % 32 * 2 END AS BIGINT) AS valid_time_secs,
  CASE WHEN ok THEN {hex_eui('user_id + 7', 8)} END AS entity_id, CASE WHEN ok THEN {hex_eui('user_id % 9', 8)} END AS entity_model_id,
  CAST(CASE WHEN ok THEN event_id * 331 % 4294967296 END AS BIGINT) AS entity_capabilities,
  CAST(CASE WHEN ok THEN event_id % 5 END AS INTEGER) AS talker_stream_sources, CAST(CASE WHEN ok THEN event_id * 257 % 65536 END AS INTEGER) AS talker_capabilities,
  CAST(CASE WHEN ok THEN event_id % 3 END AS INTEGER) AS listener_stream_sinks, CAST(CASE WHEN ok THEN event_id * 511 % 65536 END AS INTEGER) AS listener_capabilities,
  CAST(CASE WHEN ok THEN event_id END AS BIGINT) AS available_index, CASE WHEN ok THEN {hex_eui('user_id * 3', 8)} END AS gptp_grandmaster_id,
  CAST(CASE WHEN ok THEN event_id % 128 END AS INTEGER) AS gptp_domain_number FROM f""",
)
def _decode_adp(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    domain = F.when(i % 13 == 0, "").otherwise(num(i % 128, 1))  # one byte short
    payload = raw(
        "fa", num(i % 3, 1), num(i % 32 * 2048 + 56, 2), num(u + 7, 8), num(u % 9, 8), num(i * 331 % (1 << 32), 4), num(i % 5, 2),
        num(i * 257 % 65536, 2), num(i % 3, 2), num(i * 511 % 65536, 2), "00000000", num(i, 4), num(u * 3, 8), domain,
    )
    return decode_adp(events(spark, sf_dir).select(i, payload.alias("payload"))).drop("payload")


@check(
    "decode_conmon",
    f"""
WITH f AS (SELECT *, event_id % 10 <> 9 AND event_id % 7 <> 6 AS ok, event_id % 4 < 3 AND event_id % 5 <> 4 AS meter, event_id % 20 AS n FROM events)
SELECT event_id, CASE WHEN ok THEN CASE WHEN event_id % 2 = 0 THEN '00:1d:c1:' || regexp_replace(printf('%06x', user_id), '(..)(..)(..)', '\\1:\\2:\\3')
  ELSE {hex_eui('user_id + 512', 6)} END END AS device_mac,
  CAST(CASE WHEN ok AND meter AND n BETWEEN 1 AND 9 THEN n END AS INTEGER) AS channels FROM f""",
)
def _decode_conmon(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    mac = F.when(i % 2 == 0, F.concat(F.lit("001dc1"), num(u, 3))).otherwise(num(u + 512, 6))
    ident = F.when(i % 2 == 0, F.concat(F.lit("001dc1fffe"), num(u, 3))).otherwise(F.concat(mac, F.lit("0000")))
    sign = F.when(i % 10 == 9, "4175646978617465").otherwise("417564696e617465")
    declared = F.when(i % 7 == 6, num(F.lit(200), 2)).otherwise(num(F.lit(80), 2))
    tag = F.when(i % 4 < 3, "4d4243").otherwise("4d4244")
    repeated = F.when(i % 5 == 4, "ffffffffffff").otherwise(mac)
    payload = raw(
        "ffff", declared, "00000000", ident, sign, F.repeat(F.lit("00"), 18), tag, "000000", repeated, F.repeat(F.lit("00"), 14),
        num(i % 20, 1), F.repeat(F.lit("00"), 11),
    )
    return decode_conmon(events(spark, sf_dir).select(i, payload.alias("payload"))).drop("payload")


@check(
    "decode_flow_control",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'pause' WHEN 1 THEN 'pfc' END AS flow_control FROM events",
)
def _decode_flow_control(spark, sf_dir):
    i = F.col("event_id")
    payload = raw(F.when(i % 3 == 0, "0001").when(i % 3 == 1, "0101").otherwise("00"), "00")
    return decode_flow_control(events(spark, sf_dir).select(i, payload.alias("payload"))).drop("payload")


def sdp_texts(spark, sf_dir):
    """Session text per supplier: two media sections for odd keys, framecount for keys divisible by 3."""
    s = F.col("s_suppkey")
    k = s.cast("string")
    second = F.when(
        s % 2 == 1, F.concat(F.lit("m=video "), (s % 1000 + 6000).cast("string"), F.lit(" RTP/AVP 96 97\r\na=rtpmap:96 raw/90000\r\na=mediaclk:direct=0\r\n"))
    ).otherwise("")
    timing = F.when(s % 3 == 0, "a=framecount:96\r\n").when(s % 3 == 1, "a=ptime:0.25\r\n").otherwise("a=ptime:x\r\n")
    return table(spark, sf_dir, "supplier").select(
        s.alias("announce_id"),
        F.concat(
            F.lit("v=0\r\no=- "), k, F.lit(" 1 IN IP4 10.0.0.1\r\ns="), F.col("s_name"), F.lit("\r\ni=site "),
            F.col("s_nationkey").cast("string"), F.lit("\r\nc=IN IP4 1.2.3.4\r\nm=audio "), (s % 1000 + 5004).cast("string"),
            F.lit(" RTP/AVP 98 x 300\r\ni=ignored\r\nc=IN IP4 239.69.0."), (s % 250).cast("string"),
            F.lit("/32\r\na=rtpmap:98 L24/48000/"), (s % 8 + 1).cast("string"), F.lit("\r\n"), timing,
            F.lit("a=ts-refclk:ptp=IEEE1588-2008:00-1D-C1-FF-FE-00-00-"), F.lpad(F.hex(s % 256), 2, "0"), F.lit(":"), (s % 300).cast("string"),
            F.lit("\r\nm=bad 1\r\n"), second,
        ).alias("sdp"),
    )


_SDP = """
WITH s AS (SELECT s_suppkey AS k, s_name, s_nationkey FROM supplier),
m AS (SELECT k, s_name, s_nationkey, 0 AS o, 'audio' AS mt, k % 1000 + 5004 AS port, '98' AS pts, '239.69.0.' || (k % 250) AS ip,
    'L24/48000/' || (k % 8 + 1) AS rtpmap, 48000.0 AS hz, k % 8 + 1 AS ch, CASE k % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 0.25 ELSE 1.0 END AS pt,
    '' AS mc, CASE WHEN k % 300 < 256 THEN '00:1d:c1:ff:fe:00:00:' || printf('%02x', k % 256) END AS gm,
    CASE WHEN k % 300 < 256 THEN k % 300 END AS dom FROM s
  UNION ALL SELECT k, s_name, s_nationkey, 1, 'video', k % 1000 + 6000, '96,97', NULL, 'raw/90000', 90000.0, 0, 0.0, 'direct=0', NULL, NULL FROM s WHERE k % 2 = 1)
SELECT k AS announce_id, CAST(k AS VARCHAR) AS session_id, s_name AS session_name, 'site ' || s_nationkey AS info, CAST(o AS INTEGER) AS media_ordinal,
  mt AS media_type, CAST(port AS INTEGER) AS port, pts AS payload_types, ip AS connection_ip, rtpmap, CAST(hz AS DOUBLE) AS clock_hz,
  CAST(ch AS INTEGER) AS channels, CAST(pt AS DOUBLE) AS ptime_ms, mc AS mediaclk, gm AS claimed_gm, CAST(dom AS INTEGER) AS claimed_domain FROM m"""


@check("parse_sdp", _SDP)
def _parse_sdp(spark, sf_dir):
    out = media_sections(sdp_texts(spark, sf_dir), keep=("announce_id",))
    types = F.array_join(F.transform("payload_types", lambda x: x.cast("string")), ",")
    return out.withColumn("payload_types", types).drop("ts_refclk")


@check(
    "decode_sap",
    """SELECT s_suppkey AS announce_id, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS announced,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN 's=' || s_name END AS sdp FROM supplier""",
)
def _decode_sap(spark, sf_dir):
    s = F.col("s_suppkey")
    head = F.when(s % 5 == 0, "24").when(s % 7 == 0, "40").when(s % 3 == 0, "30").otherwise("20")  # deletion, version, IPv6
    auth = s % 4
    address = F.repeat(F.lit("0a"), F.when((s % 3 == 0) & (s % 5 != 0) & (s % 7 != 0), 16).otherwise(4))
    mime = F.when(s % 2 == 0, F.concat(F.hex(F.lit("application/sdp")), F.lit("00"))).otherwise("")
    payload = raw(head, num(auth, 1), "beef", address, F.repeat(F.lit("00000000"), auth.cast("int")), mime, F.hex(F.concat(F.lit("s="), F.col("s_name"))))
    out = decode_sap(table(spark, sf_dir, "supplier").select(s.alias("announce_id"), payload.alias("payload")))
    return out.select("announce_id", F.col("sdp").isNotNull().alias("announced"), "sdp")


@check(
    "ts_refclk_norm",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 AND p_size * 6 < 256 THEN 'aa:bb:' || p_size END AS gm,
  CAST(CASE WHEN p_partkey % 4 < 2 AND p_size * 6 < 256 THEN p_size * 6 END AS INTEGER) AS domain FROM part""",
)
def _ts_refclk_norm(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    prefix = F.when(k % 4 == 0, "ptp=IEEE1588-2008:").when(k % 4 == 1, "ptp=IEEE1588-2002:").when(k % 4 == 2, "ptp=IEEE1588-2019:").otherwise("local")
    text = F.concat(prefix, F.lit("AA-BB-"), size.cast("string"), F.lit(":"), (size * 6).cast("string"))
    ref = clock_reference(text)
    return table(spark, sf_dir, "part").select("p_partkey", ref["gm"].alias("gm"), ref["domain"].alias("domain"))


@check("format_eui", f"SELECT c_custkey, {hex_eui('c_custkey * 65537', 8)} AS eui, {hex_eui('c_custkey', 6)} AS mac FROM customer")
def _format_eui(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k, format_eui(F.hex(k * 65537), 8).alias("eui"), format_eui(F.hex(k), 6).alias("mac")
    )


def bits(expr: str, mask: int) -> str:
    return f"(({expr}) & {mask}) <> 0"


@check(
    "decode_caps",
    f"""
WITH f AS (SELECT event_id, event_id * 331 % 4294967296 AS e, event_id * 257 % 65536 AS t, event_id * 511 % 65536 AS l, event_id % 5 AS ts, event_id % 3 AS ls FROM events)
SELECT event_id,
  CASE WHEN ts > 0 THEN CASE WHEN {bits('t', 512)} AND {bits('t', 1024)} THEN 'audio+video' WHEN {bits('t', 512)} THEN 'audio' WHEN {bits('t', 1024)} THEN 'video' ELSE 'other' END END AS talker,
  CASE WHEN ls > 0 THEN CASE WHEN {bits('l', 512)} AND {bits('l', 1024)} THEN 'audio+video' WHEN {bits('l', 512)} THEN 'audio' WHEN {bits('l', 1024)} THEN 'video' ELSE 'other' END END AS listener,
  CASE WHEN {bits('e', 256)} AND {bits('e', 512)} THEN 'Class A+B' WHEN {bits('e', 256)} THEN 'Class A' WHEN {bits('e', 512)} THEN 'Class B' ELSE '' END AS sr_class,
  {bits('e', 8)} AS aem, {bits('e', 131072)} AS not_ready FROM f""",
)
def _decode_caps(spark, sf_dir):
    i = F.col("event_id")
    cols = describe_entity(i * 331 % (1 << 32), i * 257 % 65536, i % 5, i * 511 % 65536, i % 3)
    return events(spark, sf_dir).select(i, *[c.alias(n) for n, c in cols.items()])


@check(
    "code_lookup",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'IEC 61883' WHEN 1 THEN 'MMA Streams' WHEN 2 THEN 'CRF' WHEN 3 THEN 'CVF' WHEN 4 THEN 'CEF' ELSE 'AVTP' END AS subtype,
  CASE p_size WHEN 1 THEN 'insufficient bandwidth' WHEN 2 THEN 'insufficient bridge resources' WHEN 3 THEN 'insufficient bandwidth for Traffic Class'
  WHEN 4 THEN 'StreamID already in use by another Talker' WHEN 5 THEN 'stream destination address already in use' WHEN 6 THEN 'stream pre-empted by a higher-rank stream'
  WHEN 7 THEN 'reported latency has changed' WHEN 8 THEN 'egress port is not AVB-capable' WHEN 9 THEN 'use a different destination address' WHEN 10 THEN 'out of MSRP resources'
  WHEN 11 THEN 'out of MMRP resources' WHEN 12 THEN 'cannot store destination address' WHEN 13 THEN 'requested priority is not an SR Class priority'
  WHEN 14 THEN 'MaxFrameSize too large for the media' WHEN 15 THEN 'max fan-in ports limit reached' WHEN 16 THEN 'changed FirstValue for a registered StreamID'
  WHEN 17 THEN 'VLAN blocked on this egress port (registration forbidden)' WHEN 18 THEN 'VLAN tagging disabled on this egress port'
  WHEN 19 THEN 'SR class priority mismatch' ELSE 'unknown failure' END AS reason FROM part""",
)
def _code_lookup(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 7).cast("int").alias("code"))
    out = lookup(df, AVTP_SUBTYPES, "code", "code int, subtype string", UNKNOWN_SUBTYPE, "subtype")
    reason = case_of(F.col("p_size"), RESERVATION_FAILURES, UNKNOWN_FAILURE)
    return out.select("p_partkey", "subtype", reason.alias("reason"))


@check(
    "range_lookup",
    """WITH f AS (SELECT event_id, event_id % 16 + 30 AS a FROM events)
SELECT event_id, CASE WHEN a IN (32, 33) THEN '< 100 ns' WHEN a IN (34, 35) THEN '< 1 µs' WHEN a IN (36, 37) THEN '< 10 µs' WHEN a IN (38, 39) THEN '< 100 µs'
  WHEN a IN (40, 41) THEN '< 1 ms' ELSE 'other' END AS accuracy FROM f""",
)
def _range_lookup(spark, sf_dir):
    i = F.col("event_id")
    df = events(spark, sf_dir).select(i, (i % 16 + 30).alias("code"))
    out = lookup(df, CLOCK_ACCURACY, "code", "lo int, hi int, accuracy string", OTHER_ACCURACY, "accuracy")
    return out.select("event_id", "accuracy")
