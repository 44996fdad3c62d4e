"""From frames to typed rows. Narrow transformations on column expressions only: no shuffle, no Python on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.addresses import ip_text
from tallywire.functions.arith import signed_wrap
from tallywire.functions.binary import computed_once, cut, eui, flag, hex_at, stream_id_text, tail, uint
from tallywire.functions.lookups import (
    CLOCK_ACCURACY,
    CLOCK_CLASSES,
    OTHER_ACCURACY,
    PTP1_CONTROLS,
    PTP1_OTHER,
    PTP2_MESSAGES,
    STRATA,
    V1_IDENTIFIERS,
    case_of,
)

# EtherTypes and IP protocol numbers.
VLAN_TAGS = (0x8100, 0x88A8, 0x9100)
ETHERTYPE_IPV4 = 0x0800
PROTO_IGMP, PROTO_TCP, PROTO_UDP = 2, 6, 17


def decode_l2(df: DataFrame, frame: str = "frame", few: int = 2) -> DataFrame:
    """Add `src_mac`, `ethertype`, `pcp` of the outermost tag and `l2_offset`; null when a tag is cut off.

    Tag stacks of any depth are walked: up to `few` tags by plain comparisons, deeper ones by a search for the first
    position without a tag.
    """
    data = F.col(frame)
    size = F.length(data)
    marks = [f"{t:04X}" for t in VLAN_TAGS]
    places = F.sequence(F.lit(few), F.floor((size - 14) / 4).cast("int"))
    tags = F.get(F.filter(places, lambda i: ~F.hex(cut(data, i * 4 + 12, 2)).isin(marks)), F.lit(0))
    tags = F.when(size >= 14 + 4 * few, tags)
    for i in reversed(range(few)):
        at = 12 + 4 * i
        tags = F.when(size < at + 2, None).when(F.hex(cut(data, at, 2)).isin(marks), tags).otherwise(F.lit(i))
    df = df.withColumn("_tags", tags)
    tags = F.col("_tags")
    return computed_once(
        df,
        {
            "src_mac": eui(data, 6, 6),
            "ethertype": uint(data, tags * 4 + 12, 2).cast("int"),
            "pcp": F.when(tags > 0, F.shiftright(uint(data, 14), 5)).cast("int"),
            "l2_offset": (tags * 4 + 14).cast("int"),
        },
        drop=("_tags",),
    )


def decode_ipv4(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add addresses (text and number), `ip_proto`, `dscp`, `ecn`, `ttl` and the bounds of the IP payload."""
    data, at = F.col(frame), F.col("l2_offset")
    is_ip = (F.col("ethertype") == ETHERTYPE_IPV4) & (F.length(data) >= at + 20)
    df = df.withColumn("_ip", F.when(is_ip, cut(data, at, 20)))
    ip = F.col("_ip")
    df = df.withColumns(
        {
            "_ihl": uint(ip, 0).bitwiseAND(0x0F) * 4,
            "_tos": uint(ip, 1),
            "_total": uint(ip, 2, 2),
            "_frag": uint(ip, 6, 2).bitwiseAND(0x1FFF),
            "_src": uint(ip, 12, 4),
            "_dst": uint(ip, 16, 4),
        }
    )
    start = F.col("l2_offset") + F.col("_ihl")
    stop = F.least(F.length(data), start + F.greatest(F.col("_total") - F.col("_ihl"), F.lit(0)))
    return computed_once(
        df,
        {
            "src_ip_num": F.col("_src"),
            "dst_ip_num": F.col("_dst"),
            "src_ip": ip_text(F.col("_src")),
            "dst_ip": ip_text(F.col("_dst")),
            "ip_proto": uint(F.col("_ip"), 9).cast("int"),
            "ttl": uint(F.col("_ip"), 8).cast("int"),
            "dscp": F.shiftright(F.col("_tos"), 2).cast("int"),
            "ecn": F.col("_tos").bitwiseAND(3).cast("int"),
            "first_fragment": F.col("_frag") == 0,
            "ip_payload_start": start.cast("int"),
            "ip_payload_end": stop.cast("int"),
        },
        drop=("_ip", "_ihl", "_tos", "_total", "_frag", "_src", "_dst"),
    )


def decode_l4(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add ports, TCP numbers and flags, `payload` and `payload_len`; later fragments have none of them.

    `payload` is the UDP payload, the IGMP message, or what follows the EtherType in frames that are not IPv4.
    """
    data, start, stop = F.col(frame), F.col("ip_payload_start"), F.col("ip_payload_end")
    room = F.greatest(stop - start, F.lit(0))
    whole = F.coalesce(F.col("first_fragment"), F.lit(False))
    udp = whole & (F.col("ip_proto") == PROTO_UDP) & (room >= 8)
    tcp = whole & (F.col("ip_proto") == PROTO_TCP) & (room >= 20)
    df = df.withColumn("_l4", F.when(udp, cut(data, start, 8)).when(tcp, cut(data, start, 20)))
    l4 = F.col("_l4")
    flags = F.when(tcp, uint(l4, 13))
    udp_len = F.greatest(F.least(uint(l4, 4, 2) - 8, stop - start - 8), F.lit(0))
    payload = (
        F.when(udp, cut(data, start + 8, udp_len))
        .when(F.col("ip_proto") == PROTO_IGMP, cut(data, start, room))
        .when(F.col("ethertype") != ETHERTYPE_IPV4, tail(data, F.col("l2_offset")))
    )
    return computed_once(
        df.withColumn("_payload", payload),
        {
            "src_port": uint(l4, 0, 2).cast("int"),
            "dst_port": uint(l4, 2, 2).cast("int"),
            "tcp_seq": F.when(tcp, uint(l4, 4, 4)),
            "tcp_ack": F.when(tcp, uint(l4, 8, 4)),
            "fin": flag(flags, 0x01),
            "syn": flag(flags, 0x02),
            "rst": flag(flags, 0x04),
            "payload": F.col("_payload"),
            "payload_len": F.length("_payload"),
        },
        drop=("_l4", "_payload"),
    )


def decode_rtp(df: DataFrame, payload: str = "payload", only: Column | None = None) -> DataFrame:
    """Add `rtp_pt`, `rtp_seq`, `rtp_ts`, `rtp_ssrc`, null unless 12 bytes with version 2 are there."""
    p = F.col(payload)
    gate = (F.length(p) >= 12) & (F.shiftright(uint(p, 0), 6) == 2)
    gate = gate if only is None else gate & only
    df = df.withColumn("_rtp", F.when(gate, cut(p, 0, 12)))
    r = F.col("_rtp")
    return computed_once(
        df,
        {
            "rtp_pt": uint(r, 1).bitwiseAND(0x7F).cast("int"),
            "rtp_seq": uint(r, 2, 2).cast("int"),
            "rtp_ts": uint(r, 4, 4),
            "rtp_ssrc": uint(r, 8, 4),
        },
        drop=("_rtp",),
    )


def decode_packets(frames: DataFrame) -> DataFrame:
    """All layers up to RTP in one narrow job."""
    out = decode_l4(decode_ipv4(decode_l2(frames)))
    return decode_rtp(out, only=F.col("ip_proto") == PROTO_UDP)


def decode_ptp(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the `ptp_*` fields of a clock message, version 1 or 2; `ptp_version` is null if it is too short.

    Fields are added a few at a time: generated code for all of them is one method, too long for the JVM to compile.
    """
    p = F.col(payload)
    size = F.length(p)
    is_v2 = uint(p, 1).bitwiseAND(0x0F) == 2
    version = F.when((size >= 34) & is_v2, 2).when((size >= 40) & ~is_v2, 1)
    df = computed_once(df, {"ptp_version": version})
    v2, v1 = F.col("ptp_version") == 2, F.col("ptp_version") == 1

    kind2 = uint(p, 0).bitwiseAND(0x0F)
    control = uint(p, 32)
    kind1 = case_of(control, [(c, t) for c, t, _ in PTP1_CONTROLS], F.lit(PTP1_OTHER[0]))
    df = computed_once(df, {"ptp_type": F.when(v2, kind2).when(v1, kind1).cast("int")})
    kind = F.col("ptp_type")
    unnamed = F.concat(F.lit("Unknown(0x"), F.hex(kind), F.lit(")"))
    name1 = case_of(F.col("_at_control"), [(c, n) for c, _, n in PTP1_CONTROLS], PTP1_OTHER[1])
    announce = v2 & (kind == 0x0B) & (size >= 64)
    body = v1 & (kind == 0) & (size >= 66) & (hex_at(p, 50, 6) != "0" * 12)

    # The correction is signed, in units of 2^-16 ns: its upper 48 bits are the whole nanoseconds.
    correction = F.when(v2, signed_wrap(uint(p, 8, 6), 48))
    subdomain = F.substring(hex_at(p, 4, 16), 1, 10)
    # Version 1 subdomain names and their domain numbers (hex of the ASCII text).
    alternates = [("_ALT%d" % n, n) for n in (1, 2, 3)]
    domain1 = case_of(subdomain, [(text.encode().hex(), n) for text, n in alternates], F.lit(0))
    read = {
        "_at_control": F.when(v1, control),
        "_at_class": F.when(announce, uint(p, 48)),
        "_at_accuracy": F.when(announce, uint(p, 49)),
        "_at_stratum": F.when(body, uint(p, 61)),
    }
    clock_class, stratum = F.col("_at_class"), F.col("_at_stratum")
    quality2 = F.concat(
        case_of(clock_class, CLOCK_CLASSES, F.concat(F.lit("class="), clock_class.cast("string"))),
        F.lit("  "),
        case_of(F.col("_at_accuracy"), CLOCK_ACCURACY, OTHER_ACCURACY),
    )
    raw = F.try_validate_utf8(cut(p, 62, 4).cast("string"))
    ident = F.trim(F.regexp_replace(raw, "\\x00+$", ""))
    level = case_of(stratum, STRATA, F.concat(F.lit("Stratum "), stratum.cast("string")))
    quality1 = F.when(ident.isin(V1_IDENTIFIERS), F.concat(level, F.lit("  "), ident)).otherwise(level)
    log_interval = signed_wrap(uint(p, 33), 8)
    named = {
        "ptp_name": F.when(v2, case_of(kind, PTP2_MESSAGES, unnamed)).when(v1, name1),
        "ptp_domain": F.when(v2, uint(p, 4)).when(v1, domain1).cast("int"),
    }
    clock = {"clock_id": F.when(v2, eui(p, 20, 8)).when(v1, eui(p, 22, 6))}
    master = {"grandmaster_id": F.when(announce, eui(p, 53, 8)).when(body, eui(p, 50, 6))}
    quality = {"clock_quality": F.when(announce, quality2).when(body, quality1)}
    delays = {"correction_ns": correction}
    numbers = {
        "path_delay_ns": F.when(kind.isin(0x9, 0x3), F.col("correction_ns")),
        "ptp_port": F.when(v2 | v1, uint(p, 28, 2)).cast("int"),
        "ptp_sequence": F.when(v2 | v1, uint(p, 30, 2)).cast("int"),
        "log_sync_interval": F.when(v2 | v1, log_interval).cast("int"),
        "stratum": stratum.cast("int"),
    }
    for fields in (read, named, clock, master, quality, delays, numbers):
        df = computed_once(df, fields)
    return df.drop(*read)


def decode_avtp(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `avtp_subtype`, `avtp_seq` and, when the valid bit is set, `stream_id`."""
    p = F.col(payload)
    has_id = (F.length(p) >= 12) & flag(uint(p, 1), 0x80)
    return df.withColumns(
        {
            "avtp_subtype": F.coalesce(uint(p, 0), F.lit(0)).cast("int"),
            "avtp_seq": uint(p, 2).cast("int"),
            "stream_id": F.when(has_id, stream_id_text(p, 4)),
        }
    )


def decode_adp(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the fields of an entity discovery message, all null unless it is one of at least 49 bytes."""
    df = df.withColumn("_adp", F.when((F.length(payload) >= 49) & (uint(F.col(payload), 0) == 0xFA), F.col(payload)))
    p = F.col("_adp")
    return df.withColumns(
        {
            "adp_type": uint(p, 1).bitwiseAND(0x0F).cast("int"),
            "valid_time_secs": F.shiftright(uint(p, 2, 2), 11) * 2,
            "entity_id": eui(p, 4, 8),
            "entity_model_id": eui(p, 12, 8),
            "entity_capabilities": uint(p, 20, 4),
            "talker_stream_sources": uint(p, 24, 2).cast("int"),
            "talker_capabilities": uint(p, 26, 2).cast("int"),
            "listener_stream_sinks": uint(p, 28, 2).cast("int"),
            "listener_capabilities": uint(p, 30, 2).cast("int"),
            "available_index": uint(p, 36, 4),
            "gptp_grandmaster_id": eui(p, 40, 8),
            "gptp_domain_number": uint(p, 48).cast("int"),
        }
    ).drop("_adp")


# Fixed value: signature of a device-monitoring message.
CONMON_SIGNATURE = "Audinate".encode().hex()


def decode_conmon(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `device_mac` and `channels` of a device-monitoring message; null for anything else.

    The identity is a MAC, or an EUI-64 whose FF:FE filler is dropped. A channel count is only taken from a metering
    block that repeats the sender's MAC and fits into the declared length.
    """
    p = F.col(payload)
    declared = uint(p, 2, 2)
    valid = (F.length(p) >= 24) & (hex_at(p, 16, 8) == CONMON_SIGNATURE) & declared.between(24, F.length(p))
    ident = hex_at(p, 8, 8)
    filler = F.substring(ident, 7, 4) == "fffe"
    mac = F.when(filler, F.concat(F.substring(ident, 1, 6), F.substring(ident, 11, 6))).otherwise(F.substring(ident, 1, 12))
    df = computed_once(df, {"_mac": F.when(valid, mac)})
    count = uint(p, 0x44)
    metering = (hex_at(p, 0x2A, 3) == "MBC".encode().hex()) & (hex_at(p, 0x30, 6) == F.col("_mac"))
    channels = F.when(F.col("_mac").isNotNull() & metering & (count > 0) & (count + 0x47 <= declared), count)
    text = F.concat_ws(":", *[F.substring("_mac", 2 * i + 1, 2) for i in range(6)])
    return computed_once(
        df, {"device_mac": F.when(F.col("_mac").isNotNull(), text), "channels": channels.cast("int")}, drop=("_mac",)
    )


def decode_flow_control(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `flow_control`: pause, pfc or null."""
    opcode = uint(F.col(payload), 0, 2)
    return df.withColumn("flow_control", F.when(opcode == 0x0001, "pause").when(opcode == 0x0101, "pfc"))


def decode_igmp(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `igmp_kind` and, for queries, `igmp_version` (3 from 12 bytes on)."""
    first = F.coalesce(uint(F.col(payload), 0), F.lit(0))
    kind = (
        F.when(first == 0x11, "query")
        .when(first == 0x16, "join")
        .when(first == 0x17, "leave")
        .when(first == 0x22, "v3_report")
        .otherwise("unknown")
    )
    version = F.when(first == 0x11, F.when(F.length(payload) >= 12, 3).otherwise(2))
    return df.withColumns({"igmp_kind": kind, "igmp_version": version})
