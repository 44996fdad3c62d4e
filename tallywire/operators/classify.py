"""Ordered rules: protocol of a packet, stream subtype, sender class, marks that break the rules, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.addresses import is_aes67_group, is_dante_group, is_st2110_group
from tallywire.functions.arith import as_col
from tallywire.functions.binary import computed_once
from tallywire.functions.lookups import ALLOWED_DSCP

Rule = tuple[str, Column]

# Ports and port ranges the rules look at.
SAP_PORT, MDNS_PORT = 9875, 5353
PTP_PORTS = (319, 320)
CONMON_PORTS = (8700, 8708)
CONTROL_PORTS = (4440, 4455, 8700, 8800)
ATP_PORT, ATP_PORTS = 4321, (14336, 15359)
AUDIO_PORTS = (5000, 6000)
DVS_RANGES = [(38700, 38708), (38800, 38800), (38900, 38900)]
VIA_RANGES = [(28700, 28708), (28800, 28800), (28900, 28900), (4777, 4777), (24440, 24441), (24444, 24444), (24455, 24455), (34336, 34600)]
HARDWARE_RANGES = [(8751, 8751)]
DVS_DESTINATION = [(8899, 8899)]
HARDWARE_DESTINATION = [(61440, 61951)]

# EtherTypes of the layer-2 kinds.
ETHERTYPES = [("msrp", 0x22EA), ("lldp", 0x88CC), ("flow_control", 0x8808), ("mvrp", 0x88F5), ("avtp", 0x22F0), ("gptp", 0x88F7)]


DROPPED = "-"


def first_match(rules: Sequence[Rule], otherwise: str | None = None) -> Column:
    """One CASE chain out of ordered rules: the first that holds names the row."""
    out = None
    for name, cond in rules:
        value = F.lit(None if name == DROPPED else name)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(otherwise))


def _within(port: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | (port == lo if lo == hi else port.between(lo, hi))
    return hit


def control_plane_class(src_port: Column | str = "src_port", dst_port: Column | str = "dst_port") -> Column:
    """Sender class from its control ports. Ports that collide with common ones count as destination only."""
    src, dst = as_col(src_port), as_col(dst_port)

    def either(ranges: Sequence[tuple[int, int]]) -> Column:
        return _within(src, ranges) | _within(dst, ranges)

    return first_match(
        [
            ("DVS", either(DVS_RANGES) | _within(dst, DVS_DESTINATION)),
            ("Via", either(VIA_RANGES)),
            ("Hardware", either(HARDWARE_RANGES) | _within(dst, HARDWARE_DESTINATION)),
        ]
    )


def video_subtype(payload_type: Column | str = "rtp_pt", dst_port: Column | str = "dst_port") -> Column:
    """Label of an ST 2110 stream: last digit of the port, else the payload type."""
    digit, pt = as_col(dst_port) % 10, as_col(payload_type)
    return first_match(
        [
            ("2110-20", digit == 4),
            ("2110-30", digit == 6),
            ("2110-40", digit == 8),
            ("2110-20", pt.between(96, 107)),
            ("2110-30", pt.between(108, 115)),
            ("2110-40", pt.between(116, 127)),
        ],
        "2110-??",
    )


def likely_dante_audio(src_port: Column, dst_port: Column, payload_type: Column) -> Column:
    """Both ports even within the audio range and a payload type that audio uses."""

    def even(p: Column) -> Column:
        return p.between(*AUDIO_PORTS) & (p % 2 == 0)

    return even(src_port) & even(dst_port) & (payload_type.isin(0, 8) | (payload_type >= 96))


def packet_rules(
    ethertype: Column | str = "ethertype",
    ip_proto: Column | str = "ip_proto",
    src_port: Column | str = "src_port",
    dst_port: Column | str = "dst_port",
    dst_ip: Column | str = "dst_ip_num",
    payload_type: Column | str = "rtp_pt",
    rtp: Column | None = None,
    entity: Column | None = None,
    conmon: Column | None = None,
    ptp: Column | None = None,
    sap: Column | None = None,
    mdns_kind: Column | None = None,
) -> list[Rule]:
    """The rule list for `first_match`. Optional columns say what the payload turned out to be.

    Rules named DROPPED recognise rows that get no name.
    """
    et, proto = as_col(ethertype), as_col(ip_proto)
    src, dst, to, pt = as_col(src_port), as_col(dst_port), as_col(dst_ip), as_col(payload_type)
    yes, no = F.lit(True), F.lit(False)
    is_rtp = pt.isNotNull() if rtp is None else rtp
    is_entity = no if entity is None else entity
    is_conmon = no if conmon is None else conmon
    is_ptp = yes if ptp is None else ptp
    is_sap = yes if sap is None else sap
    l2 = dict(ETHERTYPES)
    mdns = (src == MDNS_PORT) | (dst == MDNS_PORT)
    rules: list[Rule] = [
        ("msrp", et == l2["msrp"]),
        ("lldp", et == l2["lldp"]),
        ("flow_control", et == l2["flow_control"]),
        ("mvrp", et == l2["mvrp"]),
        ("adp", (et == l2["avtp"]) & is_entity),
        ("avtp", et == l2["avtp"]),
        ("ptp", (et == l2["gptp"]) & is_ptp),
        (DROPPED, (et != 0x0800) | et.isNull()),
        ("igmp", proto == 2),
        ("tcp", (proto == 6) & src.isNotNull()),
        (DROPPED, (proto != 17) | proto.isNull() | src.isNull()),
        ("sap", (dst == SAP_PORT) & is_sap),
        (DROPPED, dst == SAP_PORT),
    ]
    if mdns_kind is not None:
        rules += [("dante_discovery", mdns & (mdns_kind == "dante")), ("ndi_discovery", mdns & (mdns_kind == "ndi"))]
    return rules + [
        (DROPPED, mdns),
        ("dante_conmon", dst.between(*CONMON_PORTS) & is_conmon),
        ("dante_control", src.isin(*CONTROL_PORTS) | dst.isin(*CONTROL_PORTS)),
        ("dante_control_plane", control_plane_class(src, dst).isNotNull()),
        ("ptp", (src.isin(*PTP_PORTS) | dst.isin(*PTP_PORTS)) & is_ptp),
        ("dante_audio", (is_dante_group(to) & (dst == ATP_PORT)) | dst.between(*ATP_PORTS) | src.between(*ATP_PORTS)),
        (DROPPED, ~is_rtp),
        ("dante_audio", likely_dante_audio(src, dst, pt)),
        ("dante_audio", is_dante_group(to) & dst.between(*AUDIO_PORTS) & (dst % 2 == 0)),
        ("aes67", is_aes67_group(to)),
        ("st2110", is_st2110_group(to)),
    ]


def classify(df: DataFrame, rules: Sequence[Rule], name: str = "kind") -> DataFrame:
    """Add the name of the first rule that holds; null for dropped and unmatched rows."""
    return computed_once(df, {name: first_match(rules)})


def protocol_label(kind: Column | str = "kind", payload_type: Column | str = "rtp_pt", dst_port: Column | str = "dst_port") -> Column:
    """Stream label of a classified packet; null for control traffic."""
    k = as_col(kind)
    return (
        F.when(k == "aes67", "AES67").when(k == "dante_audio", "Dante").when(k == "st2110", video_subtype(payload_type, dst_port))
    )


# What a choice stands for, and the kinds each protocol needs.
CHOICES = {
    "all": ("AES67", "ST2110", "Dante", "NDI", "AVB"),
    "audio": ("AES67", "Dante", "AVB"),
    "video": ("ST2110", "NDI"),
    "aes67": ("AES67",),
    "avb": ("AVB",),
    "dante": ("Dante",),
    "ndi": ("NDI",),
    "st2110": ("ST2110",),
}
KINDS = {
    "AES67": ("aes67", "ptp", "igmp", "sap"),
    "ST2110": ("st2110", "ptp", "igmp", "sap"),
    "Dante": ("dante_audio", "dante_control", "dante_control_plane", "dante_conmon", "dante_discovery", "ptp", "igmp"),
    "NDI": ("ndi_discovery", "tcp"),
    "AVB": ("avtp", "msrp", "mvrp", "adp", "ptp"),
}
ALWAYS = ("lldp", "flow_control")


def expand_choices(choices: Sequence[str]) -> tuple[str, ...]:
    """Protocols a selection stands for, in a fixed order."""
    wanted = {p for c in choices for p in CHOICES[c.strip().lower()]}
    return tuple(p for p in CHOICES["all"] if p in wanted)


def select_protocols(df: DataFrame, choices: Sequence[str], kind: str = "kind") -> DataFrame:
    """Rows that the selected protocols need. A literal IN list, so the filter reaches the scan."""
    kinds = sorted({k for p in expand_choices(choices) for k in KINDS[p]} | set(ALWAYS))
    return df.where(F.col(kind).isin(kinds))


def dscp_violation(protocol: Column | str = "protocol", dscp: Column | str = "dscp", software: Column | None = None) -> Column:
    """Whether a mark breaks the protocol's rule; unmarked Dante packets of software senders do not."""
    p, d = as_col(protocol), as_col(dscp)
    ok = F.lit(False)
    for label in dict.fromkeys(name for name, _ in ALLOWED_DSCP):
        ok = ok | ((p == label) & d.isin([v for name, v in ALLOWED_DSCP if name == label]))
    if software is not None:
        ok = ok | ((p == "Dante") & (d == 0) & F.coalesce(software, F.lit(False)))
    governed = p.isin(sorted({name for name, _ in ALLOWED_DSCP}))
    return F.coalesce(governed & ~ok, F.lit(False))


def pcp_advisory(protocol: Column | str = "protocol", pcp: Column | str = "pcp") -> Column:
    """Tagged media packets whose priority is not 6."""
    p = as_col(protocol)
    return F.coalesce((p == "AES67") | p.startswith("2110"), F.lit(False)) & F.coalesce(as_col(pcp) != 6, F.lit(False))


def pt_mismatch(rtp_pt: Column | str = "rtp_pt", expected: Column | str = "expected_pt") -> Column:
    """Payload type other than the announced one; false while none is announced."""
    return F.coalesce(as_col(rtp_pt) != as_col(expected), F.lit(False))


def sender_verdict(control: Column, regularity: Column, ttl: Column, dscp: Column) -> Column:
    """struct(class, confidence, signals) of a sender, null without any signal.

    Control ports decide, then timing, then a TTL of 128, then a first mark of 0. `signals` counts the evidence
    that agrees.
    """
    windows_host, unmarked = F.coalesce(ttl == 128, F.lit(False)), F.coalesce(dscp == 0, F.lit(False))
    noisy, steady = F.coalesce(regularity == "noisy", F.lit(False)), F.coalesce(regularity == "metronomic", F.lit(False))

    def verdict(cls: Column | str, confidence: str, *evidence: Column) -> Column:
        signals = F.lit(1)
        for e in evidence:
            signals = signals + e.cast("int")
        name = F.lit(cls) if isinstance(cls, str) else cls
        return F.struct(name.alias("class"), F.lit(confidence).alias("confidence"), signals.alias("signals"))

    return (
        F.when(control == "Hardware", verdict(control, "confirmed", steady))
        .when(control.isNotNull(), verdict(control, "confirmed", noisy, windows_host, unmarked))
        .when(steady, verdict("Hardware", "inferred"))
        .when(noisy, verdict("DVS", "inferred", windows_host, unmarked))
        .when(windows_host, verdict("DVS", "inferred", unmarked))
        .when(unmarked, verdict("DVS", "hint"))
    )


def is_software(control: Column, regularity: Column, ttl: Column) -> Column:
    """Whether the sender counts as software when its marks are left aside."""
    v = sender_verdict(control, regularity, ttl, F.lit(None).cast("int"))
    return F.coalesce(v["class"] != "Hardware", F.lit(False))


def sender_signals(
    packets: DataFrame, key: Sequence[str], order: Sequence[str] = ("ts", "frame_no"), ttl: str = "ttl", dscp: str = "dscp", pcp: str = "pcp", size: str = "frame_bytes"
) -> DataFrame:
    """Lifetime firsts and extremes of a stream: smallest TTL, first mark, first violating priority, largest packet."""
    at = F.struct(*order)
    bad = F.col(pcp).isNotNull() & (F.col(pcp) != 6)
    return packets.groupBy(*key).agg(
        F.min(ttl).alias("min_ttl"),
        F.min_by(dscp, at).alias("first_dscp"),
        F.min_by(pcp, F.when(bad, at)).alias("first_bad_pcp"),
        F.max(size).alias("max_bytes"),
    )
