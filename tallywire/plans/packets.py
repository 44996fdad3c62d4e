"""The packets table: decoded, classified and labelled frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.addresses import is_multicast
from tallywire.functions.arith import block, period_start
from tallywire.functions.binary import computed_once, flag, uint
from tallywire.operators.classify import classify, control_plane_class, packet_rules, protocol_label, select_protocols
from tallywire.operators.windows import WINDOW_SECONDS
from tallywire.sources.decode import (
    decode_adp,
    decode_avtp,
    decode_conmon,
    decode_flow_control,
    decode_igmp,
    decode_packets,
    decode_ptp,
)
from tallywire.sources.sdp import decode_sap, media_sections
from tallywire.sources.tlv import (
    DANTE_NAME_SERVICES,
    DECLARATION_FIELDS,
    NDI_NAME_SERVICES,
    lldp_eee,
    msrp_declarations,
    mvrp_vlans,
    service_name,
)

# Service labels (length byte and text) that name the sender of a discovery response.
DANTE_SERVICES = ["_netaudio", "_netaudio-cmc", "_netaudio-arc"]
NDI_SERVICES = ["_ndi"]

# Stream identity per protocol, as columns instead of a joined text. Dante flows of one sender are told apart by
# destination; the strict form adds the sender for every protocol.
STREAM_KEY = ["capture_id", "protocol", "stream_src", "dst_ip", "dst_port"]
ORDER = ["ts", "frame_no"]
CHUNK = ["window_start", "block"]
BLOCK = 1 << 20  # frames of a capture per chunk, at most


def has_service(payload: Column, names: Sequence[str]) -> Column:
    """Whether a DNS payload holds one of the labels."""
    hit = F.lit(False)
    for name in names:
        needle = bytes([len(name)]) + name.encode()
        hit = hit | F.contains(payload, F.lit(needle))
    return hit


def packets_table(frames: DataFrame, seconds: float = WINDOW_SECONDS, strict_identity: bool = False) -> DataFrame:
    """Typed and classified packets. One narrow job: no shuffle between the frame scan and this table."""
    df = decode_packets(frames)
    df = decode_sap(decode_ptp(decode_conmon(df)))
    p = F.col("payload")
    response = F.coalesce(flag(uint(p, 2), 0x80), F.lit(False))
    mdns = F.when(response & has_service(p, DANTE_SERVICES), "dante").when(response & has_service(p, NDI_SERVICES), "ndi")
    df = computed_once(df, {"entity_": F.coalesce(uint(p, 0) == 0xFA, F.lit(False)), "mdns_": mdns})
    rules = packet_rules(
        entity=F.col("entity_"),
        conmon=F.col("device_mac").isNotNull(),
        ptp=F.col("ptp_version").isNotNull(),
        sap=F.col("sdp").isNotNull(),
        mdns_kind=F.col("mdns_"),
    )
    df = classify(df, rules).drop("entity_", "mdns_")
    multicast = F.coalesce(is_multicast(F.col("dst_ip_num")), F.lit(False))
    df = df.withColumns(
        {
            "protocol": protocol_label(),
            "control_class": F.when(F.col("kind") == "dante_control_plane", control_plane_class()),
            "is_multicast": multicast,
            "frame_bytes": F.col("wire_len"),
            "window_start": period_start("ts", seconds),
            "block": block("frame_no", BLOCK),
        }
    )
    sender = F.col("src_ip") if strict_identity else F.when(F.col("protocol") == "Dante", F.col("src_ip"))
    return df.withColumn("stream_src", F.coalesce(sender, F.lit(""))).drop("frame")


def selected_packets(packets: DataFrame, choices: Sequence[str]) -> DataFrame:
    """Packets of the chosen protocols and of the infrastructure they need."""
    return select_protocols(packets, choices)


def stream_packets(packets: DataFrame) -> DataFrame:
    """Media packets with a label, the input of the stream metrics."""
    return packets.where(F.col("protocol").isNotNull())


def kind_tables(packets: DataFrame) -> dict[str, DataFrame]:
    """One typed table per kind of message. Each is a filter and a projection of the packets, nothing is shuffled."""
    base = ["capture_id", *ORDER, *CHUNK, "src_ip"]
    at = [F.col(c) for c in base]

    def of(*kinds: str) -> DataFrame:
        return packets.where(F.col("kind").isin(*kinds))

    ptp = of("ptp").select(
        *at, F.col("ptp_version").alias("version"), F.col("ptp_domain").alias("domain"), F.col("ptp_type").alias("message_type"),
        F.col("ptp_name").alias("message_name"), "clock_id", "grandmaster_id", "clock_quality", "correction_ns", "path_delay_ns", "stratum",
        F.when(F.col("ethertype") != 0x0800, "AVB").when(F.col("ptp_version") == 1, "PTPv1").otherwise("PTPv2").alias("protocol_kind"),
    )
    igmp = decode_igmp(of("igmp")).select(*at, "src_mac", F.col("dst_ip").alias("group_ip"), "igmp_kind", "igmp_version", "payload")
    avtp = decode_avtp(of("avtp")).where(F.col("stream_id").isNotNull()).select(*at, "stream_id", "avtp_subtype", "avtp_seq", "frame_bytes", "pcp")
    tcp = of("tcp").select(*at, "dst_ip", "src_port", "dst_port", "frame_bytes", "tcp_seq", "tcp_ack", "fin", "syn", "rst")
    dante = service_name(of("dante_discovery"), DANTE_NAME_SERVICES).select(*at, "name")
    ndi = service_name(of("ndi_discovery"), NDI_NAME_SERVICES).select(*at, "name")
    return {
        "ptp": ptp,
        "igmp": igmp,
        "sdp": media_sections(of("sap"), keep=tuple(base)),
        "dante_names": dante,
        "ndi_sources": ndi,
        "conmon": of("dante_conmon").select(*at, F.col("device_mac").alias("mac"), "channels"),
        "control_plane": of("dante_control_plane").select(*at, F.col("control_class").alias("class")),
        "avtp": avtp,
        "msrp": msrp_declarations(of("msrp")).select(*at, "decl_no", *DECLARATION_FIELDS),
        "mvrp": mvrp_vlans(of("mvrp")).select(*at, "vlan_id"),
        "adp": decode_adp(of("adp")).where(F.col("adp_type").isNotNull()).withColumnRenamed("adp_type", "message_type"),
        "eee": lldp_eee(of("lldp")).select(*at, "chassis_id", "port_id", "tx_wake_us", "rx_wake_us"),
        "flow_control": decode_flow_control(of("flow_control")).where(F.col("flow_control").isNotNull()).select(*at, "flow_control"),
        "tcp": tcp,
    }
