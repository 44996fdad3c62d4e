"""Frames built byte by byte: decoding, rule precedence, and the way to one score."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from tallywire.plans.health import health_report, stream_windows, with_silence
from tallywire.plans.network import network_report
from tallywire.plans.packets import STREAM_KEY, packets_table, selected_packets, stream_packets
from tallywire.plans.scoring import session_verdict
from tallywire.plans.report import window_report, write_window_report
from tallywire.operators.windows import distinct_per_group, window_counters
from tallywire.sources.frames import FRAMES, read_frames, write_frames

T0 = dt.datetime(2024, 1, 1)


def ether(ethertype, payload, tags=()):
    head = bytes.fromhex("01005e000001020000000001")
    for kind, pcp in tags:
        head += struct.pack(">HH", kind, pcp << 13 | 7)
    return head + struct.pack(">H", ethertype) + payload


def ipv4(proto, payload, src="10.0.0.1", dst="239.69.0.1", tos=46 << 2, ttl=64, options=b"", frag=0):
    addr = b"".join(bytes(int(x) for x in a.split(".")) for a in (src, dst))
    size = 20 + len(options) + len(payload)
    head = struct.pack(">BBHHHBBH", 0x45 + len(options) // 4, tos, size, 0, frag, ttl, proto, 0)
    return head + addr + options + payload


def udp(sport, dport, payload):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def rtp(seq=1, ts=48, ssrc=9, pt=96, version=2):
    return struct.pack(">BBHII", version << 6, pt, seq, ts, ssrc) + b"\0" * 20


def tcp(seq=5, flags=0x10):
    return struct.pack(">HHIIBBHHH", 5961, 40000, seq, 0, 0x50, flags, 0, 0, 0)


SDP = b"v=0\r\no=- 77 1 IN IP4 10.0.0.1\r\ns=Desk\r\nm=audio 5004 RTP/AVP 96\r\na=rtpmap:96 L24/48000/2\r\na=ptime:1\r\n"
PTP2 = bytes([0x0B, 2]) + bytes(62)
CONMON = b"\xff\xff\x00\x18\0\0\0\0\x00\x1d\xc1\xff\xfe\x01\x02\x03Audinate"
MDNS = b"\0\0\x84\0\0\0\0\1\0\0\0\0\x04desk\x0d_netaudio-cmc\x04_udp"

CASES = {
    "msrp": ether(0x22EA, b"\0"),
    "flow_control": ether(0x8808, b"\0\1"),
    "adp": ether(0x22F0, b"\xfa" + bytes(60)),
    "avtp": ether(0x22F0, b"\x02\x80" + bytes(20)),
    "ptp": ether(0x88F7, PTP2),
    "igmp": ether(0x0800, ipv4(2, b"\x16" + bytes(7), options=b"\x94\x04\0\0")),
    "tcp": ether(0x0800, ipv4(6, tcp(), dst="10.0.0.9")),
    "sap": ether(0x0800, ipv4(17, udp(9875, 9875, b"\x20\0\0\0\x0a\0\0\1" + SDP))),
    "dante_discovery": ether(0x0800, ipv4(17, udp(5353, 5353, MDNS))),
    "dante_conmon": ether(0x0800, ipv4(17, udp(8700, 8702, CONMON))),
    "dante_control": ether(0x0800, ipv4(17, udp(8700, 9000, b"x"))),
    "dante_control_plane": ether(0x0800, ipv4(17, udp(38700, 9000, b"x"))),
    "dante_audio": ether(0x0800, ipv4(17, udp(7000, 5004, rtp()), dst="239.255.1.1")),
    "aes67": ether(0x0800, ipv4(17, udp(7000, 5004, rtp())), tags=[(0x88A8, 5), (0x8100, 1)]),
    "st2110": ether(0x0800, ipv4(17, udp(7000, 5004, rtp()), dst="239.1.1.1")),
}
DROPPED = {
    "ipv6": ether(0x86DD, bytes(60)),
    "cut tag": ether(0x0800, b"", tags=[(0x8100, 1)])[:15],
    "no rtp": ether(0x0800, ipv4(17, udp(7000, 5004, rtp(version=1)))),
    "unicast rtp": ether(0x0800, ipv4(17, udp(7000, 7002, rtp()), dst="10.0.0.7")),
    "sap deletion": ether(0x0800, ipv4(17, udp(9875, 9875, b"\x24\0\0\0\x0a\0\0\1" + SDP))),
    "mdns query": ether(0x0800, ipv4(17, udp(5353, 5353, b"\0\0\0\0" + MDNS[4:]))),
    "fragment": ether(0x0800, ipv4(17, udp(7000, 5004, rtp()), frag=100)),
}


def frames(spark, items):
    rows = [("c", i, T0 + dt.timedelta(seconds=t), len(f), bytearray(f)) for i, (t, f) in enumerate(items)]
    return spark.createDataFrame(rows, FRAMES)


def test_kinds(spark):
    order = [*CASES.items(), *DROPPED.items()]
    out = packets_table(frames(spark, [(0, f) for _, f in order]))
    got = {r["frame_no"]: r["kind"] for r in out.select("frame_no", "kind").collect()}
    assert {name: got[i] for i, (name, _) in enumerate(order)} == {**{k: k for k in CASES}, **{k: None for k in DROPPED}}


def test_layers(spark):
    r = packets_table(frames(spark, [(0, CASES["aes67"])])).first()
    assert (r["pcp"], r["dscp"], r["ecn"], r["ttl"], r["src_ip"], r["dst_ip"]) == (5, 46, 0, 64, "10.0.0.1", "239.69.0.1")
    assert (r["rtp_seq"], r["rtp_ts"], r["rtp_ssrc"], r["rtp_pt"], r["protocol"]) == (1, 48, 9, 96, "AES67")
    r = packets_table(frames(spark, [(0, CASES["dante_conmon"])])).first()
    assert r["device_mac"] == "00:1d:c1:01:02:03"


def test_selection_keeps_what_a_protocol_needs(spark):
    out = selected_packets(packets_table(frames(spark, [(0, f) for f in CASES.values()])), ["ndi"])
    assert sorted(r["kind"] for r in out.select("kind").collect()) == ["flow_control", "tcp"]


def test_scan_prunes_captures(spark, tmp_path):
    folder = str(tmp_path / "frames")
    df = frames(spark, [(0, CASES["tcp"]), (1, CASES["ptp"])])
    write_frames(df.unionByName(df.withColumn("capture_id", F.lit("d"))), folder)
    scan = read_frames(spark, folder).where("capture_id = 'd' AND frame_no > 0").select("frame_no")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(capture_id" in plan and "GreaterThan(frame_no,0)" in plan
    assert "frame:binary" not in plan
    assert scan.count() == 1


@pytest.fixture(scope="module")
def score(spark):
    """A clean stream, and one that loses packets in the second Window and is wrongly marked."""
    items = []
    for i in range(100):
        t = i * 0.1
        items.append((t, ether(0x0800, ipv4(17, udp(7000, 5004, rtp(i, i * 4800, 1))))))
        gap = 5 if i >= 75 else 0
        items.append((t, ether(0x0800, ipv4(17, udp(7000, 5006, rtp(i + gap, i * 4800, 2)), tos=0, dst="239.69.0.2"))))
    packets = stream_packets(packets_table(frames(spark, items))).withColumns(
        {"dscp_viol": F.col("dscp") != 46, "clock_hz": F.lit(48000.0), "ptime_ms": F.lit(100.0), "clock_confirmed": F.lit(True)}
    )
    rows = stream_windows(packets, STREAM_KEY, gap_ms=500)
    rows = with_silence(rows, STREAM_KEY, packets.select(F.max("window_start")).scalar())
    windows = packets.select("window_start").distinct()
    return packets, rows, health_report(rows, windows, STREAM_KEY).orderBy("window_start")


def test_frames_to_score(score):
    packets, rows, report = score
    got = report.collect()
    # Window 1: marks 5. Window 2: marks 5 and 5 lost of 55, that is 9.0909 %.
    assert [round(r["score"], 4) for r in got] == [95.0, round(100 - 5 - 100 * 5 / 55, 4)]
    assert got[0]["summary"] == ["incorrect DSCP: 1"]
    assert got[1]["summary"] == ["packet loss: 1", "incorrect DSCP: 1"]
    assert session_verdict(report).first()["healthy"] is False
    lost = {(r["dst_port"], r["window_start"].second): (r["lost"], r["ts_disc"]) for r in rows.collect()}
    assert lost == {(5004, 0): (0, 0), (5004, 5): (0, 0), (5006, 0): (0, 0), (5006, 5): (5, 0)}


def test_report_sink(spark, score, tmp_path):
    packets, _, report = score
    counts = window_counters(packets)
    labels = distinct_per_group(packets, ["capture_id", "window_start", "protocol"], ["dst_ip", "dst_port"])
    out = window_report(counts, report.withColumn("capture_id", F.lit("c")), labels)
    write_window_report(out, str(tmp_path / "report"))
    back = spark.read.parquet(str(tmp_path / "report")).orderBy("window_start").collect()
    assert [(r["capture_id"], r["n_streams"], r["traffic"]["packets"]) for r in back] == [("c", 2, 100), ("c", 2, 100)]


def test_decode_is_one_narrow_job_without_python(spark):
    plan = packets_table(frames(spark, [(0, CASES["tcp"])]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_whole_network_report(spark, tmp_path):
    """A lossy AES67 stream without a querier, a clock that is lost, a Dante device, and an energy-saving port."""
    lldp = bytes.fromhex("0207040011223344550403053731") + bytes.fromhex("fe0e00120f050011001e000000000000") + b"\0\0"
    lldp = ether(0x88CC, lldp)
    announce = bytes([0x0B, 2]) + bytes(18) + b"\1" * 8 + bytes(25) + b"\7" * 8 + bytes(3)
    clock = ether(0x0800, ipv4(17, udp(320, 320, announce), dst="224.0.1.129"))
    sap = ether(0x0800, ipv4(17, udp(9875, 9875, b"\x20\0\0\0\x0a\0\0\1" + SDP.replace(b"ptime:1", b"ptime:100"))))
    items = [(0.0, clock), (0.1, sap), (0.2, CASES["dante_discovery"]), (0.3, lldp)]
    for i in range(200):
        seq = i + (3 if i >= 150 else 0)
        items.append((0.5 + i * 0.1, ether(0x0800, ipv4(17, udp(7000, 5004, rtp(seq, i * 4800, 1))))))
    net = network_report(frames(spark, sorted(items, key=lambda x: x[0])), str(tmp_path), ["audio"])
    got = {r["window_start"].second: (r["score"], r["summary"]) for r in net.report.collect()}
    first, last = got[0], got[15]
    rows = {r["window_start"].second: r for r in net.report.collect()}
    gaps = ["signal gaps: 1"]
    assert first == (100 - 10 - 10 - 15, [*gaps, "querier absent: 1", "EEE active: 1"])
    loss = 100 * 3 / 53
    assert last[1] == ["packet loss: 1", *gaps, "querier absent: 1", "clock source lost: 1", "EEE active: 1"]
    assert round(last[0], 6) == round(100 - loss - 10 - 10 - 25 - 15, 6)
    # the clock is still lost when the stream loses packets
    assert sorted((r["window_start"].second, r["code"]) for r in net.alerts.collect()) == [(5, "clock_lost"), (15, "clock_dropout")]
    assert rows[0]["missing_clocks"] is None and [tuple(c) for c in rows[15]["missing_clocks"]] == [("ptpv2", "AES67")]
    assert [(r["src_ip"], r["name"]) for r in net.devices.collect()] == [("10.0.0.1", "desk")]
    assert {r["clock_confirmed"] for r in net.streams.collect()} == {True}
