"""Every alert of the network report, raised by frames built byte by byte, one capture per cause."""

import datetime as dt
from collections import Counter

from test_frames import CASES, FRAMES, MDNS, SDP, T0, ether, ipv4, rtp, udp

from tallywire.operators.state import ALERT_ORDER
from tallywire.plans.network import network_report

QUERIER = "224.0.0.1"


def conmon(src, mac):
    body = b"\xff\xff\x00\x18\0\0\0\0" + mac[:3] + b"\xff\xfe" + mac[3:] + b"Audinate"
    return ether(0x0800, ipv4(17, udp(8700, 8702, body), src=src, dst="224.0.0.231"))


def ptp1(src, control, stratum=3, gm=b"\0\0\0\0\0\0"):
    body = bytearray(70)
    body[1] = 1
    body[4:8] = b"_DFL"
    body[32] = control
    body[50:56] = gm
    body[61] = stratum
    return ether(0x0800, ipv4(17, udp(319, 319, bytes(body)), src=src, dst="224.0.1.129"))


def ptp2(domain, gm):
    body = bytes([0x0B, 2, 0, 64, domain]) + bytes(15) + gm + bytes(25) + gm + bytes(3)
    return ether(0x0800, ipv4(17, udp(320, 320, body), dst="224.0.1.129"))


def query(src, version=2):
    return ether(0x0800, ipv4(2, b"\x11" + bytes(7 if version == 2 else 11), src=src, dst=QUERIER))


def stream(n, seq, dst="239.69.0.1", port=5004):
    return ether(0x0800, ipv4(17, udp(7000, port, rtp(seq, n * 48, 1)), dst=dst))


def sap(refclk):
    text = SDP + b"a=ts-refclk:" + refclk + b"\r\n"
    return ether(0x0800, ipv4(17, udp(9875, 9875, b"\x20\0\0\0\x0a\0\0\1" + text), dst="239.255.255.255"))


def captures():
    mac, gm = b"\x00\x1d\xc1\x01\x02\x03", b"\1\1\1\1\1\1\1\1"
    one = [(t, stream(t, t)) for t in range(0, 20)]
    return {
        # only link-local messages, two addresses of one device, one of them without a lease
        "filtered": [(t, conmon(ip, mac)) for t in (0, 6, 11) for ip in ("192.168.1.9", "169.254.1.1")],
        "subnets": [(0, query("10.0.0.1")), (1, conmon("192.168.1.9", mac)), (2, conmon("192.168.2.9", mac[::-1]))],
        # the clock goes, once without and once with a stream that loses packets
        "lost": [(0, ptp2(0, gm)), *[(t, stream(t, t)) for t in range(12)]],
        "dropout": [(0, ptp2(0, gm)), *[(t, stream(t, t + (9 if t > 7 else 0))) for t in range(12)]],
        # an AVB clock serves no such stream
        "avb": [(0, ether(0x88F7, bytes([0x0B, 2]) + bytes(18) + gm + bytes(25) + gm + bytes(3))), *[(t, stream(t, t + (9 if t > 7 else 0))) for t in range(12)]],
        "spike": one + [(15 + n / 10, stream(n, n, "239.69.1.%d" % n)) for n in range(4)],
        "queriers": [*one, (1, query("10.0.0.1")), (2, query("10.0.0.2"))],
        "slow": [(0, query("10.0.0.1")), (62, query("10.0.0.1"))],
        "version": [(0, query("10.0.0.1")), (1, ether(0x0800, ipv4(2, b"\x22" + bytes(15), dst="224.0.0.22")))],
        "mismatch": [(0, ptp2(0, gm)), (1, sap(b"ptp=IEEE1588-2008:02-02-02-02-02-02-02-02:0")), (2, stream(0, 0))],
        "match": [(0, ptp2(0, gm)), (1, sap(b"ptp=IEEE1588-2008:01-01-01-01-01-01-01-01:0")), (2, stream(0, 0))],
        "no clock": [(1, sap(b"ptp=IEEE1588-2008:01-01-01-01-01-01-01-01:7")), (2, stream(0, 0))],
        # three devices, one follows, one is the master: the third is missing
        "census": [
            *[(0, ether(0x0800, ipv4(17, udp(5353, 5353, MDNS), src="10.0.0.%d" % n))) for n in (1, 2, 3)],
            (1, ptp1("10.0.0.1", 0, gm=mac)),
            (2, ptp1("10.0.0.2", 1)),
        ],
        "two masters": [(0, ptp1("10.0.0.1", 0, 0, mac)), (1, ptp1("10.0.0.2", 0, 0, mac))],
        "masters": [(0, ptp1("10.0.0.1", 0, 0, mac)), (1, ptp1("10.0.0.2", 0, 4, mac))],
        "heavy": one[:3],
        # no alert: a stream that nobody reserved
        "reservation": [(0, CASES["avtp"]), (6, CASES["avtp"])],
    }


def test_every_alert_fires(spark, tmp_path):
    rows = []
    for name, items in captures().items():
        for i, (t, f) in enumerate(sorted(items, key=lambda x: x[0])):
            size = 20_000_000 if name == "heavy" else len(f)
            rows.append((name, i, T0 + dt.timedelta(seconds=t), size, bytearray(f)))
    net = network_report(spark.createDataFrame(rows, FRAMES), str(tmp_path), ["all"])
    got = Counter()
    for r in net.alerts.collect():
        got[(r["capture_id"], r["code"], r["level"], int((r["window_start"] - T0).total_seconds()), r["subject"])] += 1
    mac = "00:1d:c1:01:02:03"
    want = [
        *[("filtered", "ptp_blocked", "warn", w, None) for w in (0, 5, 10)],
        *[("filtered", "filtered_multicast", "warn", w, None) for w in (5, 10)],
        *[("filtered", "bridged_network", "error", w, mac) for w in (0, 5, 10)],
        *[("filtered", "ip_config", "error", w, "1 without address") for w in (0, 5, 10)],
        ("subnets", "ip_config", "warn", 0, "2 subnets"),
        ("lost", "clock_lost", "error", 5, "0/2"),
        # the loss at the end of the second Window goes with lost packets
        ("dropout", "clock_dropout", "error", 5, None),
        ("avb", "clock_lost", "error", 5, "0/2"),
        ("spike", "stream_spike", "warn", 15, "5"),
        ("queriers", "multiple_queriers", "error", 0, "10.0.0.1"),
        ("queriers", "multiple_queriers", "error", 0, "10.0.0.2"),
        ("slow", "slow_queries", "info", 60, "62"),
        ("version", "version_mismatch", "warn", 0, None),
        ("mismatch", "refclk_mismatch", "warn", 0, "77 0 mismatch"),
        ("no clock", "refclk_mismatch", "warn", 0, "77 7 no_ptp"),
        ("census", "followers_missing", "warn", 0, "1"),
        ("two masters", "sync_conflict", "error", 0, "0"),
        ("masters", "sync_conflict", "warn", 0, "0"),
        ("heavy", "high_multicast", "warn", 0, None),
    ]
    assert got == Counter(want)
    assert {w[1] for w in want} == set(ALERT_ORDER)
    rows = sorted((r["capture_id"], int((r["window_start"] - T0).total_seconds()), r["status"], r["no_vlan"]) for r in net.reservations.collect())
    assert rows == [("reservation", 0, "none", True), ("reservation", 5, "none", True)]
    gone = {tuple(c) for r in net.report.where("capture_id = 'reservation'").collect() for c in r["missing_clocks"]}
    assert gone == {("gptp", "AVB")}
