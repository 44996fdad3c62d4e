"""Control messages of variable length, built byte by byte."""

import struct

import pytest

from tallywire.sources.tlv import (
    DANTE_NAME_SERVICES,
    NDI_NAME_SERVICES,
    igmp_v3_groups,
    lldp_eee,
    msrp_declarations,
    mvrp_vlans,
    service_name,
)


def payloads(spark, *items):
    return spark.createDataFrame([(i, bytearray(p)) for i, p in enumerate(items)], "n int, payload binary")


def record(group, sources=0, aux=0):
    return struct.pack(">BBH4B", 4, aux, sources, *group) + bytes(4 * sources + 4 * aux)


def test_group_records(spark):
    head = b"\x22" + bytes(5)
    full = head + struct.pack(">H", 3) + record((239, 1, 2, 3), 2) + record((10, 0, 0, 1)) + record((239, 69, 0, 1), 0, 1)
    out = igmp_v3_groups(payloads(spark, full, full[:30], head, head + b"\0\5"))
    assert [r["groups"] for r in out.orderBy("n").collect()] == [["239.1.2.3", "239.69.0.1"], ["239.1.2.3"], [], []]


def test_group_records_are_read_by_the_batch(spark):
    sizes = [0, 1, 40, 3, 1200]
    reports = [b"\x22" + bytes(5) + struct.pack(">H", n) + b"".join(record((239, k // 256, k % 256, 7), k % 3, k % 2) for k in range(n)) for n in sizes]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*reports, None, b""])], "n int, payload binary").coalesce(1)
    out = igmp_v3_groups(df)
    wanted = [[f"239.{k // 256}.{k % 256}.7" for k in range(n)] for n in sizes]
    assert [r["groups"] for r in out.orderBy("n").collect()] == [*wanted, [], []]
    assert "aggregate(" not in out._jdf.queryExecution().executedPlan().toString()  # a fold is interpreted record by record


SID = bytes.fromhex("001dc1aabbcc0007")


def attribute(kind, value, vectors=b"\0\0\0\0"):
    body = b"\0\1" + value + vectors
    return struct.pack(">BBH", kind, len(value), len(body)) + body


def talker(kind, extra=b""):
    return attribute(kind, SID + bytes.fromhex("91e0f0000e80") + struct.pack(">HHHB", 0xF002, 224, 1, 3 << 5) + bytes(4) + extra)


def test_reservations(spark):
    listener = attribute(3, SID + b"\2")
    whole = b"\0" + talker(1) + attribute(4, bytes(4)) + talker(2, bytes(8) + b"\x08") + listener + b"\0\0"
    out = msrp_declarations(payloads(spark, whole, b"\1" + whole[1:], whole[:20], b"")).orderBy("n", "decl_no").collect()
    assert [(r["n"], r["decl_type"], r["failure_code"], r["listener_state"]) for r in out] == [
        (0, "talker_advertise", None, None),
        (0, "talker_failed", 8, None),
        (0, "listener", None, 2),
    ]
    r = out[0]
    assert (r["stream_id"], r["dest_mac"], r["vlan_id"]) == ("00:1d:c1:aa:bb:cc:0007", "91:e0:f0:00:0e:80", 2)
    assert (r["max_frame_size"], r["max_interval_frames"], r["priority"]) == (224, 1, 3)
    assert out[2]["vlan_id"] is None


def vector(base, n):
    return struct.pack(">HH", n, base) + bytes(-(-n // 3))


def test_vlans(spark):
    one = b"\0\1\2" + vector(5, 2) + vector(5, 1) + struct.pack(">H", 0x2000) + vector(4095, 2) + b"\0\0\0\0"
    cut = b"\0\1\2" + vector(7, 1) + vector(9, 6)[:4]
    out = mvrp_vlans(payloads(spark, one, cut, b"\0", b"\1\1\2" + vector(3, 1), b"\0\2\2" + vector(3, 1))).collect()
    assert sorted((r["n"], r["vlan_id"]) for r in out) == [(0, 5), (0, 6), (0, 4095), (1, 7), (1, 9), (1, 10), (1, 11), (1, 12), (1, 13), (1, 14)]


def option(kind, value):
    return struct.pack(">H", kind << 9 | len(value)) + value


def test_energy_saving_ports(spark):
    eee = bytes.fromhex("00120f05") + struct.pack(">HHHHH", 17, 30, 0, 0, 0)
    ids = option(1, b"\4" + bytes.fromhex("001122334455")) + option(2, b"\5 port 7 ")
    quiet = bytes.fromhex("00120f05") + bytes(10)
    out = lldp_eee(
        payloads(
            spark,
            ids + option(127, eee) + option(0, b""),
            ids + option(127, quiet),
            ids,
            ids + option(0, b"") + option(127, eee),
            ids + option(127, eee)[:-1],
        )
    ).collect()
    assert [tuple(r)[:1] + tuple(r)[2:] for r in out] == [(0, "00:11:22:33:44:55", "port 7", 17, 30)]


def label(text):
    return bytes([len(text)]) + text


def dns(questions, answers, body):
    return struct.pack(">HHHHHH", 0, 0x8400, questions, answers, 0, 0) + body


@pytest.mark.parametrize("service", ["_netaudio-cmc", "_netaudio-arc", "_netaudio"])
def test_label_before_service(spark, service):
    p = dns(0, 1, label(b"Stage Box 1") + label(service.encode()) + label(b"_udp") + b"\0")
    assert service_name(payloads(spark, p), DANTE_NAME_SERVICES).first()["name"] == "Stage Box 1"


def test_name_behind_a_pointer_record(spark):
    service = label(b"_ndi") + label(b"_tcp") + label(b"local") + b"\0"
    target = label(b"CAM 2") + b"\xc0\x0c"
    answer = b"\xc0\x0c" + struct.pack(">HHIH", 12, 1, 120, len(target)) + target
    other = b"\xc0\x0c" + struct.pack(">HHIH", 16, 1, 120, 3) + b"\2ab"
    asked = dns(1, 2, service + b"\0\x0c\0\1" + other + answer)
    plain = dns(0, 1, service + struct.pack(">HHIH", 12, 1, 120, len(target)) + target)
    nothing = dns(0, 1, service + struct.pack(">HHIH", 16, 1, 120, 3) + b"\2ab")
    broken = dns(1, 9, service[:-1])
    out = service_name(payloads(spark, asked, plain, nothing, broken), NDI_NAME_SERVICES).orderBy("n")
    assert [r["name"] for r in out.collect()] == ["CAM 2", "CAM 2", None, None]
