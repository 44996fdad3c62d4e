"""Small hand-made inputs with expected results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywire.operators.classify import expand_choices, is_software, sender_verdict
from tallywire.operators.enrich import announce_enrich, bridged_networks, follower_census, no_address_devices, subnets
from tallywire.operators.sequence import connection_quality, seq_gaps
from tallywire.operators.state import clock_state, entity_events, rearm_dedup
from tallywire.operators.timing import iat_stats, rate_buckets
from tallywire.operators.windows import consecutive_true, querier_state, silence_states, spike
from tallywire.functions.arith import period_start
from tallywire.plans.scoring import health_score, infrastructure_deductions, penalties, session_verdict, stream_diagnostics

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def packets(spark, rows, cols):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], f"key string, frame_no long, {cols}")
    return df.withColumn("window_start", period_start("ts", 5)) if "ts " in cols else df.withColumn("window_start", F.lit(0))


@pytest.mark.parametrize(
    "seqs, bits, lost, reorders",
    [
        ([0, 3], 16, 2, 0),
        ([65534, 65535, 0], 16, 0, 0),
        ([10, 5], 16, 0, 1),
        ([10, 5, 11], 16, 5, 1),
        ([7, 7], 16, 0, 1),
        ([253, 1], 8, 3, 0),
        ([9], 16, 0, 0),
    ],
)
def test_sequence(spark, seqs, bits, lost, reorders):
    df = packets(spark, [(s,) for s in seqs], "rtp_seq int")
    r = seq_gaps(df, ["key"], ["frame_no"], bits=bits, keep=[]).first()
    assert (r["lost"], r["reorders"]) == (lost, reorders)


@pytest.mark.parametrize("gap, events", [(0.051, 1), (0.05, 0)])
def test_gap_threshold(spark, gap, events):
    r = iat_stats(packets(spark, [(at(0),), (at(gap),)], "ts timestamp"), ["key"], ["ts", "frame_no"], keep=[]).first()
    assert r["gap_events"] == events


def test_bitrate_bucket(spark):
    df = packets(spark, [(at(0.1), 100), (at(0.9), 150), (at(1.2), 10)], "ts timestamp, frame_bytes int")
    assert sorted(r["bitrate_bps"] for r in rate_buckets(df, ["key"]).collect()) == [80, 2000]


@pytest.mark.parametrize(
    "rst, fin, retx, want",
    [(0, 0, 2, "healthy"), (0, 0, 3, "degrading"), (0, 0, 10, "degrading"), (0, 0, 11, "critical"), (1, 0, 0, "terminated"), (0, 1, 0, "healthy"), (0, 2, 0, "terminated")],
)
def test_quality(spark, rst, fin, retx, want):
    df = spark.range(1).select(connection_quality(F.lit(rst), F.lit(fin), F.lit(retx)).alias("q"))
    assert df.first()["q"] == want


@pytest.mark.parametrize(
    "control, timing, ttl, dscp, want, software",
    [
        ("DVS", "noisy", 128, 0, ("DVS", "confirmed", 4), True),
        ("Hardware", "metronomic", 64, 46, ("Hardware", "confirmed", 2), False),
        (None, "metronomic", None, 0, ("Hardware", "inferred", 1), False),
        (None, "noisy", 128, 46, ("DVS", "inferred", 2), True),
        (None, None, 128, 0, ("DVS", "inferred", 2), True),
        (None, None, 64, 0, ("DVS", "hint", 1), False),
        (None, None, 64, 46, None, False),
    ],
)
def test_verdict(spark, control, timing, ttl, dscp, want, software):
    df = spark.createDataFrame([(control, timing, ttl, dscp)], "c string, t string, l int, d int")
    r = df.select(
        sender_verdict(F.col("c"), F.col("t"), F.col("l"), F.col("d")).alias("v"),
        is_software(F.col("c"), F.col("t"), F.col("l")).alias("s"),
    ).first()
    assert (tuple(r["v"]) if r["v"] else None, r["s"]) == (want, software)


def test_choices():
    assert expand_choices(["audio"]) == ("AES67", "Dante", "AVB")
    assert expand_choices([" All "]) == ("AES67", "ST2110", "Dante", "NDI", "AVB")


def clock_rows(spark, rows):
    cols = "domain int, version int, frame_no long, ts timestamp, message_type int, grandmaster_id string"
    df = spark.createDataFrame([(0, 2, i, at(t), m, g) for i, (t, m, g) in enumerate(rows)], cols)
    return df.withColumn("window_start", period_start("ts", 5))


def test_clock_detected_changed_lost_detected(spark):
    df = clock_rows(spark, [(0, 11, "a"), (1, 11, "b"), (4, 1, None), (20, 11, "b"), (21, 11, "b")])
    events = [(r["event"], r["gm"], r["from_gm"], r["ts"]) for r in clock_state(df).orderBy("ts").collect()]
    assert events == [
        ("detected", "a", None, at(0)),
        ("changed", "b", "a", at(1)),
        ("lost", None, None, at(10)),
        ("detected", "b", None, at(20)),
    ]


def test_followers_keep_a_clock_alive(spark):
    df = clock_rows(spark, [(0, 11, "a"), (4, 1, None), (8, 1, None), (12, 1, None), (13, 11, "a")])
    assert [r["event"] for r in clock_state(df).collect()] == ["detected"]


def test_entities(spark):
    rows = [(0, 0, 1), (1, 0, 2), (2, 2, 9), (3, 1, 0), (4, 1, 0), (5, 0, 2), (40, 0, 2)]
    df = spark.createDataFrame(
        [("e", i, at(t), m, x, 2) for i, (t, m, x) in enumerate(rows)],
        "entity_id string, frame_no long, ts timestamp, message_type int, available_index int, valid_time_secs int",
    ).withColumn("window_start", period_start("ts", 5))
    assert [(r["frame_no"], r["event"]) for r in entity_events(df).orderBy("frame_no").collect()] == [
        (0, "new"),
        (1, "changed"),
        (3, "departed"),
        (5, "new"),
        (6, "new"),
    ]


def test_join_alerts_rearm(spark):
    rows = [(0, "join"), (10, "join"), (20, "leave"), (21, "join"), (340, "join"), (350, "join")]
    df = spark.createDataFrame(
        [("h", "g", i, at(t), k) for i, (t, k) in enumerate(rows)], "src_ip string, group_ip string, frame_no long, ts timestamp, kind string"
    ).withColumn("window_start", period_start("ts", 5))
    assert sorted(r["frame_no"] for r in rearm_dedup(df).collect()) == [0, 3, 4]


def windows(spark, values, name):
    rows = [("c", at(5 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"capture_id string, window_start timestamp, {name}")


@pytest.mark.parametrize("counts, hit", [([2, 2, 2, 5], True), ([2, 2, 2, 4], False), ([2, 2, 9], False), ([0, 1, 1, 9], False)])
def test_spike(spark, counts, hit):
    assert spike(windows(spark, counts, "streams long")).orderBy("window_start").collect()[-1]["spike"] is hit


def test_consecutive(spark):
    out = consecutive_true(windows(spark, [True, True, False, True, None, True, True], "ok boolean"), F.col("ok"), 2)
    assert [r["run"] for r in out.orderBy("window_start").collect()] == [1, 2, 0, 1, 0, 1, 2]


@pytest.mark.parametrize("gap, slow", [(125, True), (30, False), (60, False)])
def test_query_interval(spark, gap, slow):
    q = spark.createDataFrame([("c", i, at(gap * i)) for i in range(2)], "capture_id string, frame_no long, ts timestamp")
    q = q.withColumn("window_start", period_start("ts", 5))
    w = q.select("capture_id", "window_start", F.lit(True).alias("active_multicast"))
    assert querier_state(q, w).orderBy("window_start").collect()[-1]["slow_queries"] is slow


def test_silence_ends_and_restarts(spark):
    rows = [("s", at(0), at(1)), ("s", at(40), at(41))]
    df = spark.createDataFrame(rows, "key string, window_start timestamp, last_ts timestamp")
    out = silence_states(df, ["key"], until=F.lit(at(40))).orderBy("window_start").collect()
    assert [(r["window_start"], r["state"], r["session"]) for r in out] == [
        (at(0), "live", 1),
        (at(5), "live", 1),
        (at(10), "dead", 1),
        (at(15), "dead", 1),
        (at(20), "pruned", 1),
        (at(40), "live", 2),
    ]


def test_bridged_and_addresses(spark):
    df = spark.createDataFrame(
        [("10.0.0.1", "m1", at(0)), ("10.0.1.1", "m1", at(1)), ("10.0.0.9", "m2", at(2)), ("169.254.0.3", "m1", at(-100))],
        "src_ip string, mac string, ts timestamp",
    )
    names = spark.createDataFrame([("10.0.1.1", "desk")], "src_ip string, name string")
    got = bridged_networks(df, names, F.lit(at(3))).collect()
    assert sorted((r["mac"], r["src_ip"], r["addresses"], r["name"]) for r in got) == [
        ("m1", "10.0.0.1", 2, "desk"),
        ("m1", "10.0.1.1", 2, "desk"),
    ]
    assert [r["src_ip"] for r in no_address_devices(df).collect()] == ["169.254.0.3"]
    assert sorted(r["subnet"] for r in subnets(df).collect()) == ["10.0.0.0/24", "10.0.1.0/24"]
    assert no_address_devices(df.where("src_ip like '169%'")).count() == 0


@pytest.mark.parametrize("gm, followers, missing", [("d1", ["d2"], ["d3"]), (None, ["d2", "d3"], []), (None, ["d2"], ["d1", "d3"]), ("d1", [], [])])
def test_follower_census(spark, gm, followers, missing):
    devices = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "src_ip string")
    rows = [(f, at(0), 1, 1, 0, None) for f in followers] + [(gm or "x", at(0), 1, 0, 0, "id" if gm else None)]
    ptp = spark.createDataFrame(rows, "src_ip string, ts timestamp, version int, message_type int, domain int, grandmaster_id string")
    assert sorted(r["src_ip"] for r in follower_census(devices, ptp, F.lit(at(5))).collect()) == missing


def test_announcement_fields(spark):
    p = spark.createDataFrame([(i, at(i), "239.69.0.1", 5004) for i in (1, 3, 5)], "frame_no long, ts timestamp, dst_ip string, dst_port int")
    m = spark.createDataFrame(
        [(2, at(2), 5004, None, "first", "L16/44100", 44100.0, 0.0, 2, [97]), (4, at(4), 5004, "239.69.0.1", "renamed", "L24/0", 0.0, 0.25, 0, []), (4, at(4), 5004, "239.69.0.9", "other", "x", 1.0, 1.0, 1, [1])],
        "frame_no long, ts timestamp, port int, connection_ip string, session_name string, rtpmap string, clock_hz double, ptime_ms double, channels int, payload_types array<int>",
    )
    p, m = (x.withColumn("window_start", period_start("ts", 5)) for x in (p, m))
    out = announce_enrich(p, m).orderBy("frame_no").collect()
    assert [r["session_name"] for r in out] == [None, "first", "first"]
    assert [r["announced_clock_hz"] for r in out] == [None, 44100.0, 44100.0]
    assert [r["announced_ptime_ms"] for r in out] == [None, None, 0.25]
    assert [r["announced_rtpmap"] for r in out] == [None, "L16/44100", "L24/0"]
    assert [r["announced_expected_pt"] for r in out] == [None, 97, 97]
    assert [r["clock_confirmed"] for r in out] == [False, True, True]


def test_diagnostics_and_caps(spark):
    rows = [
        # key, protocol, received, lost, reorders, jitter, dscp, silent, changes
        ("a", "AES67", 95, 5, 0, 25.0, 1, 1.0, 7),
        ("b", "Dante", 100, 0, 5, 12.0, 1, 10.0, 0),
        ("c", "2110-??", 1000, 0, 5, 0.0, 1, 11.0, 0),
        ("d", "Dante", 10, 90, 0, 0.0, 1, 0.0, 0),
        ("e", "Dante", 10, 0, 0, 0.0, 1, 0.0, 0),
    ]
    df = spark.createDataFrame(
        rows,
        "key string, protocol string, received long, lost long, reorders long, jitter_ms double, dscp_viol long, silent_secs double, ssrc_changes long",
    ).withColumn("window_start", F.lit(at(0)))
    found = stream_diagnostics(df, ["window_start", "key"])
    got = {(r["key"], r["code"]): r["deduction"] for r in found.collect()}
    assert got[("a", "packet_loss")] == 5.0 and got[("d", "packet_loss")] == 10.0
    assert got[("a", "high_jitter")] == 5.0 and got[("b", "high_jitter")] == 2.0
    assert ("b", "reorder") in got and ("c", "reorder") not in got
    assert got[("a", "ssrc_change")] == 30.0 and got[("c", "dead")] == 30.0 and ("b", "dead") not in got
    assert ("a", "aes67_ptp_hint") in got and ("c", "unknown_type") in got
    total = {r["code"]: (r["n"], r["deduction"]) for r in penalties(found).collect()}
    assert total["dscp"] == (5, 20.0) and total["packet_loss"] == (2, 15.0)


def test_infrastructure(spark):
    rows = [("ecn", "-", 30), ("grandmaster_changed", "0", 9), ("grandmaster_changed", "1", 1), ("eee", "-", 5), ("tcp_critical", "x", 1), ("tcp_retransmissions", "-", 3), ("clock_lost", "0", 0)]
    df = spark.createDataFrame(rows, "code string, scope string, n long").withColumn("window_start", F.lit(at(0)))
    none = df.limit(0).select("window_start", "code", F.lit(0.0).alias("deduction"))
    got = {r["code"]: r["deduction"] for r in penalties(none, infrastructure_deductions(df)).collect()}
    assert got == {"ecn": 20.0, "grandmaster_changed": 40.0, "eee": 30.0, "tcp_quality": 15.0, "tcp_retransmissions": 1.5}


def test_score_is_below_100_exactly_with_a_summary(spark):
    p = spark.createDataFrame([(at(0), "dead", 1, 130.0, 5, "silent: 1"), (at(5), "dscp", 1, 5.0, 7, "x")], "window_start timestamp, code string, n long, deduction double, rank long, bullet string")
    w = spark.createDataFrame([(at(0),), (at(5),), (at(10),)], "window_start timestamp")
    out = health_score(p, w).orderBy("window_start")
    assert [(r["score"], bool(r["summary"])) for r in out.collect()] == [(0.0, True), (95.0, True), (100.0, False)]
    assert session_verdict(out).first()["healthy"] is True
