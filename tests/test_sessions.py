"""Sessions, rates of the moving average, tag stacks, and captures that end at different times."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_frames import FRAMES, T0, ether, ipv4, rtp, udp

from tallywire.functions.arith import block
from tallywire.operators.chunks import fold_pairs
from tallywire.operators.sequence import tcp_retransmissions
from tallywire.operators.state import clock_state
from tallywire.operators.timing import jitter_ewma
from tallywire.operators.windows import silence_states
from tallywire.plans.health import stream_windows
from tallywire.plans.network import network_report
from tallywire.sources.decode import decode_l2


@pytest.mark.parametrize("alpha", [1 / 16, 0.5, 1e-4, 1.0])
def test_average_of_any_rate(spark, alpha):
    rnd = random.Random(5)
    rows, us, rtp_ts = [], 0, 0
    for n in range(5000):
        us, rtp_ts = us + rnd.randrange(500, 1500), rtp_ts + 48
        rows.append(("a", n, us, rtp_ts))
    df = spark.createDataFrame(rows, "key string, n long, us long, rtp long").withColumn("ts", F.timestamp_micros("us"))
    j, after = 0.0, {0: 0.0}
    for a, b in zip(rows, rows[1:]):
        j += alpha * (abs((b[2] - a[2]) / 1e6 - 48 / 48000.0) - j)
        after[b[1] // 37] = j
    got = jitter_ewma(df.withColumn("chunk", block("n", 37)), ["key"], ["n"], "ts", "rtp", F.lit(48000.0), 32, ["chunk"], alpha)
    for r in got.collect():
        assert r["jitter"] == pytest.approx(after[r["chunk"]], rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("size", [1, 4, 30, 10_000])
def test_sessions_do_not_depend_on_chunks(spark, size):
    rnd = random.Random(6)
    rows, us = [], 0
    for n in range(300):
        us += rnd.choice([1, 2, 3, 40])
        rows.append((rnd.choice("aab"), n, us, rnd.randrange(100)))
    df = spark.createDataFrame(rows, "key string, n long, us long, v long").withColumn("chunk", block("n", size))
    fresh = lambda p, c: c["us"] - p["us"] > 30
    steps = {"total": ("sum", lambda p, c: c["v"] - p["v"])}
    decays = {"mean": (0.25, lambda p, c: F.abs(c["v"] - p["v"]).cast("double"))}
    out = fold_pairs(df, ["key"], ["n"], ["chunk"], {"us": "us", "v": "v"}, steps, {"rows": ("sum", F.lit(1))}, [], decays, fresh)
    for r in out.collect():
        total, mean, last = 0, 0.0, None
        for _, _, at, v in (x for x in rows if x[0] == r["key"]):
            if last and at - last[0] <= 30:
                total, mean = total + v - last[1], mean + 0.25 * (abs(v - last[1]) - mean)
            else:
                mean = 0.0
            last = (at, v)
        assert (r["total"], r["mean"]) == (total, pytest.approx(mean, rel=1e-9, abs=1e-12))


def bursts(spark, starts, first_seq, ssrc):
    """Three seconds of packets from each start on, each burst with its own sequence numbers and source."""
    rows = []
    for start, seq, who in zip(starts, first_seq, ssrc):
        for i in range(300):
            at = T0 + dt.timedelta(seconds=start + i / 100)
            rows.append(("s", len(rows), at, seq + i, who, T0 + dt.timedelta(seconds=(start + i // 100) // 5 * 5)))
    return spark.createDataFrame(rows, "key string, frame_no long, ts timestamp, rtp_seq long, rtp_ssrc long, window_start timestamp")


def test_stream_starts_afresh_after_silence(spark):
    df = bursts(spark, [0, 600], [100, 20_000], [1, 2])
    old = stream_windows(df, ["key"]).agg(F.sum("lost"), F.sum("ssrc_changes"), F.sum("gap_events")).first()
    new = stream_windows(df, ["key"], prune=20).agg(F.sum("lost"), F.sum("ssrc_changes"), F.sum("gap_events")).first()
    assert tuple(old) == (19600, 1, 1) and tuple(new) == (0, 0, 0)
    # 12 seconds of silence are a gap, not an end
    short = stream_windows(bursts(spark, [0, 15], [100, 405], [1, 1]), ["key"], prune=20).agg(F.sum("lost"), F.sum("gap_events")).first()
    assert tuple(short) == (5, 1)


def test_ports_are_used_again(spark):
    df = bursts(spark, [0, 300], [90_000, 1000], [1, 1]).withColumnRenamed("rtp_seq", "tcp_seq")
    key, order = ["key"], ["ts", "frame_no"]
    assert tcp_retransmissions(df, key, order).first()["retransmissions"] == 300
    assert tcp_retransmissions(df, key, order, prune=20).first()["retransmissions"] == 0


def test_any_number_of_tags(spark):
    rows = [(n, bytearray(ether(0x0800, b"\0" * 30, [(0x8100, n % 8)] * n))) for n in range(9)]
    rows += [(100 + n, bytearray(ether(0x0800, b"", [(0x8100, 1)] * n)[: 12 + 4 * n])) for n in range(1, 6)]  # cut off
    got = {r["n"]: (r["ethertype"], r["pcp"], r["l2_offset"]) for r in decode_l2(spark.createDataFrame(rows, "n int, frame binary")).collect()}
    for n in range(9):
        assert got[n] == (0x0800, n % 8 if n else None, 14 + 4 * n)
    assert all(got[100 + n][0] is None and got[100 + n][2] is None for n in range(1, 6))


def test_each_capture_ends_by_itself(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    ends = spark.createDataFrame([("short", at(5)), ("long", at(600))], "capture_id string, until timestamp")
    active = spark.createDataFrame([("short", "k", at(0), at(4)), ("long", "k", at(0), at(4))], "capture_id string, key string, window_start timestamp, last_ts timestamp")
    states = silence_states(active, ["capture_id", "key"], until=ends)
    last = {r["capture_id"]: r["w"] for r in states.groupBy("capture_id").agg(F.max("window_start").alias("w")).collect()}
    assert last["short"] == at(5) and last["long"] > at(15)
    ptp = spark.createDataFrame(
        [(c, 0, 2, n, at(n), at(n // 5 * 5), "gm") for c in ("short", "long") for n in range(3)],
        "capture_id string, domain int, version int, frame_no long, ts timestamp, window_start timestamp, grandmaster_id string",
    )
    first = ends.withColumn("until", F.when(F.col("capture_id") == "short", F.lit(at(0))).otherwise(F.col("until")))
    events = clock_state(ptp, ["capture_id", "domain", "version"], until=first).collect()
    assert sorted((r["capture_id"], r["event"]) for r in events) == [("long", "detected"), ("long", "lost"), ("short", "detected")]


def test_traffic_is_counted_before_selection(spark, tmp_path):
    rows = []
    for i in range(40):
        at = T0 + dt.timedelta(milliseconds=50 * i)
        if i % 2:
            frame = ether(0x0800, ipv4(17, udp(5004, 5004, rtp(i, i * 48))))
        else:
            frame = ether(0x86DD, bytes(60))  # no kind
        rows.append(("c", i, at, 268, bytearray(frame)))
    net = network_report(spark.createDataFrame(rows, FRAMES), str(tmp_path), ["audio"])
    r = net.report.select("traffic.packets", "traffic.bytes").first()
    assert tuple(r) == (40, 40 * 268)
