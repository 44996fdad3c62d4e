"""Streams in several micro-batches give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywire.functions.arith import period_start
from tallywire.operators.timing import final_jitter, jitter_ewma
from tallywire.operators.windows import per_window_last, silence_states
from tallywire.plans.health import stream_windows
from tallywire.streaming.carry import merged_metrics, stream_enrich, stream_metrics
from tallywire.streaming.timers import stream_silence
from tallywire.streaming.windows import start, stream_first_seen, stream_window_totals

T0 = dt.datetime(2024, 1, 1)
COLS = "key string, frame_no long, ts timestamp, rtp_seq int, rtp_ts long, rtp_ssrc int, clock_hz double, frame_bytes int"


@pytest.fixture(scope="module")
def packets():
    rnd, rows, seq, t = random.Random(3), [], {}, 0.0
    for n in range(2000):
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(5)}"
        seq[key] = (seq.get(key, 65000) + rnd.choice([1, 1, 1, 1, 3, -2])) % 65536
        t += rnd.choice([0.01, 0.02, 0.3])
        rows.append((key, n, T0 + dt.timedelta(seconds=round(t, 6)), seq[key], seq[key] * 48, rnd.randrange(3), 48000.0, 100))
    return rows


def source(spark, rows, folder, parts, cols=COLS):
    """Write `rows` as `parts` files, read one per micro-batch in that order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], cols).coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_metrics_over_batches(spark, packets, tmp_path):
    stream = source(spark, packets, tmp_path / "in", 4)
    stream_metrics(
        stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), ["key"], gap_ms=1000, prune=10_000
    ).awaitTermination()
    got = merged_metrics(spark.read.parquet(str(tmp_path / "out")), ["key"])
    df = spark.createDataFrame(packets, COLS).withColumn("window_start", period_start("ts", 5))
    want = stream_windows(df, ["key"], gap_ms=1000)
    names = ["key", "window_start", "received", "lost", "reorders", "gap_events", "ssrc_changes", "max_iat_us", "bytes"]
    assert got.select(names).exceptAll(want.select(names)).count() == 0 and got.count() == want.count()
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 4
    # The carried jitter equals the fold over the whole stream.
    state = {r["key"]: r["_jitter"] for r in spark.read.parquet(str(tmp_path / "state")).where("version = 3").collect()}
    fold = final_jitter(jitter_ewma(df, ["key"], ["ts", "frame_no"]), ["key"], ["window_start"])
    assert state == pytest.approx({r["key"]: r["jitter"] for r in fold.collect()}, rel=1e-9)


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_silence_inside_and_across_batches(spark, tmp_path, parts):
    rnd, rows, t = random.Random(4), [], 0.0
    for n in range(240):
        t += rnd.choice([0.01, 0.02, 0.3, 4.0]) if n % 24 else rnd.choice([12.0, 21.0, 24.0, 45.0, 200.0])
        key = "steady" if n % 5 == 0 else f"k{n // 48 % 2}"
        rows.append((key, n, T0 + dt.timedelta(seconds=round(t, 6)), rnd.randrange(65536), n * 48, n // 24, 48000.0, 100))
    stream = source(spark, rows, tmp_path / "in", parts)
    stream_metrics(stream, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), ["key"], gap_ms=1000).awaitTermination()
    got = merged_metrics(spark.read.parquet(str(tmp_path / "out")), ["key"])
    df = spark.createDataFrame(rows, COLS).withColumn("window_start", period_start("ts", 5))
    want = stream_windows(df, ["key"], gap_ms=1000, prune=20)
    names = ["key", "window_start", "received", "lost", "reorders", "gap_events", "ssrc_changes", "max_iat_us", "bytes"]
    assert got.select(names).exceptAll(want.select(names)).count() == 0 and got.count() == want.count()
    ends = {r["key"]: r["j"] / 1000 for r in want.groupBy("key").agg(F.max_by("jitter_ms", "window_start").alias("j")).collect()}
    state = spark.read.parquet(str(tmp_path / "state")).where(f"version = {parts - 1}").collect()
    assert "steady" in {r["key"] for r in state}
    assert all(r["_jitter"] == pytest.approx(ends[r["key"]], rel=1e-9) for r in state)


def test_late_row_counts_as_reorder(spark, tmp_path):
    base = [("s", 0, T0, 10, 0, 1, 48000.0, 1), ("s", 1, T0 + dt.timedelta(seconds=2), 11, 0, 1, 48000.0, 1)]
    late = [("s", 2, T0 + dt.timedelta(seconds=1), 9, 0, 1, 48000.0, 1), ("s", 3, T0 + dt.timedelta(seconds=3), 12, 0, 1, 48000.0, 1)]
    stream_metrics(
        source(spark, base + late, tmp_path / "in", 2), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), ["key"]
    ).awaitTermination()
    r = merged_metrics(spark.read.parquet(str(tmp_path / "out")), ["key"]).first()
    assert (r["received"], r["reorders"], r["lost"]) == (4, 1, 2)


def test_late_row_is_no_silence(spark, tmp_path):
    at = lambda n, sec, seq: ("s", n, T0 + dt.timedelta(seconds=sec), seq, 0, 1, 48000.0, 1)
    rows = [at(0, 0, 1), at(1, 100, 10), at(2, 101, 11), at(3, 1, 9), at(4, 102, 12), at(5, 103, 13)]
    stream_metrics(
        source(spark, rows, tmp_path / "in", 2), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "ck"), ["key"]
    ).awaitTermination()
    r = merged_metrics(spark.read.parquet(str(tmp_path / "out")), ["key"]).agg(F.sum("received"), F.sum("reorders"), F.sum("lost")).first()
    assert tuple(r) == (6, 1, 2)


def test_silence_over_batches(spark, tmp_path):
    rows = [("a", T0 + dt.timedelta(seconds=s)) for s in (1, 3, 21, 60)] + [("b", T0 + dt.timedelta(seconds=s)) for s in (2, 4, 62, 100)]
    rows.sort(key=lambda r: r[1])
    stream = source(spark, rows, tmp_path / "in", 4, "key string, ts timestamp")
    closed = stream_window_totals(stream, "1 second", ["key"], {})
    start(stream_silence(closed, ["key"], "key string"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["key"], r["at_us"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    df = spark.createDataFrame(rows, "key string, ts timestamp").withColumn("window_start", period_start("ts", 5))
    closed_until = T0 + dt.timedelta(seconds=95)
    active = per_window_last(df.where(F.col("window_start") < F.lit(closed_until)), ["key"])
    states = silence_states(active, ["key"], until=F.lit(closed_until - dt.timedelta(seconds=5)))
    first = states.groupBy("key", "session", "last_ts", "state").agg(F.min(F.unix_micros("window_start") + 5_000_000).alias("at"))
    want = {(r["key"], r["at"], r["state"]) for r in first.where("state <> 'live'").collect()}
    lives = states.where("state = 'live'").groupBy("key", "session").agg(F.min(F.unix_micros("window_start") + 5_000_000).alias("at"))
    want |= {(r["key"], r["at"], "live") for r in lives.collect()}
    assert got == want


def test_first_seen_over_batches(spark, packets, tmp_path):
    stream = source(spark, packets, tmp_path / "in", 4)
    start(stream_first_seen(stream, ["key"], "1 hour").select("key", "ts"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len({r[0] for r in packets})


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # The late-row check uses the watermark of the batch before, hence the row at 110.
    rows = [("a", T0 + dt.timedelta(seconds=s)) for s in (1, 100, 110, 2, 200)]
    stream = source(spark, rows, tmp_path / "in", 5, "key string, ts timestamp")
    q = start(stream_window_totals(stream, "1 second", ["key"], {"n": F.count(F.lit(1))}), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"])
    assert dropped == 1
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 1, 1]


def test_enrichment_of_a_stream(spark, tmp_path):
    p = [(i, T0 + dt.timedelta(seconds=i), "239.69.0.1", 5004, T0) for i in range(4)]
    stream = source(spark, p, tmp_path / "in", 2, "frame_no long, ts timestamp, dst_ip string, dst_port int, window_start timestamp")
    media = spark.createDataFrame(
        [(0, T0 + dt.timedelta(seconds=1), T0, 5004, None, "Desk", "L24", 48000.0, 1.0, 2, [96])],
        "frame_no long, ts timestamp, window_start timestamp, port int, connection_ip string, session_name string, rtpmap string, clock_hz double, ptime_ms double, channels int, payload_types array<int>",
    )
    media.write.parquet(str(tmp_path / "media"))
    stream_enrich(stream, str(tmp_path / "media"), media.schema, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("frame_no").collect()
    assert [r["session_name"] for r in out] == [None, "Desk", "Desk", "Desk"]


def test_a_stream_goes_on_until_stopped(spark, tmp_path):
    """With a processing-time trigger rows that arrive after the start are written as well."""
    import time

    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(folder)
    rows = spark.readStream.schema("id long").parquet(folder)
    query = start(rows, str(tmp_path / "out"), str(tmp_path / "ck"), trigger={"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(folder)
        for _ in range(100):
            if spark.read.schema("id long").parquet(str(tmp_path / "out")).count() == 5:
                break
            time.sleep(0.2)
        assert query.isActive
    finally:
        query.stop()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]
