"""Bitrate samples against a walk over all packets, with a hot key and any cut into chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallywire.operators.bitrate import elapsed_bitrate

T0 = dt.datetime(2024, 1, 1)


def walked(rows, period):
    out, state = [], {}
    for k, us, _, size in sorted(rows, key=lambda r: (r[1], r[2])):
        check, held = state.get(k, (us, 0))
        held += size or 0
        if us - check > period:
            out.append((k, us, held, us - check, int(held * 8.0 / ((us - check) / 1e6))))
            check, held = us, 0
        state[k] = check, held
    return sorted(out)


@pytest.mark.parametrize("window, fan, block", [(5, 16, 1 << 20), (1, 2, 50), (60, 3, 7)])
def test_samples(spark, window, fan, block):
    rng = random.Random(window)
    rows, us = [], {}
    for i in range(3000):
        k = "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}"
        us[k] = us.get(k, rng.randrange(10**6)) + rng.choice([0, 1, 900, 40_000, 333_333, 1_000_000, 1_000_001, 2_500_000]) * (rng.random() < 0.4)
        rows.append((k, us[k], i, rng.choice([None, 0, 64, 1500])))
    rows.append(("one", 5, 4000, 10))
    df = spark.createDataFrame([(k, T0 + dt.timedelta(microseconds=u), i, s) for k, u, i, s in rows], "k string, ts timestamp, frame_no long, frame_bytes int")
    length = F.lit(window * 1_000_000)
    df = df.withColumns({"window_start": F.timestamp_micros(F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), length)), "block": F.floor(F.col("frame_no") / block)})
    start = df.select(F.min(F.unix_micros("ts") - F.lit(min(r[1] for r in rows)))).first()[0]
    out = elapsed_bitrate(df.repartition(4), ["k"], fan=fan).select("k", F.unix_micros("ts") - start, "bytes", "elapsed_us", "bitrate_bps")
    assert sorted(tuple(r) for r in out.collect()) == walked(rows, 1_000_000)


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, ts timestamp, frame_no long, frame_bytes int, window_start timestamp, block long")
    assert elapsed_bitrate(df, ["k"]).count() == 0
