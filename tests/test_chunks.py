"""Chunked operators give the same result however a key is cut, with one key holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallywire.functions.arith import block
from tallywire.operators.chunks import (
    with_last_known,
    with_previous,
    with_running_sum,
)
from tallywire.operators.sequence import seq_gaps, tcp_retransmissions, ts_discontinuity
from tallywire.operators.timing import final_jitter, infer_step, jitter_ewma, timing_regularity

KEY, ORDER = ["key"], ["n"]


def signed(x, bits):
    half = 1 << (bits - 1)
    return (x + half) % (1 << bits) - half


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out, seq, ts = [], {}, 0
    for n in range(6000):
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(40)}"
        step = rnd.choice([1] * 12 + [2, 3, -4, 0, 70])
        seq[key] = (seq.get(key, 65500) + step) % 65536
        ts += rnd.randrange(1, 4000)
        rtp = (seq[key] * 48 + 4294900000) % (1 << 32)
        tcp = (4294967000 + seq[key] * 7 + rnd.choice([0, 0, 0, -900])) % (1 << 32)
        out.append((key, n, ts, seq[key], rtp, tcp, rnd.choice([None, None, n]), n % 17 == 0))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    cols = "key string, n long, us long, seq int, rtp long, tcp long, maybe long, syn boolean"
    return spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_micros("us")).repartition(6).cache()


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


CUTS = [1, 7, 250, 100_000]


@pytest.mark.parametrize("size", CUTS)
def test_loss_and_reorder(df, rows, size):
    got = seq_gaps(df.withColumn("chunk", block("n", size)), KEY, ORDER, "seq", 16, ["chunk"], []).collect()
    for r in got:
        seqs = [x[3] for x in by_key(rows)[r["key"]]]
        deltas = [signed(b - a - 1, 16) for a, b in zip(seqs, seqs[1:])]
        assert (r["lost"], r["reorders"], r["received"]) == (
            sum(d for d in deltas if d > 0),
            sum(d < 0 for d in deltas),
            len(seqs),
        )
    assert len(got) == len(by_key(rows))


@pytest.mark.parametrize("size", CUTS)
def test_jitter_fold(df, rows, size):
    cut = df.withColumn("chunk", block("n", size))
    out = final_jitter(jitter_ewma(cut, KEY, ORDER, "ts", "rtp", F.lit(48000.0), 32, ["chunk"]), KEY, ["chunk"])
    for r in out.collect():
        j, packets = 0.0, by_key(rows)[r["key"]]
        for a, b in zip(packets, packets[1:]):
            j += (abs((b[2] - a[2]) / 1e6 - signed(b[4] - a[4], 32) / 48000.0) - j) / 16.0
        assert r["jitter"] == pytest.approx(j, rel=1e-9, abs=1e-12)


def test_jitter_after_every_chunk(df, rows):
    cut = df.withColumn("chunk", block("n", 250))
    got = {(r["key"], r["chunk"]): r["jitter"] for r in jitter_ewma(cut, KEY, ORDER, "ts", "rtp", F.lit(48000.0), 32, ["chunk"]).collect()}
    for key, packets in by_key(rows).items():
        j, after = 0.0, {packets[0][1] // 250: 0.0}
        for a, b in zip(packets, packets[1:]):
            j += (abs((b[2] - a[2]) / 1e6 - signed(b[4] - a[4], 32) / 48000.0) - j) / 16.0
            after[b[1] // 250] = j
        for chunk, want in after.items():
            assert got[key, chunk] == pytest.approx(want, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("size", CUTS)
def test_tcp_retransmissions(df, rows, size):
    cut = df.withColumn("chunk", block("n", size))
    for r in tcp_retransmissions(cut, KEY, ORDER, "tcp", F.col("syn"), 32, ["chunk"]).collect():
        top, count = None, 0
        for i, x in enumerate(by_key(rows)[r["key"]]):
            if top is not None and signed(x[5] - top, 32) < 0 and not x[7] and i + 1 > 2:
                count += 1
            if top is None or signed(x[5] - top, 32) > 0:
                top = x[5]
        assert r["retransmissions"] == count


@pytest.mark.parametrize("size", CUTS)
def test_row_look_back(df, size):
    cut = df.withColumn("chunk", block("n", size))
    w = Window.partitionBy("key").orderBy("n")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "n",
        F.lag("seq").over(w).alias("p"),
        F.last("maybe", ignorenulls=True).over(past).alias("k"),
        F.last("maybe", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("e"),
        F.sum("seq").over(past).alias("s"),
    )
    got = with_previous(cut, KEY, ORDER, ["chunk"], {"p": "seq"})
    got = with_last_known(got, KEY, ORDER, ["chunk"], {"k": "maybe"})
    got = with_last_known(got, KEY, ORDER, ["chunk"], {"e": "maybe"}, include_current=False)
    got = with_running_sum(got, KEY, ORDER, ["chunk"], {"s": "seq"}).select("n", "p", "k", "e", "s")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_regularity_of_recent_times(df, rows):
    shared = df.withColumn("ts", F.timestamp_micros(F.col("us") - F.col("us") % 3000))  # repeated arrival times
    for size in (50, 100_000):
        got = timing_regularity(shared.withColumn("chunk", block("n", size)), KEY, "ts", ["chunk"]).collect()
        for r in got:
            us = [x[2] - x[2] % 3000 for x in by_key(rows)[r["key"]]]
            iat = [b - a for a, b in zip(us, us[1:]) if b > a][-64:]
            assert r["samples"] == len(iat)
            if len(iat) >= 16:
                assert r["cv"] == pytest.approx(statistics.pstdev(iat) / statistics.fmean(iat))


def test_inference_across_chunks(spark):
    # 20 steps of 960 with three odd ones; the eight-step batches straddle the chunks of five rows.
    steps = [960] * 5 + [111, 222] + [960] * 6 + [333] + [960] * 6
    ts, rows = 0, [("a", 0, 0)]
    for i, s in enumerate(steps):
        ts += s
        rows.append(("a", i + 1, ts))
    df = spark.createDataFrame(rows, "key string, n long, rtp long").withColumn("chunk", block("n", 5))
    assert [tuple(r) for r in infer_step(df, KEY, ORDER, "rtp", chunk=["chunk"]).collect()] == [("a", 0, 960, 48000.0, 20.0)]


def test_discontinuity_at_chunk_border(spark):
    rows = [("a", 0, 0), ("a", 1, 48), ("a", 2, 200), ("a", 3, 248), ("a", 4, 100)]
    df = spark.createDataFrame(rows, "key string, n long, rtp long")
    df = df.withColumns({"clock_hz": F.lit(48000.0), "ptime_ms": F.lit(1.0)})
    for size in (1, 2, 10):
        out = ts_discontinuity(df.withColumn("chunk", block("n", size)), KEY, ORDER, "rtp", chunk=["chunk"], keep=[])
        assert out.first()["ts_disc"] == 2


def test_no_task_gets_a_whole_hot_key(df):
    """Rows are shuffled by key and chunk: the largest shuffle group is one chunk, not the hot key."""
    out = seq_gaps(df.withColumn("chunk", block("n", 100)), KEY, ORDER, "seq", 16, ["chunk"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert len(exchanges) == 2
    assert any("key" in x and "chunk" in x for x in exchanges)
