"""Arrival-time metrics: inter-arrival gaps, jitter, clock-rate inference, bitrate, regularity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import as_col, block, micros, period_start, signed_wrap
from tallywire.functions.lookups import KNOWN_STEPS, literal_table
from tallywire.operators.chunks import Decay, Row, Step, fold_pairs, with_previous, with_running_sum


def iat_steps(gap_ms: float = 50.0) -> dict[str, Step]:
    """Steps for `fold_pairs` on a field `us` (arrival in µs)."""
    gap = F.lit(int(round(gap_ms * 1000)))
    return {
        "max_iat_us": ("max", lambda p, c: c["us"] - p["us"]),
        "gap_events": ("sum", lambda p, c: (c["us"] - p["us"] > gap).cast("bigint")),
    }


def iat_stats(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    ts: str = "ts",
    gap_ms: float = 50.0,
    known_ptime: Column | None = None,
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Largest inter-arrival time and the number above `gap_ms`, on rows whose packet time is known."""
    us = micros(ts)
    known = F.lit(True) if known_ptime is None else known_ptime
    gap = F.lit(int(round(gap_ms * 1000)))
    steps: dict[str, Step] = {
        "max_iat_us": ("max", lambda p, c: F.when(c["known"], c["us"] - p["us"])),
        "gap_events": ("sum", lambda p, c: (c["known"] & (c["us"] - p["us"] > gap)).cast("bigint")),
    }
    fields = {"us": us, "known": known}
    out = fold_pairs(df, key, order, chunk, fields, steps, {"packets": ("sum", F.lit(1).cast("bigint"))}, keep)
    return out.withColumn("gap_events", F.coalesce("gap_events", F.lit(0).cast("bigint")))


def jitter_decay(bits: int = 32, alpha: float = 1.0 / 16.0) -> Decay:
    """Interarrival jitter in seconds as a decay for `fold_pairs`, on the fields `us`, `rtp` and `hz`."""

    def deviation(p: Row, c: Row) -> Column:
        media = F.when(c["hz"] > 0, signed_wrap(c["rtp"] - p["rtp"], bits) / c["hz"])
        return F.abs((c["us"] - p["us"]) / 1e6 - media)

    return alpha, deviation


def jitter_fields(ts: str = "ts", rtp_ts: str = "rtp_ts", clock_hz: Column | str = "clock_hz") -> dict[str, Column]:
    return {"us": micros(ts), "rtp": F.col(rtp_ts).cast("bigint"), "hz": as_col(clock_hz).cast("double")}


def jitter_ewma(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    ts: str = "ts",
    rtp_ts: str = "rtp_ts",
    clock_hz: Column | str = "clock_hz",
    bits: int = 32,
    chunk: Sequence[str] = ("window_start",),
    alpha: float = 1.0 / 16.0,
) -> DataFrame:
    """Jitter after each chunk: J += alpha * (|arrival step - media step| - J), from 0."""
    fields = jitter_fields(ts, rtp_ts, clock_hz)
    packets = {"packets": ("sum", F.lit(1).cast("bigint"))}
    return fold_pairs(df, key, order, chunk, fields, {}, packets, None, {"jitter": jitter_decay(bits, alpha)})


def final_jitter(per_chunk: DataFrame, key: Sequence[str], chunk: Sequence[str]) -> DataFrame:
    """Jitter after the last chunk of every key."""
    return per_chunk.groupBy(*key).agg(
        F.sum("packets").alias("packets"), F.max_by("jitter", F.struct(*chunk)).alias("jitter")
    )


def infer_step(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str = "rtp_ts",
    bits: int = 32,
    batch: int = 8,
    chunk: Sequence[str] = ("window_start",),
    known: Sequence[tuple[int, float, float]] = KNOWN_STEPS,
) -> DataFrame:
    """First batch of `batch` positive steps whose most frequent step (smallest on ties) is a known one.

    Returns `(key, batch, step, clock_hz, ptime_ms)` for keys that a batch confirms.
    """
    key = list(key)
    prev = with_previous(df.select(*key, *chunk, *order, value), key, order, chunk, {"_pv": value})
    step = signed_wrap(F.col(value).cast("bigint") - F.col("_pv").cast("bigint"), bits)
    positive = prev.select(*key, *chunk, *order, step.alias("step"), F.lit(1).alias("_one")).where(F.col("step") > 0)
    ranked = with_running_sum(positive, key, order, chunk, {"_nth": "_one"})
    ranked = ranked.withColumn("batch", block(F.col("_nth") - 1, batch))
    counts = ranked.groupBy(*key, "batch", "step").agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.groupBy(*key, "batch").agg(
        F.max_by("step", F.struct(F.col("_n"), -F.col("step"))).alias("step"), F.sum("_n").alias("_size")
    )
    table = literal_table(df.sparkSession, known, "step bigint, clock_hz double, ptime_ms double")
    hits = modes.where(F.col("_size") == batch).join(F.broadcast(table), "step")
    first = F.min_by(F.struct("batch", "step", "clock_hz", "ptime_ms"), F.col("batch"))
    return hits.groupBy(*key).agg(first.alias("_hit")).select(*key, "_hit.*")


def rate_buckets(
    df: DataFrame, key: Sequence[str], ts: str = "ts", size: Column | str = "frame_bytes", seconds: float = 1.0
) -> DataFrame:
    """Bits per second in every bucket of a key (whole bits, as a floor)."""
    size = F.col(size) if isinstance(size, str) else size
    return (
        df.groupBy(*key, period_start(ts, seconds).alias("bucket_start"))
        .agg(F.sum(size).alias("bytes"))
        .withColumn("bitrate_bps", F.floor(F.col("bytes") * 8 / F.lit(float(seconds))).cast("bigint"))
    )


def tcp_payload_estimate(frame_bytes: Column | str) -> Column:
    """Frame length without 40 header bytes, never below 0."""
    c = F.col(frame_bytes) if isinstance(frame_bytes, str) else frame_bytes
    return F.greatest(c - F.lit(40), F.lit(0))


def latest_bitrate(buckets: DataFrame, key: Sequence[str]) -> DataFrame:
    return buckets.groupBy(*key).agg(F.max_by("bitrate_bps", "bucket_start").alias("bitrate_bps"))


def timing_regularity(
    df: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    chunk: Sequence[str] = ("window_start",),
    n: int = 64,
    min_n: int = 16,
    low: float = 0.10,
    high: float = 0.30,
) -> DataFrame:
    """Coefficient of variation of the last `n` positive inter-arrival times and the regularity read from it.

    Positive inter-arrival times are the steps between distinct arrival times, so the last n + 1 of those suffice.
    The rank limit is applied before the shuffle as well: a busy stream sends n + 1 times per chunk and input split.
    """
    us = micros(ts).alias("_us")
    inner = Window.partitionBy(*key, *chunk).orderBy(F.col("_us").desc())
    rows = df.select(*key, *chunk, us).select("*", F.dense_rank().over(inner).alias("_rank"))
    times = rows.where(F.col("_rank") <= n + 1).select(*key, "_us").distinct()
    outer = Window.partitionBy(*key).orderBy(F.col("_us").desc())
    recent = times.select("*", F.row_number().over(outer).alias("_rank")).where(F.col("_rank") <= n + 1)
    recent = recent.select(*key, (F.col("_us") - F.lead("_us").over(outer)).cast("double").alias("_iat"))
    stats = recent.where(F.col("_iat").isNotNull()).groupBy(*key).agg(
        F.count(F.lit(1)).alias("samples"), (F.stddev_pop("_iat") / F.avg("_iat")).alias("cv")
    )
    enough = F.col("samples") >= min_n
    return stats.select(
        *key,
        "samples",
        F.when(enough, F.col("cv")).alias("cv"),
        F.when(enough & (F.col("cv") < low), "metronomic").when(enough & (F.col("cv") > high), "noisy").alias("regularity"),
    )


def presence_stats(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    ts: str = "ts",
    size: str = "payload_len",
    seq: str = "rtp_seq",
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Packets, bytes and largest gap for flows with or without RTP fields, and whether RTP was ever seen."""
    totals = {
        "packets": ("sum", F.lit(1).cast("bigint")),
        "bytes": ("sum", F.col(size).cast("bigint")),
        "_rtp": ("max", F.col(seq).isNotNull().cast("int")),
    }
    out = fold_pairs(
        df, key, order, chunk, {"us": micros(ts)}, {"max_iat_us": ("max", lambda p, c: c["us"] - p["us"])}, totals, keep
    )
    return out.withColumn("rtp_seen", F.col("_rtp") == 1).drop("_rtp")


