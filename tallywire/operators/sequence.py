"""Sequence-number metrics: loss, reordering, value changes, timestamp steps, TCP retransmissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import micros, percent, signed_wrap
from tallywire.operators.chunks import Row, Step, fold_pairs


def seq_delta(prev: Column, cur: Column, bits: int) -> Column:
    """Distance of a sequence number from the expected one; the expected one follows the last *arrived* row."""
    return signed_wrap(cur.cast("bigint") - (prev.cast("bigint") + 1), bits)


def loss_steps(bits: int = 16, seq: str = "seq") -> dict[str, Step]:
    def delta(p: Row, c: Row) -> Column:
        return seq_delta(p[seq], c[seq], bits)

    return {
        "lost": ("sum", lambda p, c: F.when(delta(p, c) > 0, delta(p, c)).when(p[seq].isNotNull(), 0).cast("bigint")),
        "reorders": ("sum", lambda p, c: (delta(p, c) < 0).cast("bigint")),
    }


def seq_gaps(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    seq: str = "rtp_seq",
    bits: int = 16,
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Received, lost and reordered rows per key and kept chunk column (`keep=[]` gives totals per key).

    The expected number follows the last arrived row even after a reorder: arrivals 10, 5, 11 give one reorder
    and then five lost. A repeat counts as a reorder.
    """
    out = fold_pairs(
        df, key, order, chunk, {"seq": seq}, loss_steps(bits), {"received": ("sum", F.lit(1).cast("bigint"))}, keep
    )
    zero = F.lit(0).cast("bigint")
    return out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("lost", "reorders")})


def loss_rates(windows: DataFrame, key: Sequence[str], window: str = "window_start") -> DataFrame:
    """Add the loss and reorder percentages of each Window and the running lifetime loss of its key. A key that comes back after
    being pruned has a new lifetime: put the `session` of `silence_states` into `key`."""
    life = Window.partitionBy(*key).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("received") + F.col("lost")
    return windows.withColumns(
        {
            "loss_pct": percent(F.col("lost"), total),
            "reorder_pct": percent(F.col("reorders"), total),
            "lifetime_received": F.sum("received").over(life),
            "lifetime_lost": F.sum("lost").over(life),
        }
    ).withColumn("lifetime_loss_pct", percent(F.col("lifetime_lost"), F.col("lifetime_received") + F.col("lifetime_lost")))


def value_changes(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    value: str,
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows whose value differs from the row before, per key and Window."""
    steps = {"changes": ("sum", lambda p, c: (p["v"] != c["v"]).cast("bigint"))}
    out = fold_pairs(df, key, order, chunk, {"v": value}, steps, {"packets": ("sum", F.lit(1).cast("bigint"))}, keep)
    return out.withColumn("changes", F.coalesce("changes", F.lit(0).cast("bigint")))


def expected_step(clock_hz: Column, ptime_ms: Column) -> Column:
    """Timestamp units per packet: clock x packet time, 1 ms where the time is unknown, 48 without a clock."""
    ptime = F.when(ptime_ms > 0, ptime_ms).otherwise(F.lit(1.0))
    return F.when(clock_hz > 0, (clock_hz * ptime / 1000.0).cast("bigint")).otherwise(F.lit(48).cast("bigint"))


def ts_discontinuity(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    rtp_ts: str = "rtp_ts",
    expected: Column | None = None,
    confirmed: Column | None = None,
    lo: float = 0.5,
    hi: float = 1.5,
    bits: int = 32,
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Timestamp steps outside `lo..hi` times the expected step, on rows whose clock is confirmed."""
    expected = expected_step(F.col("clock_hz"), F.col("ptime_ms")) if expected is None else expected
    confirmed = F.lit(True) if confirmed is None else confirmed

    def bad(p: Row, c: Row) -> Column:
        step = signed_wrap(c["t"].cast("bigint") - p["t"].cast("bigint"), bits)
        outside = (step < c["e"] * F.lit(lo)) | (step > c["e"] * F.lit(hi))
        return (c["ok"] & (c["e"] > 0) & outside).cast("bigint")

    fields = {"t": rtp_ts, "e": expected.cast("bigint"), "ok": confirmed}
    out = fold_pairs(
        df, key, order, chunk, fields, {"ts_disc": ("sum", bad)}, {"packets": ("sum", F.lit(1).cast("bigint"))}, keep
    )
    return out.withColumn("ts_disc", F.coalesce("ts_disc", F.lit(0).cast("bigint")))


def tcp_retransmissions(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    seq: str = "tcp_seq",
    syn: Column | None = None,
    bits: int = 32,
    chunk: Sequence[str] = ("window_start",),
    keep: Sequence[str] = (),
    totals: dict[str, Column] | None = None,
    prune: float | None = None,
    ts: str = "ts",
    window: str = "window_start",
) -> DataFrame:
    """Rows behind the highest sequence number so far, not SYN, from the third row of the connection on.

    Sequence numbers are unwrapped by summing signed steps. A chunk needs three values from the past: its offset,
    the highest number reached and the rows seen, all of which come from one small row per chunk. `keep` names chunk
    columns of the result, `totals` further sums. With `prune`, a connection that was silent for so many whole seconds when a Window began
    is a new one on the same ports (chunks must not be longer than Windows).
    """
    key, order, chunk = list(key), list(order), list(chunk)
    syn = F.lit(False) if syn is None else F.coalesce(syn, F.lit(False))
    base = df.select(*key, *dict.fromkeys([*chunk, *order]), *([micros(ts).alias("_us"), micros(window).alias("_begin_us")] if prune is not None else []), F.col(seq).cast("bigint").alias("_seq"), syn.alias("_syn"), *[c.cast("bigint").alias(f"_t_{n}") for n, c in (totals or {}).items()])
    w = Window.partitionBy(*key, *chunk).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    step = signed_wrap(F.col("_seq") - F.lag("_seq").over(w), bits)
    rows = base.select("*", F.coalesce(step, F.lit(0)).alias("_step"), F.row_number().over(w).alias("_rn"))
    rows = rows.withColumn("_rel", F.sum("_step").over(upto))
    rows = rows.withColumn("_high", F.max("_rel").over(earlier))

    per_chunk = rows.groupBy(*key, *chunk).agg(
        F.sum("_step").alias("_end"),
        F.max("_rel").alias("_top"),
        F.count(F.lit(1)).alias("_n"),
        F.max(F.when(F.col("_rn") == 1, F.col("_seq"))).alias("_first"),
        *([F.max("_us").alias("_last_us"), F.min("_begin_us").alias("_begin_us")] if prune is not None else []),
    )
    across = Window.partitionBy(*key).orderBy(*chunk)
    if prune is not None:
        silent = F.floor((F.col("_begin_us") - F.lag("_last_us").over(across)) / 1_000_000) >= prune
        per_chunk = per_chunk.withColumn("_new", F.coalesce(silent, F.lit(False)).cast("bigint"))
        per_chunk = per_chunk.withColumn("_life", F.sum("_new").over(across))
        across = Window.partitionBy(*key, "_life").orderBy(*chunk)
    past = across.rowsBetween(Window.unboundedPreceding, -1)
    last = signed_wrap(F.col("_first") + F.col("_end"), bits)
    per_chunk = per_chunk.withColumn("_last", last)
    jump = F.coalesce(signed_wrap(F.col("_first") - F.lag("_last").over(across), bits), F.lit(0))
    per_chunk = per_chunk.withColumn("_jump", jump)
    per_chunk = per_chunk.withColumn("_begin", F.coalesce(F.sum(F.col("_jump") + F.col("_end")).over(past), F.lit(0)) + F.col("_jump"))
    per_chunk = per_chunk.select(
        *key,
        *chunk,
        "_begin",
        F.max(F.col("_begin") + F.col("_top")).over(past).alias("_reached"),
        F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_seen"),
    )
    placed = rows.join(per_chunk, [*key, *chunk], "left")
    top = F.greatest(F.col("_reached"), F.col("_begin") + F.col("_high"))
    behind = (F.col("_begin") + F.col("_rel") < top) & ~F.col("_syn") & (F.col("_seen") + F.col("_rn") > 2)
    return placed.groupBy(*key, *keep).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(behind).cast("bigint").alias("retransmissions"),
        *[F.sum(f"_t_{n}").alias(n) for n in totals or {}],
    )


def connection_quality(rst: Column, fin: Column, retransmissions: Column) -> Column:
    """Quality of a TCP connection from its totals."""
    return (
        F.when((rst > 0) | (fin >= 2), "terminated")
        .when(retransmissions > 10, "critical")
        .when(retransmissions > 2, "degrading")
        .otherwise("healthy")
    )

