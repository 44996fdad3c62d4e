"""From packets to one score per Window: a single pass over the packets, then small tables only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import MICROS, micros, percent, period_micros, signed_wrap
from tallywire.operators.chunks import Decay, Step, Total, fold_pairs
from tallywire.operators.sequence import expected_step, loss_steps
from tallywire.operators.timing import jitter_decay, jitter_fields
from tallywire.operators.windows import WINDOW_SECONDS, silence_states
from tallywire.plans.scoring import Limits, health_score, penalties, stream_diagnostics


def stream_windows(
    packets: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    chunk: Sequence[str] = ("window_start",),
    window: str = "window_start",
    gap_ms: float = 50.0,
    extra: Mapping[str, Total] | None = None,
    prune: float | None = None,
) -> DataFrame:
    """All metrics of every stream and Window from one shuffle and one sort of the packets.

    Uses whichever of the columns rtp_seq, rtp_ts, rtp_ssrc, clock_hz, ptime_ms, clock_confirmed, frame_bytes,
    dscp_viol, pcp_viol, pt_mismatch and ttl are present; `jitter_ms` is the jitter at the end of the Window. `extra` adds totals `{name: (combine, column)}`.
    A stream that was silent for `prune` whole seconds when its Window began starts afresh, as in `silence_states`.
    """
    have = set(packets.columns)
    fields: dict[str, Column | str] = {"us": micros(ts)}
    one = F.lit(1).cast("bigint")
    ptime_known = F.coalesce(F.col("ptime_ms") > 0, F.lit(False)) if "ptime_ms" in have else F.lit(True)
    fields["known"] = ptime_known
    gap = F.lit(int(round(gap_ms * 1000)))
    steps: dict[str, Step] = {
        "max_iat_us": ("max", lambda p, c: F.when(c["known"], c["us"] - p["us"])),
        "gap_events": ("sum", lambda p, c: (c["known"] & (c["us"] - p["us"] > gap)).cast("bigint")),
    }
    totals: dict[str, Total] = {"received": ("sum", one), "last_us": ("max", micros(ts))}
    if "rtp_seq" in have:
        fields["seq"] = "rtp_seq"
        steps.update(loss_steps(16))
    if "rtp_ssrc" in have:
        fields["ssrc"] = "rtp_ssrc"
        steps["ssrc_changes"] = ("sum", lambda p, c: (p["ssrc"] != c["ssrc"]).cast("bigint"))
    if {"rtp_ts", "clock_hz", "ptime_ms"} <= have:
        fields["expect"] = expected_step(F.col("clock_hz"), F.col("ptime_ms"))
        fields["ok"] = F.coalesce(F.col("clock_confirmed"), F.lit(False)) if "clock_confirmed" in have else F.lit(True)

        def off(p: Mapping[str, Column], c: Mapping[str, Column]) -> Column:
            step = signed_wrap(c["rtp"].cast("bigint") - p["rtp"].cast("bigint"), 32)
            return (c["ok"] & ((step < c["expect"] * 0.5) | (step > c["expect"] * 1.5))).cast("bigint")

        steps["ts_disc"] = ("sum", off)
    decays: dict[str, Decay] = {}
    if {"rtp_ts", "clock_hz"} <= have:
        fields.update(jitter_fields(ts))
        decays["jitter_ms"] = jitter_decay(32)
    if "frame_bytes" in have:
        totals["bytes"] = ("sum", F.col("frame_bytes").cast("bigint"))
    for flag in ("dscp_viol", "pcp_viol", "pt_mismatch"):
        if flag in have:
            totals[flag] = ("sum", F.coalesce(F.col(flag), F.lit(False)).cast("bigint"))
    if "ttl" in have:
        totals["min_ttl"] = ("min", F.col("ttl"))
    totals.update(extra or {})
    fresh = None
    if prune is not None:
        fields["begin"] = micros(window)
        fresh = lambda p, c: F.floor((c["begin"] - p["us"]) / MICROS) >= prune
    out = fold_pairs(packets, key, order, chunk, fields, steps, totals, [window], decays, fresh)
    out = out.withColumns({n: F.col(n) * 1000.0 for n in decays})
    counted = [n for n, (how, _) in steps.items() if how == "sum"]
    return out.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in counted}).withColumn(
        "last_ts", F.timestamp_micros("last_us")
    ).drop("last_us")


def with_silence(
    stream_rows: DataFrame,
    key: Sequence[str],
    until: Column | DataFrame,
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    dead: float = 10,
    prune: float = 20,
) -> DataFrame:
    """Add the Windows in which a stream was silent but not yet pruned, `silent_secs`, `session` and lifetime loss."""
    states = silence_states(stream_rows, key, window, "last_ts", seconds, dead, prune, until)
    rest = stream_rows.drop("last_ts")
    out = states.where(F.col("state") != "pruned").join(rest, [*key, window], "left")
    counts = [c for c in ("received", "lost") if c in rest.columns]
    others = ("reorders", "gap_events", "ssrc_changes", "ts_disc", "bytes", "dscp_viol", "pcp_viol", "pt_mismatch", "ecn_marks")
    end = micros(window) + F.lit(period_micros(seconds)).cast("bigint")
    out = out.withColumn("silent_secs", (end - micros("last_ts")) / float(MICROS))
    out = out.na.fill(0, [*counts, *[c for c in others if c in rest.columns]])
    life = Window.partitionBy(*key, "session").orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"lifetime_{c}": F.sum(c).over(life) for c in counts})
    if len(counts) == 2:
        whole = F.col("lifetime_received") + F.col("lifetime_lost")
        out = out.withColumn("lifetime_loss_pct", percent(F.col("lifetime_lost"), whole))
    return out


def health_report(
    stream_rows: DataFrame,
    windows: DataFrame,
    key: Sequence[str],
    infrastructure: DataFrame | None = None,
    limits: Limits = Limits(),
    window: str = "window_start",
    by: Sequence[str] = (),
) -> DataFrame:
    """Score and summary per Window from stream rows and infrastructure deductions."""
    group = [*by, window]
    found = stream_diagnostics(stream_rows, [*group, *[k for k in key if k not in group]], limits)
    return health_score(penalties(found, infrastructure, group), windows, group)

