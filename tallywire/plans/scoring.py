"""Diagnostics, penalties, score, summary and verdict. One row per condition; nothing here touches packets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.arith import percent
from tallywire.functions.lookups import case_of


@dataclass(frozen=True)
class Limits:
    """Thresholds of the stream conditions (times in milliseconds or seconds)."""

    reorder_pct: float = 1.0
    jitter_ms: float = 10.0
    high_jitter_ms: float = 20.0
    dante_jitter_ms: float = 15.0
    dante_loss_pct: float = 0.1
    routed_ttl: int = 64
    announce_after: int = 10
    gap_events: int = 2
    dead_secs: float = 10.0


def _conditions(lim: Limits) -> list[tuple[str, tuple[str, ...], Column, Column, Column, bool]]:
    """(code, columns it needs, condition, value, deduction, critical) for one stream in one Window."""
    c = F.col
    rtp = c("protocol").isin("AES67", "Dante") | c("protocol").startswith("2110")
    loss = percent(c("lost"), c("received") + c("lost"))
    reorder = percent(c("reorders"), c("received") + c("lost"))
    jitter = c("jitter_ms")
    none = F.lit(0.0)

    def num(x: Column) -> Column:
        return x.cast("double")

    return [
        ("ts_discontinuity", ("ts_disc",), c("ts_disc") > 0, num(c("ts_disc")), 3.0 * F.least(c("ts_disc"), F.lit(5)), False),
        ("packet_loss", ("lost", "received"), c("lost") > 0, loss, F.least(loss, F.lit(10.0)), False),
        ("reorder", ("reorders", "lost", "received"), reorder > lim.reorder_pct, reorder, none, False),
        ("dscp", ("dscp_viol",), c("dscp_viol") > 0, num(c("dscp_viol")), F.lit(5.0), False),
        (
            "ttl_routed",
            ("protocol", "min_ttl"),
            (c("protocol") == "Dante") & (c("min_ttl") < lim.routed_ttl),
            num(c("min_ttl")),
            none,
            False,
        ),
        (
            "high_jitter",
            ("jitter_ms",),
            jitter > lim.jitter_ms,
            jitter,
            F.when(jitter > lim.high_jitter_ms, 5.0).otherwise(2.0),
            False,
        ),
        (
            "aes67_ptp_hint",
            ("protocol", "jitter_ms"),
            (c("protocol") == "AES67") & (jitter > lim.jitter_ms),
            jitter,
            none,
            False,
        ),
        (
            "dante_clock_hint",
            ("protocol", "jitter_ms", "lifetime_loss_pct"),
            (c("protocol") == "Dante") & ((c("lifetime_loss_pct") > lim.dante_loss_pct) | (jitter > lim.dante_jitter_ms)),
            c("lifetime_loss_pct"),
            none,
            False,
        ),
        ("ssrc_change", ("ssrc_changes",), c("ssrc_changes") > 0, num(c("ssrc_changes")), 10.0 * F.least(c("ssrc_changes"), F.lit(3)), False),
        ("pt_mismatch", ("pt_mismatch",), c("pt_mismatch") > 0, num(c("pt_mismatch")), none, False),
        (
            "not_announced",
            ("protocol", "rtp_seen", "clock_confirmed", "lifetime_received"),
            rtp & c("rtp_seen") & ~c("clock_confirmed") & (c("lifetime_received") > lim.announce_after),
            none,
            none,
            False,
        ),
        ("unknown_type", ("protocol",), c("protocol") == "2110-??", none, none, False),
        ("signal_gap", ("gap_events",), c("gap_events") >= lim.gap_events, num(c("gap_events")), F.lit(10.0), False),
        ("dead", ("silent_secs",), c("silent_secs") > lim.dead_secs, num(c("silent_secs")), F.lit(30.0), True),
        (
            "pcp_advisory",
            ("protocol", "pcp_viol"),
            (c("pcp_viol") > 0) & ((c("protocol") == "AES67") | c("protocol").startswith("2110")),
            num(c("pcp_viol")),
            none,
            False,
        ),
    ]


def stream_diagnostics(
    streams: DataFrame, keep: Sequence[str], limits: Limits = Limits()
) -> DataFrame:
    """One row per active condition of a stream in a Window: `keep` columns, code, value, deduction, critical.

    Conditions whose columns the input lacks are left out.
    """
    have = set(streams.columns)
    active = [
        F.when(
            cond,
            F.struct(
                F.lit(code).alias("code"),
                value.cast("double").alias("value"),
                deduction.cast("double").alias("deduction"),
                F.lit(critical).alias("critical"),
            ),
        )
        for code, needs, cond, value, deduction, critical in _conditions(limits)
        if have.issuperset(needs)
    ]
    return streams.select(*keep, F.explode(F.array_compact(F.array(*active))).alias("_d")).select(*keep, "_d.*")


# Penalty code, order in the summary, name, cap on the total per Window (null = none).
PENALTIES = [
    ("packet_loss", 1, "packet loss", None),
    ("high_jitter", 2, "high jitter", None),
    ("ts_discontinuity", 3, "timestamp discontinuities", None),
    ("ssrc_change", 4, "SSRC changes", None),
    ("dead", 5, "silent", None),
    ("signal_gap", 6, "signal gaps", None),
    ("dscp", 7, "incorrect DSCP", 20.0),
    ("avb_pcp", 8, "PCP mismatch", None),
    ("tcp_quality", 9, "degraded TCP quality", None),
    ("tcp_retransmissions", 10, "TCP retransmissions", 10.0),
    ("ecn", 11, "ECN congestion marks", 20.0),
    ("querier_absent", 12, "querier absent", None),
    ("multiple_queriers", 13, "multiple queriers", None),
    ("clock_lost", 14, "clock source lost", None),
    ("no_grandmaster", 15, "PTP without grandmaster", None),
    ("grandmaster_changed", 16, "grandmaster changed", None),
    ("reservation_failed", 17, "reservation failures", None),
    ("eee", 18, "EEE active", 30.0),
]

# Deduction per occurrence of an infrastructure factor, and how many occurrences count per row.
INFRASTRUCTURE = [
    ("avb_pcp", 15.0, None),
    ("tcp_degrading", 5.0, None),
    ("tcp_critical", 15.0, None),
    ("tcp_terminated", 25.0, None),
    ("tcp_retransmissions", 0.5, None),
    ("ecn", 2.0, None),
    ("querier_absent", 10.0, None),
    ("multiple_queriers", 15.0, None),
    ("clock_lost", 25.0, None),
    ("no_grandmaster", 15.0, None),
    ("grandmaster_changed", 10.0, 3),
    ("reservation_failed", 20.0, None),
    ("eee", 15.0, None),
]


def infrastructure_deductions(factors: DataFrame, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Turn counted factors `(group, scope, code, n)` into deductions; rows with n = 0 vanish.

    `scope` tells apart rows of one code, such as clock domains or connections.
    """
    unit = case_of(F.col("code"), [(c, u) for c, u, _ in INFRASTRUCTURE], F.lit(0.0))
    counted = case_of(F.col("code"), [(c, n) for c, _, n in INFRASTRUCTURE if n], F.col("n"))
    code = F.when(F.col("code").startswith("tcp_") & (F.col("code") != "tcp_retransmissions"), "tcp_quality")
    return factors.where(F.col("n") > 0).select(
        *group,
        F.coalesce(code, F.col("code")).alias("code"),
        F.col("n").cast("bigint").alias("n"),
        (unit * F.least(F.col("n"), counted)).alias("deduction"),
    )


def penalties(diagnostics: DataFrame, infrastructure: DataFrame | None = None, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Summed and capped deductions, one row per Window and code: `n`, `deduction`, `rank`, `bullet`."""
    rows = diagnostics.where(F.col("deduction") > 0).select(*group, "code", F.lit(1).cast("bigint").alias("n"), "deduction")
    if infrastructure is not None:
        rows = rows.unionByName(infrastructure.select(*group, "code", "n", "deduction"))
    total = rows.groupBy(*group, "code").agg(F.sum("n").alias("n"), F.sum("deduction").alias("deduction"))
    cap = case_of(F.col("code"), [(c, v) for c, _, _, v in PENALTIES if v is not None])
    name = case_of(F.col("code"), [(c, t) for c, _, t, _ in PENALTIES], F.col("code"))
    rank = case_of(F.col("code"), [(c, r) for c, r, _, _ in PENALTIES], F.lit(len(PENALTIES) + 1))
    return total.withColumns(
        {
            "deduction": F.least(F.col("deduction"), cap),
            "rank": rank.cast("bigint"),
            "bullet": F.concat(name, F.lit(": "), F.col("n").cast("string")),
        }
    )


def health_score(penalty_rows: DataFrame, windows: DataFrame, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Score and summary of every Window: 100 minus all deductions, not below 0; 100 exactly if there is no bullet.

    A Window has at most one row per penalty code, so the collected summary is bounded by the code table.
    """
    group = list(group)
    total = penalty_rows.groupBy(*group).agg(
        F.sum("deduction").alias("_sum"),
        F.sort_array(F.collect_list(F.struct("rank", "bullet"))).alias("_bullets"),
    )
    out = windows.select(*group).join(total, group, "left")
    score = F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce("_sum", F.lit(0.0)))
    summary = F.coalesce(F.transform("_bullets", lambda b: b["bullet"]), F.array().cast("array<string>"))
    return out.select(*group, score.alias("score"), summary.alias("summary"))


def unhealthy_only(report: DataFrame, missing_clocks: DataFrame | None = None, section_alerts: DataFrame | None = None, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Windows worth printing in quiet mode: any bullet, missing clock or section alert."""
    marked = report.where(F.size("summary") > 0).select(*group)
    for extra in (missing_clocks, section_alerts):
        if extra is not None:
            marked = marked.unionByName(extra.select(*group))
    return report.join(marked.distinct(), list(group), "left_semi")


def session_verdict(report: DataFrame, window: str = "window_start", by: Sequence[str] = ()) -> DataFrame:
    """A session is healthy if and only if its last Window scored 100."""
    return report.groupBy(*by).agg(
        F.max(window).alias("last_window"), (F.max_by("score", window) >= 100).alias("healthy")
    )


# Order of the protocol groups in a report.
GROUP_ORDER = [("AES67", 1), ("Dante", 2), ("NDI", 3), ("ST2110", 4), ("AVB", 5)]


def order_streams(streams: DataFrame, key: Sequence[str], family: str = "family") -> DataFrame:
    """Add `group_rank` and sort by group, then by key (one range shuffle, no single-task ranking)."""
    rank = case_of(F.col(family), GROUP_ORDER, F.lit(len(GROUP_ORDER) + 1)).cast("bigint")
    return streams.withColumn("group_rank", rank).orderBy("group_rank", *key)


def worst_streams(diagnostics: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The `n` streams with the largest total deduction (ties by key)."""
    total = diagnostics.groupBy(*key).agg(F.sum("deduction").alias("deduction"), F.count(F.lit(1)).alias("conditions"))
    return total.orderBy(F.col("deduction").desc(), *key).limit(n)


def device_list(registry: DataFrame, flagged: DataFrame, live: DataFrame, flows: DataFrame, key: str = "src_ip") -> DataFrame:
    """Devices with their state (live, flagged, verified) and number of transmitted flows."""
    mark = F.lit(True)
    out = (
        registry.join(flagged.select(key, mark.alias("_flag")).distinct(), key, "left")
        .join(live.select(key, mark.alias("_live")).distinct(), key, "left")
        .join(flows.select(key, "tx_flows"), key, "left")
    )
    state = F.when(F.col("_live"), "live").when(F.col("_flag"), "flagged").otherwise("verified")
    return out.select(
        *registry.columns, state.alias("state"), F.coalesce("tx_flows", F.lit(0).cast("bigint")).alias("tx_flows")
    )

