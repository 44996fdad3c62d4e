"""Aggregates and checks per reporting Window.

Everything after the first aggregation works on one row per Window (per key), never on packets again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import MICROS, micros, period_micros, plus_seconds
from tallywire.operators.chunks import with_previous

WINDOW_SECONDS = 5


def count_true(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))


def window_end(window: str, seconds: float) -> Column:
    return plus_seconds(window, seconds)


def densify(windows: DataFrame, by: Sequence[str], window: str = "window_start", seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Every Window between the first and the last of a group, with the given rows joined on."""
    by = list(by)
    step = F.expr(f"INTERVAL '{period_micros(seconds) / MICROS}' SECOND")
    span = windows.groupBy(*by).agg(F.min(window).alias("_lo"), F.max(window).alias("_hi"))
    grid = span.select(*by, F.explode(F.sequence("_lo", "_hi", step)).alias(window))
    return grid.join(windows, [*by, window], "left")


def window_counters(
    df: DataFrame,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    size: str = "frame_bytes",
    multicast: Column | None = None,
    ecn: str = "ecn",
    retransmission: Column | None = None,
    kind: str = "kind",
    dispatched: Column | None = None,
) -> DataFrame:
    """Packets and bytes per Window, split by multicast, with congestion, retransmission and pause counts."""
    mc = F.coalesce(F.col("is_multicast") if multicast is None else multicast, F.lit(False))
    size_col = F.col(size).cast("bigint")
    retx = F.lit(False) if retransmission is None else retransmission
    sent = F.col("protocol").isNotNull() if dispatched is None else dispatched
    zero = F.lit(0).cast("bigint")
    return df.groupBy(*by, window).agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(size_col).alias("bytes"),
        count_true(mc).alias("multicast_packets"),
        F.sum(F.when(mc, size_col).otherwise(zero)).alias("multicast_bytes"),
        count_true(~mc).alias("unicast_packets"),
        F.sum(F.when(mc, zero).otherwise(size_col)).alias("unicast_bytes"),
        count_true(F.col(ecn) == 3).alias("ecn_marks"),
        count_true(retx).alias("retransmissions"),
        count_true(F.col(kind) == "pause").alias("pause_frames"),
        count_true(F.col(kind) == "pfc").alias("pfc_frames"),
        count_true(sent).alias("dispatched"),
    )


def bandwidth(
    counters: DataFrame,
    queries: DataFrame,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    limit_mbps: float = 80.0,
) -> DataFrame:
    """Mbit/s of each Window and the warning for high multicast while no general query was ever seen.

    `queries` holds the general queries with their Window.
    """
    by = list(by)
    first = queries.groupBy(*by).agg(F.min(window).alias("_first_query"))
    per = F.lit(float(seconds)) * 1e6
    out = counters.join(first, by, "left").withColumns(
        {"mbps": F.col("bytes") * 8 / per, "multicast_mbps": F.col("multicast_bytes") * 8 / per}
    )
    never = F.col("_first_query").isNull() | (F.col("_first_query") > F.col(window))
    return out.withColumn("high_multicast", (F.col("multicast_mbps") > limit_mbps) & never).drop("_first_query")


def distinct_per_group(df: DataFrame, group: Sequence[str], key: Sequence[str], name: str = "streams") -> DataFrame:
    """Number of distinct keys per group; duplicates are removed before anything is grouped by the coarse key."""
    cols = list(dict.fromkeys([*group, *key]))
    return df.select(*cols).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(name))


def spike(
    counts: DataFrame,
    value: str = "streams",
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    n: int = 3,
    factor: int = 2,
) -> DataFrame:
    """Windows whose count exceeds `factor` times the whole-number mean of exactly `n` earlier Windows.

    `counts` must hold every Window (see `densify`), with 0 where nothing was seen.
    """
    w = Window.partitionBy(*by).orderBy(window).rowsBetween(-n, -1)
    out = counts.withColumns({"_n": F.count(F.lit(1)).over(w), "_sum": F.sum(value).over(w)})
    mean = F.when(F.col("_n") == n, F.floor(F.col("_sum") / n).cast("bigint"))
    out = out.withColumn("trailing_mean", mean)
    hit = (F.col("trailing_mean") > 0) & (F.col(value) > F.col("trailing_mean") * factor)
    return out.withColumn("spike", F.coalesce(hit, F.lit(False))).drop("_n", "_sum")


def consecutive_true(
    windows: DataFrame, condition: Column, n: int, by: Sequence[str] = ("capture_id",), window: str = "window_start"
) -> DataFrame:
    """Add `run`, the number of Windows in a row on which the condition holds, and `held` for run >= n."""
    w = Window.partitionBy(*by).orderBy(window)
    ok = F.coalesce(condition, F.lit(False))
    out = windows.withColumns({"_ok": ok, "_rn": F.row_number().over(w)})
    since = F.max(F.when(~F.col("_ok"), F.col("_rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.when(F.col("_ok"), F.col("_rn") - F.coalesce(since, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return out.withColumn("run", run).withColumn("held", F.col("run") >= n).drop("_ok", "_rn")


def unverified_spans(
    sources: DataFrame,
    evidence: DataFrame,
    last_window: Column,
    key: str = "src_ip",
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    hold: float = 60,
    n: int = 3,
) -> DataFrame:
    """Spans of Windows at whose end a known source had gone `n` Windows in a row without evidence.

    `sources` are sightings `(key, ts)`, `evidence` liveness or stream rows `(key, ts)`; evidence counts for `hold`
    seconds. Returns `(key, from_end, to_end)`: Window ends, inclusive. Spans instead of one row per Window keep
    the result as small as the number of silences. `last_window` is the start of the capture's last Window, for
    example a scalar subquery.
    """
    length = F.lit(period_micros(seconds)).cast("bigint")

    def end_of(us: Column) -> Column:
        return us - F.pmod(us, length) + length

    def close_at_or_after(us: Column) -> Column:
        return us + F.pmod(-us, length)

    seen = sources.groupBy(key).agg(F.min(micros(ts)).alias("_us"))
    starts = seen.select(key, F.col("_us"), end_of(F.col("_us")).alias("_dead"))
    known = seen.select(key, F.col("_us").alias("_since"))
    live = evidence.select(key, micros(ts).alias("_us")).groupBy(key, end_of(F.col("_us")).alias("_end")).agg(
        F.max("_us").alias("_us")
    )
    # Evidence that no longer counts at its own Window end never interrupts a silence.
    live = live.where(F.col("_end") - F.col("_us") < F.lit(period_micros(hold)).cast("bigint")).join(known, key)
    gone = F.greatest(close_at_or_after(F.col("_us") + F.lit(period_micros(hold)).cast("bigint")), end_of(F.col("_since")))
    marks = live.select(key, F.col("_end").alias("_at"), gone.alias("_dead")).unionByName(
        starts.select(key, F.lit(-1).cast("bigint").alias("_at"), "_dead")
    )
    w = Window.partitionBy(key).orderBy("_at")
    spans = marks.select(key, "_dead", F.lead("_at").over(w).alias("_next"))
    final = micros(last_window) + length
    first_flag = F.col("_dead") + length * F.lit(n - 1)
    until = F.coalesce(F.col("_next") - length, final)
    spans = spans.select(key, first_flag.alias("_from"), F.least(until, final).alias("_to"))
    return spans.where(F.col("_from") <= F.col("_to")).select(
        key, F.timestamp_micros("_from").alias("from_end"), F.timestamp_micros("_to").alias("to_end")
    )


def conflicting_senders(
    queries: DataFrame,
    active: DataFrame,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    sender: str = "src_ip",
) -> DataFrame:
    """One row per querier of every Window with two or more distinct queriers and active multicast."""
    group = [*by, window]
    pairs = queries.select(*group, sender).distinct()
    many = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("senders")).where(F.col("senders") >= 2)
    many = many.join(active.select(*group).distinct(), group, "left_semi")
    return pairs.join(many, group)


def sync_conflict(
    syncs: DataFrame,
    group: Sequence[str] = ("domain", "window_start"),
    sender: str = "src_ip",
    stratum: str = "stratum",
    order: Sequence[str] = ("ts", "frame_no"),
) -> DataFrame:
    """Clock domains with two or more Sync senders in a Window; an error if two of them claim stratum 0.

    The last stratum of a sender counts; an unknown one reads as 255.
    """
    last = syncs.groupBy(*group, sender).agg(
        F.max_by(F.coalesce(F.col(stratum), F.lit(255)), F.struct(*order)).alias("_stratum")
    )
    out = last.groupBy(*group).agg(
        F.count(F.lit(1)).alias("senders"), count_true(F.col("_stratum") == 0).alias("preferred")
    )
    return out.where(F.col("senders") >= 2).withColumn(
        "level", F.when(F.col("preferred") >= 2, "error").otherwise("warn")
    )


def querier_state(
    queries: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = ("capture_id",),
    ts: str = "ts",
    order: Sequence[str] = ("ts", "frame_no"),
    window: str = "window_start",
    chunk: Sequence[str] = ("window_start",),
    seconds: float = WINDOW_SECONDS,
    advisory: int = 60,
    slack: int = 10,
    default_silence: int = 260,
) -> DataFrame:
    """Querier interval and silence at the end of every Window.

    `queries` are general queries, `windows` one row per Window with a boolean `active_multicast`. The interval is
    the whole seconds between the two latest queries; the querier is absent when never seen or silent for more
    than twice the interval plus `slack` (or `default_silence` while the interval is unknown).
    """
    by = list(by)
    step = with_previous(queries.select(*dict.fromkeys([*by, *chunk, window, *order, ts])), by, order, chunk, {"_prev": ts})
    step = step.withColumn("_interval", F.floor((micros(ts) - micros("_prev")) / MICROS).cast("bigint"))
    per = step.groupBy(*by, window).agg(
        F.max(ts).alias("_last"), F.max_by("_interval", F.struct(*order)).alias("_interval")
    )
    w = Window.partitionBy(*by).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    out = windows.join(per, [*by, window], "left").withColumns(
        {
            "last_query": F.last("_last", ignorenulls=True).over(w),
            "interval_secs": F.last("_interval", ignorenulls=True).over(w),
        }
    )
    silent = F.floor((micros(window_end(window, seconds)) - micros("last_query")) / MICROS)
    limit = F.coalesce(F.col("interval_secs") * 2 + slack, F.lit(default_silence))
    absent = F.col("last_query").isNull() | (silent > limit)
    return out.withColumns(
        {
            "slow_queries": F.coalesce(F.col("interval_secs") > advisory, F.lit(False)),
            "querier_absent": absent,
            "penalised": absent & F.col("active_multicast"),
        }
    ).drop("_last", "_interval")


def version_mismatch(
    queries: DataFrame,
    reports: DataFrame,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    version: str = "version",
    order: Sequence[str] = ("ts", "frame_no"),
) -> DataFrame:
    """Windows with a version 3 report while the last querier seen so far speaks version 2."""
    by = list(by)
    seen = queries.groupBy(*by, window).agg(F.max_by(version, F.struct(*order)).alias("_version"))
    v3 = reports.select(*by, window).distinct().withColumn("_v3", F.lit(True))
    w = Window.partitionBy(*by).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    both = seen.join(v3, [*by, window], "full")
    both = both.withColumn("querier_version", F.last("_version", ignorenulls=True).over(w))
    return both.where(F.col("_v3") & (F.col("querier_version") == 2)).select(*by, window, "querier_version")


def missing_evidence(
    windows: DataFrame,
    devices: Column,
    evidence: Sequence[Column],
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
) -> DataFrame:
    """Windows by which devices are known but none of the evidence flags was ever true."""
    w = Window.partitionBy(*by).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)

    def ever(flag: Column) -> Column:
        return F.coalesce(F.max(flag).over(w), F.lit(False))

    seen = F.lit(False)
    for flag in evidence:
        seen = seen | ever(flag)
    return windows.withColumns({"_known": ever(devices), "_seen": seen}).where(
        F.col("_known") & ~F.col("_seen")
    ).drop("_known", "_seen")


def qos_status(streams: DataFrame, group: Sequence[str], violations: str = "dscp_viol") -> DataFrame:
    """Per Window: how many streams carry wrong marks, as a number and as a state."""
    out = streams.groupBy(*group).agg(F.count(F.lit(1)).alias("streams"), count_true(F.col(violations) > 0).alias("bad"))
    return out.withColumn("qos", F.when(F.col("streams") == 0, "none").when(F.col("bad") == 0, "ok").otherwise("violations"))


def with_until(df: DataFrame, until: Column | DataFrame | None, name: str = "_until") -> DataFrame:
    """Add the start of the last Window in microseconds: one for all rows, or one per capture from a table with the key columns and
    `until`."""
    if isinstance(until, DataFrame):
        keys = [c for c in until.columns if c != "until"]
        return df.join(until.select(*keys, micros("until").alias(name)), keys, "left")
    return df.withColumn(name, micros(until) if until is not None else F.lit(None).cast("bigint"))


def silence_states(
    active: DataFrame,
    key: Sequence[str],
    window: str = "window_start",
    last_ts: str = "last_ts",
    seconds: float = WINDOW_SECONDS,
    dead: float = 10,
    prune: float = 20,
    until: Column | DataFrame | None = None,
) -> DataFrame:
    """State of every key at each Window end from its first row until it is pruned.

    `active` has one row per key and Window with rows, holding the last arrival. Silent Windows are generated per
    key only up to the prune limit, so there is no product of keys and Windows. `until` is the last Window's start,
    or a table with that start by capture (see `with_until`).
    A key is dead after more than `dead` seconds of silence and pruned at `prune` whole seconds; `session` numbers
    the lives between prunes.
    """
    length = F.lit(period_micros(seconds)).cast("bigint")
    w = Window.partitionBy(*key).orderBy(window)
    rows = with_until(active, until).select(
        *key,
        "_until",
        F.col(window),
        micros(window).alias("_w"),
        micros(last_ts).alias("_us"),
        F.lead(micros(window)).over(w).alias("_next"),
        F.lag(micros(last_ts)).over(w).alias("_before"),
    )
    # Pruned when the close right before this Window (its start) is `prune` whole seconds after the row before.
    restart = F.col("_before").isNull() | (F.floor((F.col("_w") - F.col("_before")) / MICROS) >= prune)
    rows = rows.withColumn("session", F.sum(restart.cast("bigint")).over(w))
    past = F.pmod(F.col("_us") + F.lit(period_micros(prune)).cast("bigint"), length)
    gone = F.col("_us") + F.lit(period_micros(prune)).cast("bigint")
    prune_end = F.when(past == 0, gone).otherwise(gone - past + length)  # first close at or after the limit
    final = F.coalesce(F.col("_next") - length, F.col("_until"), F.col("_w"))
    last = F.greatest(F.least(prune_end - length, final), F.col("_w"))
    ends = F.explode(F.sequence(F.col("_w"), last, length)).alias("_at")
    out = rows.select(*key, "session", "_us", ends)
    silent = F.col("_at") + length - F.col("_us")
    state = (
        F.when(F.floor(silent / MICROS) >= prune, "pruned")
        .when(silent > F.lit(period_micros(dead)).cast("bigint"), "dead")
        .otherwise("live")
    )
    return out.select(
        *key,
        F.timestamp_micros("_at").alias(window),
        "session",
        F.timestamp_micros("_us").alias(last_ts),
        state.alias("state"),
    )


def per_window_last(df: DataFrame, key: Sequence[str], ts: str = "ts", window: str = "window_start") -> DataFrame:
    """One row per key and Window: rows and last arrival (the input of `silence_states`)."""
    return df.groupBy(*key, window).agg(F.count(F.lit(1)).alias("packets"), F.max(ts).alias("last_ts"))
