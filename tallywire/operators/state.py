"""State over time in batch form: clocks, entities, memberships, registries, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import micros, period_micros
from tallywire.operators.chunks import with_previous, with_running_sum
from tallywire.operators.windows import WINDOW_SECONDS, with_until


def _length(seconds: float) -> Column:
    return F.lit(period_micros(seconds)).cast("bigint")


def clock_sessions(
    ptp: DataFrame,
    key: Sequence[str] = ("domain", "version"),
    ts: str = "ts",
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    timeout: float = 5,
    until: Column | DataFrame | None = None,
    refresh: Column | None = None,
) -> DataFrame:
    """Per clock domain and active Window: the session number and, on its last Window, when the clock is lost.

    Loss is judged at Window ends only: the first end more than `timeout` seconds after the last message. Messages
    of any type keep a clock alive (`refresh` narrows that). Works on one row per domain and Window.
    """
    alive = F.lit(True) if refresh is None else refresh
    per = ptp.groupBy(*key, window).agg(F.max(F.when(alive, micros(ts))).alias("_us"))
    w = Window.partitionBy(*key).orderBy(window)
    seen = F.last("_us", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("_us", seen)
    per = per.select("*", F.lag("_us").over(w).alias("_before"), F.lead(micros(window)).over(w).alias("_next"))
    broke = F.col("_before").isNull() | (micros(window) - F.col("_before") > _length(timeout))
    per = per.withColumn("session", F.sum(broke.cast("bigint")).over(w))
    due = F.col("_us") + _length(timeout)
    lost_at = due - F.pmod(due, _length(seconds)) + _length(seconds)  # first end strictly after the limit
    per = with_until(per, until)
    last_end = F.coalesce(F.col("_next"), F.col("_until") + _length(seconds))
    return per.select(
        *key,
        window,
        "session",
        F.when(lost_at <= last_end, F.timestamp_micros(lost_at)).alias("lost_at"),
    )


def clock_state(
    ptp: DataFrame,
    key: Sequence[str] = ("domain", "version"),
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    gm: str = "grandmaster_id",
    window: str = "window_start",
    chunk: Sequence[str] = ("window_start",),
    seconds: float = WINDOW_SECONDS,
    timeout: float = 5,
    until: Column | DataFrame | None = None,
) -> DataFrame:
    """Clock events per domain: detected, changed (with the clock before) and lost.

    A lost clock forgets its grandmaster, so the next one is detected again.
    """
    key = list(key)
    sessions = clock_sessions(ptp, key, ts, window, seconds, timeout, until)
    named = ptp.where(F.col(gm).isNotNull()).join(sessions.drop("lost_at"), [*key, window])
    named = named.select(*key, "session", *dict.fromkeys([*chunk, *order, ts]), F.col(gm).alias("gm"))
    steps = with_previous(named, [*key, "session"], order, chunk, {"from_gm": "gm"})
    kind = F.when(F.col("from_gm").isNull(), "detected").when(F.col("from_gm") != F.col("gm"), "changed")
    changes = steps.select(*key, "session", F.col(ts).alias("ts"), kind.alias("event"), "gm", "from_gm")
    valid = named.select(*key, "session").distinct()
    lost = sessions.where(F.col("lost_at").isNotNull()).join(valid, [*key, "session"], "left_semi")
    lost = lost.select(*key, "session", F.col("lost_at").alias("ts"), F.lit("lost").alias("event"))
    return changes.where(F.col("event").isNotNull()).unionByName(lost, allowMissingColumns=True)


def path_delay(
    ptp: DataFrame,
    changed: Column,
    key: Sequence[str] = ("domain", "version"),
    order: Sequence[str] = ("ts", "frame_no"),
    chunk: Sequence[str] = ("window_start",),
    delay: str = "path_delay_ns",
    unstable_ns: int = 10_000,
    far_ns: int = 1_000_000,
    hop_ns: int = 5_000,
) -> DataFrame:
    """Smallest and largest absolute path delay per epoch between grandmaster changes, and what they suggest."""
    rows = ptp.select(
        *dict.fromkeys([*key, *chunk, *order]), F.abs(delay).alias("_d"), F.coalesce(changed, F.lit(False)).cast("int").alias("_c")
    )
    rows = with_running_sum(rows, key, order, chunk, {"epoch": "_c"})
    out = rows.where(F.col("_d").isNotNull()).groupBy(*key, "epoch").agg(
        F.min("_d").alias("min_ns"), F.max("_d").alias("max_ns"), F.count(F.lit(1)).alias("samples")
    )
    return out.withColumns(
        {
            "unstable": F.col("max_ns") - F.col("min_ns") > unstable_ns,
            "too_many_hops": F.col("max_ns") > far_ns,
            "hops": F.floor(F.col("min_ns") / hop_ns).cast("bigint"),
        }
    )


def clock_status(
    ptp: DataFrame,
    sessions: DataFrame,
    key: Sequence[str] = ("domain", "version"),
    order: Sequence[str] = ("ts", "frame_no"),
    window: str = "window_start",
) -> DataFrame:
    """One row per domain at the end of the data: valid, lost, sync without a grandmaster, peer delay only, none."""
    key = list(key)
    at = F.struct(*order)
    per = ptp.groupBy(*key).agg(
        F.count(F.lit(1)).alias("packets"),
        F.bool_or(F.col("message_type") == 0).alias("seen_sync"),
        F.max_by("clock_id", F.when(F.col("clock_id").isNotNull(), at)).alias("clock_id"),
        F.max_by("grandmaster_id", F.when(F.col("grandmaster_id").isNotNull(), at)).alias("grandmaster_id"),
        F.max(F.when(F.col("grandmaster_id").isNotNull(), F.col(window))).alias("_gm_window"),
        F.max_by("correction_ns", F.when(F.col("message_type").isin(0, 8), at)).alias("correction_ns"),
    )
    last = sessions.groupBy(*key).agg(
        F.max_by("session", window).alias("_session"), F.max_by("lost_at", window).alias("_lost_at")
    )
    at_gm = sessions.select(*key, F.col(window).alias("_gm_window"), F.col("session").alias("_gm_session"))
    out = per.join(last, key).join(at_gm, [*key, "_gm_window"], "left")
    named = F.col("_gm_session").isNotNull()
    current = named & (F.col("_gm_session") == F.col("_session")) & F.col("_lost_at").isNull()
    status = (
        F.when(current, "valid")
        .when(named, "lost")
        .when(F.col("clock_id").isNull(), "no_clock")
        .when(F.col("seen_sync"), "sync_only")
        .otherwise("peer_delay_only")
    )
    return out.select(
        *key,
        "packets",
        status.alias("status"),
        "clock_id",
        F.when(current, F.col("grandmaster_id")).alias("grandmaster_id"),
        "correction_ns",
        F.coalesce(F.abs("correction_ns") > 1000, F.lit(False)).alias("large_correction"),
    )


def _expiry(valid_secs: Column) -> Column:
    return F.greatest(valid_secs, F.lit(10)) + 10


def entity_events(
    adp: DataFrame,
    key: str = "entity_id",
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    window: str = "window_start",
    chunk: Sequence[str] = ("window_start",),
    unit: float = 1,
) -> DataFrame:
    """New, changed and departed entities. An entity not renewed within its valid time is new when it returns.

    Expiry is checked at Window ends. Discover messages (type 2) are ignored. `unit` scales seconds.
    """
    rows = adp.where(F.col("message_type") != 2).select(
        *dict.fromkeys([key, *chunk, window, *order, ts]), "message_type", "available_index", "valid_time_secs"
    )
    prev = {"_pt": ts, "_pm": "message_type", "_pi": "available_index", "_pv": "valid_time_secs"}
    rows = with_previous(rows, [key], order, chunk, prev)
    age = F.floor((micros(window) - micros("_pt")) / F.lit(period_micros(unit)))
    alive = F.coalesce((F.col("_pm") != 1) & (age < _expiry(F.col("_pv"))), F.lit(False))
    event = (
        F.when((F.col("message_type") == 1) & alive, "departed")
        .when(F.col("message_type") == 1, None)
        .when(~alive, "new")
        .when(F.col("available_index") != F.col("_pi"), "changed")
    )
    return rows.withColumn("event", event).where(F.col("event").isNotNull()).select(
        key, *dict.fromkeys([*order, ts]), "event", "available_index"
    )


def entity_registry(
    adp: DataFrame, as_of: Column, key: str = "entity_id", order: Sequence[str] = ("ts", "frame_no"), ts: str = "ts", unit: float = 1
) -> DataFrame:
    """Entities present at `as_of`: last message not a departure and not older than its valid time allows."""
    rows = adp.where(F.col("message_type") != 2)
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")
    age = F.floor((micros(as_of) - micros(ts)) / F.lit(period_micros(unit)))
    return last.where((F.col("message_type") != 1) & (age < _expiry(F.col("valid_time_secs"))))


def rearm_dedup(
    df: DataFrame,
    key: Sequence[str] = ("src_ip", "group_ip"),
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    kind: str = "kind",
    joined: str = "join",
    left: str = "leave",
    window: str = "window_start",
    chunk: Sequence[str] = ("window_start",),
    ttl: float = 300,
) -> DataFrame:
    """Joins worth an alert: the first of a member, one after a leave, or one after `ttl` seconds without renewal.

    The time limit is checked at Window ends.
    """
    rows = df.where(F.col(kind).isin(joined, left)).select(*dict.fromkeys([*key, *chunk, window, *order, ts, kind]))
    rows = with_previous(rows, key, order, chunk, {"_pk": kind, "_pt": ts})
    expired = micros(window) - micros("_pt") >= _length(ttl)
    fresh = F.col("_pt").isNull() | (F.col("_pk") == left) | expired
    return rows.where((F.col(kind) == joined) & fresh).drop("_pk", "_pt")


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str] = ("ts", "frame_no"), fields: Sequence[str] = ()) -> DataFrame:
    """First row of every key: its time and the given fields."""
    cols = list(dict.fromkeys([*order, *fields]))
    return df.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f")).select(*key, "_f.*")


def dependent_reset(
    entries: DataFrame, windows: DataFrame, empty: Column, key: Sequence[str], by: Sequence[str] = ("capture_id",), window: str = "window_start", ts: str = "ts"
) -> DataFrame:
    """First sighting of a key in every segment of a registry that is cleared at the end of each `empty` Window.

    `windows` has one row per Window.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.coalesce(F.sum(F.coalesce(empty, F.lit(False)).cast("bigint")).over(w), F.lit(0))
    segments = windows.select(*by, window, cleared.alias("segment"))
    return entries.join(segments, [*by, window]).groupBy(*by, "segment", *key).agg(F.min(ts).alias("first_seen"))


# Fixed order in which the checks of one Window report.
ALERT_ORDER = [
    "clock_lost",
    "clock_dropout",
    "stream_spike",
    "slow_queries",
    "multiple_queriers",
    "version_mismatch",
    "filtered_multicast",
    "high_multicast",
    "ptp_blocked",
    "refclk_mismatch",
    "ip_config",
    "bridged_network",
    "followers_missing",
    "sync_conflict",
]


def alerts(*checks: DataFrame) -> DataFrame:
    """Union of check results with the columns window_start, level, code, subject, in report order."""
    out = checks[0]
    for other in checks[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    rank = F.array_position(F.array(*[F.lit(c) for c in ALERT_ORDER]), F.col("code"))
    return out.withColumn("rank", F.when(rank > 0, rank).otherwise(len(ALERT_ORDER) + 1).cast("bigint"))
