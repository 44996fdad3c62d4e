"""The report: one row per Window, plus its sink. Lists inside a row are bounded by code tables; streams and devices
stay in tables of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywire.streaming.windows import AVAILABLE


def window_report(
    counters: DataFrame,
    health: DataFrame,
    stream_counts: DataFrame,
    missing_clocks: DataFrame | None = None,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
) -> DataFrame:
    """Join the per-Window results: traffic, score with summary, streams per protocol, missing clocks.

    `stream_counts` has `protocol` and `streams`, `missing_clocks` has `clock` and `family`.
    """
    group = [*by, window]
    labels = stream_counts.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("protocol", "streams"))).alias("streams"), F.sum("streams").alias("n_streams")
    )
    values = [c for c in counters.columns if c not in group]
    traffic = counters.select(*group, F.struct(*values).alias("traffic"))
    out = health.join(traffic, group, "left").join(labels, group, "left")
    if missing_clocks is not None:
        gone = missing_clocks.groupBy(*group).agg(
            F.sort_array(F.collect_set(F.struct("clock", "family"))).alias("missing_clocks")
        )
        out = out.join(gone, group, "left")
    return out.withColumn("n_streams", F.coalesce("n_streams", F.lit(0).cast("bigint")))


def _by_day(report: DataFrame, window: str) -> DataFrame:
    return report.withColumn("day", F.date_from_unix_date(F.floor(F.unix_micros(window) / 86_400_000_000).cast("int")))


def write_window_report(report: DataFrame, path: str, by: Sequence[str] = ("capture_id",), mode: str = "overwrite", window: str = "window_start") -> None:
    """Store report rows as Parquet, partitioned by capture and UTC day of the Window.

    The days of captures that `report` has rows of are replaced, all others stay: a run that is repeated, after a failure or with better rules,
    leaves one row per Window. `report` must hold whole days of its captures; `mode="append"` adds instead.
    """
    rows = _by_day(report, window)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by, "day").parquet(path)


def stream_window_report(
    report: DataFrame,
    path: str,
    checkpoint: str,
    by: Sequence[str] = ("capture_id",),
    window: str = "window_start",
    trigger: Mapping[str, Any] = AVAILABLE,
) -> StreamingQuery:
    """The same folders for a stream of closed Windows; its checkpoint keeps a repeated batch from adding rows twice."""
    return (
        _by_day(report, window)
        .writeStream.outputMode("append")
        .partitionBy(*by, "day")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )
