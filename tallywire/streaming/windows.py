"""Streaming forms that Structured Streaming expresses directly, and the close of a Window.

Late rows: a row older than the watermark is dropped and shows up in `numRowsDroppedByWatermark`; within the watermark
the order of arrival does not matter for these operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywire.operators.windows import WINDOW_SECONDS, window_counters
from tallywire.plans.scoring import Limits, health_score, penalties, stream_diagnostics


def with_window(stream: DataFrame, watermark: str, ts: str = "ts", seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Set the watermark and add the Window of each row as `window`."""
    length = f"{int(round(seconds * 1000))} milliseconds"
    return stream.withWatermark(ts, watermark).withColumn("window", F.window(ts, length))


def stream_window_counters(
    stream: DataFrame, watermark: str, by: Sequence[str] = ("capture_id",), ts: str = "ts", seconds: float = WINDOW_SECONDS, **columns: Column
) -> DataFrame:
    """The per-Window counters; every Window is emitted once, when the watermark has passed its end."""
    out = window_counters(with_window(stream, watermark, ts, seconds), by, "window", **columns)
    return out.withColumn("window_start", F.col("window.start")).drop("window")


def stream_window_totals(
    stream: DataFrame, watermark: str, key: Sequence[str], totals: dict[str, Column], ts: str = "ts", seconds: float = WINDOW_SECONDS
) -> DataFrame:
    """Aggregates per key and closed Window, with the last arrival as `last_ts`."""
    out = with_window(stream, watermark, ts, seconds).groupBy(*key, "window").agg(
        F.max(ts).alias("last_ts"), *[c.alias(n) for n, c in totals.items()]
    )
    return out.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})


def stream_first_seen(stream: DataFrame, key: Sequence[str], watermark: str, ts: str = "ts") -> DataFrame:
    """First row of a key; repeats within the watermark are dropped, and so is their state afterwards."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(list(key))


#: The trigger of all streams unless told otherwise: everything that is there, then stop.
AVAILABLE: Mapping[str, Any] = {"availableNow": True}


def start(df: DataFrame, path: str, checkpoint: str, output: str = "append", trigger: Mapping[str, Any] = AVAILABLE) -> StreamingQuery:
    """Write a stream to Parquet; `trigger` as of `DataStreamWriter.trigger`, for example {"processingTime": "5 seconds"} to go on for ever."""
    return (
        df.writeStream.outputMode(output)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(path)
    )


def start_batches(
    df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, output: str = "append", trigger: Mapping[str, Any] = AVAILABLE
) -> StreamingQuery:
    """Run `each` on every micro-batch."""
    return (
        df.writeStream.outputMode(output)
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Store the result of a micro-batch under its number: repeating a batch replaces its own output only."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def close_windows(
    closed: DataFrame,
    path: str,
    checkpoint: str,
    key: Sequence[str],
    limits: Limits = Limits(),
    group: Sequence[str] = ("window_start",),
    trigger: Mapping[str, Any] = AVAILABLE,
) -> StreamingQuery:
    """Score Windows as they close.

    `closed` are stream rows per key and Window in append mode: all keys of a Window arrive in the batch in which the
    watermark passes its end. Every check reads those rows, so nothing has to be reset in a given order.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        found = stream_diagnostics(batch, [*group, *key], limits)
        windows = batch.select(*group).distinct()
        write_batch(health_score(penalties(found, None, group), windows, group), path, batch_id)

    return start_batches(closed, each, checkpoint, trigger=trigger)
