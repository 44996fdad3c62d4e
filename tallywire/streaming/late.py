"""Rows that arrive after their Window has closed: kept in a side table and counted, where a plain stream only drops them."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywire.functions.arith import micros, period_micros, period_start
from tallywire.operators.windows import WINDOW_SECONDS
from tallywire.streaming.windows import AVAILABLE, start_batches

#: One row per micro-batch: the watermark it leaves behind, its rows, and how many of them were late.
MARKS = "watermark_us bigint, n_rows bigint, n_late bigint"


def _marks_path(marks: str, batch_id: int) -> str:
    return f"{marks}/batch={batch_id}"


def split_late(
    stream: DataFrame,
    path: str,
    marks: str,
    checkpoint: str,
    delay: float,
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    trigger: Mapping[str, Any] = AVAILABLE,
) -> StreamingQuery:
    """Store every row of a stream under `path`, split by `late`: whether its Window had ended at the watermark before its batch.

    The watermark is the newest time of all earlier batches less `delay` seconds, as Spark's own. One pass writes both sides and observes the
    newest time and the counts; they go to `marks`. All output is kept by batch number, so a repeated batch replaces its own only. Rows without
    a time are late in no batch. An empty batch leaves the watermark as it was.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MARKS).parquet(_marks_path(marks, batch_id - 1)).first()["watermark_us"] if batch_id > 0 else None
        end = micros(period_start(ts, seconds)) + period_micros(seconds)
        late = F.coalesce(end <= F.lit(before).cast("bigint"), F.lit(False))
        seen = Observation(f"rows of batch {batch_id}")
        marked = batch.withColumn("late", late).observe(
            seen, F.max(micros(ts)).alias("newest"), F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late")
        )
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch={batch_id}")
        newest = seen.get["newest"]
        reached = [w for w in (before, None if newest is None else newest - period_micros(delay)) if w is not None]
        mark = spark.createDataFrame([(max(reached, default=None), seen.get["n_rows"], seen.get["n_late"])], MARKS)
        mark.write.mode("overwrite").parquet(_marks_path(marks, batch_id))

    return start_batches(stream, each, checkpoint, trigger=trigger)


def read_split(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """The late rows, or the others; the other side's files are not read."""
    return spark.read.parquet(path).where(F.col("late") == late).drop("late")


def late_counts(spark: SparkSession, marks: str) -> DataFrame:
    """`batch`, `watermark_us`, `n_rows` and `n_late` of every micro-batch so far."""
    return spark.read.schema(f"{MARKS}, batch int").parquet(marks)
