"""The frame table: scan in batch or as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAMES = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("frame_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("wire_len", T.IntegerType()),
        T.StructField("frame", T.BinaryType()),
    ]
)


#: Frames are stored by capture and UTC day.
_STORED = T.StructType([*FRAMES.fields, T.StructField("day", T.DateType())])


def read_frames(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 1000, days: Sequence[str] | None = None) -> DataFrame:
    """Frames stored as Parquet, best by `write_frames`. Filters and column choice reach the scan; `days` ("2024-01-01") reads the folders of
    these days only and needs frames stored by day."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if streaming else spark.read
    df = reader.schema(_STORED).parquet(path)
    if days is not None:
        df = df.where(F.col("day").isin([F.lit(d).cast("date") for d in days]))
    return df.select(*FRAMES.names)


def write_frames(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store frames by capture and UTC day, so that reading one of them prunes the others.

    The days of captures that `df` has rows of are replaced, all others stay: storing the same rows again changes nothing. `df` must hold
    whole days of its captures; `mode="append"` adds instead.
    """
    day = F.date_from_unix_date(F.floor(F.unix_micros("ts") / 86_400_000_000).cast("int"))
    rows = df.select(*FRAMES.names, day.alias("day"))
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("capture_id", "day").parquet(path)
