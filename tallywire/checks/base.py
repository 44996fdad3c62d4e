"""Registry of the checks and the stand-in inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.functions.arith import block, period_start

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR = 3600
DAY = 24 * HOUR
BLOCK = 1 << 20


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under `name`, with the SQL text it is compared to."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(name: str):
    """A timestamp without a zone read as UTC, whatever the session's zone is."""
    return F.timestamp_micros(
        F.datediff(F.to_date(name), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
        + F.hour(name).cast("bigint") * 3_600_000_000
        + F.minute(name).cast("bigint") * 60_000_000
        + (F.date_part(F.lit("SECONDS"), F.col(name)) * 1_000_000).cast("bigint")
    )


def events(spark: SparkSession, sf_dir: str, seconds: int = HOUR) -> DataFrame:
    """Events as a packet stream: `ts` as a TIMESTAMP, its Window, and the block that bounds a chunk."""
    df = table(spark, sf_dir, "events").withColumn("ts", utc("ts"))
    return df.withColumns({"window_start": period_start("ts", seconds), "block": block("event_id", BLOCK)})


ORDER = ["ts", "event_id"]
CHUNK = ["window_start", "block"]


def us(name: str, alias: str | None = None):
    """A timestamp column as epoch microseconds, the form both sides compare."""
    return F.unix_micros(name).alias(alias or name)
