"""Checks of what arrives when: late rows, announcements between batches, a report that is written twice.

The events are dealt to three arrivals by day, a fifth of them one arrival late, and a stream is run after each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywire.checks.base import DAY, HOUR, check, table, us, utc
from tallywire.checks.streams import run_folder
from tallywire.functions.arith import MICROS, period_start, plus_seconds
from tallywire.operators.windows import window_counters
from tallywire.plans.report import write_window_report
from tallywire.streaming.late import late_counts, read_split, split_late
from tallywire.streaming.live import enrich_windows
from tallywire.streaming.timers import ROCKSDB
from tallywire.streaming.windows import start

ARRIVALS = 3
DAY_US = DAY * MICROS

THIRD_SQL = f"""d AS (SELECT *, epoch_us(ts) AS t, epoch_us(ts) // {DAY_US} AS day FROM events),
ends AS (SELECT min(day) AS first, max(day) AS last FROM d),
dealt AS (SELECT d.*, (day - first) * {ARRIVALS} // (last - first + 1) AS third FROM d, ends),
arrived AS (SELECT *, least({ARRIVALS - 1}, third + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS arrival FROM dealt)"""


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").withColumn("ts", utc("ts")).withColumn("day", F.floor(F.unix_micros("ts") / DAY_US))
    first, last = df.select(F.min("day")).scalar(), df.select(F.max("day")).scalar()
    df = df.withColumn("third", F.floor((F.col("day") - first) * ARRIVALS / (last - first + 1)))
    return df.withColumn("arrival", F.least(F.lit(ARRIVALS - 1), F.col("third") + (F.col("event_id") % 5 == 0).cast("int")))


def arrive(df: DataFrame, number: int, path: str) -> None:
    """Add the rows of one arrival to the files a stream reads."""
    df.where(F.col("arrival") == number).drop("arrival").write.mode("append").parquet(path)


@check(
    "stream_late_rows",
    f"""
WITH {THIRD_SQL},
tops AS (SELECT arrival, max(t) AS top FROM arrived GROUP BY 1),
marks AS (SELECT a.arrival, max(b.top) - {2 * DAY_US} AS mark FROM tops a LEFT JOIN tops b ON b.arrival < a.arrival GROUP BY 1),
judged AS (SELECT r.*, coalesce((r.day + 1) * {DAY_US} <= m.mark, false) AS late FROM arrived r JOIN marks m USING (arrival)),
counted AS (SELECT arrival, count(*) AS n_rows, sum(CASE WHEN late THEN 1 ELSE 0 END) AS n_late FROM judged GROUP BY 1)
SELECT CAST(arrival AS BIGINT) AS arrival, CAST(day * {DAY_US} AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS late_rows, CAST(sum(event_id) AS BIGINT) AS id_sum,
  CAST(any_value(n_late) AS BIGINT) AS batch_late, CAST(any_value(n_rows) AS BIGINT) AS batch_rows
FROM judged JOIN counted USING (arrival) WHERE late GROUP BY 1, 2""",
)
def _stream_late_rows(spark, sf_dir):
    folder = run_folder(spark)
    rows = dealt_events(spark, sf_dir)
    for number in range(ARRIVALS):
        arrive(rows, number, f"{folder}/in")
        stream = spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{folder}/in")
        split_late(stream, f"{folder}/out", f"{folder}/marks", f"{folder}/ck", 2 * DAY, seconds=DAY).awaitTermination()
    late = read_split(spark, f"{folder}/out", True).withColumn("window_start", period_start("ts", DAY))
    found = late.groupBy("batch", "window_start").agg(F.count("*").alias("late_rows"), F.sum("event_id").alias("id_sum"))
    return found.join(late_counts(spark, f"{folder}/marks"), "batch").select(
        F.col("batch").cast("bigint").alias("arrival"),
        us("window_start"),
        "late_rows",
        "id_sum",
        F.col("n_late").alias("batch_late"),
        F.col("n_rows").alias("batch_rows"),
    )


# Purchases are announcements, a fifth of which come one arrival late; a user's days are the Windows they hold for.
@check(
    "stream_enrich",
    f"""
WITH {THIRD_SQL},
w AS (SELECT user_id, day, third, count(*) AS n FROM arrived GROUP BY 1, 2, 3),
a AS (SELECT * FROM arrived WHERE event_type = 'purchase'),
j AS (SELECT w.user_id, w.day, w.n, arg_max(a.event_id, struct_pack(t := a.t, e := a.event_id)) AS announced_id,
        arg_max(a.value, struct_pack(t := a.t, e := a.event_id)) AS announced_value
      FROM w LEFT JOIN a ON a.user_id = w.user_id AND a.t < (w.day + 1) * {DAY_US} AND a.arrival <= w.third GROUP BY 1, 2, 3)
SELECT user_id, CAST(day * {DAY_US} AS BIGINT) AS window_start, CAST(n AS BIGINT) AS n, CAST(announced_id AS BIGINT) AS announced_id,
  CAST(announced_value AS DOUBLE) AS announced_value FROM j""",
)
def _stream_enrich(spark, sf_dir):
    folder = run_folder(spark)
    rows = dealt_events(spark, sf_dir)
    begin = period_start("ts", DAY).alias("window_start")
    windows = rows.groupBy("user_id", begin, F.col("third").alias("arrival")).agg(F.count("*").alias("n"))
    windows = windows.withColumn("window_end", plus_seconds("window_start", DAY))
    said = rows.where("event_type = 'purchase'").select(
        "user_id", "ts", F.col("event_id").alias("announced_id"), F.col("value").cast("double").alias("announced_value"), "arrival"
    )
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    for number in range(ARRIVALS):
        arrive(windows, number, f"{folder}/windows")
        arrive(said, number, f"{folder}/said")
        read = spark.readStream
        asked = read.schema(windows.drop("arrival").schema).parquet(f"{folder}/windows")
        out = enrich_windows(
            asked, read.schema(said.drop("arrival").schema).parquet(f"{folder}/said"), ["user_id"], ["announced_id", "announced_value"], no="announced_id"
        )
        spark.conf.set(name, ROCKSDB)  # read when the stream starts; the caller's session stays as it was
        try:
            start(out, f"{folder}/out", f"{folder}/ck").awaitTermination()
        finally:
            spark.conf.set(name, before)
    return spark.read.parquet(f"{folder}/out").select("user_id", us("window_start"), "n", "announced_id", "announced_value")


@check(
    "report_rerun",
    """SELECT event_type AS capture_id, CAST(epoch_us(ts) // 3600000000 * 3600000000 AS BIGINT) AS window_start, CAST(count(*) AS BIGINT) AS packets,
  CAST(sum(event_id % 1500 + 64) AS BIGINT) AS bytes FROM events GROUP BY 1, 2""",
)
def _report_rerun(spark, sf_dir):
    folder = f"{run_folder(spark)}/report"
    rows = table(spark, sf_dir, "events").withColumn("ts", utc("ts")).withColumn("window_start", period_start("ts", HOUR))
    rows = rows.select(
        F.col("event_type").alias("capture_id"),
        "window_start",
        (F.col("event_id") % 1500 + 64).alias("frame_bytes"),
        F.lit(False).alias("is_multicast"),
        F.lit(0).alias("ecn"),
        F.lit(None).cast("string").alias("kind"),
        F.col("event_type").alias("protocol"),
    )
    report = window_counters(rows)
    write_window_report(report, folder)
    write_window_report(report, folder)  # the same run again
    write_window_report(report.where("capture_id = 'view'"), folder)  # and one capture alone
    return spark.read.parquet(folder).select("capture_id", us("window_start"), "packets", "bytes")
