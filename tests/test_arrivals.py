"""Late rows, announcements that arrive between batches, and reports that are stored twice."""

import datetime as dt

from pyspark.sql import functions as F

from tallywire.plans.report import write_window_report
from tallywire.sources.frames import FRAMES, read_frames, write_frames
from tallywire.streaming.late import late_counts, read_split, split_late
from tallywire.streaming.live import enrich_windows
from tallywire.streaming.windows import start

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    cols = "n long, ts timestamp"
    batches = [[(1, at(1)), (2, at(21)), (3, at(2))], [(4, at(4.5)), (5, at(11)), (6, at(30)), (7, None)], [], [(8, at(14)), (9, at(20))]]
    for rows in batches:
        spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(cols).parquet(str(tmp_path / "in"))
        split_late(stream, str(tmp_path / "out"), str(tmp_path / "marks"), str(tmp_path / "ck"), delay=10, seconds=5).awaitTermination()
    # marks: 11 after the first arrival, 20 after the second; the Windows [0, 5) and [10, 15) had ended by then
    assert sorted(r["n"] for r in read_split(spark, str(tmp_path / "out"), True).collect()) == [4, 8]
    assert sorted(r["n"] for r in read_split(spark, str(tmp_path / "out"), False).collect()) == [1, 2, 3, 5, 6, 7, 9]
    counts = late_counts(spark, str(tmp_path / "marks")).where("n_rows > 0").orderBy("batch").collect()
    assert [(r["n_rows"], r["n_late"]) for r in counts] == [(3, 0), (4, 1), (2, 1)]
    plan = read_split(spark, str(tmp_path / "out"), True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(late" in plan


def test_announcements_that_arrive_between_batches(spark, tmp_path):
    said_cols, asked_cols = "k string, frame_no long, ts timestamp, clock long, name string", "k string, window_end timestamp, n long"
    arrivals = [
        ([("a", 1, at(1), 48000, "x"), ("a", 2, at(1), 44100, None), (None, 3, at(1), 1, "y")], [("a", at(1), 0), ("a", at(5), 1), ("b", at(5), 2)]),
        # known late: its Window was given out without it; at the end of a Window: for the next one
        ([("b", 4, at(2), 2**53 + 1, "z"), ("a", 5, at(10), 96000, "w"), ("b", 9, None, 7, "v")], [("a", at(10), 3), ("a", at(15), 4), ("b", at(10), 5)]),
        ([("a", 6, at(3), 8000, "old")], [("a", at(20), 6), (None, at(20), 7)]),
    ]
    for said, asked in arrivals:
        spark.createDataFrame(said, said_cols).write.mode("append").parquet(str(tmp_path / "said"))
        spark.createDataFrame(asked, asked_cols).write.mode("append").parquet(str(tmp_path / "asked"))
        read = spark.readStream
        out = enrich_windows(
            read.schema(asked_cols).parquet(str(tmp_path / "asked")), read.schema(said_cols).parquet(str(tmp_path / "said")), ["k"], ["clock", "name"]
        )
        start(out, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r["n"]: (r["k"], r["clock"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {
        0: ("a", None, None),
        1: ("a", 44100, None),
        2: ("b", None, None),
        3: ("a", 44100, None),
        4: ("a", 96000, "w"),
        5: ("b", 2**53 + 1, "z"),
        6: ("a", 96000, "w"),
    }


def test_a_stored_day_is_replaced(spark, tmp_path):
    frames, report = str(tmp_path / "frames"), str(tmp_path / "report")
    rows = spark.createDataFrame([(c, n, at(d * 86400 + n), 60, b"x") for c in "cd" for d in (0, 1) for n in (1, 2)], FRAMES)
    write_frames(rows, frames)
    write_frames(rows, frames)
    write_frames(rows.where("capture_id = 'c' AND ts < '2024-01-02'").withColumn("wire_len", F.lit(99)), frames)
    assert read_frames(spark, frames).count() == 8
    day = read_frames(spark, frames, days=["2024-01-01"])
    assert sorted((r["capture_id"], r["wire_len"]) for r in day.collect()) == [("c", 99), ("c", 99), ("d", 60), ("d", 60)]
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [day" in day._jdf.queryExecution().executedPlan().toString()
    windows = rows.select("capture_id", F.col("ts").alias("window_start"), F.lit(1).alias("score"))
    write_window_report(windows, report)
    write_window_report(windows.where("capture_id = 'd'").withColumn("score", F.lit(2)), report)
    back = spark.read.parquet(report).groupBy("capture_id").agg(F.count("*").alias("n"), F.sum("score").alias("s")).orderBy("capture_id").collect()
    assert [tuple(r) for r in back] == [("c", 4, 4), ("d", 4, 8)]
