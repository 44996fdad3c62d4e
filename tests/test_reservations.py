"""Reservations at each Window end: lists that are cleared, declarations that come too early, talkers and listeners."""

import datetime as dt

from test_frames import T0

from tallywire.operators.enrich import reservation_timeline


def at(t):
    return T0 + dt.timedelta(seconds=t)


def table(spark, rows, fields):
    rows = [("c", i, at(t), at(t // 5 * 5), *rest) for i, (t, *rest) in enumerate(rows)]
    return spark.createDataFrame(rows, "capture_id string, frame_no long, ts timestamp, window_start timestamp" + fields)


def test_timeline(spark):
    frames = table(spark, [(12, "s"), (14, "s"), (60, "s")], ", stream_id string")
    said = table(
        spark,
        [
            (1, "s", "talker_advertise", 2, None, None),  # the stream is not listed yet
            (17, "s", "talker_advertise", 3, None, None),
            (18, "s", "listener", None, None, 2),
            (22, "s", "talker_failed", 3, 1, None),
            (40, "s", "talker_failed", 3, 1, None),  # no longer listed
            (61, "other", "talker_advertise", 3, None, None),  # never has frames
        ],
        ", stream_id string, decl_type string, priority int, failure_code int, listener_state int",
    )
    vlans = table(spark, [(2,), (11,)], "")  # the first is cleared before the stream is there, the second when it is gone
    until = spark.createDataFrame([("c", at(65))], "capture_id string, until timestamp")
    got = reservation_timeline(frames, said, vlans, until=until).orderBy("window_start").collect()
    assert [((r["window_start"] - T0).seconds, r["status"], r["priority"], r["reason"], r["listener"], r["no_vlan"]) for r in got] == [
        (10, "none", None, None, None, False),
        (15, "reserved", 3, None, "ready", False),
        (20, "failed", 3, "insufficient bandwidth", "ready", False),
        (25, "failed", 3, "insufficient bandwidth", "ready", False),
        (60, "none", None, None, None, True),
        (65, "none", None, None, None, True),
    ]
    assert {r["stream_id"] for r in got} == {"s"}
    assert reservation_timeline(frames.limit(0), said, vlans, until=until).count() == 0
