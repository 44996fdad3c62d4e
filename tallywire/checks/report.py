"""The whole report over two captures of frames of every kind, against SQL that looks at every Window by itself.

An event is a frame, ten a second: device messages from the start, then media, clock followers, device names and queriers one after the
other. The second capture is short and holds device messages only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywire.checks.base import check, table, us
from tallywire.checks.frames import num, raw
from tallywire.checks.ordered import wrap_sql
from tallywire.plans.network import NetworkReport, network_report
from tallywire.session import checkpoint_root

START = 1_704_067_200_000_000
_RUNS: dict[tuple[str, str], NetworkReport] = {}


def _ipv4(proto: int, body: Column, src: Column, dst: Column | str) -> Column:
    size = num(F.length(body) / 2 + 20, 2)
    return F.concat(F.lit("080045b8"), size, F.lit("0000000040"), F.lit(f"{proto:02x}0000"), src, dst if isinstance(dst, Column) else F.lit(dst), body)


def _udp(sport: int, dport: int, body: Column) -> Column:
    return F.concat(F.lit(f"{sport:04x}{dport:04x}"), num(F.length(body) / 2 + 8, 2), F.lit("0000"), body)


def mixed_frames(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    src = F.concat(F.when(u % 11 == 0, F.concat(F.lit("a9fe"), num(u % 7, 1))).otherwise(F.concat(F.lit("0a00"), num(u % 3, 1))), num(u % 250, 1))
    conmon = F.concat(F.lit("ffff001800000000001dc1fffe0000"), num(u % 20, 1), F.lit("Audinate".encode().hex()))
    rtp = F.concat(F.lit("8060"), num(i % 65536, 2), num(i * 48 % (1 << 32), 4), F.lit("00000009" + "00" * 20))
    follow = F.lit("00010000" + "_DFL".encode().hex() + "00" * 24 + "01" + "00" * 37)
    name = F.lit("000084000000000100000000" + "04" + b"desk".hex() + "0d" + b"_netaudio-cmc".hex() + "04" + b"_udp".hex())
    body = (
        F.when(i % 6 == 0, _ipv4(17, _udp(8700, 8702, conmon), src, "e00000e7"))
        .when((i % 6 == 1) & (i >= 200), _ipv4(17, _udp(7000, 5004, rtp), F.lit("0a000001"), F.concat(F.lit("ef4500"), num(u % 7, 1))))
        .when((i % 6 == 2) & (i >= 1000), _ipv4(17, _udp(319, 319, follow), src, "e0000181"))
        .when((i % 6 == 3) & (i >= 1500), _ipv4(17, _udp(5353, 5353, name), src, "e00000fb"))
        .when((i % 6 == 4) & (i >= 3000), _ipv4(2, F.lit("11" + "00" * 7), F.concat(F.lit("0a0900"), num(1 + u % 2, 1)), "e0000001"))
        .otherwise(F.lit("86dd" + "00" * 40))
    )
    frame = raw("01005e000001", "020000000001", body)
    ev = table(spark, sf_dir, "events").select(
        F.lit("c").alias("capture_id"), i.alias("frame_no"), F.timestamp_micros(i * 100_000 + START).alias("ts"), F.length(frame).alias("wire_len"), frame.alias("frame")
    )
    return ev.unionByName(ev.where((F.col("frame_no") % 3 == 0) & (F.col("frame_no") < 400)).withColumn("capture_id", F.lit("d")))


def report_of(spark, sf_dir) -> NetworkReport:
    """The report of a folder's events, worked out once per application and read from its stages afterwards."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _RUNS:
        root = f"{checkpoint_root(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
        _RUNS[at] = network_report(mixed_frames(spark, sf_dir), root, ["all"])
    return _RUNS[at]


_BASE = f"""
WITH RECURSIVE a AS (SELECT 'c' AS cap, event_id AS i, user_id AS u FROM events UNION ALL SELECT 'd', event_id, user_id FROM events WHERE event_id % 3 = 0 AND event_id < 400),
e AS (SELECT *, i * 100000 AS us, i // 50 AS w,
  CASE WHEN u % 11 = 0 THEN '169.254.' || (u % 7) || '.' || (u % 250) ELSE '10.0.' || (u % 3) || '.' || (u % 250) END AS ip FROM a),
b AS (SELECT cap, min(w) AS lo, max(w) AS hi FROM e GROUP BY 1),
win AS (SELECT cap, unnest(generate_series(lo, hi)) AS w FROM b),
con AS (SELECT * FROM e WHERE i % 6 = 0),
rtp AS (SELECT *, u % 7 AS s FROM e WHERE i % 6 = 1 AND i >= 200),
ptp AS (SELECT * FROM e WHERE i % 6 = 2 AND i >= 1000),
mdns AS (SELECT * FROM e WHERE i % 6 = 3 AND i >= 1500),
qry AS (SELECT *, '10.9.0.' || (1 + u % 2) AS src FROM e WHERE i % 6 = 4 AND i >= 3000),
seen AS (SELECT cap, ip, us, w, CAST(NULL AS VARCHAR) AS name FROM con UNION ALL SELECT cap, ip, us, w, 'desk' FROM mdns),
st AS (SELECT cap, s, w, count(*) AS n, max(us) AS last FROM rtp GROUP BY 1, 2, 3),
ls AS (SELECT win.cap, win.w, s, max(last) AS last, sum(CASE WHEN st.w = win.w THEN n ELSE 0 END) AS n FROM win JOIN st ON st.cap = win.cap AND st.w <= win.w GROUP BY 1, 2, 3)"""


@check(
    "report_devices",
    _BASE
    + f""" SELECT cap AS capture_id, ip AS src_ip, CAST(min(us) + {START} AS BIGINT) AS first_seen, CAST(max(us) + {START} AS BIGINT) AS last_seen, max(name) AS name
FROM seen GROUP BY 1, 2""",
)
def _report_devices(spark, sf_dir):
    return report_of(spark, sf_dir).devices.select("capture_id", "src_ip", us("first_seen"), us("last_seen"), "name")


@check(
    "report_streams",
    _BASE
    + f""",
p AS (SELECT *, lag(us) OVER o AS pus, {wrap_sql('i - lag(i) OVER o - 1', 16)} AS step FROM rtp WINDOW o AS (PARTITION BY cap, s ORDER BY us)),
m AS (SELECT cap, s, w, sum(CASE WHEN step > 0 AND (w * 5000000 - pus) // 1000000 < 20 THEN step ELSE 0 END) AS lost FROM p GROUP BY 1, 2, 3)
SELECT ls.cap AS capture_id, '239.69.0.' || ls.s AS dst_ip, CAST({START} + ls.w * 5000000 AS BIGINT) AS window_start, CAST(n AS BIGINT) AS received,
  CAST(coalesce(lost, 0) AS BIGINT) AS lost, CASE WHEN (ls.w + 1) * 5000000 - last > 10000000 THEN 'dead' ELSE 'live' END AS state
FROM ls LEFT JOIN m ON m.cap = ls.cap AND m.s = ls.s AND m.w = ls.w WHERE ((ls.w + 1) * 5000000 - last) // 1000000 < 20""",
)
def _report_streams(spark, sf_dir):
    return report_of(spark, sf_dir).streams.select("capture_id", "dst_ip", us("window_start"), "received", "lost", "state")


@check(
    "report_alerts",
    _BASE
    + f""",
dev AS (SELECT cap, ip, min(w) AS w FROM seen GROUP BY 1, 2),
kn AS (SELECT win.cap, win.w, dev.ip FROM win JOIN dev ON dev.cap = win.cap AND dev.w <= win.w),
kc AS (SELECT cap, w, count(*) AS devices, count(*) FILTER (ip LIKE '169%') AS ll, count(*) FILTER (ip LIKE '10%') AS rt,
  count(DISTINCT split_part(ip, '.', 3)) FILTER (ip LIKE '10%') AS nets FROM kn GROUP BY 1, 2),
fo AS (SELECT DISTINCT win.cap, win.w, ip FROM win JOIN ptp ON ptp.cap = win.cap AND ptp.w <= win.w AND ((win.w + 1) * 5000000 - us) // 1000000 < 15),
ab AS (SELECT cap, w, count(*) AS n FROM (SELECT * FROM kn EXCEPT SELECT * FROM fo) GROUP BY 1, 2),
fc AS (SELECT cap, w, count(*) AS n FROM fo GROUP BY 1, 2),
lc AS (SELECT win.cap, win.w, con.ip, arg_max(con.u % 20, us) AS mac, max(us) AS us FROM win JOIN con ON con.cap = win.cap AND con.w <= win.w GROUP BY 1, 2, 3),
lv AS (SELECT * FROM lc WHERE ((w + 1) * 5000000 - us) // 1000000 < 60),
br AS (SELECT cap, w, mac, count(*) AS n FROM lv GROUP BY 1, 2, 3 HAVING count(*) >= 2),
fl AS (SELECT cap, w, count(*) AS n FROM ls WHERE (w * 5000000 - last) // 1000000 < 20 GROUP BY 1, 2),
ac AS (SELECT DISTINCT cap, w FROM ls WHERE ((w + 1) * 5000000 - last) // 1000000 < 20),
x AS (SELECT win.cap, win.w, coalesce(fl.n, 0) AS flows,
  EXISTS (SELECT 1 FROM ptp WHERE ptp.cap = win.cap AND ptp.w <= win.w) AS p, EXISTS (SELECT 1 FROM qry WHERE qry.cap = win.cap AND qry.w <= win.w) AS q,
  EXISTS (SELECT 1 FROM mdns WHERE mdns.cap = win.cap AND mdns.w <= win.w) AS m, EXISTS (SELECT 1 FROM lv WHERE lv.cap = win.cap AND lv.w = win.w) AS c,
  EXISTS (SELECT 1 FROM kn WHERE kn.cap = win.cap AND kn.w = win.w) AS d FROM win LEFT JOIN fl ON fl.cap = win.cap AND fl.w = win.w),
y AS (SELECT *, c AND NOT m AND NOT p AND flows = 0 AS local, lag(c AND NOT m AND NOT p AND flows = 0) OVER (PARTITION BY cap ORDER BY w) AS before,
  sum(flows) OVER h AS three, count(*) OVER h AS h FROM x WINDOW h AS (PARTITION BY cap ORDER BY w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
mq AS (SELECT cap, w FROM qry GROUP BY 1, 2 HAVING count(DISTINCT src) >= 2),
r AS (
  SELECT cap, w, 'error' AS level, 'ip_config' AS code, ll || ' without address' AS subject FROM kc WHERE rt > 0 AND ll > 0
  UNION ALL SELECT cap, w, 'warn', 'ip_config', nets || ' subnets' FROM kc WHERE nets > 1
  UNION ALL SELECT cap, w, 'error', 'bridged_network', printf('00:1d:c1:00:00:%02x', mac) FROM br
  UNION ALL SELECT ab.cap, ab.w, 'warn', 'followers_missing', CAST(ab.n AS VARCHAR) FROM ab JOIN fc ON fc.cap = ab.cap AND fc.w = ab.w JOIN kc ON kc.cap = ab.cap AND kc.w = ab.w
    WHERE ab.n >= 2 AND devices >= 2
  UNION ALL SELECT cap, w, 'warn', 'filtered_multicast', NULL FROM y WHERE local AND before
  UNION ALL SELECT cap, w, 'warn', 'ptp_blocked', NULL FROM x WHERE d AND NOT p AND NOT q
  UNION ALL SELECT cap, w, 'warn', 'stream_spike', CAST(flows AS VARCHAR) FROM y WHERE h = 3 AND three // 3 > 0 AND flows > 2 * (three // 3)
  UNION ALL SELECT DISTINCT qry.cap, qry.w, 'error', 'multiple_queriers', src FROM qry JOIN mq ON mq.cap = qry.cap AND mq.w = qry.w JOIN ac ON ac.cap = qry.cap AND ac.w = qry.w)
SELECT cap AS capture_id, CAST({START} + w * 5000000 AS BIGINT) AS window_start, level, code, subject FROM r""",
)
def _report_alerts(spark, sf_dir):
    return report_of(spark, sf_dir).alerts.select("capture_id", us("window_start"), "level", "code", "subject")
