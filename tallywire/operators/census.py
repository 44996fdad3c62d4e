"""Discovery checks at the end of every Window of every capture.

What is known of a device is a presence span over Windows. Spans become +1 at their first and -1 after their last Window, and running
sums of these give the numbers at each Window end: no product of devices and Windows, no value for one instant only. Windows are
counted by number (microseconds since the epoch divided by their length).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.addresses import is_link_local
from tallywire.functions.arith import MICROS, as_col, micros, period_micros
from tallywire.operators.windows import WINDOW_SECONDS


def window_no(time: Column | str, seconds: float) -> Column:
    """The number of the Window of a timestamp."""
    return F.floor(micros(time) / F.lit(period_micros(seconds))).cast("bigint")


def window_of(number: Column | str, seconds: float) -> Column:
    """The start of a Window by its number."""
    return F.timestamp_micros(as_col(number) * F.lit(period_micros(seconds)).cast("bigint"))


def presence(
    sightings: DataFrame,
    key: Sequence[str],
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    hold: float | None = None,
    payload: Sequence[str] = (),
) -> DataFrame:
    """(key, payload, first, last): spans of Window numbers at whose ends a key counts as present, without overlaps. A sighting counts while
    fewer than `hold` whole seconds old, for ever (null `last`) without; of several the latest one counts, with its payload."""
    at = F.struct(ts, *payload)
    seen = sightings.groupBy(*key, window_no(ts, seconds).alias("first")).agg(F.max(at).alias("_s"))
    us = F.unix_micros(F.col(f"_s.{ts}").cast("timestamp"))
    last = F.lit(None).cast("bigint")
    if hold is not None:
        last = F.floor((us + F.lit(int(round(hold * MICROS)) - 1)) / F.lit(period_micros(seconds))).cast("bigint") - 1
    seen = seen.select(*key, *[F.col(f"_s.{c}").alias(c) for c in payload], "first", last.alias("last"))
    if hold is not None:
        seen = seen.where("last >= first")
    after = F.lead("first").over(Window.partitionBy(*key).orderBy("first"))
    return seen.withColumn("last", F.least("last", after - 1))


def running_counts(windows: DataFrame, by: Sequence[str], spans: Mapping[str, DataFrame], no: str = "no") -> DataFrame:
    """`windows` (by, no, ...) with the number of spans of each kind that cover the Window. Works on one row per Window and
    change of a count."""
    by = list(by)
    marks = windows.select(*by, F.col(no).alias("_at"), F.lit(1).alias("_asked"))
    for name, found in spans.items():
        edges = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("n"))))
        steps = found.select(*by, edges.alias("_e")).where("_e.at IS NOT NULL")
        steps = steps.groupBy(*by, F.col("_e.at").alias("_at")).agg(F.sum("_e.n").alias(name))
        marks = marks.unionByName(steps, allowMissingColumns=True)
    marks = marks.groupBy(*by, "_at").agg(F.max("_asked").alias("_asked"), *[F.sum(n).alias(n) for n in spans])
    upto = Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select(*by, "_at", "_asked", *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in spans])
    return windows.join(marks.where("_asked = 1").drop("_asked").withColumnRenamed("_at", no), [*by, no])


def numbered_windows(windows: DataFrame, by: Sequence[str], window: str, seconds: float) -> DataFrame:
    return windows.select(*by, window, window_no(window, seconds).alias("no")).distinct()


def census_windows(
    devices: DataFrame,
    ptp: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = ("capture_id",),
    key: str = "src_ip",
    ts: str = "ts",
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    recent: float = 15,
) -> DataFrame:
    """Per Window: `devices` known, `followers` (senders of a Delay_Req of version 1 in the last `recent` seconds) and `missing`, the devices that
    are neither followers nor the grandmaster. Nothing is missing before PTPv1 was seen, with fewer than two devices or with no follower;
    without a known grandmaster one missing device is tolerated. The grandmaster is that of the smallest domain that has named one, by the latest message."""
    by = list(by)
    asked = numbered_windows(windows, by, window, seconds)
    v1 = ptp.where(F.col("version") == 1)
    known = presence(devices, [*by, key], ts, seconds).groupBy(*by, key).agg(F.min("first").alias("first")).withColumn("last", F.lit(None).cast("bigint"))
    syncing = presence(v1.where(F.col("message_type") == 1), [*by, key], ts, seconds, recent)
    # a device's syncing spans, from when the device is known
    synced = syncing.join(known.select(*by, key, F.col("first").alias("_since")), [*by, key])
    synced = synced.withColumn("first", F.greatest("first", "_since")).where("last >= first").drop("_since")
    ever = v1.groupBy(*by).agg(F.min(window_no(ts, seconds)).alias("first")).withColumn("last", F.lit(None).cast("bigint"))
    out = running_counts(asked, by, {"devices": known, "followers": syncing, "_synced": synced, "_v1": ever})

    named = v1.where(F.col("grandmaster_id").isNotNull())
    masters = named.groupBy(*by, "domain", window_no(ts, seconds).alias("no")).agg(F.max_by(key, F.struct(ts, key)).alias("_gm"))
    smallest = masters.groupBy(*by, "no").agg(F.min("domain").alias("_low"))
    upto = Window.partitionBy(*by).orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    both = out.join(smallest, [*by, "no"], "full").withColumn("_domain", F.min("_low").over(upto)).drop("_low")
    # while a domain is the smallest, all its rows since its first one are here
    held = Window.partitionBy(*by, "_domain").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    both = both.join(masters.withColumnRenamed("domain", "_domain"), [*by, "_domain", "no"], "left")
    both = both.withColumn("gm", F.last("_gm", ignorenulls=True).over(held)).where(F.col(window).isNotNull()).drop("_gm", "_domain")
    mine = both.where(F.col("gm").isNotNull()).select(*by, F.col("gm").alias(key), "no")
    mine = running_counts(mine, [*by, key], {"_is_device": known, "_is_synced": synced}).withColumnRenamed(key, "gm")
    both = both.join(mine, [*by, "gm", "no"], "left")
    absent = F.col("devices") - F.col("_synced")
    listed = F.when(F.col("gm").isNull(), F.when(absent >= 2, absent).otherwise(0)).otherwise(absent - (F.col("_is_device") - F.col("_is_synced")))
    gate = (F.col("_v1") >= 1) & (F.col("devices") >= 2) & (F.col("followers") >= 1)
    return both.select(*by, window, "devices", "followers", F.when(gate, listed).otherwise(0).cast("bigint").alias("missing"))


def bridged_windows(
    conmon: DataFrame,
    by: Sequence[str] = ("capture_id",),
    mac: str = "mac",
    ip: str = "src_ip",
    ts: str = "ts",
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    retain: float = 60,
    until: DataFrame | None = None,
) -> DataFrame:
    """(by, Window, mac, addresses): hardware addresses that two or more addresses showed within the last `retain` seconds before the Window's end.
    An address counts for the hardware address it showed last. `until` (by, until) has each capture's last Window."""
    by = list(by)
    spans = presence(conmon, [*by, ip], ts, seconds, retain, [mac])
    edges = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("n"))))
    steps = spans.select(*by, mac, edges.alias("_e")).groupBy(*by, mac, F.col("_e.at").alias("_at")).agg(F.sum("_e.n").alias("_n"))
    order = Window.partitionBy(*by, mac).orderBy("_at")
    steps = steps.where("_n <> 0").withColumn("addresses", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.withColumn("_to", F.lead("_at").over(order) - 1).where("addresses >= 2")
    if until is not None:
        steps = steps.join(until.select(*by, window_no("until", seconds).alias("_end")), by).withColumn("_to", F.least("_to", "_end"))
    steps = steps.where(F.col("_to") >= F.col("_at"))
    return steps.select(*by, mac, "addresses", F.explode(F.sequence("_at", "_to")).alias("_no")).select(*by, window_of("_no", seconds).alias(window), mac, "addresses")


def ip_windows(
    devices: DataFrame,
    windows: DataFrame,
    by: Sequence[str] = ("capture_id",),
    ip: str = "src_ip",
    ts: str = "ts",
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
) -> DataFrame:
    """Per Window: `no_address`, the link-local devices known while routable ones are as well, and `subnets`, the /24 networks of routable devices if
    more than one; 0 where all is well. Devices count from their first sighting on."""
    by = list(by)
    never = F.lit(None).cast("bigint").alias("last")
    first = devices.groupBy(*by, ip).agg(F.min(window_no(ts, seconds)).alias("first"))
    local = is_link_local(F.col(ip))
    nets = first.where(~local).groupBy(*by, F.substring_index(ip, ".", 3).alias("_net")).agg(F.min("first").alias("first"))
    spans = {"_local": first.where(local).select(*by, "first", never), "_routable": first.where(~local).select(*by, "first", never), "_nets": nets.select(*by, "first", never)}
    out = running_counts(numbered_windows(windows, by, window, seconds), by, spans)
    return out.select(
        *by,
        window,
        F.when(F.col("_routable") >= 1, F.col("_local")).otherwise(0).cast("bigint").alias("no_address"),
        F.when(F.col("_nets") > 1, F.col("_nets")).otherwise(0).cast("bigint").alias("subnets"),
    )


def refclk_windows(
    claims: DataFrame,
    active: DataFrame,
    clocks: DataFrame,
    by: Sequence[str] = ("capture_id",),
    session: str = "session_id",
    port: str = "port",
    ts: str = "ts",
    window: str = "window_start",
) -> DataFrame:
    """(by, Window, session, port, claimed_domain, claimed_gm, active_gm, status): announced clocks of active sessions that no PTP traffic backs (`no_ptp`) or
    that are not the domain's grandmaster (`mismatch`).

    `claims` are media sections with (claimed_gm, claimed_domain), both null where a section claims none; of each the latest up to the Window
    counts. A session is active in Windows in which a stream runs on one of its ports: `active` has (by, Window, port). `clocks` has (by, Window,
    domain, version, gm, valid) from a domain's first message on; version 2 is preferred.
    """
    by = list(by)
    rows = claims.select(*by, session, port, ts, window, "claimed_gm", "claimed_domain")
    wanted = rows.where(F.col("claimed_domain").isNotNull()).select(*by, session).distinct()
    ports = rows.join(wanted, [*by, session], "left_semi").groupBy(*by, session, port).agg(F.min(window).alias("_since"))
    live = active.select(*by, window, port).distinct().join(ports, [*by, port]).where(F.col(window) >= F.col("_since")).select(*by, session, window).distinct()
    asked = live.join(ports, [*by, session]).where(F.col(window) >= F.col("_since")).select(*by, session, port, window, F.lit(1).alias("_asked"))
    said = rows.join(wanted, [*by, session], "left_semi").groupBy(*by, session, port, window)
    said = said.agg(F.max(F.struct(ts, "claimed_gm", "claimed_domain")).alias("_said"))
    both = asked.join(said, [*by, session, port, window], "full")
    upto = Window.partitionBy(*by, session, port).orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_c", F.last("_said", ignorenulls=True).over(upto)).where("_asked = 1 AND _c.claimed_domain IS NOT NULL")
    both = both.select(*by, window, session, port, "_c.claimed_gm", "_c.claimed_domain")
    best = clocks.groupBy(*by, window, F.col("domain").alias("claimed_domain")).agg(F.max_by(F.struct("gm", "valid"), "version").alias("_s"))
    best = best.select(*by, window, "claimed_domain", F.col("_s.gm").alias("active_gm"), "_s.valid", F.lit(True).alias("_seen"))
    out = both.join(best, [*by, window, "claimed_domain"], "left")
    status = F.when(F.col("_seen").isNull(), "no_ptp").when(F.col("valid") & (F.col("active_gm") != F.col("claimed_gm")), "mismatch")
    return out.withColumn("status", status).where(F.col("status").isNotNull()).drop("_seen", "valid")
