"""Joins: announcements, device registries, clock cross-checks, reservations.

Small sides are left to Catalyst's size estimate (and AQE); only fixed code tables are broadcast by hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.addresses import is_link_local
from tallywire.functions.arith import MICROS, micros, period_micros
from tallywire.functions.lookups import (
    LISTENER_STATES,
    RESERVATION_FAILURES,
    STREAM_DEFAULTS,
    UNKNOWN_FAILURE,
    case_of,
    literal_table,
)
from tallywire.operators.chunks import with_last_known
from tallywire.operators.windows import WINDOW_SECONDS, per_window_last, silence_states

QUALITY_RANK = [("healthy", 0), ("degrading", 1), ("critical", 2), ("terminated", 3)]


def asof_latest(
    packets: DataFrame,
    announcements: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[str],
    fields: Mapping[str, str],
) -> DataFrame:
    """Add to every packet the latest non-null value of each announced field at or before it.

    Both inputs carry the key, order and chunk columns; `fields` maps result names to announcement columns.
    One union and one chunked window, no range join.
    """
    at = list(dict.fromkeys([*key, *chunk, *order]))
    left = packets.select(struct_of(packets).alias("_packet"), *at, F.lit(1).alias("_side"))
    right = announcements.select(*at, F.lit(0).alias("_side"), *[F.col(c).alias(f"_a_{n}") for n, c in fields.items()])
    both = left.unionByName(right, allowMissingColumns=True)
    ordered = [order[0], "_side", *order[1:]]
    known = with_last_known(both, key, ordered, chunk, {n: f"_a_{n}" for n in fields})
    return known.where(F.col("_side") == 1).select("_packet.*", *fields)


def struct_of(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def _announced_values() -> dict[str, Column]:
    """What a media section announces; null where it says nothing."""
    return {
        "rtpmap": F.col("rtpmap"),
        "clock_hz": F.when(F.col("clock_hz") > 0, F.col("clock_hz")),
        "ptime_ms": F.when(F.col("ptime_ms") > 0, F.col("ptime_ms")),
        "channels": F.when(F.col("channels") > 0, F.col("channels")),
        "expected_pt": F.get("payload_types", F.lit(0)),
    }


def _known_points(slots: DataFrame, events: DataFrame, key: Sequence[str], order: Sequence[str], bucket: str, names: Sequence[str], out: str) -> DataFrame:
    """(key, bucket, order, `out`) what is known of each key from its announcements: at the start of each bucket in `slots` (order
    columns null) and after every announcement."""
    marks = slots.select(*key, bucket).distinct()
    rows = events.unionByName(marks, allowMissingColumns=True)
    known = with_last_known(rows, key, order, [bucket], {f"_k_{n}": n for n in names})
    some = F.coalesce(*[F.col(f"_k_{n}.at")[order[0]] for n in names]).isNotNull()
    return known.where(some).select(*key, bucket, *order, F.struct(*[F.col(f"_k_{n}").alias(n) for n in names]).alias(out))


def announced_intervals(
    slots: DataFrame,
    media: DataFrame,
    port: str = "dst_port",
    ip: str = "dst_ip",
    order: Sequence[str] = ("ts", "frame_no"),
    bucket: str = "window_start",
    by: Sequence[str] = (),
) -> DataFrame:
    """What is announced for every slot (by, port, ip, bucket), as intervals: `_from` (null: from the bucket's start), `_to` (null: to its
    end), `session_name` and `announced_*`. A slot has one interval and one more for each announcement inside it; slots of which nothing is
    known have none. Rows are as many as slots and announcements, never packets."""
    order = list(order)
    values = _announced_values()
    at = F.struct(*[F.col(c) for c in order])
    stamped = media.select(
        F.col("port").alias(port),
        F.col("connection_ip").alias(ip),
        *dict.fromkeys([*by, *order, bucket]),
        *[F.when(v.isNotNull(), F.struct(at.alias("at"), v.alias("v"))).alias(n) for n, v in values.items()],
        F.struct(at.alias("at"), F.col("session_name").alias("v")).alias("session_name"),
    )
    names = [*values, "session_name"]
    slot = [*by, port, ip, bucket]
    slots = slots.select(*slot).distinct()
    points = []
    for side, rows, key in (
        ("_x", stamped.where(F.col(ip).isNotNull()), [*by, port, ip]),
        ("_y", stamped.where(F.col(ip).isNull()).drop(ip), [*by, port]),
    ):
        first = rows.groupBy(*key).agg(F.min_by("session_name", at).alias("_first"))
        rows = rows.join(first, key).withColumn(
            "session_name", F.when(F.col("session_name.at") == F.col("_first.at"), F.col("session_name"))
        )
        known = _known_points(slots, rows.drop("_first"), key, order, bucket, names, side)
        points.append(slots.join(known, [*key, bucket]))
    every = points[0].unionByName(points[1], allowMissingColumns=True)
    every = every.groupBy(*slot, *order).agg(F.first("_x", ignorenulls=True).alias("_x"), F.first("_y", ignorenulls=True).alias("_y"))
    w = Window.partitionBy(*slot).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    every = every.select(
        *slot, F.col(order[0]).alias("_from"), F.lead(order[0]).over(w).alias("_to"), *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("_x", "_y")]
    )

    def pick(n: str, latest: bool) -> Column:
        a, b = F.col(f"_x.{n}"), F.col(f"_y.{n}")
        use_a = b.isNull() | (a.isNotNull() & ((a["at"] >= b["at"]) if latest else (a["at"] <= b["at"])))
        return F.when(use_a, a["v"]).otherwise(b["v"])

    held = every.where(F.col("_to").isNull() | F.col("_from").isNull() | (F.col("_from") < F.col("_to")))
    return held.select(
        *slot, "_from", "_to", pick("session_name", latest=False).alias("session_name"), *[pick(n, latest=True).alias(f"announced_{n}") for n in values]
    )


def announce_enrich(
    packets: DataFrame,
    media: DataFrame,
    port: str = "dst_port",
    ip: str = "dst_ip",
    ts: str = "ts",
    order: Sequence[str] = ("ts", "frame_no"),
    chunk: Sequence[str] = ("window_start",),
    by: Sequence[str] = (),
) -> DataFrame:
    """Apply announced media fields to the packets of a stream from the announcement on.

    An announcement matches on the port and on the connection address unless it has none. `session_name` is
    written once (first announcement); `rtpmap`, `clock_hz`, `ptime_ms`, `channels` and the first payload type
    follow the latest announcement that carries a positive value; a positive clock confirms the clock.

    Packets meet the intervals of their slot (stream address and first chunk column) in one equi-join with a range test. If the
    intervals are small they are broadcast; if not, packets are shuffled once by the slot, which later work per stream and chunk needs anyway.
    """
    bucket = chunk[0]
    slot = [*by, port, ip, bucket]
    found = announced_intervals(packets.select(*slot), media, port, ip, order, bucket, by)
    names = [c for c in found.columns if c not in slot]
    right = found.select(*[F.col(c).alias(f"_s_{c}") for c in slot], *names)
    here = F.col(order[0])
    same = (F.col("_from").isNull() | (F.col("_from") <= here)) & (F.col("_to").isNull() | (here < F.col("_to")))
    for c in slot:
        same = same & (packets[c] == F.col(f"_s_{c}"))
    out = packets.join(right, same, "left").select(*[packets[c] for c in packets.columns], *[c for c in names if c not in ("_from", "_to")])
    return out.withColumn("clock_confirmed", F.col("announced_clock_hz").isNotNull())


def backfill_name(streams: DataFrame, names: DataFrame, on: str = "src_ip", name: str = "name", ts: str = "ts") -> DataFrame:
    """Give nameless streams the first name announced for their sender."""
    first = names.where(F.col(name).isNotNull()).groupBy(on).agg(F.min_by(name, ts).alias("_first"))
    return streams.join(first, on, "left").withColumn(name, F.coalesce(F.col(name), F.col("_first"))).drop("_first")


def device_registry(sightings: Sequence[DataFrame], key: str = "src_ip", ts: str = "ts", name: str = "name") -> DataFrame:
    """Union of all sightings of devices: first and last seen, latest announced name."""
    rows = sightings[0].select(key, ts, name)
    for other in sightings[1:]:
        rows = rows.unionByName(
            other.select(key, ts, F.col(name) if name in other.columns else F.lit(None).cast("string").alias(name))
        )
    return rows.groupBy(key).agg(
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(ts))).alias(name),
    )


def follower_census(
    devices: DataFrame,
    ptp: DataFrame,
    as_of: Column,
    key: str = "src_ip",
    ts: str = "ts",
    recent: float = 15,
) -> DataFrame:
    """Devices that are neither syncing followers nor the grandmaster at time `as_of`.

    Syncing means a Delay_Req of version 1 less than `recent` seconds ago. Nothing is reported without PTPv1, with
    fewer than two devices or with no follower; without a known grandmaster one missing device is tolerated.
    """
    v1 = ptp.where(F.col("version") == 1)
    ids = devices.select(key).distinct()
    age = F.floor((micros(as_of) - micros(ts)) / MICROS)
    followers = v1.where((F.col("message_type") == 1) & (age < recent)).select(key).distinct()
    masters = v1.where(F.col("grandmaster_id").isNotNull()).groupBy("domain").agg(F.max_by(key, F.struct(ts, key)).alias("_gm"))
    gm = masters.select(F.min_by("_gm", "domain")).scalar()
    n_devices = ids.select(F.count(F.lit(1))).scalar()
    n_followers = followers.select(F.count(F.lit(1))).scalar()
    missing = ids.join(followers, key, "left_anti")
    n_missing = missing.select(F.count(F.lit(1))).scalar()
    gate = (n_devices >= 2) & (n_followers >= 1)
    listed = F.when(gm.isNull(), n_missing >= 2).otherwise(F.col(key) != gm)
    return missing.where(gate & listed)


def bridged_networks(
    conmon: DataFrame,
    names: DataFrame,
    as_of: Column,
    mac: str = "mac",
    ip: str = "src_ip",
    ts: str = "ts",
    retain: float = 60,
) -> DataFrame:
    """One row per address of every hardware address that was seen from two or more addresses lately."""
    last = conmon.groupBy(ip).agg(F.max_by(mac, ts).alias(mac), F.max(ts).alias("_last"))
    live = last.where(F.floor((micros(as_of) - micros("_last")) / MICROS) < retain).select(mac, ip)
    many = live.groupBy(mac).agg(F.count(F.lit(1)).alias("addresses")).where(F.col("addresses") >= 2)
    named = live.join(names, ip).groupBy(mac).agg(F.min_by("name", ip).alias("name"))
    return live.join(many, mac).join(named, mac, "left")


def no_address_devices(devices: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Link-local devices, when routable ones exist as well."""
    ids = devices.select(ip).distinct()
    routable = ids.where(~is_link_local(F.col(ip))).select(F.count(F.lit(1))).scalar()
    return ids.where(is_link_local(F.col(ip)) & (routable >= 1))


def subnets(devices: DataFrame, ip: str = "src_ip") -> DataFrame:
    """The /24 networks of routable devices, when there is more than one."""
    ids = devices.select(ip).distinct().where(~is_link_local(F.col(ip)))
    nets = ids.groupBy(F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")).alias("subnet")).agg(
        F.count(F.lit(1)).alias("devices")
    )
    return nets.where(nets.select(F.count(F.lit(1))).scalar() > 1)


def refclk_check(media: DataFrame, ptp_state: DataFrame, streams: DataFrame, session: str = "session_id") -> DataFrame:
    """Announced clocks of active sessions that are absent or differ from the domain's grandmaster.

    `media` has `port` and the normalised claim (`claimed_gm`, `claimed_domain`, null if none); `ptp_state` one row
    per (domain, version) with `grandmaster_id` and `valid`; version 2 is preferred. `streams` lists active ports.
    """
    ports = streams.select(F.col("dst_port").alias("port")).distinct()
    active = media.join(ports, "port", "left_semi").select(session).distinct()
    claims = media.where(F.col("claimed_domain").isNotNull()).join(active, session, "left_semi")
    best = ptp_state.groupBy("domain").agg(
        F.max_by(F.struct("grandmaster_id", "valid"), "version").alias("_s")
    ).select(F.col("domain").alias("claimed_domain"), F.col("_s.grandmaster_id").alias("active_gm"), "_s.valid")
    out = claims.join(best, "claimed_domain", "left")
    status = F.when(F.col("valid").isNull(), "no_ptp").when(
        F.col("valid") & (F.col("active_gm") != F.col("claimed_gm")), "mismatch"
    )
    return out.withColumn("status", status).where(F.col("status").isNotNull())


# Stream families and the clock they need.
CLOCK_NEEDS = [("AES67", "ptpv2"), ("ST2110", "ptpv2"), ("Dante", "ptp"), ("AVB", "gptp")]


def missing_clock(streams: DataFrame, clocks: DataFrame, group: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """Observed and selected families whose kind of clock is nowhere valid, one row per family.

    `streams` has a `family` column, `clocks` the columns `version`, `protocol_kind` and `valid`.
    """
    need = F.broadcast(literal_table(streams.sparkSession, CLOCK_NEEDS, "family string, clock string"))
    wanted = streams.where(F.col("family").isin(list(selected))).select(*group, "family").distinct().join(need, "family")
    gptp = F.coalesce(F.col("protocol_kind") == "AVB", F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(~gptp & (F.col("version") == 2), "ptpv2"), F.when(~gptp, "ptp"), F.when(gptp, "gptp")
        )
    )
    valid = clocks.where(F.col("valid")).select(*group, F.explode(kinds).alias("clock")).distinct()
    return wanted.join(valid, [*group, "clock"], "left_anti")


def dropout_correlation(ptp_windows: DataFrame, loss_windows: DataFrame, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Windows in which a clock is lost and a stream of the family it serves loses packets.

    `ptp_windows` has `version` and `lost`, `loss_windows` has `family` and `lost` packets.
    """
    serves = [(1, "Dante"), (2, "AES67"), (2, "ST2110")]
    dim = F.broadcast(literal_table(ptp_windows.sparkSession, serves, "version int, family string"))
    gone = ptp_windows.where(F.col("lost")).select(*group, F.col("version").cast("int").alias("version")).distinct()
    hurt = loss_windows.where(F.col("lost") > 0).select(*group, "family").distinct()
    return gone.join(dim, "version").join(hurt, [*group, "family"]).select(*group).distinct()


def uncorrelated(alerts: DataFrame, correlated: DataFrame, group: Sequence[str] = ("window_start",)) -> DataFrame:
    """Single alerts of Windows without a combined one."""
    return alerts.join(correlated, list(group), "left_anti")


def latest_declarations(
    msrp: DataFrame, key: Sequence[str] = ("stream_id", "decl_type"), order: Sequence[str] = ("ts", "frame_no")
) -> DataFrame:
    """Latest declaration per stream and kind: a Listener does not replace the Talker."""
    rest = [c for c in msrp.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_d")
    return msrp.groupBy(*key).agg(last).select(*key, "_d.*")


def reservation_status(avtp_streams: DataFrame, declarations: DataFrame, vlans: DataFrame) -> DataFrame:
    """Reservation of every stream that has frames: reserved, failed (with reason) or none, and listener state."""
    talker = declarations.where(F.col("decl_type") != "listener")
    talker = latest_declarations(talker, ["stream_id"], ["ts"]).select(
        "stream_id", F.col("decl_type").alias("_t"), "priority", "failure_code"
    )
    listener = declarations.where(F.col("decl_type") == "listener")
    listener = latest_declarations(listener, ["stream_id"], ["ts"]).select("stream_id", "listener_state")
    have_vlan = vlans.select(F.count(F.lit(1))).scalar() > 0
    out = avtp_streams.select("stream_id").distinct().join(talker, "stream_id", "left").join(listener, "stream_id", "left")
    status = F.when(F.col("_t") == "talker_failed", "failed").when(F.col("_t") == "talker_advertise", "reserved").otherwise("none")
    return out.select(
        "stream_id",
        status.alias("status"),
        "priority",
        "failure_code",
        F.when(F.col("_t") == "talker_failed", case_of(F.col("failure_code"), RESERVATION_FAILURES, UNKNOWN_FAILURE)).alias(
            "reason"
        ),
        case_of(F.col("listener_state"), LISTENER_STATES).alias("listener"),
        (F.col("_t").isNull() & ~have_vlan).alias("no_vlan"),
    )


def reservation_timeline(
    avtp: DataFrame,
    declarations: DataFrame,
    vlans: DataFrame,
    by: Sequence[str] = ("capture_id",),
    key: str = "stream_id",
    order: Sequence[str] = ("ts", "frame_no"),
    window: str = "window_start",
    seconds: float = WINDOW_SECONDS,
    prune: float = 20,
    until: Column | DataFrame | None = None,
) -> DataFrame:
    """Reservation of every listed stream at each Window end: status, priority, failure_code, reason, listener and `no_vlan`.

    A stream is listed from its first frame until it was silent for `prune` seconds. A declaration counts from its Window on while the stream
    stays listed; one whose stream is not listed at the end of its Window is forgotten. The latest talker and the latest listener count, each by itself.
    VLAN registrations of a capture are forgotten at the end of a Window without any listed stream. Streams without frames have no rows.
    """
    by = list(by)
    who = [*by, key]
    states = silence_states(per_window_last(avtp, who, order[0], window), who, window, seconds=seconds, prune=prune, until=until)
    listed = states.where(F.col("state") != "pruned").select(*who, window, "session")
    at = F.struct(*order)
    is_talker = F.col("decl_type") != "listener"
    said = declarations.groupBy(*who, window).agg(
        F.max_by(F.struct(F.col("decl_type").alias("t"), "priority", "failure_code"), F.when(is_talker, at)).alias("_talker"),
        F.max_by(F.struct("listener_state"), F.when(~is_talker, at)).alias("_listener"),
    )
    life = Window.partitionBy(*who, "session").orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    out = listed.join(said, [*who, window], "left")
    out = out.withColumns({c: F.last(c, ignorenulls=True).over(life) for c in ("_talker", "_listener")})

    # runs of Windows with listed streams, and whether a VLAN was registered in the run so far
    busy = listed.select(*by, window).distinct()
    number = F.floor(micros(window) / F.lit(period_micros(seconds)))
    busy = busy.withColumn("_run", number - F.row_number().over(Window.partitionBy(*by).orderBy(window)))
    busy = busy.join(vlans.select(*by, window).distinct().withColumn("_vlan", F.lit(True)), [*by, window], "left")
    so_far = Window.partitionBy(*by, "_run").orderBy(window).rowsBetween(Window.unboundedPreceding, 0)
    busy = busy.select(*by, window, F.coalesce(F.max("_vlan").over(so_far), F.lit(False)).alias("_vlan"))

    kind = F.col("_talker.t")
    status = F.when(kind == "talker_failed", "failed").when(kind == "talker_advertise", "reserved").otherwise("none")
    return out.join(busy, [*by, window]).select(
        *who,
        window,
        status.alias("status"),
        F.col("_talker.priority").alias("priority"),
        F.col("_talker.failure_code").alias("failure_code"),
        F.when(kind == "talker_failed", case_of(F.col("_talker.failure_code"), RESERVATION_FAILURES, UNKNOWN_FAILURE)).alias("reason"),
        case_of(F.col("_listener.listener_state"), LISTENER_STATES).alias("listener"),
        (kind.isNull() & ~F.col("_vlan")).alias("no_vlan"),
    )


def announced_no_flow(devices: DataFrame, streams: DataFrame, key: str = "src_ip", window: str = "window_start") -> DataFrame:
    """Announced devices without any active flow, once, at the Window of the first announcement."""
    idle = devices.join(streams.select(key).distinct(), key, "left_anti")
    return idle.groupBy(key).agg(F.min(window).alias(window))


def class_registry(sightings: DataFrame, key: str = "src_ip", cls: str = "class", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Sender class per address: software classes replace Hardware, the latest of them counts."""
    rank = F.when(F.col(cls) == "Hardware", 0).otherwise(1)
    return sightings.groupBy(key).agg(F.max_by(cls, F.struct(rank.alias("r"), *order)).alias(cls))


def leave_monitored(leaves: DataFrame, streams: DataFrame, group: str = "group_ip", dst: str = "dst_ip") -> DataFrame:
    """Leave messages for a group that carries a stream."""
    return leaves.join(streams.select(F.col(dst).alias(group)).distinct(), group, "left_semi")


def label_sender(streams: DataFrame, devices: DataFrame, key: str = "src_ip", label: str = "label") -> DataFrame:
    """Mark AES67 streams whose sender is a known Dante device."""
    known = devices.select(key, F.col("name").alias("_name"), F.lit(True).alias("_known"))
    text = F.when(
        F.col("_known") & (F.col("protocol") == "AES67"),
        F.coalesce(F.concat(F.lit('AES67 (Dante: "'), F.col("_name"), F.lit('")')), F.lit("AES67 (Dante)")),
    ).otherwise(F.col("protocol"))
    return streams.join(known, key, "left").withColumn(label, text).drop("_name", "_known")


def source_rollup(connections: DataFrame, sources: DataFrame, key: str = "src_ip") -> DataFrame:
    """Bitrate, retransmissions and worst quality per source over its connections, as either end."""
    ends = connections.select(
        F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("_end"), "bitrate_bps", "retransmissions", "quality"
    )
    rank = case_of(F.col("quality"), QUALITY_RANK)
    partial = ends.groupBy("_end").agg(
        F.count(F.lit(1)).alias("connections"),
        F.sum("bitrate_bps").alias("bitrate_bps"),
        F.sum("retransmissions").alias("retransmissions"),
        F.max_by("quality", rank).alias("worst_quality"),
    )
    return partial.withColumnRenamed("_end", key).join(sources.select(key).distinct(), key, "left_semi")


def known_ends(
    segments: DataFrame, sources: DataFrame, src: str = "src_ip", dst: str = "dst_ip", key: str = "src_ip", by: Sequence[str] = ()
) -> DataFrame:
    """Add `src_known`/`dst_known`: whether either end is a known source of the same `by` columns (a capture). Two equi joins, no OR join."""
    ids = sources.select(*by, F.col(key).alias("_id")).distinct()
    out = segments
    for side, name in ((src, "src_known"), (dst, "dst_known")):
        flag = ids.select(*by, F.col("_id").alias(side), F.lit(True).alias(name))
        out = out.join(flag, [*by, side], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def relevant_segments(segments: DataFrame, sources: DataFrame, lo: int = 5960, hi: int = 5980, by: Sequence[str] = ()) -> DataFrame:
    """TCP segments on a media port or from/to a known source."""
    ends = known_ends(segments, sources, by=by)
    port = F.col("src_port").between(lo, hi) | F.col("dst_port").between(lo, hi)
    return ends.where(port | F.col("src_known") | F.col("dst_known")).select(*segments.columns)


def attribute_sender(segments: DataFrame, sources: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add `sender`: the source address if known, else the destination if known, else null."""
    ends = known_ends(segments, sources, by=by)
    sender = F.when(F.col("src_known"), F.col("src_ip")).when(F.col("dst_known"), F.col("dst_ip"))
    return ends.select(*segments.columns, sender.alias("sender"))


def exclude_local(df: DataFrame, local: DataFrame, key: str = "src_ip") -> DataFrame:
    """Drop sightings of the monitor's own addresses."""
    return df.join(local.select(key).distinct(), key, "left_anti")


def stream_defaults(streams: DataFrame, protocol: str = "protocol") -> DataFrame:
    """Fill unknown clock rate, packet time and media type of a stream from its protocol.

    A default clock is not confirmed, except the fixed one of ST 2110 video.
    """
    dim = literal_table(
        streams.sparkSession, STREAM_DEFAULTS, f"{protocol} string, _clock double, _ptime double, _media string"
    )
    out = streams.join(F.broadcast(dim), protocol, "left")
    have = set(streams.columns)
    fills = {"clock_hz": "_clock", "ptime_ms": "_ptime", "media_type": "_media"}
    values = {n: F.coalesce(F.col(n), F.col(d)) if n in have else F.col(d) for n, d in fills.items()}
    fixed = F.coalesce(F.col(protocol) == "2110-20", F.lit(False))
    values["clock_confirmed"] = F.coalesce("clock_confirmed", F.lit(False)) | fixed if "clock_confirmed" in have else fixed
    return out.withColumns(values).drop(*fills.values())
