"""The whole report of a capture, from frames to score, alerts and devices.

Packets are read by a few keyed aggregations; every check after that works on rows per Window, stream, clock domain,
connection or device.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import micros, period_micros
from tallywire.operators.chunks import with_last_known
from tallywire.operators.classify import dscp_violation, expand_choices, is_software, pcp_advisory, pt_mismatch, sender_verdict
from tallywire.operators.enrich import announce_enrich, attribute_sender, class_registry, device_registry, relevant_segments, reservation_timeline, stream_defaults
from tallywire.operators.sequence import connection_quality, tcp_retransmissions
from tallywire.operators.state import alerts, clock_state
from tallywire.operators.timing import timing_regularity
from tallywire.operators.windows import (
    WINDOW_SECONDS,
    bandwidth,
    conflicting_senders,
    densify,
    distinct_per_group,
    per_window_last,
    querier_state,
    silence_states,
    sync_conflict,
    version_mismatch,
    window_counters,
)
from tallywire.plans.health import stream_windows, with_silence
from tallywire.plans.packets import CHUNK, ORDER, STREAM_KEY, kind_tables, packets_table, selected_packets, stream_packets
from tallywire.plans.report import window_report
from tallywire.plans.scoring import Limits, health_score, infrastructure_deductions, penalties, stream_diagnostics
from tallywire.plans.window_checks import (
    BY,
    GROUP,
    alert,
    discovery_checks,
    dropouts,
    listed,
    missing_clocks,
    multicast_checks,
    reference_clocks,
    stream_spikes,
)

PRUNE = 20  # seconds of silence after which a stream, connection or reservation is forgotten
# Fixed value: the address that general group queries go to.
ALL_SYSTEMS = "224.0.0.1"


@dataclass(frozen=True)
class NetworkReport:
    """Tables of one run; the stages they read are stored."""

    packets: DataFrame
    streams: DataFrame
    diagnostics: DataFrame
    penalties: DataFrame
    report: DataFrame
    alerts: DataFrame
    devices: DataFrame
    reservations: DataFrame


def sightings(kinds: dict[str, DataFrame]) -> DataFrame:
    """Where each sender's class was seen: control-plane messages, and device announcements, which only hardware sends."""
    control = kinds["control_plane"].select("capture_id", "src_ip", *ORDER, "class")
    devices = kinds["conmon"].select("capture_id", "src_ip", *ORDER, F.lit("Hardware").alias("class"))
    return control.unionByName(devices).select(F.struct("capture_id", "src_ip").alias("_who"), *ORDER, "class")


#: What the stream metrics read of a media packet; payloads stay in the packets table.
MEDIA_COLUMNS = [*STREAM_KEY, *ORDER, *CHUNK, "rtp_seq", "rtp_ts", "rtp_ssrc", "rtp_pt", "frame_bytes", "dscp", "ecn", "pcp", "ttl", "is_multicast"]


def media_packets(packets: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Media packets with announced fields, defaults, and flags for wrong marks and payload types. `unmarked` tells which
    wrong marks are forgiven if the sender turns out to be software."""
    media = stream_packets(packets).select(*MEDIA_COLUMNS)
    media = announce_enrich(media, kinds["sdp"], order=ORDER, chunk=CHUNK, by=BY)
    media = media.withColumnsRenamed({"announced_clock_hz": "clock_hz", "announced_ptime_ms": "ptime_ms"})
    media = stream_defaults(media.withColumn("expected_pt", F.col("announced_expected_pt")))
    wrong = dscp_violation()
    unmarked = wrong & F.coalesce(~dscp_violation(software=F.lit(True)), F.lit(False))
    return media.withColumns({"dscp_viol": wrong, "unmarked": unmarked, "pcp_viol": pcp_advisory(), "pt_mismatch": pt_mismatch()})


def software_streams(packets: DataFrame, rows: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Whether each Dante stream comes from software, by the signals of the whole stream: `rows` are its Windows."""
    ttl = rows.where(F.col("protocol") == "Dante").groupBy(*STREAM_KEY).agg(F.min("min_ttl").alias("_ttl"))
    dante = stream_packets(packets).where(F.col("protocol") == "Dante").select(*STREAM_KEY, *CHUNK, "ts")
    timing = timing_regularity(dante, STREAM_KEY, "ts", CHUNK)
    classes = class_registry(sightings(kinds), "_who", order=ORDER).select("_who.capture_id", F.col("_who.src_ip").alias("stream_src"), "class")
    soft = ttl.join(timing, STREAM_KEY, "left").join(classes, ["capture_id", "stream_src"], "left")
    return soft.select(*STREAM_KEY, is_software(F.col("class"), F.col("regularity"), F.col("_ttl")).alias("_soft"))


def sender_classes(packets: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """Class, confidence and number of signals of every Dante stream's sender."""
    dante = stream_packets(packets).where(F.col("protocol") == "Dante")
    signals = dante.groupBy(*STREAM_KEY).agg(F.min("ttl").alias("_ttl"), F.min_by("dscp", F.struct(*ORDER)).alias("_dscp"))
    timing = timing_regularity(dante, STREAM_KEY, "ts", CHUNK)
    classes = class_registry(sightings(kinds), "_who", order=ORDER).select("_who.capture_id", F.col("_who.src_ip").alias("stream_src"), "class")
    out = signals.join(timing, STREAM_KEY, "left").join(classes, ["capture_id", "stream_src"], "left")
    v = sender_verdict(F.col("class"), F.col("regularity"), F.col("_ttl"), F.col("_dscp"))
    return out.select(*STREAM_KEY, v.alias("_v")).select(*STREAM_KEY, "_v.*")


def _factor(df: DataFrame, code: Column | str, n: Column, scope: Column | None = None) -> DataFrame:
    name = F.lit(code) if isinstance(code, str) else code
    where = F.lit("") if scope is None else scope.cast("string")
    return df.select(*GROUP, name.alias("code"), where.alias("scope"), n.cast("bigint").alias("n"))


def with_event_window(events: DataFrame, seconds: float) -> DataFrame:
    """Add the Window of a clock event. A loss is found at a Window end and belongs to the Window that ends there."""
    length = F.lit(period_micros(seconds)).cast("bigint")
    us = micros("ts") - F.when(F.col("event") == "lost", 1).otherwise(0)
    return events.withColumn("window_start", F.timestamp_micros(us - F.pmod(us, length)))


def clock_windows(ptp: DataFrame, events: DataFrame, windows: DataFrame, seconds: float) -> DataFrame:
    """State, grandmaster named last, kind and number of changes of every clock domain at each Window end from its first message on."""
    key = ["capture_id", "domain", "version"]
    at = F.struct(*ORDER)
    said = ptp.groupBy(*key, "window_start").agg(
        F.max_by("protocol_kind", at).alias("_kind"), F.max_by("grandmaster_id", F.when(F.col("grandmaster_id").isNotNull(), at)).alias("_gm")
    )
    per = with_event_window(events, seconds).groupBy(*key, "window_start").agg(
        F.max_by("event", F.struct("ts", F.col("event") == "lost")).alias("_state"),
        F.count_if(F.col("event") == "changed").alias("_changes"),
    )
    first = ptp.groupBy(*key).agg(F.min("window_start").alias("_first"))
    last = windows.groupBy(*BY).agg(F.max("window_start").alias("_last"))
    each = F.sequence(micros("_first"), micros("_last"), F.lit(period_micros(seconds)).cast("bigint"))
    grid = first.join(last, BY).select(*key, F.explode(each).alias("_us"))
    grid = grid.withColumn("window_start", F.timestamp_micros("_us")).drop("_us")
    w = Window.partitionBy(*key).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(per, [*key, "window_start"], "left").join(said, [*key, "window_start"], "left").withColumns(
        {
            "state": F.last("_state", ignorenulls=True).over(w),
            "gm": F.last("_gm", ignorenulls=True).over(w),
            "protocol_kind": F.last("_kind", ignorenulls=True).over(w),
            "changes": F.sum(F.coalesce("_changes", F.lit(0))).over(w),
        }
    )
    out = out.withColumn("valid", F.coalesce(F.col("state").isin("detected", "changed"), F.lit(False)))
    return out.drop("_state", "_changes", "_gm", "_kind")


def connection_windows(tcp: DataFrame, seconds: float, until: Column | DataFrame) -> DataFrame:
    """Retransmissions, resets and quality of every TCP connection per Window up to the one at whose end it is pruned (`state`)."""
    key = ["capture_id", "src_ip", "dst_ip", "src_port", "dst_port"]
    sums = {"rst_n": F.col("rst"), "fin_n": F.col("fin")}
    per = tcp_retransmissions(tcp, key, ORDER, "tcp_seq", F.col("syn"), 32, CHUNK, ["window_start"], sums, prune=PRUNE)
    last = per_window_last(tcp, key)
    states = silence_states(last, key, seconds=seconds, prune=PRUNE, until=until)
    out = states.join(per, [*key, "window_start"], "left").na.fill(0, ["retransmissions", "rst_n", "fin_n"])
    w = Window.partitionBy(*key, "session").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    quality = connection_quality(F.sum("rst_n").over(w), F.sum("fin_n").over(w), F.sum("retransmissions").over(w))
    # A terminated connection leaves the list at once, so it counts only in Windows with packets.
    return out.withColumn("quality", quality).where((F.col("quality") != "terminated") | F.col("packets").isNotNull())


def reservation_windows(avtp: DataFrame, msrp: DataFrame, until: Column | DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Per AVB stream and Window until it is pruned: frames whose priority breaks the declaration then in force, and whether the
    reservation in force at the end of the Window has failed."""
    key = ["capture_id", "stream_id"]
    talkers = msrp.where(F.col("decl_type") != "listener").select(
        "capture_id", *ORDER, *CHUNK, "stream_id", F.col("priority").alias("_p"), (F.col("decl_type") == "talker_failed").alias("_f")
    )
    rows = avtp.select("capture_id", *ORDER, *CHUNK, "stream_id", "pcp", F.lit(True).alias("_frame"))
    known = with_last_known(rows.unionByName(talkers, allowMissingColumns=True), key, ORDER, CHUNK, {"_declared": "_p"})
    broken = known.where(F.col("_frame")).groupBy(*key, "window_start").agg(F.count_if(F.col("pcp") != F.col("_declared")).alias("pcp_viol"))
    seen = rows.select(*key, "ts", "window_start").unionByName(talkers.select(*key, "ts", "window_start"))
    states = silence_states(per_window_last(seen, key), key, seconds=seconds, prune=PRUNE, until=until).where(F.col("state") != "pruned")
    last = talkers.groupBy(*key, "window_start").agg(F.max_by("_f", F.struct(*ORDER)).alias("_f"))
    life = Window.partitionBy(*key, "session").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    out = states.select(*key, "session", "window_start").join(last, [*key, "window_start"], "left").join(broken, [*key, "window_start"], "left")
    return out.select(
        *key,
        "window_start",
        F.coalesce("pcp_viol", F.lit(0)).alias("pcp_viol"),
        F.coalesce(F.last("_f", ignorenulls=True).over(life), F.lit(False)).alias("failed"),
    )


def stage(df: DataFrame, root: str, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Store an intermediate table under `root` and read it back: computed once, and safe when executors are lost."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


def network_report(
    frames: DataFrame,
    root: str,
    choices: Sequence[str] = ("all",),
    seconds: float = WINDOW_SECONDS,
    limits: Limits = Limits(),
    live: bool = True,
) -> NetworkReport:
    """Every section of the report for the chosen protocols, one set of rows per capture.

    `root` is a shared folder for the stages. Packets are stored by capture and kind, so each kind reads its own
    partitions only. `live` tells that the capturing host had joined the clocks' multicast groups; without it the alert `ptp_blocked` is not judged.
    """
    everything = stage(packets_table(frames, seconds), root, "packets", ["capture_id", "kind"])
    packets = selected_packets(everything, choices)
    kinds = {name: stage(df, root, name) for name, df in kind_tables(packets).items()}
    # a capture ends with its own last frame
    until = stage(everything.groupBy(*BY).agg(F.max("window_start").alias("until")), root, "ends")
    tcp = relevant_segments(kinds["tcp"], kinds["ndi_sources"], by=BY)

    extra = {
        "_unmarked": ("sum", F.col("unmarked").cast("bigint")),
        "ecn_marks": ("sum", (F.col("ecn") == 3).cast("bigint")),
        "_multicast": ("max", F.col("is_multicast").cast("int")),
        "_rtp": ("max", F.col("rtp_seq").isNotNull().cast("int")),
        "_confirmed": ("max", F.col("clock_confirmed").cast("int")),
    }
    # packets are read and shuffled once from the packets table to one row per stream and Window
    streams = stream_windows(media_packets(packets, kinds), STREAM_KEY, ORDER, chunk=CHUNK, extra=extra, prune=PRUNE)
    packet_windows = stage(streams, root, "stream_windows")
    streams = packet_windows.join(software_streams(packets, packet_windows, kinds), STREAM_KEY, "left")
    forgiven = F.when(F.col("_soft"), F.col("_unmarked")).otherwise(0)
    streams = streams.withColumn("dscp_viol", F.col("dscp_viol") - forgiven).drop("_soft", "_unmarked")
    streams = with_silence(streams, STREAM_KEY, until, seconds=seconds, prune=PRUNE)
    life = Window.partitionBy(*STREAM_KEY, "session").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    streams = streams.withColumns(
        {
            "rtp_seen": F.coalesce(F.max("_rtp").over(life) == 1, F.lit(False)),
            "clock_confirmed": F.coalesce(F.max("_confirmed").over(life) == 1, F.lit(False)),
            "multicast": F.coalesce(F.max("_multicast").over(life) == 1, F.lit(False)),
            "min_ttl": F.min("min_ttl").over(life),
            "jitter_ms": F.last("jitter_ms", ignorenulls=True).over(life),
        }
    ).drop("_rtp", "_confirmed", "_multicast")
    streams = stage(streams, root, "streams")

    pause = F.when(F.hex(F.substring("payload", 1, 2)) == "0001", "pause").when(F.hex(F.substring("payload", 1, 2)) == "0101", "pfc")
    # traffic is counted before any selection
    marked = everything.withColumn("kind", F.when(F.col("kind") == "flow_control", pause).otherwise(F.col("kind")))
    counters = window_counters(
        marked, BY, retransmission=F.coalesce("rst", F.lit(False)), dispatched=F.col("kind").isNotNull()
    )
    counters = stage(counters, root, "counters")
    windows = densify(counters.select(*GROUP), BY, seconds=seconds)
    active = streams.where(F.col("multicast")).select(*GROUP).distinct()

    queries = kinds["igmp"].where((F.col("igmp_kind") == "query") & (F.col("group_ip") == ALL_SYSTEMS))
    state = windows.join(active.withColumn("active_multicast", F.lit(True)), GROUP, "left").na.fill(False, ["active_multicast"])
    querier = stage(querier_state(queries, state, BY, "ts", ORDER, chunk=CHUNK, seconds=seconds), root, "querier")
    conflicts = stage(conflicting_senders(queries, active, BY), root, "conflicts")
    clock_key = ["capture_id", "domain", "version"]
    clock_events = stage(clock_state(kinds["ptp"], clock_key, ORDER, chunk=CHUNK, seconds=seconds, until=until), root, "clock_events")
    clocks = stage(clock_windows(kinds["ptp"], clock_events, windows, seconds), root, "clocks")
    held = stage(connection_windows(tcp, seconds, until), root, "connections")
    connections = held.where(F.col("state") != "pruned")
    senders = attribute_sender(tcp, kinds["ndi_sources"], by=BY)
    flows = stage(listed(packet_windows, STREAM_KEY, senders, held, kinds["avtp"], until, seconds, PRUNE), root, "flows")
    reserved = stage(reservation_windows(kinds["avtp"], kinds["msrp"], until, seconds), root, "reserved")
    ports = kinds["eee"].groupBy("capture_id", "chassis_id", "port_id").agg(F.min("window_start").alias("window_start"))
    running = Window.partitionBy(*BY).orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    eee = windows.join(ports.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")), GROUP, "left")
    eee = eee.withColumn("_n", F.sum(F.coalesce("_n", F.lit(0))).over(running))

    one = F.lit(1)
    domain = F.concat_ws("/", F.col("domain").cast("string"), F.col("version").cast("string"))
    poor = connections.where(F.col("quality") != "healthy")
    factors = [
        _factor(poor, F.concat(F.lit("tcp_"), F.col("quality")), one, F.concat_ws(":", "src_ip", "src_port", "dst_ip", "dst_port")),
        _factor(
            connections.groupBy(*GROUP).agg((F.sum("retransmissions") + F.sum("rst_n")).alias("_n")), "tcp_retransmissions", F.col("_n")
        ),
        _factor(streams.groupBy(*GROUP).agg(F.sum("ecn_marks").alias("_n")), "ecn", F.coalesce("_n", F.lit(0))),
        _factor(querier.where(F.col("penalised")), "querier_absent", one),
        _factor(conflicts.select(*GROUP).distinct(), "multiple_queriers", one),
        _factor(clocks.where(F.col("state") == "lost"), "clock_lost", one, domain),
        _factor(clocks.where(F.col("state").isNull()), "no_grandmaster", one, domain),
        _factor(clocks.where(F.col("changes") > 0), "grandmaster_changed", F.col("changes"), domain),
        _factor(reserved.where(F.col("pcp_viol") > 0), "avb_pcp", one, F.col("stream_id")),
        _factor(reserved.where(F.col("failed")), "reservation_failed", one, F.col("stream_id")),
        _factor(eee, "eee", F.col("_n")),
    ]
    every = factors[0]
    for f in factors[1:]:
        every = every.unionByName(f)

    found = stream_diagnostics(streams, [*GROUP, *[k for k in STREAM_KEY if k not in GROUP]], limits)
    charged = stage(penalties(found, infrastructure_deductions(every, GROUP), GROUP), root, "penalties")
    score = health_score(charged, windows, GROUP)
    labels = distinct_per_group(streams, [*GROUP, "protocol"], ["stream_src", "dst_ip", "dst_port"])

    syncs = kinds["ptp"].where((F.col("version") == 1) & (F.col("message_type") == 0))
    clash = sync_conflict(syncs, ["capture_id", "domain", "window_start"])
    fast = bandwidth(counters, queries, BY, seconds=seconds).where(F.col("high_multicast"))
    reports = kinds["igmp"].where(F.col("igmp_kind") == "v3_report")
    versions = version_mismatch(queries.withColumn("version", F.col("igmp_version")), reports, BY)
    sightings_of = [kinds[k].select("capture_id", "src_ip", "ts") for k in ("dante_names", "conmon", "control_plane")]
    seen_devices = stage(sightings_of[0].unionByName(sightings_of[1]).unionByName(sightings_of[2]), root, "device_sightings")
    lost = with_event_window(clock_events, seconds).where(F.col("event") == "lost")
    raised = alerts(
        *dropouts(alert(lost, "error", "clock_lost", domain), clocks, streams),
        stream_spikes(flows, windows),
        alert(querier.where(F.col("slow_queries")), "info", "slow_queries", F.col("interval_secs")),
        alert(conflicts, "error", "multiple_queriers", F.col("src_ip")),
        alert(versions, "warn", "version_mismatch"),
        *multicast_checks(kinds, seen_devices, queries, flows, windows, seconds, live),
        alert(fast, "warn", "high_multicast"),
        reference_clocks(kinds["sdp"], streams, clocks),
        *discovery_checks(kinds, seen_devices, windows, until, seconds),
        alert(clash, F.col("level"), "sync_conflict", F.col("domain")),
    )
    who = F.struct("capture_id", "src_ip").alias("device")
    seen = [kinds[k].select(who, *[c for c in ("ts", "name") if c in kinds[k].columns]) for k in ("dante_names", "conmon", "control_plane")]
    devices = device_registry(seen, "device").select("device.*", "first_seen", "last_seen", "name")
    reservations = reservation_timeline(
        kinds["avtp"], kinds["msrp"], kinds["mvrp"], BY, order=[*ORDER, "decl_no"], seconds=seconds, prune=PRUNE, until=until
    )
    reservations = stage(reservations, root, "reservations")
    report = window_report(counters, score, labels, missing_clocks(flows, clocks, expand_choices(choices)), by=BY)
    return NetworkReport(packets, streams, found, charged, report, raised, devices, reservations)
