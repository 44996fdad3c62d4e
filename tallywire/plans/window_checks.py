"""Checks at the end of every Window of the network report, on rows per Window, stream, clock domain or device.

Each check returns alerts (capture, Window, level, code, subject). Nothing here reads media packets again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.operators.census import bridged_windows, census_windows, ip_windows, numbered_windows, presence, refclk_windows, running_counts, window_no
from tallywire.operators.enrich import dropout_correlation, missing_clock, uncorrelated
from tallywire.operators.windows import consecutive_true, missing_evidence, per_window_last, silence_states, spike

BY = ["capture_id"]
GROUP = ["capture_id", "window_start"]
CONMON_HOLD = 60  # seconds for which a device message shows that the device is there


def alert(df: DataFrame, level: Column | str, code: str, subject: Column | None = None) -> DataFrame:
    """Rows of a check as alerts."""
    lv = F.lit(level) if isinstance(level, str) else level
    who = F.lit(None).cast("string") if subject is None else subject.cast("string")
    return df.select(*GROUP, lv.alias("level"), F.lit(code).alias("code"), who.alias("subject"))


def family(protocol: Column | str = "protocol") -> Column:
    """The family of a stream label: all subtypes of ST 2110 are one."""
    p = F.col(protocol) if isinstance(protocol, str) else protocol
    return F.when(p.startswith("2110"), "ST2110").otherwise(p)


def listed_flows(
    active: DataFrame, key: Sequence[str], until: DataFrame, seconds: float, prune: float, label: Column
) -> DataFrame:
    """Number of flows by (capture, Window, label) as the checks see them: a flow is listed up to the Window at whose end it is pruned."""
    held = silence_states(active, key, seconds=seconds, prune=prune, until=until)
    return held.groupBy(*GROUP, label.alias("label")).agg(F.count("*").alias("n"))


def listed(
    streams: DataFrame,
    stream_key: Sequence[str],
    senders: DataFrame,
    connections: DataFrame,
    avtp: DataFrame,
    until: DataFrame,
    seconds: float,
    prune: float,
) -> DataFrame:
    """Flows of every Window by label: media streams by family, `AVB` streams, `NDI` senders and `TCP` connections.

    `streams` has a row per stream and Window with packets, `senders` the TCP segments with their known `sender`, `connections` the listed
    connections per Window.
    """
    media = listed_flows(streams, stream_key, until, seconds, prune, family())
    avb = listed_flows(per_window_last(avtp, [*BY, "stream_id"]), [*BY, "stream_id"], until, seconds, prune, F.lit("AVB"))
    sent = per_window_last(senders.where(F.col("sender").isNotNull()), [*BY, "sender"])
    ndi = listed_flows(sent, [*BY, "sender"], until, seconds, prune, F.lit("NDI"))
    tcp = connections.groupBy(*GROUP, F.lit("TCP").alias("label")).agg(F.count("*").alias("n"))
    return media.unionByName(avb).unionByName(ndi).unionByName(tcp)


def missing_clocks(flows: DataFrame, clocks: DataFrame, selected: Sequence[str]) -> DataFrame:
    """(capture, Window, family, clock): listed and selected families whose kind of clock is nowhere valid."""
    return missing_clock(flows.withColumnRenamed("label", "family"), clocks, GROUP, selected)


def dropouts(clock_lost: DataFrame, clocks: DataFrame, streams: DataFrame) -> list[DataFrame]:
    """Clock losses; in a Window in which streams that the lost clock serves lose packets, one combined alert instead.

    `clocks` has every domain's state at each Window end. A clock of AVB serves no stream of these families.
    """
    state = clocks.where(F.col("protocol_kind") != "AVB").withColumn("lost", F.col("state") == "lost")
    both = dropout_correlation(state, streams.withColumn("family", family()), GROUP)
    return [uncorrelated(clock_lost, both, GROUP), alert(both, "error", "clock_dropout")]


def stream_spikes(flows: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with more than twice the flows of the three before."""
    counts = windows.join(flows.groupBy(*GROUP).agg(F.sum("n").alias("streams")), GROUP, "left").na.fill(0, ["streams"])
    return alert(spike(counts, "streams", BY).where("spike"), "warn", "stream_spike", F.col("streams"))


def multicast_checks(
    kinds: dict[str, DataFrame], devices: DataFrame, queries: DataFrame, flows: DataFrame, windows: DataFrame, seconds: float, live: bool
) -> list[DataFrame]:
    """Signs of switches that drop multicast: devices that only show themselves link-locally, and devices without any clock or querier.

    The second is judged only if the capturing host was `live`, a member of the clocks' multicast groups; a mere recording has none to miss.
    """
    never = F.lit(None).cast("bigint").alias("last")

    def since(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*BY).agg(F.min(window_no("ts", seconds)).alias("first")).select(*BY, "first", never)

    spans = {
        "conmon": presence(kinds["conmon"], [*BY, "src_ip"], "ts", seconds, CONMON_HOLD),
        "devices": since(devices),
        "names": since(kinds["dante_names"].where(F.col("name").isNotNull())),
        "ptp": since(kinds["ptp"]),
        "queries": since(queries),
    }
    known = running_counts(numbered_windows(windows, BY, "window_start", seconds), BY, spans)
    media = flows.where(~F.col("label").isin("TCP")).groupBy(*GROUP).agg(F.sum("n").alias("flows"))
    known = known.join(media, GROUP, "left").na.fill(0, ["flows"])
    only_local = (F.col("conmon") > 0) & (F.col("names") == 0) & (F.col("ptp") == 0) & (F.col("flows") == 0)
    out = [alert(consecutive_true(known, only_local, 2, BY).where("held"), "warn", "filtered_multicast")]
    if live:
        blocked = missing_evidence(known, F.col("devices") > 0, [F.col("ptp") > 0, F.col("queries") > 0], BY)
        out.append(alert(blocked, "warn", "ptp_blocked"))
    return out


def reference_clocks(sdp: DataFrame, streams: DataFrame, clocks: DataFrame) -> DataFrame:
    """Announced reference clocks of sessions with streams that are absent or not the domain's grandmaster."""
    named = clocks.select(*GROUP, "domain", "version", "gm", F.coalesce(F.col("state").isin("detected", "changed"), F.lit(False)).alias("valid"))
    found = refclk_windows(sdp, streams.select(*GROUP, F.col("dst_port").alias("port")), named, BY)
    return alert(found, "warn", "refclk_mismatch", F.concat_ws(" ", "session_id", "claimed_domain", "status"))


def discovery_checks(kinds: dict[str, DataFrame], devices: DataFrame, windows: DataFrame, until: DataFrame, seconds: float) -> list[DataFrame]:
    """Addresses, bridged networks and devices that follow no clock. `devices` are all sightings (capture, src_ip, ts)."""
    ip = ip_windows(devices, windows, BY, seconds=seconds)
    bridged = bridged_windows(kinds["conmon"], BY, seconds=seconds, retain=CONMON_HOLD, until=until)
    census = census_windows(devices, kinds["ptp"], windows, BY, seconds=seconds)
    return [
        alert(ip.where("no_address > 0"), "error", "ip_config", F.concat_ws(" ", "no_address", F.lit("without address"))),
        alert(ip.where("subnets > 0"), "warn", "ip_config", F.concat_ws(" ", "subnets", F.lit("subnets"))),
        alert(bridged, "error", "bridged_network", F.col("mac")),
        alert(census.where("missing > 0"), "warn", "followers_missing", F.col("missing")),
    ]
