"""Session announcements: envelope, session text, one row per media section. Narrow: each announcement stays one row
until its sections are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywire.functions.addresses import ip_number
from tallywire.functions.binary import computed_once, flag, tail, uint
from tallywire.functions.formats import clock_reference

MIME = "application/sdp"
DEFAULT_CLOCK_HZ = 48000.0


def decode_sap(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `sdp`, the session text of an announcement; null for deletions, other versions and broken text."""
    p = F.col(payload)
    head = uint(p, 0)
    announce = (F.length(p) >= 8) & (F.shiftright(head, 5) == 1) & ~flag(head, 0x04)
    start = F.when(flag(head, 0x10), 20).otherwise(8) + uint(p, 1) * 4
    df = computed_once(df, {"_body": F.when(announce & (F.length(p) > start), tail(p, start))})
    text = F.try_validate_utf8(F.col("_body").cast("string"))
    zero = F.locate("\0", text)
    body = F.when(text.startswith(MIME) & (zero > 0), F.substring(text, zero + 1, F.length(text))).otherwise(text)
    return computed_once(df, {"sdp": body}, drop=("_body",))


def _last(text: Column, pattern: str) -> Column:
    """Group 1 of the last line that matches, or null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def connection_address(connection: Column) -> Column:
    """The IPv4 address of a connection line without network type and scope, null if it has none."""
    text = F.trim(F.regexp_extract(F.trim(connection), r"^IN IP4 ([^/]*)", 1))
    return F.when(ip_number(text).isNotNull(), text)


def media_sections(df: DataFrame, text: str = "sdp", keep: tuple[str, ...] = ("announce_id", "ts")) -> DataFrame:
    """One row per media section with the session's fields.

    The text is split before every `m=` line. A section whose first line has fewer than four words is no media
    section; its lines belong to nobody, except an `i=` line, which is read as the session's. Of repeated lines the
    last one counts.
    """
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.col(text), F.lit("\n")), r"[ \t]*\r?\n[ \t]*", "\n")
    df = df.select(*keep, lines.alias("_all"))
    df = df.withColumn("_parts", F.split("_all", "\nm="))

    def is_media(part: Column) -> Column:
        return F.size(F.split(F.trim(F.substring_index(part, "\n", 1)), r"\s+")) >= 4

    media = F.filter(F.slice("_parts", 2, F.size("_parts")), is_media)
    other = F.filter("_parts", lambda part, i: (i == 0) | ~is_media(part))
    origin = F.split(_last(F.col("_all"), r"(?m)^o=(.*)$"), " ")
    df = df.select(
        *keep,
        F.coalesce(F.get(origin, F.lit(1)), F.lit("")).alias("session_id"),
        F.coalesce(_last(F.col("_all"), r"(?m)^s=(.*)$"), F.lit("")).alias("session_name"),
        F.coalesce(_last(F.array_join(other, "\n"), r"(?m)^i=(.*)$"), F.lit("")).alias("info"),
        F.posexplode(media).alias("media_ordinal", "_m"),
    )
    m = F.col("_m")
    words = F.split(F.trim(F.substring_index(m, "\n", 1)), r"\s+")
    types = F.filter(
        F.transform(F.slice(words, 4, F.size(words)), lambda x: x.try_cast("int")), lambda x: x.between(0, 255)
    )
    port = F.get(words, F.lit(1)).try_cast("int")
    df = df.withColumns(
        {
            "media_type": F.get(words, F.lit(0)),
            "port": F.when(port.between(0, 65535), port).otherwise(0),
            "payload_types": types,
            "connection_ip": connection_address(_last(m, r"(?m)^c=(.*)$")),
            "rtpmap": F.coalesce(_last(m, r"(?m)^a=rtpmap:[^ \n]* (.*)$"), F.lit("")),
            "_clock": _last(m, r"(?m)^a=rtpmap:[^ \n]* [^/\n]*/([^/\n]*)"),
            "_channels": _last(m, r"(?m)^a=rtpmap:[^ \n]* [^/\n]*/[^/\n]*/([^/\n]*)"),
            "_ptime": _last(m, r"(?m)^a=ptime:(.*)$"),
            "_timing": _last(m, r"(?m)^a=((?:ptime|framecount):.*)$"),
            "ts_refclk": F.coalesce(_last(m, r"(?m)^a=ts-refclk:(.*)$"), F.lit("")),
            "mediaclk": F.coalesce(_last(m, r"(?m)^a=mediaclk:(.*)$"), F.lit("")),
        }
    )
    clock = F.when(F.col("_clock").isNull(), 0.0).otherwise(
        F.coalesce(F.col("_clock").try_cast("double"), F.lit(DEFAULT_CLOCK_HZ))
    )
    channels = F.col("_channels").try_cast("int")
    channels = F.when(F.col("_channels").isNull(), 0).when(channels.between(0, 255), channels).otherwise(1)
    df = df.withColumns({"clock_hz": clock, "channels": channels})
    frames = F.regexp_extract("_timing", r"^framecount:\s*(\d{1,10})\s*$", 1).try_cast("bigint")
    ptime = F.when(F.col("_ptime").isNull(), 0.0).otherwise(F.coalesce(F.trim("_ptime").try_cast("double"), F.lit(1.0)))
    ptime = F.when(frames.isNotNull() & (F.col("clock_hz") > 0), frames / F.col("clock_hz") * 1000.0).otherwise(ptime)
    df = df.withColumn("ptime_ms", ptime).drop("_m", "_clock", "_channels", "_ptime", "_timing")
    claim = clock_reference(F.col("ts_refclk"))
    return df.withColumns({"claimed_gm": claim["gm"], "claimed_domain": claim["domain"]})
