"""Fixed code tables and the join that applies them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Timestamp step per packet, clock rate in Hz, packet time in ms.
KNOWN_STEPS = [
    (48, 48000.0, 1.0),
    (24, 48000.0, 0.5),
    (96, 48000.0, 2.0),
    (192, 48000.0, 4.0),
    (384, 48000.0, 8.0),
    (480, 48000.0, 10.0),
    (960, 48000.0, 20.0),
    (12, 48000.0, 0.25),
    (6, 48000.0, 0.125),
    (441, 44100.0, 10.0),
    (882, 44100.0, 20.0),
]

# Stream-reservation failure codes.
RESERVATION_FAILURES = [
    (1, "insufficient bandwidth"),
    (2, "insufficient bridge resources"),
    (3, "insufficient bandwidth for Traffic Class"),
    (4, "StreamID already in use by another Talker"),
    (5, "stream destination address already in use"),
    (6, "stream pre-empted by a higher-rank stream"),
    (7, "reported latency has changed"),
    (8, "egress port is not AVB-capable"),
    (9, "use a different destination address"),
    (10, "out of MSRP resources"),
    (11, "out of MMRP resources"),
    (12, "cannot store destination address"),
    (13, "requested priority is not an SR Class priority"),
    (14, "MaxFrameSize too large for the media"),
    (15, "max fan-in ports limit reached"),
    (16, "changed FirstValue for a registered StreamID"),
    (17, "VLAN blocked on this egress port (registration forbidden)"),
    (18, "VLAN tagging disabled on this egress port"),
    (19, "SR class priority mismatch"),
]
UNKNOWN_FAILURE = "unknown failure"

# AVTP subtype names.
AVTP_SUBTYPES = [
    (0x00, "IEC 61883"),
    (0x01, "MMA Streams"),
    (0x02, "CRF"),
    (0x03, "CVF"),
    (0x04, "CEF"),
    (0x7E, "MAAP"),
    (0x7F, "Experimental"),
]
UNKNOWN_SUBTYPE = "AVTP"

# PTPv2 clock classes.
CLOCK_CLASSES = [
    (6, "Primary reference — locked"),
    (7, "Primary reference — free-running"),
    (52, "Application-specific"),
    (135, "Primary reference — holdover"),
    (165, "Default"),
    (187, "Slave-only"),
    (255, "Slave-only"),
]

# PTPv2 clock accuracy as inclusive code ranges.
CLOCK_ACCURACY = [
    (0x20, 0x21, "< 100 ns"),
    (0x22, 0x23, "< 1 µs"),
    (0x24, 0x25, "< 10 µs"),
    (0x26, 0x27, "< 100 µs"),
    (0x28, 0x29, "< 1 ms"),
    (0xFE, 0xFE, "unknown precision"),
]
OTHER_ACCURACY = "other"

# PTPv1 strata with a name, and the clock identifiers that are shown.
STRATA = [(0, "Preferred grandmaster"), (1, "Primary reference"), (2, "Secondary reference")]
V1_IDENTIFIERS = "GPS ATOM NTP HAND INIT DFLT PPS ACTS USNO PTB TDF DCF MSF WWVB GOES GLN LORC".split()

# PTPv2 message types; PTPv1 control codes with the v2 type they correspond to.
PTP2_MESSAGES = [
    (0x0, "Sync"),
    (0x1, "Delay_Req"),
    (0x2, "P_Delay_Req"),
    (0x3, "P_Delay_Resp"),
    (0x8, "Follow_Up"),
    (0x9, "Delay_Resp"),
    (0xA, "P_Delay_Resp_Follow_Up"),
    (0xB, "Announce"),
    (0xC, "Signaling"),
    (0xD, "Management"),
]
PTP1_CONTROLS = [(0, 0x00, "Sync"), (1, 0x01, "Delay_Req"), (2, 0x08, "Follow_Up"), (3, 0x09, "Delay_Resp"), (4, 0x0D, "Management")]
PTP1_OTHER = (0xFF, "Unknown")

# State carried by a Listener declaration.
LISTENER_STATES = [(0, "ignore"), (1, "asking failed"), (2, "ready"), (3, "ready failed")]

# Defaults of a new stream per label: clock rate, packet time in ms (0 = unknown), media type.
STREAM_DEFAULTS = [
    ("AES67", 48000.0, 0.0, "audio"),
    ("2110-20", 90000.0, 0.0, "video"),
    ("2110-30", 48000.0, 1.0, "audio"),
    ("2110-40", 48000.0, 0.0, "ancillary"),
    ("2110-??", 48000.0, 0.0, "unknown"),
    ("Dante", 48000.0, 1.0, "unknown"),
    ("NDI", 0.0, 0.0, "unknown"),
]

# DSCP marks that comply, per label.
ALLOWED_DSCP = [
    ("AES67", 46),
    ("2110-20", 46),
    ("2110-20", 40),
    ("2110-20", 34),
    ("2110-30", 46),
    ("2110-40", 46),
    ("2110-??", 46),
    ("Dante", 46),
]


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A code table of fixed size as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def case_of(code: Column, table: Sequence[tuple], default: Column | str | None = None) -> Column:
    """The text for a code as one CASE expression; for `(lo, hi, text)` rows the code's range decides."""
    out = None
    for row in table:
        hit = code == row[0] if len(row) == 2 else code.between(row[0], row[1])
        out = F.when(hit, row[-1]) if out is None else out.when(hit, row[-1])
    return out.otherwise(F.lit(default) if isinstance(default, str) or default is None else default)


def lookup(
    df: DataFrame, table: Sequence[tuple], on: str, schema: str, default: str | None = None, text: str = "text"
) -> DataFrame:
    """Left join with a fixed code table; rows `(code, text)` or ranges `(lo, hi, text)`."""
    dim = F.broadcast(literal_table(df.sparkSession, table, schema))
    first = dim.columns[0]
    if len(dim.columns) == 2:
        out = df.join(dim.withColumnRenamed(first, on), on, "left")
    else:
        lo, hi = dim.columns[0], dim.columns[1]
        out = df.join(dim, F.col(on).between(F.col(lo), F.col(hi)), "left").drop(lo, hi)
    return out.withColumn(text, F.coalesce(text, F.lit(default))) if default is not None else out
