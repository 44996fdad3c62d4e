"""Capability masks and clock references as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallywire.functions.binary import colon_hex, flag


def format_eui(number_hex: Column, n: int) -> Column:
    """Hex text of an n-byte identifier as lower-case colon hex, left-padded with zeros."""
    return colon_hex(F.lower(F.lpad(number_hex, 2 * n, "0")), n)


def media_kinds(caps: Column) -> Column:
    """Audio (0x0200) and video (0x0400) support of a talker or listener."""
    audio, video = flag(caps, 0x0200), flag(caps, 0x0400)
    return F.when(audio & video, "audio+video").when(audio, "audio").when(video, "video").otherwise("other")


def reservation_classes(entity_caps: Column) -> Column:
    """Stream reservation classes A (0x100) and B (0x200) of an entity."""
    a, b = flag(entity_caps, 0x100), flag(entity_caps, 0x200)
    return F.when(a & b, "Class A+B").when(a, "Class A").when(b, "Class B").otherwise("")


def describe_entity(
    entity_caps: Column, talker_caps: Column, talker_streams: Column, listener_caps: Column, listener_streams: Column
) -> dict[str, Column]:
    """Readable columns of an entity: roles, class, model support, readiness."""
    return {
        "talker": F.when(talker_streams > 0, media_kinds(talker_caps)),
        "listener": F.when(listener_streams > 0, media_kinds(listener_caps)),
        "sr_class": reservation_classes(entity_caps),
        "aem": flag(entity_caps, 0x08),
        "not_ready": flag(entity_caps, 0x20000),
    }


_REFCLK = r"^ptp=IEEE1588-200[28]:(.*):\s*(\d{1,9})\s*$"


def clock_reference(text: Column) -> Column:
    """A PTP clock reference as struct(gm, domain): identifier in colon hex, domain 0 to 255; null for anything else."""
    gm = F.lower(F.translate(F.regexp_extract(text, _REFCLK, 1), "-", ":"))
    domain = F.regexp_extract(text, _REFCLK, 2).try_cast("int")
    return F.when(domain.between(0, 255), F.struct(gm.alias("gm"), domain.alias("domain")))
