"""Unsigned integers, hex text and slices out of BINARY columns, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Offset = int | Column


def _pos(offset: Offset) -> Column:
    return F.lit(offset + 1) if isinstance(offset, int) else (offset + 1).cast("int")


def cut(data: Column, offset: Offset, n: int | Column) -> Column:
    """`n` bytes from 0-based `offset` (fewer at the end of the data)."""
    return F.substring(data, _pos(offset), F.lit(n) if isinstance(n, int) else n.cast("int"))


def tail(data: Column, offset: Offset) -> Column:
    """Everything from `offset` on."""
    return F.substring(data, _pos(offset), F.length(data))


def hex_at(data: Column, offset: Offset, n: int) -> Column:
    """Lower-case hex of exactly `n` bytes, null if the data is shorter."""
    text = F.lower(F.hex(cut(data, offset, n)))
    return F.when(F.length(text) == 2 * n, text)


def uint(data: Column, offset: Offset, n: int = 1) -> Column:
    """Big-endian unsigned integer of `n` <= 7 bytes as BIGINT, null if the data is shorter."""
    part = cut(data, offset, n)
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("bigint"))


def colon_hex(text: Column, groups: int) -> Column:
    """Hex text as `groups` byte pairs joined by colons."""
    return F.when(text.isNotNull(), F.concat_ws(":", *[F.substring(text, 2 * i + 1, 2) for i in range(groups)]))


def eui(data: Column, offset: Offset, n: int) -> Column:
    """An `n`-byte identifier as colon hex."""
    return colon_hex(hex_at(data, offset, n), n)


def stream_id_text(data: Column, offset: Offset) -> Column:
    """A stream id: six bytes as colon hex, the last two as one four-digit group."""
    text = hex_at(data, offset, 8)
    mac = colon_hex(F.substring(text, 1, 12), 6)
    return F.when(text.isNotNull(), F.concat(mac, F.lit(":"), F.substring(text, 13, 4)))


def flag(value: Column, mask: int) -> Column:
    """Whether any bit of `mask` is set."""
    return value.bitwiseAND(F.lit(mask)) != 0


def computed_once(df: DataFrame, fields: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add columns that later filters and projections read but never recompute.

    A filter on a decoded column would otherwise be pushed below the projection with the whole decoding expression
    copied into it, once per reference. The one-element `inline` is the border such rewrites stop at; it stays
    inside whole-stage codegen.
    """
    kept = [c for c in df.columns if c not in drop]
    df = df.select(*kept, *[c.alias(f"_{n}") for n, c in fields.items()])
    row = F.struct(*[F.col(f"_{n}").alias(n) for n in fields])
    return df.select(*kept, F.inline(F.array(row)))
