"""Wrapping integers, microseconds and epoch-aligned periods, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def signed_wrap(value: Column, bits: int) -> Column:
    """Read `value` modulo 2^bits as a two's-complement number of that width."""
    half = 1 << (bits - 1)
    return F.pmod(value.cast("bigint") + F.lit(half), F.lit(1 << bits).cast("bigint")) - F.lit(half)


def micros(ts: Column | str) -> Column:
    return F.unix_micros(as_col(ts))


def micros_between(earlier: Column | str, later: Column | str) -> Column:
    return micros(later) - micros(earlier)


def period_micros(seconds: float) -> int:
    return int(round(seconds * MICROS))


def period_start(ts: Column | str, seconds: float) -> Column:
    """Start of the epoch-aligned period that holds `ts`."""
    us, length = micros(ts), F.lit(period_micros(seconds)).cast("bigint")
    return F.timestamp_micros(us - F.pmod(us, length))


def plus_seconds(ts: Column | str, seconds: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(period_micros(seconds)).cast("bigint"))


def block(counter: Column | str, size: int) -> Column:
    """Number of the fixed-size run of `counter` values a row falls in."""
    value, whole = as_col(counter).cast("bigint"), F.lit(size).cast("bigint")
    return F.call_function("div", value - F.pmod(value, whole), whole)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") * 100.0 / whole).otherwise(F.lit(0.0))
