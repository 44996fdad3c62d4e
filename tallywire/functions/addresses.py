"""IPv4 addresses as numbers and text, and the address classes the rules use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_number(text: Column) -> Column:
    """Dotted text as an unsigned 32-bit number in a BIGINT; null for anything else."""
    parts = F.split(text, r"\.")
    octet = [F.get(parts, F.lit(i)).try_cast("bigint") for i in range(4)]
    valid = F.size(parts) == 4
    for o in octet:
        valid = valid & o.between(0, 255)
    total = octet[0] * F.lit(1 << 24) + octet[1] * F.lit(1 << 16) + octet[2] * F.lit(1 << 8) + octet[3]
    return F.when(valid, total)


def ip_text(number: Column) -> Column:
    """The dotted text of an address number."""
    octet = [F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.when(number.isNotNull(), F.concat_ws(".", *octet))


def network(number: Column, a: int, b: int | None = None) -> Column:
    """Whether an address number lies in a.0.0.0/8 or a.b.0.0/16."""
    lo = a << 24 if b is None else (a << 24) | (b << 16)
    size = 1 << 24 if b is None else 1 << 16
    return number.between(lo, lo + size - 1)


def is_multicast(number: Column) -> Column:
    return number.between(224 << 24, (240 << 24) - 1)


def is_aes67_group(number: Column) -> Column:
    return network(number, 239, 69)


def is_st2110_group(number: Column) -> Column:
    return network(number, 239) & ~network(number, 239, 69)


def is_dante_group(number: Column) -> Column:
    return network(number, 239, 255)


def is_link_local(ip: Column) -> Column:
    """Addresses that a device gives itself, as dotted text."""
    number = ip_number(ip)
    return network(number, 169, 254) | network(number, 172, 31)


def address_class(number: Column) -> Column:
    """Name of the narrowest class an address belongs to."""
    return (
        F.when(is_aes67_group(number), "aes67")
        .when(is_dante_group(number), "dante")
        .when(is_st2110_group(number), "st2110")
        .when(is_multicast(number), "multicast")
        .when(network(number, 169, 254) | network(number, 172, 31), "link_local")
        .otherwise("unicast")
    )
