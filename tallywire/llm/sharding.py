"""Deal rows to shards by a hierarchical weighted hash tree, with DataFrame functions only.

A tree has regions, a region has racks, a rack has shards; a node weighs as much as the shards below it. A row descends
level by level: at each node every child draws a number from the row's key and the child's name, and the child with the
largest `ln(u) / weight` takes the row. A child's draw does not depend on its siblings, so a changed weight moves
rows only into (or out of) the subtree whose weight changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a draw: 13 hexadecimal digits of an MD5, exact in a double.
DRAW_DIGITS = 13
#: Slots are counted per (shard, bucket); the table of buckets has at most 8 * BUCKETS rows for 8 shards.
BUCKETS = 4096


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, its path and its weight."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def tree(n: int, base: int = 8) -> list[Shard]:
    """Shards 0 to n-1. The first `base` stand four to a region and two to a rack; each later one is a region of its own,
    so that no other subtree's weight changes when it is added."""
    return [
        Shard(i, f"r{i // 4}", f"r{i // 4}k{i % 4 // 2}") if i < base else Shard(i, f"r+{i}", f"r+{i}k0") for i in range(n)
    ]


def draw(key: Column, name: str) -> Column:
    """A number in (0, 1] from a key and a node's name."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{name}:"), key)), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint") + 1) / F.lit(float(16**DRAW_DIGITS))


def _descend(key: Column, shards: Sequence[Shard], level: int = 0) -> Column:
    if level == 3:
        return F.lit(shards[0].number)
    named: dict[str, list[Shard]] = {}
    for s in shards:
        named.setdefault((s.region, s.rack, f"s{s.number}")[level], []).append(s)
    if len(named) == 1:
        return _descend(key, shards, level + 1)
    drawn = [(F.log(draw(key, n)) / F.lit(float(sum(s.weight for s in below)))).alias(n) for n, below in named.items()]
    best = F.greatest(*drawn)
    chosen = F.lit(None).cast("int")
    for d, below in reversed(list(zip(drawn, named.values()))):
        chosen = F.when(d == best, _descend(key, below, level + 1)).otherwise(chosen)
    return chosen


def shard_of(key: Column | str, shards: Sequence[Shard]) -> Column:
    """The number of the shard that takes a row with this key. A null key is the key with the name `null`."""
    key = F.col(key) if isinstance(key, str) else key
    if not shards or any(s.weight <= 0 for s in shards) or len({s.number for s in shards}) < len(shards):
        raise ValueError("a tree needs shards of positive weight with different numbers")
    return _descend(F.coalesce(key.cast("string"), F.lit("null")), shards)


def deal(docs: DataFrame, n: int = 8, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size: UTF-8 bytes of the text and 1 (a null text has none); text_crc32: of these bytes; grown_shard: with one more
    shard. slot counts a shard's rows from 0 without gaps: rows are numbered inside (shard, hash bucket of the key) and
    the rows of earlier buckets are added, so no task sorts a whole shard. Repeated keys go to one shard with a slot
    each; a null key is a key like others; an empty table gives no rows; other columns are not read.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("doc_id"), F.octet_length(data).cast("bigint").alias("n"), F.crc32(data).alias("crc"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = rows.select(
        "doc_id",
        (F.col("n") + 1).alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of("doc_id", tree(n)).alias("shard"),
        shard_of("doc_id", tree(n + 1)).alias("grown_shard"),
        F.pmod(F.xxhash64(name, F.col("n"), F.col("crc")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    starts = counts.selectExpr(
        "shard", "bucket", "sum(rows) OVER (PARTITION BY shard ORDER BY bucket) - rows AS first_slot"
    )
    numbered = placed.selectExpr(
        "*", "row_number() OVER (PARTITION BY shard, bucket ORDER BY doc_id, size, text_crc32) - 1 AS place"
    )
    # at most n * buckets rows of three numbers
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("first_slot") + F.col("place")).alias("slot"), "grown_shard"
    )
