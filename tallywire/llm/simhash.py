"""SimHash near-duplicate detection by pigeonhole blocks.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two fingerprints that differ in at most MOST bits agree on all but MOST blocks,
so for some choice of BLOCKS - MOST blocks they agree on the whole choice: each choice with its bits is a key, pairs are found by an
equi-join on keys and verified by their Hamming distance. Equal fingerprints are one node before that, however many copies have them.

A key of more than CROWD different fingerprints (a large family of edited copies) is not joined with itself, which would grow with the
square of the family. Its fingerprints list every value within MOST / 2 flipped bits instead: two fingerprints are within MOST
bits exactly if they list a common value, so each is linked to the smallest one that lists the same value. A value is listed by as many
fingerprints as lie around it, at most 2081 for MOST = 4; the rows grow in proportion to the family.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.common import components, stored

BITS, BLOCKS, MOST, CROWD, SEED = 64, 7, 4, 256, 42


def shingle_hashes(text: str | None, n: int = 4) -> np.ndarray:
    """XXH64 of every n-word shingle in order, repeats included; with fewer words of the whole sequence; none without words.
    Only A-Z are lowered, words end at the six ASCII white-space characters, shingles are joined by one blank."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    digest = xxhash.xxh64_digest
    parts = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]
    return np.frombuffer(b"".join(parts), ">u8").astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint as a signed number: a bit is 1 if set in over half the hashes; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text as a bigint. One narrow pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [simhash(shingle_hashes(t, n)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(rows, f"key {kind}, fp bigint")


def masks(blocks: int = BLOCKS, most: int = MOST) -> list[int]:
    """The bits of every choice of blocks - most blocks, as signed numbers."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    whole = [sum(block[i] for i in choice) for choice in combinations(range(blocks), blocks - most)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in whole]


def _around(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(value, fp): every value within most / 2 flipped bits of a fingerprint."""
    one = [np.uint64(1) << np.uint64(i) for i in range(BITS)]
    flips = [np.uint64(0)]
    for size in range(1, most // 2 + 1):
        flips += [np.bitwise_or.reduce(np.array(c, np.uint64)) for c in combinations(one, size)]
    flips = np.array(flips, np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 64):
            some = fps[at : at + 64]
            values = (some.view(np.uint64)[:, None] ^ flips).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(some, len(flips)))], ["value", "fp"])


def links(nodes: DataFrame, most: int = MOST, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Of different fingerprints (fp), pairs (x, y) within `most` bits whose components are those of all such pairs. Fingerprints that share
    a key of at most `crowd` fingerprints are all compared; in larger ones each is linked to the smallest around each value."""
    if not 0 < most < blocks or most % 2:
        raise ValueError("most is even, above 0 and below blocks")
    choices = masks(blocks, most)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(choices)])
    signed = nodes.select("fp", F.explode(keys).alias("k")).select("k.*", "fp")
    crowded = stored(signed.groupBy("choice", "bits").count().where(F.col("count") > crowd).select("choice", "bits"), "crowded")
    few = signed.join(crowded, ["choice", "bits"], "left_anti")
    # both sides are dealt out: Spark sizes the exploded keys like the fingerprints, 35 times too low, and would broadcast them
    x, y = few.withColumnRenamed("fp", "x").hint("merge"), few.withColumnRenamed("fp", "y").hint("merge")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= most
    pairs = x.join(y, (x["choice"] == y["choice"]) & (x["bits"] == y["bits"]) & (F.col("x") < F.col("y")) & near).select("x", "y")
    many = stored(signed.join(crowded, ["choice", "bits"], "left_semi").select("fp").distinct(), "crowd")
    around = many.mapInArrow(lambda it: _around(it, most), "value bigint, fp bigint")
    heads = around.selectExpr("min(fp) OVER (PARTITION BY value) AS x", "fp AS y").where("x < y").where(near)
    return pairs.union(heads).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 4, most: int = MOST, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint, component_id) of every row: the fingerprint as 16 hexadecimal digits, and the smallest key reachable over
    fingerprints that differ in at most `most` bits, its own included.

    Null, empty and blank texts have the fingerprint zero and are linked like any other. Rows with a null key have a fingerprint,
    a null component_id and no links. Repeated keys stay as rows, each linked by its own text; two texts of which the same key is the
    smallest are linked by that key. An empty table gives no rows.
    Other columns are not read, so their names do not matter. More blocks make longer keys and more of them: 7 give 35 keys of
    about 27 bits, 9 give 126 of about 35 bits, for tables where 2^27 is not large against the number of different texts.
    """
    rows = stored(fingerprints(docs, key, text, n), "fingerprints")
    nodes = stored(rows.where("key IS NOT NULL").groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    found = links(nodes.select("fp"), most, blocks, crowd)
    ends = found.join(nodes.toDF("x", "a"), "x").join(nodes.toDF("y", "b"), "y").select("a", "b")
    labels = components(ends).toDF("first", "component_id")
    named = nodes.join(labels, "first", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(named, "fp", "left").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"),
    )
