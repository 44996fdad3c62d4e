"""Passages that repeat across documents, by hash joins over a sparse choice of suffixes.

No suffix array is built: nothing is sorted, and no match is extended word by word. Only suffixes at content-selected places are
retained: of every SPARSE neighbouring k-grams the one with the smallest hash, so two copies of a passage of `length` words retain a
suffix at the same place, at most SPARSE - 1 words from its start. Retained suffixes are joined on the hash of their first
`length - SPARSE + 1` words; those that equal no suffix of another document end here. The others stand for the windows of
`length` words that hold them, to the left and to the right; these are joined on their hash as well, and windows of two documents make up passages.

Why not sorted neighbours: the neighbour of a suffix shares the longest stretch to its right, but another document further off in the order may be the
only one that also shares the words to its left, so extending neighbours alone loses passages, and comparing all of an equal run is quadratic.

Keys are compared as (smallest, largest document), a partial aggregate: a passage on a third of all documents is one row
a task, and no list of its places is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywire.llm.ngram_join import _WORDS, mix

K, SPARSE = 8, 32
_BASE = np.uint64(0x2545F4914F6CDD1D)
_PLACE = np.uint64((1 << 24) - 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class _Powers:
    """Powers of the base and of its inverse, as many as the longest text so far needs."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                cls.up = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE), dtype=np.uint64)))
                cls.down = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, _INVERSE), dtype=np.uint64)))
        return cls.up, cls.down


class Prefix:
    """Hashes of any stretch of words from one pass: polynomials over 64 bits."""

    def __init__(self, h: np.ndarray):
        up, self.down = _Powers.to(len(h))
        with np.errstate(over="ignore"):
            # sum of h[i] * base^i; a stretch is a difference, shifted by the power of its start
            self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))

    def hash(self, starts: np.ndarray, length: int, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[starts + length] - self.sums[starts]) * self.down[starts], seed)


def retained(h: np.ndarray, prefix: Prefix, length: int) -> np.ndarray:
    """The retained place of every window of `length` words: the leftmost smallest of its first SPARSE k-grams. The minimum runs
    over numbers that hold 40 bits of the k-gram's hash and its place, widened step by step."""
    n = len(h) - K + 1
    with np.errstate(over="ignore"):
        grams = (prefix.sums[K:] - prefix.sums[:n]) * prefix.down[:n] * np.uint64(0x9E3779B97F4A7C15)
    least = (grams & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    width = 1
    while width < SPARSE:
        step = min(width, SPARSE - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    starts = np.arange(len(h) - length + 1)
    low = (least[: len(starts)] & _PLACE).astype(np.int64)
    return starts + ((low - starts) & int(_PLACE))  # a place is near its window, so its lower bits tell it in a text of any length


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, places, keys = [], [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            h = _WORDS.hashes(t)
            if len(h) < length:
                continue
            p = Prefix(h)
            at = np.unique(retained(h, p, length))
            found.append(p.hash(at, length - SPARSE + 1, 22).view(np.int64))
            places.append(at.astype(np.int32))
            keys.append(np.full(len(at), i))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(places))], ["suffix", "key", "place"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        size = pa.array([len(x) for x in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.compress(x).to_pybytes() for x in raw], pa.binary()), size], ["key", "data", "size"])


def _extended(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        found, begins, keys = [], [], []
        for i, (data, size, at) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            h = _WORDS.hashes(codec.decompress(data, size).to_pybytes().decode("utf-8", "surrogatepass"))
            p = Prefix(h)
            starts = np.flatnonzero(np.isin(retained(h, p, length), np.array(at)))
            found.append(p.hash(starts, length, 23).view(np.int64))
            begins.append(starts.astype(np.int32))
            keys.append(np.full(len(starts), i))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(pa.array(np.concatenate(keys))), pa.array(np.concatenate(begins))], ["window", "key", "start"])


def _in_two(rows: DataFrame, by: str) -> DataFrame:
    """The values of `by` that two different keys have."""
    return rows.groupBy(by).agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select(by)


def repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word_from, word_to, n_words): the longest stretches of words all of whose windows of `length` words occur in another document
    as well. Words are separated by white space and compared exactly; word_to is exclusive.

    Repeats inside one document do not count. Texts of fewer than `length` words, empty and null texts have none. Rows
    with a null key are left out; keys must identify texts; an empty table gives no rows; other columns are not read.
    """
    if length < K + SPARSE:
        raise ValueError(f"length must be {K + SPARSE} words or more")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    suffixes = rows.mapInArrow(lambda it: _suffixes(it, length), f"suffix bigint, key {kind}, place int")
    places = suffixes.join(_in_two(suffixes, "suffix"), "suffix", "left_semi").groupBy("key").agg(F.collect_list("place").alias("places"))
    again = rows.mapInArrow(_packed, f"key {kind}, data binary, size bigint").join(places, "key").select("key", "data", "size", "places")
    windows = again.mapInArrow(lambda it: _extended(it, length), f"window bigint, key {kind}, start int")
    found = windows.join(_in_two(windows, "window"), "window", "left_semi").select("key", "start")
    edge = found.selectExpr("*", "start - lag(start) OVER (PARTITION BY key ORDER BY start) AS step")
    island = edge.selectExpr("*", "sum(CASE WHEN step <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY start) AS island")
    spans = island.groupBy("key", "island").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    word_to = F.col("b") + length
    return spans.select(F.col("key").alias(key), F.col("a").cast("bigint").alias("word_from"), word_to.cast("bigint").alias("word_to"), (word_to - F.col("a")).cast("bigint").alias("n_words"))
