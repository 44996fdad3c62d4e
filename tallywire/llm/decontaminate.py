"""Find benchmark passages in training documents, paraphrased and edited copies included.

A document is a leak of an item if the item aligned with it (Smith-Waterman over words) reaches the least score. Two looks find all
places where that can be: every word n-gram of the item is a seed, and an alignment that shares no n-gram must match so many words
that some of the item's rarest are among them. Bounds on the score then spare most of the alignments. None of this loses a place:
the result is that of aligning every item with every document.

Test items go to the tasks in blocks of bounded size, so a benchmark of any size can be searched.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_WORD = regex.compile(r"\W+")
#: Words of test items that are searched at once, the bound of what is broadcast. V^3 of a block's vocabulary fits 64 bits.
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
COST = -max(MISMATCH, GAP)
#: Rare words of an item that must stand close together where it shares no n-gram: more words to look up, fewer places to align.
TOGETHER = 4
#: Characters of documents that are read and searched at once (or one document).
SLICE_CHARS = 1 << 18
#: Pairs of an item and one of its rare words that are sorted at once (or those of one document).
SORTED_PAIRS = 1 << 18
#: Stands behind the words of a text; no word.
END = " "


@cache
def letters() -> np.ndarray:
    """Of every character itself, or a blank where it is no part of a word."""
    out = np.arange(sys.maxunicode + 1, dtype="<u4")
    for blanks in NO_WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[blanks.start() : blanks.end()] = ord(" ")
    return out


@cache
def ascii_letters() -> str:
    return "".join(map(chr, letters()[:128]))


def words_of(text: str | None) -> list[str]:
    r"""The runs of `\w` in the text in lower case. Nothing that `split` cuts at is part of a word."""
    text = (text or "").lower()
    if text.isascii():
        return text.translate(ascii_letters()).split()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return letters()[codes].tobytes().decode("utf-32-le").split()


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """The texts cut into [from, to) of at most SLICE_CHARS characters (or one text)."""
    lo = size = 0
    for hi, t in enumerate(texts):
        if hi > lo and size + len(t or "") > SLICE_CHARS:
            yield lo, hi
            lo, size = hi, 0
        size += len(t or "")
    if texts:
        yield lo, len(texts)


@dataclass
class Block:
    """Some test items as word numbers (0 is a word of no item), their distinct words with counts, and the codes of n-grams to look
    for: code to items."""

    n: int
    items: list[tuple[object, np.ndarray]]
    numbers: dict[str, int]
    places: dict[int, list[int]]
    distinct: list[tuple[np.ndarray, np.ndarray]]

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.uint64, len(words))

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the texts, a 0 behind those of each, and where each text begins and the last one ends."""
        words = list(map(words_of, texts))
        for w in words:
            w.append(END)
        first = np.cumsum([0, *map(len, words)])
        return np.fromiter(map(self.numbers.get, chain.from_iterable(words), repeat(0)), np.uint64, first[-1]), first

    def codes(self, a: np.ndarray, width: int) -> np.ndarray:
        base, rows = np.uint64(len(self.numbers) + 1), len(a) - width + 1
        if rows <= 0:
            return np.empty(0, np.uint64)
        out, inside = np.zeros(rows, np.uint64), np.ones(rows, bool)
        for i in range(width):
            out = out * base + a[i : i + rows]
            inside &= a[i : i + rows] > 0
        return np.where(inside, out, np.uint64(0)) * np.uint64(4) + np.uint64(width)

    def looked(self) -> list[tuple[int, np.ndarray]]:
        """The codes to look for, sorted, by the words of their n-grams."""
        codes = np.array(sorted(self.places), np.uint64)
        width = codes % np.uint64(4)
        return [(int(w), codes[width == w]) for w in np.unique(width)]

    def hits(self, a: np.ndarray, looked: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int]]:
        """(code, place) of the n-grams of `a` that are among the codes `looked`."""
        for width, wanted in looked:
            codes = self.codes(a, width)
            places = np.flatnonzero(codes >= 4)  # without words of no item
            codes = codes[places]
            at = np.searchsorted(wanted, codes)
            at[at == len(wanted)] = 0
            same = wanted[at] == codes
            yield from zip(codes[same].tolist(), places[same].tolist())


def blocks(benchmark: DataFrame, n: int, item: str, text: str) -> Iterator[Block]:
    """The items in blocks of at most BLOCK_WORDS words (or one item). An item of fewer than n words is one shorter n-gram; one without
    words is never found."""
    rows: list[tuple[object, list[str]]] = []
    size = 0

    def made() -> Block:
        numbers: dict[str, int] = {}
        for _, words in rows:
            for w in words:
                numbers.setdefault(w, len(numbers) + 1)
        block = Block(n, [], numbers, {}, [])
        for k, (name, words) in enumerate(rows):
            a = block.number(words)
            block.items.append((name, a))
            block.distinct.append(np.unique(a, return_counts=True))
            for c in np.unique(block.codes(a, min(n, len(a)))):
                block.places.setdefault(int(c), []).append(k)
        return block

    for row in benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        if rows and size + len(words) > BLOCK_WORDS:
            yield made()
            rows, size = [], 0
        rows.append((row["i"], words))
        size += len(words)
    if rows:
        yield made()


@dataclass
class Bounds:
    """What any alignment of an item with `least` or more of its full score has."""

    score: int
    span: int  # words of the document, at most
    matched: int  # matched words, at least, if no n-gram is shared; more than the item has where that cannot be


def bounds(length: int, n: int, least: float) -> Bounds:
    """An alignment is runs of matched words with a cost between any two; without a shared n-gram no run has n words."""
    score = max(1, math.ceil(least * MATCH * length - 1e-9))
    run = min(n, length) - 1
    enough = (m for m in range(1, length + 1) if run and MATCH * m - COST * (-(-m // run) - 1) >= score)
    return Bounds(score, max(1, length + (MATCH * length - score) // COST), next(enough, length + 1))


@dataclass
class RareWords:
    """Word number to items: `items[start[w]:start[w + 1]]`. Of these words of an item, `together` are matched by any alignment that
    shares no n-gram with it."""

    start: np.ndarray
    items: np.ndarray
    together: np.ndarray
    span: np.ndarray

    def cut(self, a: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """The texts that begin at `first` cut into [from, to) of at most SORTED_PAIRS pairs (or one text)."""
        pairs = np.concatenate([[0], np.cumsum(self.start[a + 1] - self.start[a])])[first]
        lo = 0
        while lo < len(first) - 1:
            hi = max(lo + 1, int(np.searchsorted(pairs, pairs[lo] + SORTED_PAIRS, "right")) - 1)
            yield lo, hi
            lo = hi

    def near(self, a: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, place) where enough rare words of the item stand close together in one of the texts that begin at `first`."""
        n = self.start[a + 1] - self.start[a]
        at = np.flatnonzero(n)
        if not len(at):
            return
        n = n[at]
        pos = np.repeat(at, n)
        items = self.items[np.repeat(self.start[a[at]] - np.cumsum(n) + n, n) + np.arange(len(pos))]
        bits = len(a).bit_length()
        both = np.sort(items << bits | pos)
        items, pos = both >> bits, both & ((1 << bits) - 1)
        last = np.arange(len(pos)) + self.together[items] - 1
        inside = last < len(pos)
        last[~inside] = 0
        found = np.flatnonzero(inside & (items[last] == items) & (pos[last] - pos < self.span[items]))
        text = lambda p: np.searchsorted(first, p, "right")
        found = found[text(pos[last[found]]) == text(pos[found])]
        yield from zip(items[found].tolist(), pos[found].tolist())


def rare_words(docs: DataFrame, block: Block, limits: list[Bounds], text: str) -> RareWords:
    """Of every item so many of its words, the rarest of all documents first, that an alignment without a shared n-gram cannot avoid them."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        found = np.zeros(len(b.numbers) + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(texts):
                found += np.bincount(b.read(texts[lo:hi])[0].astype(np.int64), minlength=len(found))
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(found[seen], pa.int64())], ["word", "n"])

    counted = docs.select(text).mapInArrow(tally, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    often = np.zeros(len(block.numbers) + 1, np.int64)
    for r in counted.collect():  # at most the words of a block
        often[r["word"]] = r["n"]
    pairs, together = set(), np.ones(len(block.items), np.int64)
    for k, (_, a) in enumerate(block.items):
        least = limits[k].matched
        if least <= len(a):
            together[k] = min(TOGETHER, least)
            rarest = a[np.argsort(often[a.astype(np.int64)], kind="stable")]
            pairs |= {(int(w), k) for w in rarest[: len(a) - least + together[k]]}
    ordered = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    start = np.searchsorted(ordered[:, 0], np.arange(len(often) + 1))
    return RareWords(start, ordered[:, 1], together, np.array([x.span for x in limits], np.int64))


def seeds(block: Block, looked: list[tuple[int, np.ndarray]], rare: RareWords, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, dict[int, list[int]]]]:
    """(text, its word numbers, item to places) of the texts that have an n-gram or enough rare words of an item."""
    for start, end in slices(texts):
        numbers, first = block.read(texts[start:end])
        words = numbers.astype(np.int64)
        for lo, hi in rare.cut(words, first):
            here = slice(first[lo], first[hi])
            begin = (first[lo : hi + 1] - first[lo]).tolist()
            ngrams: dict[int, list[tuple[int, int]]] = {}
            for code, p in block.hits(numbers[here], looked):
                ngrams.setdefault(bisect_right(begin, p) - 1, []).append((code, p))
            groups: dict[int, list[tuple[int, int]]] = {}
            for it, p in rare.near(words[here], np.array(begin)):
                groups.setdefault(bisect_right(begin, p) - 1, []).append((it, p))
            for k in sorted(ngrams.keys() | groups.keys()):
                near: dict[int, list[int]] = {}
                for code, p in ngrams.get(k, ()):
                    for it in block.places[code]:
                        near.setdefault(it, []).append(p - begin[k])
                for it, p in groups.get(k, ()):
                    near.setdefault(it, []).append(p - begin[k])
                yield start + lo + k, numbers[here][begin[k] : begin[k + 1] - 1], near


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of a and b: (score, end in a, end in b), ends exclusive. A gap costs the same per word, so a row follows
    from the one above by a running maximum."""
    j = np.arange(len(b) + 1)
    above, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, w in enumerate(a):
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where((b == w) & (w > 0), MATCH, MISMATCH))
        row = np.maximum.accumulate(row - GAP * j) + GAP * j
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
        above = row
    return best


def reaches(words: np.ndarray, counts: np.ndarray, b: np.ndarray, score: int) -> bool:
    """False if no alignment of b with an item of these distinct words can have the score: no word of b counts more than a match, one
    that the item lacks costs, and no word matches more often than the item has it."""
    at = np.searchsorted(words, b)
    at[at == len(words)] = 0
    same = words[at] == b
    if MATCH * int(np.minimum(np.bincount(at[same], minlength=len(words)), counts).sum()) < score:
        return False
    total = np.concatenate([[0], np.cumsum(np.where(same, MATCH, -COST))])
    return int((total - np.minimum.accumulate(total)).max()) >= score


def _windows(places: list[int], span: int, size: int) -> list[tuple[int, int]]:
    """The stretches of a document that alignments of `span` words through the places can cover, joined where they overlap."""
    spans: list[list[int]] = []
    for p in sorted(set(places)):
        lo, hi = max(0, p - span + 1), min(size, p + span)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    return [(lo, hi) for lo, hi in spans]


LEAK = "array<struct<item:{}, score:double, doc_from:bigint, doc_to:bigint>>"


def with_leaks(
    docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, least: float = 0.5, n: int = 3,
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document its `keep` columns (all by default) in the struct `doc`, and `leaks`: the test items it contains.

    A leak has the item, the score (alignment score through that of an exact copy, 0 to 1, `least` or more) and the words
    [doc_from, doc_to) it covers; the best place counts. Null and empty texts leak nothing; an empty benchmark gives
    empty lists; items with equal texts are all named; repeated rows stay; an empty table gives no rows.
    """
    if not 1 <= n <= 3:
        raise ValueError("n-grams of one to three words have exact codes")
    kind = benchmark.schema[item].dataType
    names = docs.columns if keep is None else keep
    out = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), F.col(text).alias("body")).withColumn("leaks", F.array().cast(LEAK.format(kind.simpleString())))
    for block in blocks(benchmark, n, item, item_text):
        limits = [bounds(len(a), n, least) for _, a in block.items]
        rare = rare_words(docs, block, limits, text)
        shared = docs.sparkSession.sparkContext.broadcast((block, limits, rare))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b, limits, rare = shared.value
            looked = b.looked()
            for batch in batches:
                leaks = batch.column(2).to_pylist()
                for k, a, near in seeds(b, looked, rare, batch.column(1).to_pylist()):
                    for it, places in near.items():
                        (name, words), limit = b.items[it], limits[it]
                        spans = [(lo, hi) for lo, hi in _windows(places, limit.span, len(a)) if reaches(*b.distinct[it], a[lo:hi], limit.score)]
                        best = max((align(words, a[lo:hi]) + (lo,) for lo, hi in spans), key=lambda x: x[0], default=(0, 0, 0, 0))
                        value = best[0] / (MATCH * len(words))
                        if best[0] and value >= least:
                            lo, end_a, end_b = best[3], best[1], best[2]
                            back = align(words[:end_a][::-1], a[lo : lo + end_b][::-1])
                            leaks[k].append({"item": name, "score": value, "doc_from": lo + end_b - back[2], "doc_to": lo + end_b})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaks, batch.schema.field(2).type)], ["doc", "body", "leaks"])

        out = out.mapInArrow(search, out.schema)
    return out.select("doc", "leaks")
