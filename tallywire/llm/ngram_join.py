"""N-gram Jaccard self-join by PartEnum signatures.

Two sets of sizes a <= b reach a Jaccard similarity s only if they differ in at most (1-s)/(1+s)*(a+b) elements and a >= s*b.
Sizes are cut into bands; a set signs for its own band and for the next one if a partner can be there. For a band whose
pairs differ in at most k elements, the feature domain is hashed to n1 partitions of two levels. A pair differs in at
most one element in some partition (n1 * 2 > k), so one of the two second-level parts of that partition agrees: each part of
each partition gives a signature.

Empty projections would put unrelated sets together, so an empty part signs nothing. Where one part of a partition is empty, the other part signs
with each of its elements left out in turn as well: if a pair agrees in the empty part only, the other parts differ in one element, and one set's part is
the other's with that element left out. Only partitions with at most one element stay without a signature that holds. Large bands have some partitions more than the
proof needs; a set with more such poor partitions than these signs by the next of FAMILIES independent hashings as well (in the last one with its empty
parts), so that no pair is lost: of the partitions that differ in at most one element, one is not poor.

Very common shingles (a line on a third of all documents) would do the same. The families but the last sign without the HOT most common ones: sets
without them differ in no more elements than before, so nothing is lost whichever are chosen.

Equal sets are one class before anything else. Within a signature, members are compared with its smallest member, not with each
other; what those links leave in different components is compared in a second step. There, classes that share a signature's smallest member
with a class of another component form families (components of that relation); a family is compared block by block over bitmaps, and what these allow to link is
compared exactly. Inside a family this looks at all pairs of different components, as any exact method must that cannot tell 0.79 from 0.8 without
looking, but it emits and shuffles only blocks and the few pairs that may link.

Signatures are dealt out in sorted blocks, one for a stretch of documents and a range of signatures, not row by row: steps between signatures and numbers of
documents take about 6 bytes for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywire.llm.common import components, stored

FAMILIES = 4
#: Signatures that a task holds before it deals them out, and of a bucket, by and large.
HELD, PER_BUCKET = 4_000_000, 300_000
#: Shingles of so many documents among CHUNK shingles are common; the HOT most common ones are left out of the first families.
COMMON, CHUNK, HOT = 8, 2_000_000, 1 << 16
BITS = 2048
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser over uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((_ODD[0] * (seed + 1)) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
        return x ^ (x >> np.uint64(31))


class Words(dict):
    """A 64-bit hash by word (its UTF-8 bytes), kept by a Python worker; when full, it starts again."""

    MOST = 600_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: str | None, lower: bool = False) -> np.ndarray:
        """The hashes of a text's words. Bytes split at, and `lower` lowers, exactly the ASCII characters that are meant."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = (data.lower() if lower else data).split()
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_WORDS = Words()


#: A number by byte, and the base of the polynomial over them that hashes a word of at most LONG bytes; text is hashed by the PIECE.
_BYTE, _BASE, LONG, PIECE = mix(np.arange(256, dtype=np.uint64), 17), np.uint64(_ODD[4] | 1), 256, 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


@lru_cache(None)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2^64, for every place of a piece."""
    back = np.uint64(pow(int(_BASE), -1, 2**64))
    return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(PIECE + LONG, x), dtype=np.uint64))) for x in (_BASE, back))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every word of `data`, which begins and ends with a blank. A word's hash does not depend on its place."""
    import xxhash

    text = np.frombuffer(data, np.uint8)
    space = _SPACE[text]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    out, (up, down), at = np.empty(len(start), np.uint64), _powers(), 0
    while at < len(start):
        first = start[at]
        to = int(np.searchsorted(start, first + PIECE))
        part = text[first : min(end[to - 1], first + PIECE + LONG)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        begin, stop = start[at:to] - first, np.minimum(end[at:to] - first, len(part))
        out[at:to] = mix((sums[stop] - sums[begin]) * down[begin], 19)
        at = to
    for i in np.flatnonzero(end - start > LONG):  # a polynomial modulo 2^64 is weak for words of a thousand bytes
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out, start


def shingle_sets(texts: list[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """`shingles` of every text. Many are hashed at once."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass").lower())  # bytes: only A-Z are lowered
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield from _sets(held, n)
            held, size = [], 0
    yield from _sets(held, n)


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    h, place = _word_hashes(b" " + b" ".join(texts) + b" ")
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
    cuts = np.searchsorted(place, begins).tolist()

    def folded(words: np.ndarray, width: int) -> np.ndarray:
        rows = len(words) - width + 1
        out = np.full(rows, np.uint64(width if width < n else 0))
        for i in range(width):
            out = out * np.uint64(_ODD[3]) + words[i : i + rows]
        return mix(out, width)

    with np.errstate(over="ignore"):
        whole = folded(h, n) if len(h) >= n else h
        sets = []
        for a, b in zip(cuts, cuts[1:]):
            found = np.sort(whole[a : b - n + 1] if b - a >= n else folded(h[a:b], b - a) if b > a else h[:0])
            again = found[1:] == found[:-1]
            sets.append(found[np.concatenate(([True], ~again))] if again.any() else found)
    return iter(sets)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted different hashes of a text's n-word shingles; with fewer words, of the whole sequence; none without words."""
    return next(shingle_sets([text], n))


@lru_cache(None)
def band(size: int, numerator: int = 80) -> tuple[int, int, int]:
    """(number, smallest, largest size) of a size's band. The largest size still matches the smallest."""
    number, low = 0, 1
    while True:
        high = low * 100 // numerator
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


@lru_cache(None)
def scheme(high: int, numerator: int = 80) -> tuple[int, int, int]:
    """(k, n1, spare) for pairs whose larger set has at most `high` elements."""
    k = (100 - numerator) * 2 * high // (100 + numerator)
    needed = k // 2 + 1
    spare = needed // 20 + (needed > 10)
    return k, needed + spare, spare


def signatures(h: np.ndarray, numerator: int = 80, hot: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set of hashes: sets with a similarity of numerator/100 or more share one. None for an empty set.
    `hot`: sorted hashes of very common elements."""
    return signatures_of([h], numerator, hot)[0]


def signatures_of(sets: list[np.ndarray], numerator: int = 80, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of many sets at once, and the number of each one's set in the list."""
    out, owner, jobs = [], [], []
    for i, h in enumerate(sets):
        if not len(h):
            continue
        number, _, high = band(len(h), numerator)
        tags = [(number, high)]
        if len(h) * 100 // numerator > high:
            tags.append((number + 1, band(high + 1, numerator)[2]))
        for tag, top in tags:
            k, n1, spare = scheme(top, numerator)
            if k == 0:  # only equal sets match
                out.append(mix(np.array([h.sum(dtype=np.uint64)]), tag + 1000))
                owner.append(np.array([i]))
            else:
                jobs.append((i, tag, n1, spare))
    whole = np.concatenate([*sets, np.empty(0, np.uint64)])
    sizes = np.array([len(h) for h in sets])
    rare, few = whole, sizes
    if hot is not None and len(hot):
        at = np.searchsorted(hot, whole)
        at[at == len(hot)] = 0
        stays = hot[at] != whole
        rare, few = whole[stays], np.bincount(np.repeat(np.arange(len(sets)), sizes)[stays], minlength=len(sets))
    open_jobs = np.array(jobs, np.int64).reshape(-1, 4)
    for family in range(FAMILIES):
        if not len(open_jobs):
            break
        last = family == FAMILIES - 1
        found, of, poor = _family(*((whole, sizes) if last else (rare, few)), open_jobs, family, last)
        out.append(found)
        owner.append(of)
        open_jobs = open_jobs[poor]
    return np.concatenate([*out, np.empty(0, np.uint64)]), np.concatenate([*owner, np.empty(0, np.int64)])


def _family(elements: np.ndarray, sizes: np.ndarray, jobs: np.ndarray, family: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, their sets, which jobs are poor) of `jobs` (set, band, partitions, spare ones) in one hashing of `elements`, set after set."""
    of, tag, n1, spare = jobs.T
    lens, cells = sizes[of], 2 * n1
    base, begin = np.cumsum(cells) - cells, np.cumsum(lens) - lens
    start = np.cumsum(sizes) - sizes
    here = np.repeat(start[of] - begin, lens) + np.arange(lens.sum())  # a set's elements once for each of its jobs
    value = mix(elements, 3)
    halves = [(value & np.uint64(0xFFFFFFFF)).astype(float)[here], (value >> np.uint64(32)).astype(float)[here]]
    spread = (mix(elements, 7 + family) >> np.uint64(32))[here]
    cell = ((spread * np.repeat(cells, lens).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(base, lens)
    total = int(cells.sum())
    with np.errstate(over="ignore"):
        # exact sums modulo 2^64 in two halves: 2^21 numbers of 32 bits fit a double
        low, top = (np.bincount(cell, half, total).astype(np.uint64) for half in halves)
        sums = low + (top << np.uint64(32))
        count = np.bincount(cell, minlength=total)
        poor = np.add.reduceat((count[::2] + count[1::2] <= 1).astype(np.int64), base // 2) > spare
        place = mix((np.arange(total) + np.repeat(((tag * FAMILIES + family) << 40) - base, cells)).astype(np.uint64), 11)
        keep = count > 0
        if last:
            keep |= np.repeat(poor, cells)
        lone = ((count.reshape(-1, 2)[:, ::-1].ravel() == 0) & (count > 1))[cell]  # elements of parts whose sibling is empty
        at = cell[lone]
        without = mix((sums[at] - value[here[lone]]) ^ place[at], 5)
        found = np.concatenate([mix(sums[keep] ^ place[keep], 5), without])
    return found, np.concatenate([np.repeat(of, cells)[keep], np.repeat(of, lens)[lone]]), poor


def _digest(h: np.ndarray) -> bytes:
    import hashlib

    return hashlib.md5(h.tobytes()).digest()


def _batches(columns: list, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)


def bitmap(h: np.ndarray) -> bytes:
    """A set as BITS bits. Sets differ in at least as many elements as their bitmaps in bits."""
    on = np.zeros(BITS, np.uint8)
    on[(mix(h, 31) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(on).tobytes()


def _may_link(batches: Iterator[pa.RecordBatch], numerator: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, na, nb, bits of a, bits of b) whose bitmaps allow a link."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (4, 5))
        differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
        size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
        mask = pa.array(differ * (100 + numerator) <= (100 - numerator) * size)
        yield _batches([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"], [None, None])


def classes(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, digest, bits): rows with equal sets have equal digests; an empty set has none. A row with n_shingles -1 has the
    common shingles of a stretch of rows and their numbers of documents in `bits`."""

    def common(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        found = np.stack((h[n >= COMMON], n[n >= COMMON].astype(np.uint64)))
        return pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([found.tobytes()], pa.binary())], names)

    names, kinds = ["key", "n_shingles", "digest", "bits"], [to_arrow_type(docs.schema[key].dataType)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sets = list(shingle_sets(batch.column(1).to_pylist(), n))
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield common(held)
                held, size = [], 0
            digest = [_digest(s) if len(s) else None for s in sets]
            columns = [batch.column(0), [len(s) for s in sets], digest, [bitmap(s) if len(s) else None for s in sets]]
            yield _batches(columns, names, [None, pa.int64(), pa.binary(), pa.binary()])
        if held:
            yield common(held)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(rows, f"key {kind}, n_shingles bigint, digest binary, bits binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            h, n = np.frombuffer(data, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def most_common(classed: DataFrame) -> np.ndarray:
    """The HOT most common shingles, sorted."""
    found = classed.where("n_shingles = -1").select("bits").mapInArrow(_counted, "h bigint, n bigint")
    top = found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT)
    return np.sort(np.array([r["h"] for r in top.collect()], np.int64).view(np.uint64))  # at most HOT numbers


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys (48 bits of a signature, 16 of a document's number): the steps between signatures and the numbers, byte by byte of their digits."""
    signature, number = keys >> np.uint64(16), (keys & np.uint64(0xFFFF)).astype("<u2")
    step = np.diff(signature).astype("<u8")
    width = (int(step.max(initial=0)).bit_length() + 7) // 8
    digits = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :w].T).tobytes() for x, w in ((step, width), (number, 2))]
    return np.array([signature[0], len(keys), width], "<u8").tobytes() + pa.Codec("zstd", 1).compress(b"".join(digits)).to_pybytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, documents' numbers) of `_packed` keys."""
    first, n, width = (int(x) for x in np.frombuffer(data, "<u8", 3))
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[24:], (n - 1) * width + 2 * n), np.uint8)
    step = np.zeros((n, 8), np.uint8)
    step[1:, :width] = raw[: (n - 1) * width].reshape(width, n - 1).T
    step = step.view("<u8").reshape(-1)
    step[0] = first
    number = np.ascontiguousarray(raw[(n - 1) * width :].reshape(2, n).T).view("<u2").reshape(-1)
    return np.cumsum(step, dtype=np.uint64), number


def signed(docs: DataFrame, text: str, n: int, numerator: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, base, data): the signatures of a task's classes, a block at a time, by the first `buckets` bits of a signature.

    A class signs once in each partition of the input. A member is the number of its class in the task and the task's number (`base` plus 16 bits); rows
    with a negative bucket list the ids of the classes from `base` on: the first halves of their digests. Signatures are cut to 48 bits, since what they
    put together is compared anyway.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    borders = np.arange(1, 1 << buckets, dtype=np.uint64) << np.uint64(64 - buckets)

    def block(keys: list[np.ndarray], ids: list[int], base: int) -> pa.RecordBatch:
        key = np.sort(np.concatenate([*keys, np.empty(0, np.uint64)]))
        cuts = [0, *np.searchsorted(key, borders).tolist(), len(key)]
        rows = [(i, _packed(key[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        rows.append((-1 - (base >> 40) % (1 << 20), np.array(ids, "<i8").tobytes()))
        at, data = zip(*rows)
        return _batches([at, [base] * len(at), data], ["bucket", "base", "data"], [pa.int32(), pa.int64(), pa.binary()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        base = TaskContext.get().partitionId() << 40
        keys, ids, sets, held, total = [], [], [], 0, 0

        def sign() -> int:
            found, of = signatures_of(sets, numerator, shared.value)
            number = of.astype(np.uint64) + np.uint64(len(ids) - len(sets))
            keys.append((found & ~np.uint64(0xFFFF)) | number)
            sets.clear()
            return len(found)

        for batch in batches:
            for s in shingle_sets(batch.column(0).to_pylist(), n):
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                sets.append(s)
                ids.append(int.from_bytes(d[:8], "little", signed=True))
                held += len(s)
                if held > 100_000 or len(sets) >= 10_000:
                    total += sign()
                    held = 0
                    if total >= HELD or len(ids) > 50_000:
                        yield block(keys, ids, base)
                        base += len(ids)
                        keys, ids, total = [], [], 0
        if sets:
            sign()
        if ids:
            yield block(keys, ids, base)

    return docs.select(F.col(text)).mapInArrow(rows, "bucket int, base bigint, data binary")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, base, data) in order of their buckets, the pairs (x: smallest member, y: other member) of each signature, and with `named` each
    member's class (x: member, y: id). One bucket is held."""
    names, types = ["named", "x", "y"], [pa.bool_(), pa.int64(), pa.int64()]

    def pairs(blocks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [(_unpacked(data), base) for base, data in blocks]
        signature = np.concatenate([p[0] for p, _ in parts])
        member = np.concatenate([p[1].astype(np.int64) + base for p, base in parts])
        order = np.sort(signature)
        shared = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(shared):
            return
        at = np.searchsorted(shared, signature)
        at[at == len(shared)] = 0
        of = shared[at] == signature
        at, member = at[of], member[of]
        order = np.lexsort((member, at))
        at, member = at[order], member[order]
        first = np.concatenate(([True], at[1:] != at[:-1]))
        head = member[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        other = head != member
        head, member = head[other], member[other]
        order = np.lexsort((member, head))
        head, member = head[order], member[order]
        new = np.ones(len(head), bool)
        new[1:] = (head[1:] != head[:-1]) | (member[1:] != member[:-1])
        yield _batches([np.zeros(new.sum(), bool), head[new], member[new]], names, types)

    bucket, held = None, []
    for batch in batches:
        for now, base, data in zip(*(c.to_pylist() for c in batch.columns)):
            if now < 0:
                ids = np.frombuffer(data, "<i8")
                yield _batches([np.ones(len(ids), bool), base + np.arange(len(ids)), ids], names, types)
                continue
            if held and now != bucket:
                yield from pairs(held)
                held = []
            bucket = now
            held.append((base, data))
    if held:
        yield from pairs(held)


def stars(docs: DataFrame, reps: DataFrame, text: str, n: int, numerator: int, hot: np.ndarray) -> DataFrame:
    """(x, y), stored: the ids of each signature's smallest member and of its others."""
    size = reps.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = min(14, max(5, (size // PER_BUCKET).bit_length()))
    members = signed(docs, text, n, numerator, hot, buckets).repartition("bucket").sortWithinPartitions("bucket")
    found = stored(members.mapInArrow(_stars, "named boolean, x bigint, y bigint").distinct(), "members")
    names = found.where("named")
    pairs = found.where("NOT named").join(names.selectExpr("x", "y AS a"), "x").withColumnRenamed("y", "member")
    pairs = pairs.select("a", "member").join(names.selectExpr("x AS member", "y AS b"), "member")
    return stored(pairs.where("a <> b").selectExpr("a AS x", "b AS y").distinct(), "star")


def _similar(a: np.ndarray, b: np.ndarray, numerator: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= numerator * (len(a) + len(b) - both)


def _opened(packed: list[dict], n: int) -> list[np.ndarray]:
    """The shingles of compressed texts."""
    codec = pa.Codec("zstd")
    texts = [codec.decompress(x["data"], x["size"]).to_pybytes().decode("utf-8", "surrogatepass") for x in packed]
    return list(shingle_sets(texts, n))


def _linked(pairs: Iterator[pa.RecordBatch], n: int, numerator: int) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, np.ndarray] = {}
    for whole in pairs:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            sides = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if len(known) > 3000:
                known.clear()
            new = {x["data"]: x for side in sides for x in side if x["data"] not in known}
            known |= zip(new, _opened(list(new.values()), n))
            mask = pa.array([_similar(known[x["data"]], known[y["data"]], numerator) for x, y in zip(*sides)], pa.bool_())
            yield _batches([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"], [None, None])


def _compressed(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(a, ta: compressed text) of the rows (key, text, places in the sieve) that the sieve lets through."""
    codec = pa.Codec("zstd")
    kind = pa.struct([("data", pa.binary()), ("size", pa.int64())])
    for batch in batches:
        stays = np.ones(len(batch), bool)
        for place in batch.columns[2:]:
            at = place.to_numpy()
            stays &= (sieve[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        some = batch.filter(pa.array(stays))
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in some.column(1).to_pylist()]
        packed = [{"data": codec.compress(x).to_pybytes(), "size": len(x)} for x in raw]
        yield _batches([some.column(0), packed], ["a", "ta"], [None, kind])


def _places(key: str, log: int) -> list[Column]:
    return [F.xxhash64(F.col(key), F.lit(i)).bitwiseAND((1 << log) - 1) for i in range(3)]


def sieve_of(keys: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """(words, log): a Bloom filter of 2^log bits over the keys, twelve bits for each and 4 MB at most: with more keys it lets more rows through."""
    log = min(25, max(12, (12 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*_places(key, log))).alias("at"))
    words = at.groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toArrow()
    sieve = np.zeros(1 << log >> 6, np.uint64)
    sieve[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return sieve, log


def texts_of(ids: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(a, ta): key and compressed text of the classes `ids`, stored: texts are shuffled once for all comparisons, most others not at all."""
    kind = docs.schema[key].dataType.simpleString()
    needed = stored(ids.join(reps, "id").select(F.col("rep").alias("a")), "needed")
    sieve, log = sieve_of(needed, "a")
    shared = docs.sparkSession.sparkContext.broadcast(sieve)
    rows = docs.select(F.col(key), F.col(text), *[c.alias(f"at{i}") for i, c in enumerate(_places(key, log))])
    packed = rows.mapInArrow(lambda it: _compressed(it, shared.value), f"a {kind}, ta struct<data: binary, size: bigint>")
    return stored(packed.join(needed, "a", "left_semi").dropDuplicates(["a"]), "texts")


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, numerator: int) -> DataFrame:
    """Of candidate `pairs` (x, y: ids), the linked pairs of classes (a, b: their representatives' keys), compared exactly."""
    kind = reps.schema["rep"].dataType.simpleString()
    sized = reps.select("id", "rep", "n_shingles", "bits")
    both = pairs.join(sized.toDF("x", "a", "na", "xbits"), "x").join(sized.toDF("y", "b", "nb", "ybits"), "y")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * numerator).where("a <> b")
    both = both.select("a", "b", "na", "nb", "xbits", "ybits").mapInArrow(lambda it: _may_link(it, numerator), f"a {kind}, b {kind}")
    both = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    full = both.join(texts, "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(lambda it: _linked(it, n, numerator), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, numerator: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the smallest key reachable by links of a Jaccard
    similarity of numerator/100 or more between sets of lower-cased n-word shingles.

    Rows without words have no links and are their own component. Rows with a null key are reported with a null
    component_id and link nothing. Keys must identify texts: of rows with one key and different texts, each is
    classed by its own text, and links are compared by one of them. An empty table gives no rows.
    """
    usable = docs.where(F.col(key).isNotNull())
    everything = stored(classes(docs, key, text, n), "classes")
    hot, classed = most_common(everything), everything.where("n_shingles >= 0")
    some = classed.where("digest IS NOT NULL AND key IS NOT NULL")
    reps = some.groupBy("digest").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    reps = stored(reps.withColumn("id", id_of("digest")), "reps")
    labels = labelled(usable, reps, key, text, n, numerator, hot)
    named = reps.select("digest", "rep").join(labels, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return classed.join(named, "digest", "left").select(
        F.col("key").alias(key),
        "n_shingles",
        F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")).alias("component_id"),
    )


def id_of(digest: str):
    """The first eight bytes of a digest as a signed little-endian number."""
    h = F.hex(F.substring(digest, 1, 8))
    at = [F.substring(h, 2 * i + 1, 2) for i in range(8)]
    low = F.conv(F.concat(*reversed(at[:7])), 16, 10).cast("bigint")
    top = F.conv(at[7], 16, 10).cast("bigint")
    return low + F.shiftleft(F.when(top >= 128, top - 256).otherwise(top), 56)


CELL = ["family", "low", "high"]


def _cell(group: pa.Table, numerator: int) -> pa.Table:
    """The pairs (family, low, high, x, y) of different components in a cell that sizes and bitmaps allow to link: rows of its two blocks, or of its one block."""
    group = group.combine_chunks()
    block, low, high = group["block"].to_numpy(), group["low"][0].as_py(), group["high"][0].as_py()
    ids, size = group["id"].to_numpy(), group["n_shingles"].to_numpy()
    codes: dict[str, int] = {}  # keys may be of any type
    label = np.array([codes.setdefault(str(c), len(codes)) for c in group["component"].to_pylist()])
    bits = np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    found = []
    for at in range(0, len(left), 64):
        some = left[at : at + 64]
        differ = np.zeros((len(some), len(right)), np.int32)
        for word in range(BITS // 64):
            differ += np.bitwise_count(bits[some, word][:, None] ^ bits[right, word])
        both = size[some][:, None] + size[right]
        near = (differ * (100 + numerator) <= (100 - numerator) * both) & (label[some][:, None] != label[right])
        near &= np.minimum(size[some][:, None], size[right]) * 100 >= np.maximum(size[some][:, None], size[right]) * numerator
        x, y = np.nonzero(near)
        found.append(np.stack((ids[some[x]], ids[right[y]])))
    pairs = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    cell = {c: group[c].slice(0, 1).take(pa.array(np.zeros(pairs.shape[1], np.int64))) for c in CELL}
    return pa.table(cell | {"x": np.minimum(*pairs), "y": np.maximum(*pairs)})


def possible(rows: DataFrame, numerator: int, side: int = 1024) -> DataFrame:
    """Candidate pairs (family, low, high, x, y) of different components of a family, of `rows` (family, id, component, n_shingles, bits).

    A family is cut into blocks of about `side` members, and every pair of blocks is a cell of its own: a large family is many tasks. Pairs are
    looked at as bitmaps inside a cell; only those that may link leave it.
    """
    sizes = rows.groupBy("family").agg(F.ceil(F.count("*") / side).cast("int").alias("blocks"))
    rows = rows.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component", "n_shingles", "bits")
    return cells.groupBy(*CELL).applyInArrow(lambda t: _cell(t, numerator), "family bigint, low int, high int, x bigint, y bigint")


def _linked_in_cells(batches: Iterator[pa.RecordBatch], n: int, numerator: int) -> Iterator[pa.RecordBatch]:
    """The linked pairs (x, y) of rows (family, low, high, x, y, ta) in order of their cells, in each of which the texts, rows without y, come first."""
    cell, known, waiting = None, {}, {}
    for batch in batches:
        linked = []
        for *now, x, y, ta in zip(*(c.to_pylist() for c in batch.columns)):
            if now != cell:
                cell, known, waiting = now, {}, {}
            if y is None:
                waiting[x] = ta
                continue
            if waiting:
                known |= zip(waiting, _opened(list(waiting.values()), n))
                waiting = {}
            linked.append(_similar(known[x], known[y], numerator))
        pairs = batch.filter(pa.compute.is_valid(batch.column(4)))
        mask = pa.array(linked, pa.bool_())
        yield _batches([pairs.column(3).filter(mask), pairs.column(4).filter(mask)], ["x", "y"], [None, None])


def verified_in_cells(pairs: DataFrame, reps: DataFrame, texts: DataFrame, n: int, numerator: int) -> DataFrame:
    """Of candidate `pairs` (family, low, high, x, y), the linked ones (x, y), compared exactly. A text goes to a cell once, for however many pairs."""
    ends = pairs.select(*CELL, F.explode(F.array("x", "y")).alias("x")).distinct()
    there = ends.join(reps.selectExpr("id AS x", "rep AS a"), "x").join(texts, "a")
    rows = pairs.withColumn("ta", F.lit(None).cast(texts.schema["ta"].dataType)).unionByName(there.select(*CELL, "x", F.lit(None).cast("bigint").alias("y"), "ta"))
    rows = rows.repartition(*CELL).sortWithinPartitions(*CELL, F.asc_nulls_first("y"))
    return rows.mapInArrow(lambda it: _linked_in_cells(it, n, numerator), "x bigint, y bigint")


def labelled(docs: DataFrame, reps: DataFrame, key: str, text: str, n: int, numerator: int, hot: np.ndarray) -> DataFrame:
    """(rep, component) of the representatives of classes that have links."""
    star = stars(docs, reps, text, n, numerator, hot)
    texts = texts_of(star.select(F.explode(F.array("x", "y")).alias("id")).distinct(), reps, docs, key, text)
    links = stored(verified(star, reps, texts, n, numerator), "links")
    labels = stored(components(links).toDF("rep", "component"), "labels")
    named = stored(reps.join(labels, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component")), "named")
    # the members of a signature are neighbours of its smallest one: where all neighbours are of one component, nothing is left to compare
    placed = star.join(named.selectExpr("id AS x", "component AS cx"), "x").join(named.selectExpr("id AS y", "component AS cy"), "y")
    split = placed.groupBy("x").agg(F.min(F.least("cx", "cy")).alias("low"), F.max(F.greatest("cx", "cy")).alias("high")).where("low < high").select("x")
    family = stored(components(star.join(split, "x", "left_semi").toDF("a", "b")).toDF("id", "family"), "families")
    rest = stored(possible(family.join(named, "id").join(reps.select("id", "n_shingles", "bits"), "id"), numerator), "rest")
    more = verified_in_cells(rest, reps, texts, n, numerator)
    # links between components are few; joined components take the smaller label
    ends = more.join(named.select("id", "component").toDF("x", "ca"), "x").join(named.select("id", "component").toDF("y", "cb"), "y")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("component", "low")
    known = named.select("rep", "component").join(joined, "component", "left")
    return known.select("rep", F.coalesce("low", "component").alias("component"))
