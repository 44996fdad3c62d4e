"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

The encoding of a prefix ends in exactly one token that agrees with the encoding of what stands before it: two
neighbouring tokens agree if merging their joined bytes gives these two tokens again. So the token count of every prefix
of a pre-token follows from shorter prefixes, one step a byte, and the table of a pre-token answers counts, cuts
and budgets at any position without encoding again. Tables are kept by pre-token inside a task.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Totals and tables a Python worker keeps; when full, they start again. Results do not depend on it.
TOTALS, TABLES = 1_000_000, 100_000
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letters by which the vocabulary file names bytes: printable Latin-1 stands for itself, the other
    bytes in order for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class Vocabulary:
    """A byte-level BPE vocabulary: token bytes, merges in order of rank, and special strings."""

    def __init__(self, source: str):
        data = json.loads(source)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in data["model"]["vocab"].items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = self.ids[raw(left)], self.ids[raw(right)], self.ids[raw(left + right)]
            self.merges[a, b] = rank
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (a, b), rank
        # lengths of tokens: all up to `dense`, and single longer ones
        lengths = {len(b) for b in self.ids}
        self.dense = next(n for n in range(1, len(lengths) + 2) if n + 1 not in lengths)
        self.sparse = sorted((n for n in lengths if n > self.dense), reverse=True)
        self.special = [t["content"] for t in data.get("added_tokens", [])]
        self._ends: tuple[dict, dict] = ({}, {})
        self._agree: dict[tuple[int, int], bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at a token's left (0) or right (1) edge while it is merged, each with the rank of the merge that takes it."""
        found = self._ends[side].get(token)
        if found is None:
            found, t, until = [], token, NEVER
            while True:
                found.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.rank[t], self.parts[t][side]
            self._ends[side][token] = found
        return found

    def agree(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together encode to a and b: no merge across the border comes first on both sides.
        Of equal ranks the left merge comes first."""
        known = self._agree.get((a, b))
        if known is None:
            known = True
            for r, r_until in self._edge(a, 1):
                for left, l_until in self._edge(b, 0):
                    rank = self.merges.get((r, left))
                    if rank is not None and rank < r_until and rank <= l_until:
                        known = False
            if len(self._agree) > 2_000_000:
                self._agree.clear()
            self._agree[a, b] = known
        return known

    def prefix_counts(self, data: bytes) -> list[int]:
        """The token count of every prefix of a pre-token's bytes, the empty one first."""
        counts, last = [0], [-1]
        ids, agreed, longest, odd = self.ids, self._agree, self.dense, self.sparse
        for end in range(1, len(data) + 1):
            starts = range(max(0, end - longest), end)
            if end > longest:
                starts = [*(end - size for size in odd if size <= end), *starts]
            for start in starts:
                token = ids.get(data[start:end])
                if token is None:
                    continue
                if start:
                    known = agreed.get((last[start], token))
                    if not (self.agree(last[start], token) if known is None else known):
                        continue
                counts.append(counts[start] + 1)
                last.append(token)
                break
        return counts


class Tables(dict):
    """Prefix counts by pre-token, made when first asked for. `totals` has their last entries."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.totals = _Totals(self)

    def __missing__(self, piece: str):
        counts = self.vocabulary.prefix_counts(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= TABLES:
            self.clear()
        self[piece] = counts = bytes(counts) if counts[-1] < 256 and max(counts) < 256 else counts
        return counts


class _Totals(dict):
    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, piece: str) -> int:
        if len(self) >= TOTALS:
            self.clear()
        data = piece.encode("utf-8", "surrogatepass")
        vocabulary = self.tables.vocabulary
        # a token is its own encoding
        self[piece] = n = 1 if data in vocabulary.ids else vocabulary.prefix_counts(data)[-1]
        return n


class Counter:
    """Token counts of texts and of their prefixes."""

    def __init__(self, source: str):
        self.vocabulary = Vocabulary(source)
        self.tables = Tables(self.vocabulary)
        self.pattern = regex.compile(PATTERN)
        named = "|".join(regex.escape(s) for s in sorted(self.vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(named) if named else None

    def segments(self, text: str) -> Iterator[tuple[int, str, bool]]:
        """(start, string, is special): the text cut at its special strings."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield at, text[at : m.start()], False
            yield m.start(), m.group(), True
            at = m.end()
        yield at, text[at:], False

    def total(self, text: str) -> int:
        totals = self.tables.totals
        return sum(1 if special else sum(map(totals.__getitem__, self.pattern.findall(s))) for _, s, special in self.segments(text))

    def _inside(self, piece: str, chars: int) -> int:
        return self.tables[piece][len(piece[:chars].encode("utf-8", "surrogatepass"))]

    def _partial(self, segment: str, base: int, limit: int, at: int = 0) -> Iterator[tuple[int, int]]:
        """(characters, token count) of every non-empty prefix of a segment that is longer than `at`, the end of a pre-token that is not
        blank (or 0); `base` tokens stand before it. While whole pre-tokens stay within `limit`, only their ends are given: every prefix
        before a later end is shorter. With a limit it ends where no longer prefix can keep it."""
        space_from, space_base = at, base
        sure = [base]  # tokens before each of the last pre-tokens that are not blank
        for m in self.pattern.finditer(segment, at):
            piece, start = m.group(), m.start()
            whole = base + self.tables.totals[piece]
            blank = piece.isspace() or not piece.strip()
            if whole > limit or blank:
                # a longer prefix has the same pre-tokens up to the last two and the blanks before them
                if 0 <= limit < sure[0] and len(sure) == 3:
                    return
                for c in range(1, len(piece) + 1):
                    if blank or c == 1 and piece[0].isspace() and len(piece) > 1:
                        run = segment[space_from : start + c]  # white space up to the end is one pre-token
                        yield start + c, space_base + self.tables.totals[run]
                    elif piece[0] == "'" and c == 2 and len(piece) == 3 and piece[1:].isalpha():
                        yield start + c, base + 2  # a contraction cut short is a mark and a letter
                    else:
                        yield start + c, base + self._inside(piece, c)
            else:
                yield m.end(), whole
            base = whole
            if not blank:
                space_from, space_base = m.end(), base
                sure = [*sure[-2:], base]

    def prefixes(self, text: str, limit: int = -1) -> Iterator[tuple[int, int]]:
        """(characters, token count of that prefix) in rising order; with `limit` below 0 for every prefix."""
        base = 0
        before, before_base = "", 0
        for start, s, special in self.segments(text):
            if special:
                for c in range(1, len(s)):  # a special string cut short is ordinary text
                    yield start + c, before_base + sum(map(self.tables.totals.__getitem__, self.pattern.findall(before + s[:c])))
                base += 1
                yield start + len(s), base
            else:
                before, before_base = s, base
                for c, n in self._partial(s, base, limit):
                    yield start + c, n
                base += sum(map(self.tables.totals.__getitem__, self.pattern.findall(s)))

    def longest(self, text: str, limit: int) -> int:
        """The characters of the longest prefix with at most `limit` tokens."""
        totals, best, base = self.tables.totals, 0, 0
        before, before_base = "", 0
        for start, s, special in self.segments(text):
            if special:
                for c in range(1, len(s)) if before_base <= limit else ():  # a special string cut short is ordinary text
                    if before_base + sum(map(totals.__getitem__, self.pattern.findall(before + s[:c]))) <= limit:
                        best = max(best, start + c)
                base += 1
                if base <= limit:
                    best = start + len(s)
                continue
            before, before_base = s, base
            pieces = self.pattern.findall(s)
            ends = list(accumulate(map(totals.__getitem__, pieces), initial=base))
            if ends[-1] <= limit:
                best = start + len(s) if s else best
            elif base <= limit:
                # the counts of whole pre-tokens find the place near which the limit is passed
                k = bisect_right(ends, limit) - 1
                while k and (pieces[k - 1].isspace() or not pieces[k - 1].strip()):
                    k -= 1
                at = sum(map(len, pieces[:k]))
                best = max(best, start + at, *(start + c for c, n in self._partial(s, ends[k], limit, at) if n <= limit)) if at or s else best
            base = ends[-1]
        return best


_COUNTERS: dict[int, Counter] = {}


def _counter(source: str) -> Counter:
    """The counter of this Python worker, whose tables outlive a task."""
    key = hash(source)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(source)
    return _COUNTERS[key]


def vocabulary_source(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def token_counts(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, cut_chars) of every row's whole text, in one pass without a shuffle.

    path: the vocabulary file, read by the driver. cut_chars: length of the longest prefix whose own encoding has at most
    `limit` tokens. A null text counts as empty (0 tokens); repeated rows and null keys stay; an empty table gives no
    rows; other columns are not read, so their names do not matter.
    """
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(path))  # a vocabulary, a few MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.total(t) for t in texts]
            cut = [counter.longest(t, limit) if k > limit else len(t) for t, k in zip(texts, n)]
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(cut, pa.int64())],
                [key, "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(count, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, cut_chars bigint")


def prefix_tables(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts): the token count of every prefix of the text by its characters, the empty one first. `counts[k]` tells
    what a cut at k costs; the last k with `counts[k] <= budget` is where to cut. Null texts have the table [0]."""
    source = docs.sparkSession.sparkContext.broadcast(vocabulary_source(path))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                counts = [0, *(n for _, n in counter.prefixes(t or ""))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([counts], pa.list_(pa.int32()))], [key, "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(tables, f"`{key}` {kind}, counts array<int>")


def spark_default_path(spark: SparkSession, name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary: the session's `tallywire.tokenizers` folder, or the installed package."""
    folder = spark.conf.get("tallywire.tokenizers", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
