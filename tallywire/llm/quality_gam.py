"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins, and the model is a table of one number per bin, plus a table per chosen pair of features.
Boosted shallow trees learn the tables, one feature after the other in cycles, so that no feature takes what belongs to
another. Scoring adds up table entries, vectorised over a batch of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FEATURES = [
    "log_words", "word_length", "longest_word", "short_words", "distinct_words", "top_word", "distinct_triples", "log_lines",
    "dup_lines", "line_words", "closed_lines", "upper", "digits", "marks", "symbols", "not_ascii", "entropy", "adjacent",
]
_SYMBOLS = [ord(c) for c in "#*$%&|<>@^~=_\\{}[]+"]
_MARKS = [ord(c) for c in ".,;:!?\"'()-"]

#: Labelled rows the model is fitted on at most; the rows with the smallest hash of their id are taken.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6


def features_of(text: str | None) -> list[float]:
    """What the model sees of a whole text; a null text is an empty one. Nothing but the text is looked at."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    words = WORDS.findall(text)
    n, size = max(1, len(words)), max(1.0, hist.sum())
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    k = max(1, len(lines))
    p = hist[hist > 0] / size
    return [
        float(np.log1p(len(words))),
        float(lengths.mean()),
        float(np.log1p(lengths.max())),
        float((lengths <= 3).mean()),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2),
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / k,
        len(words) / k,
        sum(x.rstrip()[-1:] in ".!?:" for x in lines) / k,
        hist[65:91].sum() / size,
        hist[48:58].sum() / size,
        hist[_MARKS].sum() / size,
        hist[_SYMBOLS].sum() / size,
        hist[128:].sum() / size,
        float(-(p * np.log2(p)).sum()),
        sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


@dataclass
class Gam:
    """intercept, bin borders by feature, a table by feature, and (feature, feature, borders, borders, table) by pair."""

    intercept: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (b, t) in enumerate(zip(self.borders, self.tables)):
            out += t[np.searchsorted(b, x[:, f])]
        for f, g, bf, bg, t in self.pairs:
            out += t[np.searchsorted(bf, x[:, f]), np.searchsorted(bg, x[:, g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _cut(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[float, int]:
    """The best border between bins and what it gains."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0.0, -1
    all_g, all_h = grad.sum(), hess.sum()
    gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
    gain[(h < 2) | (all_h - h < 2)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """A tree over the bins of one feature, grown where it gains most: the step of each bin."""
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        gain, at, i = max((*_cut(grad[a:b], hess[a:b], penalty), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, a + at + 1), (a + at + 1, b)]
    step = np.empty(len(grad))
    for a, b in parts:
        step[a:b] = grad[a:b].sum() / (hess[a:b].sum() + penalty)
    return step


def _pair_tree(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """A tree of depth two over a pair's bins: one cut of the first feature, one of the second on each side."""
    best, step = -1.0, np.zeros_like(grad)
    for at in range(1, grad.shape[0]):
        total, found = 0.0, np.zeros_like(grad)
        for rows in (slice(0, at), slice(at, None)):
            g, h = grad[rows].sum(0), hess[rows].sum(0)
            gain, cut = _cut(g, h, penalty)
            for cols in (slice(0, cut + 1), slice(cut + 1, None)):
                value = g[cols].sum() / (h[cols].sum() + penalty)
                found[rows, cols] = value
                total += value * g[cols].sum()
        if total > best:
            best, step = total, found
    return best, step


def fit_tables(x: np.ndarray, y: np.ndarray, cycles: int = 120, rate: float = 0.1, leaves: int = 4, penalty: float = 1.0) -> Gam:
    """Fit on features `x` and labels `y` (0 or 1). With no rows or one class only the score is constant."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    n = x.shape[1]
    model.borders = [_borders(x[:, f], BINS) for f in range(n)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    bins = [np.searchsorted(b, x[:, f]) for f, b in enumerate(model.borders)]
    logit = np.full(len(y), model.intercept)
    for _ in range(cycles):
        for f in range(n):
            p = 1 / (1 + np.exp(-logit))
            size = len(model.tables[f])
            step = rate * _tree(np.bincount(bins[f], y - p, size), np.bincount(bins[f], p * (1 - p), size), leaves, penalty)
            model.tables[f] += step
            logit += step[bins[f]]
    coarse = [_borders(x[:, f], PAIR_BINS) for f in range(n)]
    at = [np.searchsorted(b, x[:, f]) for f, b in enumerate(coarse)]

    def histogram(f: int, g: int, w: np.ndarray) -> np.ndarray:
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        return np.bincount(at[f] * shape[1] + at[g], w, shape[0] * shape[1]).reshape(shape)

    p = 1 / (1 + np.exp(-logit))
    gains = {(f, g): _pair_tree(histogram(f, g, y - p), histogram(f, g, p * (1 - p)), penalty)[0] for f, g in combinations(range(n), 2)}
    chosen = sorted(gains, key=gains.get, reverse=True)[:PAIRS]
    tables = {fg: np.zeros((len(coarse[fg[0]]) + 1, len(coarse[fg[1]]) + 1)) for fg in chosen}
    for _ in range(cycles // 4):
        for f, g in chosen:
            p = 1 / (1 + np.exp(-logit))
            step = rate * _pair_tree(histogram(f, g, y - p), histogram(f, g, p * (1 - p)), penalty)[1]
            tables[f, g] += step
            logit += step[at[f], at[g]]
    model.pairs = [(f, g, coarse[f], coarse[g], tables[f, g]) for f, g in chosen]
    for f, t in enumerate(model.tables):  # tables have mean 0, the intercept takes the rest
        mean = float(t[bins[f]].mean())
        model.tables[f] = t - mean
        model.intercept += mean
    return model


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x): the feature vector of each row's whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["key", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(rows, f"key {kind}, x array<double>")


def held_out(key: str = "doc_id"):
    """The fold that never gives a label: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", max_rows: int = MAX_TRAIN) -> Gam:
    """Fit on at most `max_rows` labelled rows outside the held-out fold (those with the smallest hash of their id, so the
    choice does not depend on partitions). Rows with a null label or id, or with a label but no document, give nothing."""
    usable = labels.where(F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"))
    sample = usable.orderBy(F.xxhash64(F.col("id").cast("string")), "id", "y").limit(max_rows)
    chosen = docs.select(F.col(key).alias("id"), F.col("text")).join(F.broadcast(sample), "id")  # max_rows small rows
    rows = features(chosen, "id").withColumnRenamed("key", "id").join(F.broadcast(sample), "id").select("id", "x", "y")
    got = sorted((r["id"], r["y"], r["x"]) for r in rows.collect())  # max_rows rows of len(FEATURES) numbers
    x = np.array([r[2] for r in got], float).reshape(-1, len(FEATURES))
    return fit_tables(x, np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Gam, least: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row's whole text: score in 0 to 1, predicted 1 from `least` on. Equal texts score
    alike; empty and null texts score as a text without words; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features_of(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array((s >= least).astype(np.int32))], [key, "score", "predicted"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(rows, f"`{key}` {kind}, score double, predicted int")
