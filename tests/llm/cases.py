"""Fixtures with hard rows, and brute-force versions."""

import random
import re

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside
        *[T.StructField(c, T.StringType()) for c in ("doc", "key", "ids", "body", "block", "component_id", "signature", "leaks", "n_words", "kept", "score", "line_hash")],
    ]
)


def words(rng, n, of=400):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def hard_rows(seed=0, n=60):
    """Random texts with near copies, exact copies, blank, null, odd and very long texts, null ids and sources."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.35:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(t))
        elif texts and kind < 0.45:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(words(rng, rng.choice([1, 2, 4, 5, 6, 12, 40, 90, 160]))))
    texts += ["", " ", None, "\n\n", "\t\x0b", "é 漢字 😀 ﬁ", "▁a  b", "a" * 500, "<|endoftext|> x", "Ab aB AB ab\r\nAB ab", "!!!" * 30]
    texts.append(" ".join(words(rng, 30_000, 5000)))
    rows = [(i, t, "en", f"s{i % 7}" if i % 11 else None, len(t) if t is not None else None, *["x"] * 12) for i, t in enumerate(texts)]
    rows.append((None, texts[0], None, None, None, *[None] * 12))
    rows.append((None, None, None, None, None, *[None] * 12))
    return rows


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs; rows are (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated(rows, length=50):
    """{(doc_id, from, to)} by looking every window up in all documents."""
    ws = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows if i is not None}
    where = {}
    for i, w in ws.items():
        for k in range(len(w) - length + 1):
            where.setdefault(tuple(w[k : k + length]), set()).add(i)
    spans = set()
    for i, w in ws.items():
        start = None
        for k in range(len(w) - length + 2):
            again = k <= len(w) - length and len(where[tuple(w[k : k + length])]) > 1
            if again and start is None:
                start = k
            if not again and start is not None:
                spans.add((i, start, k - 1 + length))
                start = None
    return spans


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = {}
    for k in range(len(w) - 2):
        count[tuple(w[k : k + 3])] = count.get(tuple(w[k : k + 3]), 0) + 1
    inside = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)
