"""Operators against brute force and public libraries on small fixtures with hard rows."""

import random
import sys
import zlib

import cases
import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tallywire.llm import decontaminate, line_dedup, ngram_join, quality_gam, quality_rules, sentence_pieces, sharding, suffix_repeats, token_counts, warc
from tallywire.llm.common import components, shared_folder

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


# 1: pieces -----------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, hard, empty):
    import sentencepiece

    path = sentence_pieces.model_path(spark, PIECES)
    sp, p = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.read_pieces(path)
    rng = random.Random(3)
    parts = ["a", "the", " ", "  ", " " * 11, " " * 18, "\n", "é", "漢", "字", "😀", "ing", "----", "====", "▁", "<s>", "1."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += ["ab" * 2000, "e" * 3000, " " * 101, "a" + " " * 27 + "字", "", None]
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (hard, more):
        got = sentence_pieces.decode(sentence_pieces.encode(df, p), p).collect()
        assert len(got) == df.count()
        assert sorted(r["doc"]["doc_id"] or -1 for r in got) == sorted(r[0] or -1 for r in rows_of(df, "doc_id"))
        for r in got:
            assert r["ids"] == sp.encode(r["body"] or "")
            assert r["decoded"] == sp.decode(r["ids"])
    assert sentence_pieces.encode(empty, p).count() == 0


def test_viterbi_takes_the_largest_sum(spark):
    rng = random.Random(5)
    table = {"".join(rng.choice("abc") for _ in range(k)): -rng.random() * 10 for k in (1, 2, 2, 3, 3, 4, 5) for _ in range(3)} | dict.fromkeys("abc", -6.0)
    names = list(table)
    p = sentence_pieces.Pieces({n: i for i, n in enumerate(names)}, [], [n.encode() for n in names], [table[n] for n in names], bpe=False)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))) for _ in range(40)]

    def best(t):
        at = [(0.0, [])] + [(-1e9, [])] * len(t)
        for e in range(1, len(t) + 1):
            for s in range(e):
                if t[s:e] in table and at[s][0] + table[t[s:e]] > at[e][0]:
                    at[e] = (at[s][0] + table[t[s:e]], at[s][1] + [t[s:e]])
        return at[-1][0]

    got = sentence_pieces.dictionary(spark.createDataFrame([(t,) for t in set(texts)], "word string"), p).collect()
    assert len(got) == len(set(texts))
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<i4")
        assert "".join(names[i] for i in ids) == r["word"]
        assert sum(table[names[i]] for i in ids) == pytest.approx(best(r["word"]))


@pytest.mark.parametrize("bpe", [True, False])
def test_folded_words_go_to_arrow_without_lists(spark, bpe):
    """Spark writes an array column to Arrow batches so slowly, even one of nulls, that it took most of the time of handing the joined words over."""
    names = ["a", "b", "ab", "ba", "aba"]
    p = sentence_pieces.Pieces({n: i for i, n in enumerate(names)}, [], [n.encode() for n in names], [-9.0, -9.0, -1.0, -2.0, -3.0], bpe=bpe)
    texts = ["ab", "a" * 70, "aba" * 30, "ab" * 30, "b", "bb"]
    words = spark.createDataFrame([(t,) for t in texts], "word string")
    assert {f.name: f.dataType.simpleString() for f in sentence_pieces.folded(words, p).schema} == {"word": "string", "bits": "bigint", "more": "string"}
    got = {r["word"]: [names[i] for i in np.frombuffer(bytes(r["ids"]), "<i4")] for r in sentence_pieces.dictionary(words, p).collect()}
    assert all("".join(parts) == w for w, parts in got.items())
    assert got["ab"] == ["ab"] and got["ab" * 30] == ["ab"] * 30 and got["aba" * 30] == ["aba"] * 30


def test_chunks_are_cut_together_as_each_alone(spark):
    p = sentence_pieces.read_pieces(sentence_pieces.model_path(spark, PIECES))
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "\u2581", " ", "  ", "\n", ".", "1", "\u00bd", "\u6f22", "the", "_"]) for _ in range(rng.randrange(12)))
        marked = (sentence_pieces.MARK + text.replace(" ", sentence_pieces.MARK)) if text else ""
        chunks = p.chunks(text)
        assert "".join(sentence_pieces.MARK + c for c in chunks) == marked
        assert p.cutter.findall(marked) == [w for c in chunks for w in p.cutter.findall(sentence_pieces.MARK + c)]


# 2: token counts -----------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, hard, empty):
    from tokenizers import Tokenizer

    path = token_counts.spark_default_path(spark, BPE)
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(hard, path, limit=20)
    texts = {i: t for i, t in rows_of(hard, "doc_id", "text") if i is not None}
    seen = rows_of(got.where("doc_id IS NOT NULL"), "doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars")
    assert len(seen) == len(texts) and got.count() == hard.count()
    for i, size, tokens, over, cut in seen:
        t = texts[i] or ""
        assert (size, tokens, over) == (len(t.encode()), n(t), n(t) > 20)
        assert n(t[:cut]) <= 20
        if over:
            assert all(n(t[:k]) > 20 for k in range(cut + 1, min(len(t), cut + 40) + 1))
    assert token_counts.token_counts(empty, path).count() == 0


def test_every_prefix(spark):
    from tokenizers import Tokenizer

    path = token_counts.spark_default_path(spark, BPE)
    library, counter = Tokenizer.from_file(path), token_counts.Counter(token_counts.vocabulary_source(path))
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'re", "'l", "'", "!", "<|endoftext|>", "<|", "12", "é", "漢", "😀", "\xa0", "ing", "----", "aaaa"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(200)]
    for t in texts:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert [0, *(c for _, c in counter.prefixes(t))] == want
        for limit in (0, 1, 4):
            assert counter.longest(t, limit) == max(k for k, c in enumerate(want) if c <= limit)
    table = dict(rows_of(token_counts.prefix_tables(spark.createDataFrame(list(enumerate(texts[:20])), "doc_id long, text string"), path), "doc_id", "counts"))
    assert all(table[i][-1] == counter.total(t) for i, t in enumerate(texts[:20]))


# 3: n-gram join ------------------------------------------------------------------------------------------------------


def test_join_equals_all_pairs(spark, hard, empty):
    want = cases.components(rows_of(hard, "doc_id", "text"))
    got = ngram_join.near_duplicates(hard)
    assert got.count() == hard.count()
    assert {i: (n, c) for i, n, c in rows_of(got, "doc_id", "n_shingles", "component_id") if i is not None} == want
    assert len({c for _, c in want.values()}) < len(want)
    assert all(c is None for i, _, c in rows_of(got, "doc_id", "n_shingles", "component_id") if i is None)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_shingles_of_many_texts(monkeypatch):
    """Texts hashed together, in pieces, with words of any length and odd characters have as many shingles as one by one, and the same ones."""
    rng = random.Random(5)
    texts = [r[1] for r in cases.hard_rows()] + ["a" * 700 + " b " + "c" * 300 + " d", "x\x1cy \x85 z\u2003w", "K \u212a k", ""]
    texts += [" ".join(rng.choice(["ab", "ba", "aab", "A" * 256, "a" * 257]) for _ in range(rng.randrange(9))) for _ in range(200)]
    whole = list(ngram_join.shingle_sets(texts))
    assert [len(s) for s in whole] == [len(cases.shingles(t)) for t in texts]
    monkeypatch.setattr(ngram_join, "PIECE", 64)
    ngram_join._powers.cache_clear()
    for t, s in zip(texts, whole):
        assert np.array_equal(ngram_join.shingles(t), s)
    monkeypatch.undo()
    ngram_join._powers.cache_clear()


def test_signatures_travel_in_blocks(spark, monkeypatch):
    """A signature and its document take half of the 13 bytes of a row (signature, id), and blocks give the members of every signature."""
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 2**63, 200_000).astype(np.uint64)) << np.uint64(1)
    assert len(ngram_join._packed(keys)) < 6.7 * len(keys)
    for some in (keys, keys[:1], np.repeat(keys[:2], 3)):
        signature, number = ngram_join._unpacked(ngram_join._packed(some))
        assert np.array_equal((signature << np.uint64(16)) | number.astype(np.uint64), some)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(50)]
    texts += [t + " end" for t in texts[:20]] + texts[:5]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    monkeypatch.setattr(ngram_join, "HELD", 300)  # many blocks
    blocks = ngram_join.signed(docs, "text", 5, 80, np.empty(0, np.uint64), 6).collect()
    bases = sorted({r["base"] for r in blocks})
    named = {r["base"]: np.frombuffer(r["data"], "<i8") for r in blocks if r["bucket"] < 0}
    assert len(bases) == len(named)
    got = set()
    for r in blocks:
        if r["bucket"] >= 0:
            signature, number = ngram_join._unpacked(r["data"])
            assert set((signature >> np.uint64(42)).tolist()) == {r["bucket"]}
            got |= set(zip(signature.tolist(), named[r["base"]][number].tolist()))
    want = set()
    for t in texts:
        s = ngram_join.shingles(t)
        i = int.from_bytes(ngram_join._digest(s)[:8], "little", signed=True)
        want |= {(x >> 16, i) for x in ngram_join.signatures(s).tolist()}
    assert got == want


def test_texts_are_opened_once_in_a_cell(monkeypatch):
    """However many pairs of a cell a text stands in, it is shipped and hashed once."""
    import pyarrow as pa

    texts = [" ".join(f"w{i}" for i in range(60)) + f" x{k}" * (k > 0) for k in range(8)] + [" ".join(f"v{i}" for i in range(60))]
    codec, opened, real = pa.Codec("zstd"), [], ngram_join._opened
    monkeypatch.setattr(ngram_join, "_opened", lambda packed, n: opened.extend(packed) or real(packed, n))
    packed = [{"data": codec.compress(t.encode()).to_pybytes(), "size": len(t)} for t in texts]
    pairs = [(x, y) for x in range(9) for y in range(x + 1, 9)]
    kind = pa.struct([("data", pa.binary()), ("size", pa.int64())])
    names, types = [*ngram_join.CELL, "x", "y", "ta"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), kind]
    rows = [(c, 0, 0, *row) for c in (1, 2) for row in [*((i, None, p) for i, p in enumerate(packed)), *((x, y, None) for x, y in pairs)]]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 7]), types)], names) for i in range(0, len(rows), 7)]
    got = [tuple(r.values()) for b in ngram_join._linked_in_cells(iter(batches), 5, 80) for r in b.to_pylist()]
    assert got == 2 * [(x, y) for x, y in pairs if y < 8]
    assert len(opened) == 2 * len(texts)


def test_stored_measures_are_packed(spark, hard, monkeypatch):
    """With all columns they hold every text, and lie there while later stages of the pipeline run."""
    files, real = {}, quality_rules.stored

    def stored(df, what, *codec):
        out = real(df, what, *codec)
        files[what] = out.inputFiles()
        return out

    monkeypatch.setattr(quality_rules, "stored", stored)
    assert quality_rules.judge(hard).count() == hard.count()
    assert files["measures"] and all(".zstd." in f for f in files["measures"])


def test_sieve_lets_its_keys_through(spark):
    keys = spark.range(0, 3000, 3).withColumn("a", F.struct("id", F.lit("k")))
    sieve, log = ngram_join.sieve_of(keys, "a")
    rows = spark.range(3000).select(F.struct("id", F.lit("k")).alias("a"), "id").withColumns({f"at{i}": c for i, c in enumerate(ngram_join._places("a", log))})
    through = {r["id"] for r in rows.collect() if all(int(sieve[r[f"at{i}"] >> 6]) >> (r[f"at{i}"] & 63) & 1 for i in range(3))}
    assert through >= set(range(0, 3000, 3)) and len(through) < 1200


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    tested = 0
    for size in (1, 2, 4, 5, 6, 9, 13, 25, 60, 150, 400):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            k = 2 * len(a) // 9 + 2
            kept = rng.permutation(a)[min(rng.integers(0, k // 2 + 2), len(a)) :]
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**63, rng.integers(0, k + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 80 * (len(a) + len(b) - both):
                tested += 1
                assert set(ngram_join.signatures(a)) & set(ngram_join.signatures(b))
                hot = np.unique(np.concatenate([rng.permutation(a)[: rng.integers(0, len(a) + 1)], rng.integers(0, 2**63, 5).astype(np.uint64)]))
                assert set(ngram_join.signatures(a, hot=hot)) & set(ngram_join.signatures(b, hot=hot))
    assert tested > 200


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    parent = {x: x for e in edges if None not in e for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and root(a) != root(b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    linked = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4: archives ---------------------------------------------------------------------------------------------------------


def test_archives_read_back(spark):
    import base64
    import hashlib

    html = ["<p>a</p>", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny", "", None, "é漢😀", "z" * 300_000, "<p>a</p>", "<p>a</p>", "", "\n"]
    pages = [(i, f"http://h/{i}\r\nX: y" if i % 3 else None, h, "k") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", None), (None, None, "only", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(3)
    for least in (0, 5):
        got = warc.archive(df, shared_folder(spark, "test"), least).collect()
        assert len(got) == len(pages)
        by = {r["page_id"]: r for r in got if r["page_id"] is not None}
        for i, _, h, _ in pages:
            if i is None:
                continue
            data = (h or "").encode()
            top = max(k for k, _, x, _ in pages if k is not None and (x or "") == (h or ""))
            again = len(data) >= least and top != i
            r = by[i]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r["record_type"], r["refers_to"]) == (("revisit", top) if again else ("response", None))
            assert bytes(r["payload"]) == (b"" if again else data)
        assert sorted(r["record_type"] for r in got if r["page_id"] is None) == ["response", "revisit"]
    assert warc.archive(df.limit(0), shared_folder(spark, "test")).count() == 0


# 5: shards -----------------------------------------------------------------------------------------------------------


def test_shards(spark, hard, empty):
    got = sharding.deal(hard, 8)
    rows = rows_of(got, "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    data = lambda t: (t or "").encode()
    want = sorted((i if i is not None else -1, len(data(t)) + 1, zlib.crc32(data(t))) for i, t in rows_of(hard, "doc_id", "text"))
    assert sorted((i if i is not None else -1, s, c) for i, s, c, *_ in rows) == want
    for shard in range(8):
        slots = sorted(r[5] for r in rows if r[4] == shard)
        assert slots == list(range(len(slots)))
    assert all(g in (s, 8) for *_, s, _, g in rows)
    assert sharding.deal(empty).count() == 0
    names = [x.name for x in sharding.deal(hard)._jdf.queryExecution().executedPlan().toString().splitlines() if "Python" in x or "Arrow" in x]
    assert not names


def test_weights_and_movement(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    shards = [sharding.Shard(0, "a", "a1", 1.0), sharding.Shard(1, "a", "a2", 3.0), sharding.Shard(2, "b", "b1", 4.0)]
    heavier = [*shards[:2], sharding.Shard(2, "b", "b1", 8.0)]
    got = ids.select(sharding.shard_of("k", shards).alias("s"), sharding.shard_of("k", heavier).alias("t")).groupBy("s", "t").count().collect()
    share = {s: sum(r["count"] for r in got if r["s"] == s) / 20_000 for s in range(3)}
    assert share == pytest.approx({0: 0.125, 1: 0.375, 2: 0.5}, abs=0.02)
    assert all(r["s"] == r["t"] or r["t"] == 2 for r in got)
    with pytest.raises(ValueError):
        sharding.shard_of("k", [])


# 6: lines ------------------------------------------------------------------------------------------------------------


def test_lines(spark, empty):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool[: rng.randrange(1, 31)]) for _ in range(rng.randrange(6))) + rng.choice(["", "\n", "\n \n"]), f"s{rng.randrange(12)}" if i % 9 else None) for i in range(120)]
    rows += [(None, pool[0], "s1"), (3, pool[1], "s2"), (500, None, "s1"), (501, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line_hash", F.lit(1)).repartition(4)
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip() and s is not None:
                sites.setdefault(line, set()).add(s)
    for least in (1, 4, 9):
        bad = {x for x, s in sites.items() if len(s) >= least}
        want = sorted((i if i is not None else -1, "\n".join(x for x in t.split("\n") if x not in bad) if t is not None else None, sum(bool(x.strip()) for x in (t or "").split("\n")), sum(x in bad for x in (t or "").split("\n"))) for i, t, _ in rows if t is not None)
        got = line_dedup.remove_boilerplate(df, least).select("doc.doc_id", "kept_text", "n_lines", "n_removed").collect()
        assert sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in got if r[1] is not None) == want
        assert len(got) == len(rows)
    assert line_dedup.remove_boilerplate(empty).count() == 0


# 7: benchmark --------------------------------------------------------------------------------------------------------


def test_alignment_equals_the_full_matrix():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                same = decontaminate.MATCH if x == y and x else decontaminate.MISMATCH
                h[i][j] = max(0, h[i - 1][j - 1] + same, h[i - 1][j] + decontaminate.GAP, h[i][j - 1] + decontaminate.GAP)
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_leaks(spark, hard, empty):
    rng = random.Random(8)
    items = [" ".join(cases.words(rng, n, 300)) for n in (12, 20, 40, 40, 60)] + ["two words", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def edited(t, share):
        return " ".join("changed" if rng.random() < share else w for w in t.split(" "))

    other = lambda n: " ".join(f"v{rng.randrange(2000)}" for _ in range(n))
    planted, docs = [], []
    for i in range(80):
        k = i % 5
        body = {0: items[k], 1: items[k].upper(), 2: edited(items[k], 0.12), 3: None}[i % 4]
        docs.append((i, f"{other(30)}. {body}, {other(50)}" if body else other(90)))
        if body:
            planted.append((i, k))
    docs += [(900, None), (901, ""), (902, "so two words here"), (903, items[2] + " " + items[2]), (None, items[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit("x")).repartition(3)
    rows = decontaminate.with_leaks(df, bench, keep=["doc_id"]).select("doc.doc_id", "leaks").collect()
    found = {(r["doc_id"], x["item"]) for r in rows for x in r["leaks"]}
    assert len(rows) == len(docs)
    assert found == set(planted) | {(902, 5), (903, 2), (None, 3)}
    for r in rows:
        for x in r["leaks"]:
            assert 0.5 <= x["score"] <= 1 and x["doc_from"] < x["doc_to"]
            if (r["doc_id"] or 0) % 4 == 0 and r["doc_id"] is not None and r["doc_id"] < 80:
                assert (x["score"], x["doc_from"], x["doc_to"] - x["doc_from"]) == (1.0, 30, len(items[x["item"]].split(" ")))
    blocks = decontaminate.BLOCK_WORDS
    decontaminate.BLOCK_WORDS = 50  # several blocks give the same
    try:
        again = decontaminate.with_leaks(df, bench, keep=["doc_id"]).select("doc.doc_id", "leaks").collect()
    finally:
        decontaminate.BLOCK_WORDS = blocks
    assert {(r["doc_id"], x["item"]) for r in again for x in r["leaks"]} == found
    assert decontaminate.with_leaks(empty, bench).count() == 0
    assert decontaminate.with_leaks(hard, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_rare_words_are_counted_in_all_documents(spark):
    words = [f"w{i}" for i in range(12)]  # w0 is the most frequent
    docs = [(w,) for i, w in enumerate(words) for _ in range(12 - i)]
    df = spark.createDataFrame(docs, "text string").repartition(4)
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    block = next(decontaminate.blocks(bench, 3, "item_id", "text"))
    limits = [decontaminate.bounds(len(words), 3, 0.5)]
    rare = decontaminate.rare_words(df, block, limits, "text")
    n = len(words) - limits[0].matched + int(rare.together[0])
    assert n < len(words)
    chosen = {w for w, k in block.numbers.items() if rare.start[k + 1] > rare.start[k]}
    assert chosen == set(words[-n:])


def test_words_of_benchmark_and_documents():
    rng = random.Random(10)
    word = regex.compile(r"\w+")
    every = [chr(c) for c in range(sys.maxunicode + 1)]
    assert all(decontaminate.words_of(f"a{c}B") == word.findall(f"a{c}B".lower()) for c in every)
    for _ in range(500):
        t = "".join(rng.choice(every if rng.random() < 0.3 else "aB_ Σς.İ9'\u0301\u200d\u00a0\x1c\n") for _ in range(rng.randrange(40)))
        assert decontaminate.words_of(t) == word.findall(t.lower())
    assert decontaminate.words_of(None) == decontaminate.words_of("") == []


def test_leaks_of_many_short_texts_are_looked_for_at_once(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "a g")], "item_id long, text string")
    block = next(decontaminate.blocks(bench, 3, "item_id", "text"))
    limits = [decontaminate.bounds(len(a), 3, 0.5) for _, a in block.items]
    rare = decontaminate.rare_words(spark.createDataFrame([("x",)], "text string"), block, limits, "text")
    texts = ["x a b", "c d", None, "", "X c D E a g", "a x b", "g a g"] * 30
    calls, codes = [], decontaminate.Block.codes
    monkeypatch.setattr(decontaminate.Block, "codes", lambda self, a, width: calls.append(width) or codes(self, a, width))
    whole = [(k, a.tolist(), near) for k, a, near in decontaminate.seeds(block, block.looked(), rare, texts)]
    assert calls == [2, 3]  # not once a text
    n = dict(zip("abcdefg", block.number(list("abcdefg")).tolist()))
    assert [x for x in whole if x[0] == 4] == [(4, [0, n["c"], n["d"], n["e"], n["a"], n["g"]], {1: [4, 4, 5], 0: [1, 1]})]
    for limit in ("SLICE_CHARS", "SORTED_PAIRS"):  # text by text: no n-gram and no group of rare words spans two
        with monkeypatch.context() as m:
            m.setattr(decontaminate, limit, 1)
            assert [(k, a.tolist(), near) for k, a, near in decontaminate.seeds(block, block.looked(), rare, texts)] == whole


@pytest.mark.parametrize("twins", [False, True])
def test_edited_leaks_equal_alignment_of_all(spark, twins):
    rng = random.Random(9)
    common = [f"c{int(60 * rng.random() ** 3)}" for _ in range(20_000)]
    items = []
    for _ in range(24):
        a = rng.randrange(15_000)
        items.append([w if rng.random() < 0.5 else f"r{rng.randrange(3000)}" for w in common[a : a + rng.randrange(15, 60)]])
    items += [["c1"], ["c7", "r9"], ["c2", "r5", "c3"], ["c4", "r6", "c5", "r7"]]
    texts = [common[a : a + 120] for a in range(0, 6000, 120)]
    new = lambda: f"n{rng.randrange(500)}"
    for words in items:
        for every in (2, 3, 4, 5, 6):
            body = [new() if i % every == every - 1 else w for i, w in enumerate(words)]
            texts.append(common[:30] + body + common[40:90])
        body = [new() if rng.random() < 0.25 else w for w in words]
        texts += [common[:9] + body, [x for w in words for x in (w, new())], [w for w in words if rng.random() < 0.7]]
        texts += [words] if twins else []
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = decontaminate.with_leaks(df, bench).select("doc.doc_id", "leaks").collect()
    got = {(r["doc_id"], x["item"]): x["score"] for r in rows for x in r["leaks"]}
    number = {w: i for i, w in enumerate({w for x in items + texts for w in x}, 1)}
    a, b = ([np.array([number[w] for w in x]) for x in y] for y in (items, texts))
    full = {(d, i): decontaminate.align(x, y)[0] / (2 * len(x)) for i, x in enumerate(a) for d, y in enumerate(b)}
    assert got == {k: v for k, v in full.items() if v >= 0.5}


# 8: classifier -------------------------------------------------------------------------------------------------------


def test_model_learns_steps_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)) & (x[:, 3] > 0.2)).astype(float)
    model = quality_gam.fit_tables(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) >= 0.5) == (y[3000:] == 1)).mean() > 0.85
    assert (1, 2) in {(f, g) for f, g, *_ in model.pairs}
    assert quality_gam.fit_tables(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert len(set(quality_gam.fit_tables(x, np.ones(4000)).score(x[:9]))) == 1


def test_scores(spark, hard, empty):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(None, 1), (7, None), (10_000, 1)], "doc_id long, quality int")
    model = quality_gam.fit(hard, labels)
    rows = quality_gam.score(hard, model).collect()
    assert len(rows) == hard.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality_gam.score(empty, model).count() == 0
    assert quality_gam.fit(hard, labels).intercept == model.intercept
    assert quality_gam.fit(empty, labels).tables == []
    folds = rows_of(hard.select("doc_id", quality_gam.held_out().alias("h")), "doc_id", "h")
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, h in folds)


# 9: rules ------------------------------------------------------------------------------------------------------------


def test_rules(spark, hard, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["a b c a b c", "x x x x", "a\na\n\nb\na", "#*$ |<> a & b%", "a b c d a b c", "l\r\nl\r\n"])], "doc_id long, text string")
    for df in (hard, more):
        judged = quality_rules.judge(df)
        texts = {i: t for i, t in rows_of(df, "doc_id", "text") if i is not None}
        got = judged.select("doc.doc_id", *names, "base_failed", "kept", "posterior").collect()
        assert len(got) == df.count()
        for r in got:
            if r["doc_id"] is None:
                continue
            want = cases.measures(texts[r["doc_id"]])
            assert tuple(r[n] for n in names) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    assert quality_rules.judge(empty).count() == 0


def test_accuracies_are_recovered(spark):
    rng = random.Random(9)
    rates = {"length": (0.95, 0.1), "symbols": (0.9, 0.2), "repeats": (0.8, 0.3), "upper": (0.7, 0.35)}
    rows, truth = [], []
    for i in range(4000):
        good = rng.random() < 0.7
        truth.append(good)
        rows.append((i, *[-1 if rng.random() < 0.2 else int(rng.random() < rates[r][not good]) for r in rates]))
    votes = spark.createDataFrame(rows, "i long, " + ", ".join(f"v_{r} int" for r in rates))
    model = quality_rules.fit(votes, list(rates))
    assert model.prior == pytest.approx(0.7, abs=0.06)
    for r, (a, b) in rates.items():
        assert model.on_good[r] == pytest.approx(a, abs=0.06) and model.on_bad[r] == pytest.approx(b, abs=0.1)


# 10: repeats ---------------------------------------------------------------------------------------------------------


def test_repeats_equal_all_windows(spark, hard, empty):
    rng = random.Random(11)
    passages = [" ".join(cases.words(rng, n, 5000)) for n in (49, 50, 51, 58, 75, 140)]
    rows = []
    for i in range(60):
        parts = [" ".join(cases.words(rng, rng.randrange(0, 40), 5000)) for _ in range(3)]
        parts.insert(1, rng.choice(passages))
        if i % 3 == 0:
            parts.insert(3, rng.choice(passages))
        rows.append((i, " ".join(parts)))
    rows.append((70, " ".join([passages[0]] * 3)))  # repeats inside one document
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).repartition(4)
    for df in (more, hard):
        got = set(rows_of(suffix_repeats.repeats(df), "doc_id", "word_from", "word_to"))
        assert got == cases.repeated(rows_of(df, "doc_id", "text"))
        assert got
    assert suffix_repeats.repeats(empty).count() == 0
