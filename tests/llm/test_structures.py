"""Merkle manifest, SimHash and prefix trie against brute force on hard rows."""

import hashlib
import math
import random
import re
import zlib

import cases
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywire.llm import common, merkle, prefix_trie, simhash


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def merkle_brute(rows):
    """Result rows of the proofs; rows are (doc_id, source, lang, n_chars, text)."""

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            s = i // 16 * 16
            out.append(("".join(nodes[s:i]), "".join(nodes[i + 1 : s + 16])))
            i //= 16
        return out

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    by = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
        by.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], lower(r[4]))) if tampered else leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=key)
    trees = {s: up([x[1] for x in by[s]]) for s in order}
    top = up([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (d, mine, now) in enumerate(by[s]):
            p = path(trees[s], i) + path(top, k)
            for x, y in p:
                now = sha(x + now + y)
            out.append((d, mine, trees[s][-1][0], top[-1][0], sha("".join(x + y for x, y in p)), now, now == top[-1][0]))
    return sorted(out, key=key)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("span", [(4096, 4), (16, 2)])
def test_merkle_on_hard_rows(spark, hard, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span[0])
    monkeypatch.setattr(merkle, "LEVELS", span[1])
    docs = hard.unionByName(hard.where("doc_id % 4 = 0")).unionByName(hard.where("doc_id = 3").withColumn("text", F.lit("other")))
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "hot").otherwise(F.col("source")))
    got = [tuple(r) for r in merkle.proofs(merkle.build(merkle.document_leaves(docs))).collect()]
    assert sorted(got, key=key) == merkle_brute([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_merkle_of_one_row_and_of_none(spark, hard, empty):
    one = hard.where("doc_id = 1")
    row = merkle.proofs(merkle.build(merkle.document_leaves(one))).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")
    nothing = merkle.build(merkle.document_leaves(empty))
    assert nothing.root is None and merkle.proofs(nothing).count() == 0


def test_listed_siblings_fold_without_the_manifest(spark, hard):
    manifest = merkle.build(merkle.document_leaves(hard))
    for r in merkle.proofs(manifest, listed=True).collect():
        now = r["leaf"]
        for p in r["siblings"]:
            now = sha(p["left"] + now + p["right"])
        assert now == manifest.root


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 300, 4095, 4096])
def test_van_emde_boas_addresses(n):
    """Every node has its own place, subtrees stand together, and the root stands first."""
    for levels in (merkle.height(n), 4):
        size = int(merkle.size(n, levels))
        at = [merkle.address(j, np.arange(merkle.width(n, j)), n, levels) for j in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(size)) and at[-1][0] == 0
        low = levels // 2
        for sub in range(merkle.width(n, low - 1)) if levels > 1 else ():
            places = np.concatenate([at[j][sub * 16 ** (low - 1 - j) : (sub + 1) * 16 ** (low - 1 - j)] for j in range(low)])
            assert places.max() - places.min() == len(places) - 1


def test_numbering_spreads_a_hot_group(spark):
    rows = spark.range(0, 4000, numPartitions=8).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    out = common.numbered(rows, "g", ["v"], "test").collect()
    groups = {}
    for r in out:
        groups.setdefault(r["g"], []).append((r["at"], r["v"], r["total"]))
    for found in groups.values():
        found.sort()
        assert [a for a, _, _ in found] == list(range(len(found))) and {t for *_, t in found} == {len(found)}
        assert [v for _, v, _ in found] == sorted(v for _, v, _ in found)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    n = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), seed=42) for i in range(len(words) - n + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_brute(rows):
    first = {}
    for i, f in rows:
        if i is not None:
            first[f] = min(i, first.get(f, i))
    parent = {i: i for i in first.values()}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    nodes = sorted(first)
    for a, x in enumerate(nodes):
        for y in nodes[a + 1 :]:
            if (x ^ y).bit_count() <= 4:
                low, high = sorted((root(first[x]), root(first[y])))
                parent[high] = low
    return sorted(((i, f"{f:016x}", None if i is None else root(first[f])) for i, f in rows), key=key)


@pytest.mark.parametrize("crowd", [256, 1])
def test_simhash_on_hard_rows(spark, hard, crowd):
    docs = hard.unionByName(hard.where("doc_id % 4 = 0"))
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).collect()), key=key)
    assert got == simhash_brute([(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()])


def test_simhash_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=key)
    assert got == simhash_brute([(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [256, 3])
def test_links_of_a_dense_family(spark, crowd):
    """Fingerprints around a few centres, at all distances up to eight bits and with chains, have the components of all pairs."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 5, 8]))))
    rows = [(f - (1 << 64) if f >> 63 else f) for f in fps]
    found = simhash.links(spark.createDataFrame([(r,) for r in rows], "fp bigint"), crowd=crowd).collect()
    assert all(((r["x"] ^ r["y"]) & (1 << 64) - 1).bit_count() <= 4 for r in found)

    def classes(pairs):
        parent = {r: r for r in rows}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            parent[root(a)] = root(b)
        groups = {}
        for r in rows:
            groups.setdefault(root(r), set()).add(r)
        return sorted(map(sorted, groups.values()))

    every = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert classes([(r["x"], r["y"]) for r in found]) == classes(every)


def test_exploded_keys_are_not_broadcast(spark):
    """Spark sizes the keys like the fingerprints they are made of, so a small table would be broadcast 35 times as large."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 1 << 20
    found = simhash.links(spark.range(100).selectExpr("xxhash64(id) AS fp"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    inner = [line for line in plan.splitlines() if "Join [" in line and "Inner" in line]
    assert inner and not any("BroadcastHashJoin" in line for line in inner)


def test_simhash_of_nothing(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0


def trie_brute(rows):
    """Result rows of the trie; rows are (conv_id, turn, role, text)."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, sha(f"{len((r or '').encode())}:{r or ''}{x or ''}")[:32], r or "", x or ""))
    by = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    new = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = by.get(c - int(math.fmod(c, 5)), [])[:h] + by[c][h:]
    nodes, kids, sub, out = {}, {}, {}, []
    for c, s in new.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        saved = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        sub[p] = sum(sub[k][0] for k in below) or 1, saved + sum(sub[k][1] for k in below)
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(new[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), *sub[p], sha(ends)))
    return sorted(out, key=key)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def talks(seed=1):
    """Conversations with shared beginnings, some of hundreds of turns, lengths that are multiples of a segment, nulls and ties."""
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 20, 64, 65, 128, 130, 200])):
            text = f"t{t // 3}" if rng.random() > (0.01 if t < 100 else 0.3) else rng.choice([None, "", "x", "é"])
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["u", None, "a"]) if t > 6 else "u", text))
    rows += [(c, t, "u", f"same {t}") for c in range(200, 420) for t in range(8)]  # one conversation many times
    rows += [(None, 1, "u", "x"), (-3, 1, "u", "t0"), (-7, 0, None, None), (1000, 0, "u", "t0"), (1000, 0, "u", "t0"), (1001, 0, "u", "y" * 5000)]
    return rows


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 3])
def test_trie_on_hard_rows(spark, block):
    rows = talks()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("ids", F.lit("x")).repartition(5)
    out = prefix_trie.trie(*prefix_trie.rebuilt(table), block=block)
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=key) == trie_brute(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(table).count() == 0


def test_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 9, 200)
    table = prefix_trie.Minima(values)
    left = rng.integers(0, 200, 300)
    right = np.minimum(199, left + rng.integers(0, 200, 300))
    assert table.over(left, right).tolist() == [values[a : b + 1].min() for a, b in zip(left, right)]
    rows = np.arange(200)
    depth = np.maximum(values, 1)
    for i, (a, b) in enumerate(zip(*table.extents(rows, depth))):
        lo, hi = i, i
        while lo > 0 and values[lo] >= depth[i]:
            lo -= 1
        while hi < 199 and values[hi + 1] >= depth[i]:
            hi += 1
        assert (a, b) == (lo, hi)


def test_pipeline_judges_rows_by_id_and_text(spark):
    """Repeats of id and text stay once, an id with two texts is two documents, rows without an id stay."""
    import corpus_pipeline

    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    rows = [(1, t, "a"), (1, t, "b"), (2, t + " x", "a"), (2, u, "a"), (None, t, "a"), (5, None, "a"), (5, None, "a"), (6, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.keep_first_of_group(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, t), (2, u), (None, t), (5, None), (6, "")], key=str)
    assert corpus_pipeline.keep_first_of_group(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("side", [1024, 3])
def test_families_below_the_limit(spark, monkeypatch, side):
    """Texts that are alike at all degrees around the limit, compared in one block or in many, with keys of any type."""
    from tallywire.llm import ngram_join

    monkeypatch.setattr(ngram_join.possible, "__defaults__", (side,))
    rng = random.Random(7)
    base, texts = [f"b{i}" for i in range(90)], []
    for _ in range(70):
        words = list(base)
        for k in rng.sample(range(90), rng.randrange(0, 6)):
            words[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = cases.components(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == want
    if side == 3:
        keyed = docs.withColumn("k", F.struct("doc_id", F.lit(1).alias("x")))
        rows = ngram_join.near_duplicates(keyed, key="k").collect()
        assert {r["k"]["doc_id"]: r["component_id"]["doc_id"] for r in rows} == {i: c for i, (_, c) in want.items()}
