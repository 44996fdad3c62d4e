"""Prefix trie of conversations by range minima over sorted common prefixes.

Conversations are sorted as sequences of turn digests. The common prefix lengths (LCP) of neighbours say all about the trie: the members
of a prefix of depth d are the widest stretch of rows around one of them in which no LCP is below d. A sparse table of range minima over
the LCPs lets every candidate prefix search its left and its right end by itself, in powers of two; there is no stack and no order
among candidates. Candidates are the whole sequence of every row and the prefix it shares with the row before it; the depths
between a node and the next node above it have the same members.

No task holds all rows: the sorted table is cut into blocks of BLOCK rows with a sparse table each, and LCPs across the borders are known.
All measures of a node are sums over its rows (or minima), so a node that reaches over a border is added up from its blocks:
a child, a leaf or a saving is counted at the row that begins it. No row holds a whole conversation of unknown length either: it is a row
for every SEGMENT turns, whose context is a digest of all turns before; rows sort by context first, and the top of a context is the
last node of the segment before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywire.llm.common import numbered, stored

BLOCK, SEGMENT, WIDE = 8192, 64, 16


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, total, id, n_bytes): the turns of `conversations` (conv_id, turn, role, text) by number, nulls first; turns of one number
    by their digest. A null role or text is empty; rows without a conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.unhex(F.substring(digest, 1, 2 * WIDE)).alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    return numbered(rows, "conv_id", ["turn", "id"], "turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id, n_bytes) and (conv_id, length): every conversation c as the first h turns of conversation c - c % 5 and then its own
    turns after its first h, where h is the unsigned crc32 of its decimal conv_id modulo 9."""
    own = turns(conversations)
    each = own.where("at = 0").select("conv_id", F.col("total").alias("n"))
    each = each.select("*", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"))
    bases = each.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    taken = F.least("h", F.coalesce("m", F.lit(0)))
    each = each.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length"))
    each = stored(each, "conversations")
    rest = own.join(each.select("conv_id", "h", "taken"), "conv_id").where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "id", "n_bytes")
    heads = own.where("at < 8").select(F.col("conv_id").alias("base"), "at", "id", "n_bytes")
    start = heads.join(each.select("conv_id", "base", "h"), "base").where("at < h").select("conv_id", F.col("at").alias("pos"), "id", "n_bytes")
    return start.unionByName(rest), each.select("conv_id", "length")


def segments(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, tier, ctx, nxt, ids, sizes): SEGMENT turns a row in order. A conversation's last row has fewer, so one whose length is a multiple of
    SEGMENT ends in an empty row. ctx names what stands before the row, nxt (of full rows) what stands before the next."""
    tier = F.floor(F.col("pos") / SEGMENT).cast("bigint").alias("tier")
    items = F.array_sort(F.collect_list(F.struct("pos", F.hex("id").alias("id"), "n_bytes")))
    cut = rows.groupBy("conv_id", tier).agg(items.alias("items"))  # at most SEGMENT turns a group
    cut = cut.select("conv_id", "tier", F.unhex(F.array_join(F.transform("items", lambda x: x["id"]), "")).alias("ids"), F.transform("items", lambda x: x["n_bytes"]).alias("sizes"))
    ends = lengths.where(F.col("length") % SEGMENT == 0)
    ends = ends.select("conv_id", F.floor(F.col("length") / SEGMENT).cast("bigint").alias("tier"), F.lit(b"").alias("ids"), F.array().cast("array<bigint>").alias("sizes"))
    cut = stored(cut.unionByName(ends), "segments")
    full = F.octet_length("ids") == SEGMENT * WIDE
    short = cut.where((F.col("tier") == 0) & ~full).select("*", F.lit("").alias("ctx"), F.lit(None).cast("string").alias("nxt"))
    long = cut.where((F.col("tier") > 0) | full)
    digest = F.sha2(F.concat(F.col("tier").cast("string").cast("binary"), F.lit(b":"), F.col("ids")), 256)
    before = Window.partitionBy("conv_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    for i in range(3):  # sums of 60-bit digests of (tier, turns): equal only for equal beginnings
        part = F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        long = long.withColumn(f"_{i}", part).withColumn(f"_b{i}", F.coalesce(F.sum(f"_{i}").over(before), F.lit(0).cast("decimal(20,0)")).cast("decimal(38,0)"))
    sums = lambda at, parts: F.concat_ws(":", (F.col("tier") + at).cast("string"), *[p.cast("decimal(38,0)").cast("string") for p in parts])
    ctx = F.when(F.col("tier") == 0, F.lit("")).otherwise(sums(0, [F.col(f"_b{i}") for i in range(3)])).alias("ctx")
    nxt = F.when(full, sums(1, [F.col(f"_b{i}") + F.col(f"_{i}") for i in range(3)])).alias("nxt")
    return short.unionByName(long.select("conv_id", "tier", "ids", "sizes", ctx, nxt))


def _common(a: bytes, b: bytes) -> int:
    """The number of equal digests at the start of two sequences."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDE
    k = 0
    while a[k : k + WIDE] == b[k : k + WIDE]:
        k += WIDE
    return k // WIDE


def _lcp(a: tuple[str, bytes], b: tuple[str, bytes]) -> int:
    """The common prefix of two neighbours (ctx, ids); -1 in different contexts."""
    return _common(a[1], b[1]) if a[0] == b[0] else -1


def in_order(rows: DataFrame) -> DataFrame:
    """The segments in order of (ctx, ids, conv_id), stored, with `part`, `place`, `lcp` (with the row before) and `after` (with the next row); -1 where there is none."""
    names = ["conv_id", "tier", "ctx", "nxt", "ids", "sizes"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64())]

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, lcp = TaskContext.get().partitionId(), 0, None, None
        more = ["part", "place", "lcp", "after"]

        def put(held: pa.RecordBatch, first: int, lcps: list, after: list) -> pa.RecordBatch:
            n = held.num_rows
            columns = [held.column(c).cast(t) for c, t in zip(names, types)]
            columns += [pa.array(v, pa.int64()) for v in ([part] * n, range(first, first + n), lcps, after)]
            return pa.RecordBatch.from_arrays(columns, [*names, *more])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()))
            first = _lcp(last, keys[0]) if last else None
            if held is not None:
                yield put(held, place, lcp, [*lcp[1:], first])
                place += held.num_rows
            lcp = [first, *(_lcp(a, b) for a, b in zip(keys, keys[1:]))]
            held, last = batch, keys[-1]
        if held is not None:
            yield put(held, place, lcp, [*lcp[1:], None])

    order = ["ctx", "ids", "conv_id"]
    schema = "conv_id bigint, tier bigint, ctx string, nxt string, ids binary, sizes array<bigint>, part bigint, place bigint, lcp bigint, after bigint"
    out = stored(rows.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(neighbours, schema), "sorted")
    # the first and the last row of every range, two rows a partition
    ends = out.where("lcp IS NULL OR after IS NULL").select("part", "place", "lcp", "after", "ctx", "ids").collect()
    ends.sort(key=lambda r: (r["part"], r["place"]))
    known = {r["part"]: [-1, -1] for r in ends}
    lasts = {r["part"]: r for r in ends if r["after"] is None}
    for a, b in zip(sorted(known), sorted(known)[1:]):
        head = next(r for r in ends if r["part"] == b and r["lcp"] is None)
        tail = lasts[a]
        known[a][1] = known[b][0] = _lcp((tail["ctx"], bytes(tail["ids"])), (head["ctx"], bytes(head["ids"])))
    borders = rows.sparkSession.createDataFrame([(p, *v) for p, v in known.items()], "part bigint, _lcp bigint, _after bigint")
    out = out.join(F.broadcast(borders), "part", "left")  # one row a partition
    return out.withColumn("lcp", F.coalesce("lcp", "_lcp")).withColumn("after", F.coalesce("after", "_after")).drop("_lcp", "_after")


def credited(rows: DataFrame) -> DataFrame:
    """With `shared` (bytes of the turns a row has in common with the row before), `deeper` (the same of the conversation's later rows) and `leaf` (1 at
    one conversation of every childless node, on all its rows)."""
    shared = F.when(F.col("lcp") > 0, F.aggregate(F.slice("sizes", 1, F.col("lcp").cast("int")), F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(F.lit(0))
    many = F.octet_length("ids") / WIDE
    rows = rows.withColumn("shared", shared).withColumn("leaf", ((many < SEGMENT) & (F.col("after") < many)).cast("bigint"))
    long = (F.col("tier") > 0) | (many >= SEGMENT)
    later = Window.partitionBy("conv_id").orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)
    upto = later.rowsBetween(Window.unboundedPreceding, 0)
    deep = rows.where(long).withColumn("deeper", F.coalesce(F.sum("shared").over(later), F.lit(0))).withColumn("leaf", F.max("leaf").over(upto))
    return rows.where(~long).withColumn("deeper", F.lit(0).cast("bigint")).unionByName(deep)


class Minima:
    """Range minima over an array by a sparse table: row k has the minimum of every stretch of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.n, self.rows = len(values), [values]
        while 2 ** len(self.rows) <= self.n:
            half, last = 2 ** (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def over(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The minimum of values[left..right]."""
        k = np.frexp((right - left + 1).astype(float))[1] - 1
        out = np.empty(len(left), self.rows[0].dtype)
        for level in np.unique(k):
            at = k == level
            out[at] = np.minimum(self.rows[level][left[at]], self.rows[level][right[at] - 2**level + 1])
        return out

    def extents(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each candidate (row i, depth), the first and last row around i between which no value (LCP with the row before) is below depth. Each search
        goes its own way in falling powers of two."""
        left, right = i.copy(), i.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 2**k, self.rows[k]
            at = np.flatnonzero(right + step < self.n)
            at = at[row[right[at] + 1] >= depth[at]]
            right[at] += step
            at = np.flatnonzero(left >= step)
            at = at[row[left[at] - step + 1] >= depth[at]]
            left[at] -= step
        return left, right


def _name(ctx: bytes, ids: bytes = b"") -> bytes:
    return sha256(ctx + b"|" + ids).digest()[:WIDE]


def block_nodes(block: pa.Table) -> pa.Table:
    """The nodes of a block of neighbouring rows, counted by the block's rows. `whole` ones have no rows elsewhere."""
    block = block.sort_by("place").combine_chunks()
    conv, lcp, shared, deeper, leaf, tier = (block[c].to_numpy() for c in ("conv_id", "lcp", "shared", "deeper", "leaf", "tier"))
    ids, ctx, nxt = block["ids"].to_pylist(), [c.encode() for c in block["ctx"].to_pylist()], block["nxt"].to_pylist()
    n, after = len(conv), block["after"][-1].as_py()
    long = np.array([len(x) // WIDE for x in ids])
    offsets, sizes = block["sizes"].combine_chunks().offsets.to_numpy(), block["sizes"].combine_chunks().values.to_numpy()
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    sums = [np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (shared, deeper, leaf)]

    within = lcp.copy()
    within[0] = -1  # what stands before the block is in another block
    table, lowest = Minima(within), Minima(conv)
    joint = np.flatnonzero(within >= 0)
    row, depth = np.concatenate((np.arange(n), joint)), np.concatenate((long, within[joint]))
    left, right = table.extents(row, depth)
    nodes, place = np.unique(np.stack((left, depth, right), 1), axis=0, return_inverse=True)
    place = place.reshape(-1)
    left, depth, right = nodes.T
    ending = np.bincount(place[:n], minlength=len(nodes))  # rows whose whole sequence it is; they come first
    branch = np.bincount(place[n:], long[joint] > within[joint], len(nodes)).astype(np.int64)  # children begun after the first row
    above = np.maximum(within[left], np.append(within, -1)[right + 1])

    many = depth - above  # the depths above + 1 .. depth have the same rows
    which = np.repeat(np.arange(len(nodes)), many)
    steps = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    at, last = left[which], right[which]
    d = above[which] + 1 + steps
    is_node = d == depth[which]
    begins = (at > 0) | (lcp[0] < d)
    closes = (last < n - 1) | (after < d)
    over = (d == 0) & (tier[at] > 0)  # the node is counted as the last one of the segment before
    whole = begins & closes & ~over & (d < SEGMENT)
    children = np.where(is_node, branch[which], 0) + ((long[at] > d) | ~is_node) * ((at > 0) | (lcp[0] <= d))
    first = at + begins
    before = total[offsets[at] + np.maximum(d - 1, 0)] - total[offsets[at]]
    saved = sums[0][last + 1] - sums[0][first] - (last + 1 - first) * before + sums[1][last + 1] - sums[1][at]
    leaves = sums[2][last + 1] - sums[2][at]
    smallest = lowest.over(at, last)
    ends = np.where(is_node & (d < SEGMENT), ending[which], 0)

    names, texts, hashes = [], [], []
    for a, k, e, done in zip(at.tolist(), d.tolist(), ends.tolist(), whole.tolist()):
        names.append(_name(ctx[a], ids[a][: k * WIDE]) if k < SEGMENT else _name(nxt[a].encode()))
        text = ",".join(map(str, conv[a : a + e].tolist()))
        texts.append(text if e and not done else None)
        hashes.append(sha256(text.encode()).hexdigest() if done else None)
    where = {name: i for i, name in enumerate(names)}
    up = [_name(ctx[a], ids[a][: (k - 1) * WIDE]) if k else None for a, k in zip(at.tolist(), d.tolist())]
    parent = [where[u] if u is not None else -1 for u in up]
    known = [int(smallest[p]) if p >= 0 and whole[p] else None for p in parent]
    numbers = [tier[at] * SEGMENT + d, *(np.where(over, 0, x) for x in (last + 1 - at, children, leaves, saved))]
    numbers[2] = children
    return pa.table(
        {
            "key": pa.array(names, pa.binary()), "parent": pa.array(up, pa.binary()), "whole": whole,
            "part": pa.array([block["part"][0].as_py()] * len(names), pa.int64()), "block": pa.array([block["block"][0].as_py()] * len(names), pa.int64()),
            "conv_id": pa.array(smallest, pa.int64(), mask=over), "parent_conv_id": pa.array(known, pa.int64()),
            **dict(zip(("depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), (x.astype(np.int64) for x in numbers))),
            "ends": pa.array(texts, pa.string()), "ends_sha256": pa.array(hashes, pa.string()),
        }
    )


_NODE = "key binary, parent binary, whole boolean, part bigint, block bigint, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, ends_sha256 string"
_SUMS = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of several blocks, added up; rows come in order of (key, part, block), and only running values are held."""
    names = ["key", "parent", "conv_id", "parent_conv_id", "depth", *_SUMS, "ends_sha256"]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
    out: list[list] = []
    now: dict | None = None

    def done() -> list:
        return [now["key"], now["parent"], now["conv_id"], now["parent_conv_id"], now["depth"], *(now[c] for c in _SUMS), now["hash"].hexdigest()]

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or r["key"] != now["key"]:
                if now is not None:
                    out.append(done())
                now = {"key": r["key"], "parent": None, "conv_id": None, "parent_conv_id": None, "depth": r["depth"], "hash": sha256(), "any": False, **dict.fromkeys(_SUMS, 0)}
            now["parent"] = now["parent"] or r["parent"]
            if r["parent_conv_id"] is not None:
                now["parent_conv_id"] = r["parent_conv_id"]
            if r["conv_id"] is not None:
                now["conv_id"] = r["conv_id"] if now["conv_id"] is None else min(now["conv_id"], r["conv_id"])
            for c in _SUMS:
                now[c] += r[c]
            if r["ends"] is not None:
                now["hash"].update(("," if now["any"] else "").encode() + r["ends"].encode())
                now["any"] = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(done(), types)], names)


def trie(rows: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie over `rows` (conv_id, pos, id, n_bytes) of conversations `lengths` (conv_id, length), one row a different prefix:
    key and parent (digests of prefixes), conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. The root has depth 0 and no parent. Conversations without turns are members of the root. No conversations give no rows."""
    sorted_rows = credited(in_order(segments(rows, lengths)))
    cut = sorted_rows.withColumn("block", F.floor(F.col("place") / block).cast("bigint"))
    nodes = stored(cut.groupBy("part", "block").applyInArrow(block_nodes, _NODE), "nodes")
    whole = nodes.where("whole").select("key", "parent", "conv_id", "parent_conv_id", "depth", *_SUMS, "ends_sha256")
    cut = nodes.where("NOT whole").repartition("key").sortWithinPartitions("key", "part", "block").drop("whole", "ends_sha256")
    schema = "key binary, parent binary, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    added = stored(cut.mapInArrow(_added, schema), "added")
    every = whole.unionByName(added)
    known = every.where("parent_conv_id IS NOT NULL OR parent IS NULL")
    across = every.where("parent_conv_id IS NULL AND parent IS NOT NULL").drop("parent_conv_id")
    parents = added.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return known.unionByName(across.join(parents, "parent", "left").select(*known.columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """`trie` over the rebuilt conversations of a table (conv_id, turn, role, text); other columns are not read."""
    return trie(*rebuilt(conversations))
