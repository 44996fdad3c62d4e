"""Merkle manifest of a dataset in van Emde Boas layout.

Every row is a leaf; per group (a source) the leaves in order of their key form a tree of 16 children a node, and the groups' roots in
order form the top tree. A tree is stored as a table of blocks: aligned subtrees of SPAN leaves. The roots of a tier's blocks are
the leaves of the next tier, until one block is left. Within a block the digests stand in one byte string in van Emde Boas order: the upper half of
the levels first, then one after another the subtrees below it, each laid out the same way. `address` gives a node's place by
arithmetic alone; it serves construction as well as the look-up of siblings, so no node stores a pointer.

Leaves are numbered by ranges, not by one task a group, and a block is the most that one task holds: a source with a third of all
rows is many blocks. Proofs go down from the top block: a block's row gets the siblings above its root by an equi-join on (tree, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywire.llm.common import numbered, runs, stored

FAN, SPAN, LEVELS = 16, 4096, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def width(n, level: int):
    """The number of nodes `level` levels above `n` leaves."""
    return -(-n // FAN**level)


def size(n, levels: int):
    """The number of nodes in the lowest `levels` levels over `n` leaves."""
    return sum(width(n, j) for j in range(levels)) + 0 * n


def height(n: int) -> int:
    """The levels of a whole tree over `n` leaves, the leaves' own included."""
    levels = 1
    while n > 1:
        n, levels = width(n, 1), levels + 1
    return levels


def address(level: int, i, n, levels: int):
    """The place of node `i` of a level (0: leaves) in the van Emde Boas order of a tree of `levels` levels over `n` leaves (numbers or arrays).
    Of the subtrees below the split only the last can be cut short, so the ones before it are of equal size."""
    if levels == 1:
        return 0 * i
    low = levels // 2
    top = width(n, low)
    if level >= low:
        return address(level - low, i, top, levels - low)
    span, each = FAN ** (low - 1), FAN ** (low - 1 - level)
    subtree = i // each
    inside = np.minimum(span, n - subtree * span)
    return size(top, levels - low) + subtree * size(span, low) + address(level, i - subtree * each, inside, low)


def _level(tree: np.ndarray, level: int, n: int, levels: int) -> str:
    """The digests of a level, left to right, as one hexadecimal text."""
    at = address(level, np.arange(width(n, level)), n, levels)
    return tree[at].tobytes().hex()


def laid_out(leaves: np.ndarray, levels: int) -> np.ndarray:
    """The tree over `leaves` (n x 32 bytes) as rows of 32 bytes in van Emde Boas order; the root is row 0."""
    n = len(leaves)
    tree = np.zeros((int(size(n, levels)), 32), np.uint8)
    tree[address(0, np.arange(n), n, levels)] = leaves
    for level in range(1, levels):
        below = _level(tree, level - 1, n, levels).encode()
        made = b"".join(sha256(below[p * 64 * FAN : (p + 1) * 64 * FAN]).digest() for p in range(width(n, level)))
        tree[address(level, np.arange(width(n, level)), n, levels)] = np.frombuffer(made, np.uint8).reshape(-1, 32)
    return tree


def siblings(tree: np.ndarray, n: int, levels: int) -> list[list[tuple[str, str]]]:
    """For every leaf, level by level, the digests left and right of its ancestor in that node's run, as hexadecimal texts."""
    texts = [_level(tree, level, n, levels) for level in range(levels - 1)]
    out = []
    for i in range(n):
        path = []
        for text in texts:
            start = i // FAN * FAN * 64
            path.append((text[start : i * 64], text[i * 64 + 64 : start + FAN * 64]))
            i //= FAN
        out.append(path)
    return out


@dataclass
class Manifest:
    """The stored blocks: `trees` has the tiers of the groups' trees, lowest first, `top` those of the tree over their roots; the root."""

    trees: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def leaf_digest(fields: list[Column]) -> Column:
    """Lowercase hex sha256 of the concatenated fields, each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def _tier(rows: DataFrame, item: str, what: str) -> DataFrame:
    """One stored row a block of `rows` (tree, at, total, item, digest, other): (tree, block, total, items, others, nodes, root)."""
    kinds = {c: rows.schema[c].dataType for c in ("tree", item)}

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(kinds["tree"]), pa.int64(), pa.int64(), pa.list_(to_arrow_type(kinds[item])), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        for (tree, block), run in runs(batches, 2):
            run = run.combine_chunks()
            total = run["total"][0].as_py()
            leaves = np.frombuffer(b"".join(run["digest"].to_pylist()), np.uint8).reshape(-1, 32)
            nodes = laid_out(leaves, LEVELS if total > SPAN else height(total))
            values = [tree, block, total, run[item].to_pylist(), run["other"].to_pylist(), nodes.tobytes(), nodes[0].tobytes()]
            names = ["tree", "block", "total", "items", "others", "nodes", "root"]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    cut = rows.select("tree", F.floor(F.col("at") / SPAN).cast("bigint").alias("block"), "at", "total", item, "digest", "other")
    dealt = cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    schema = f"tree {kinds['tree'].simpleString()}, block bigint, total bigint, items array<{kinds[item].simpleString()}>, others array<binary>, nodes binary, root binary"
    return stored(dealt.mapInArrow(blocks, schema), what)


def _tiers(rows: DataFrame, item: str, what: str) -> list[DataFrame]:
    """The tiers over `rows`, lowest first; in the last one every tree is one block."""
    tiers = [_tier(rows, item, what)]
    while not tiers[-1].where(F.col("total") > SPAN).isEmpty():
        below = tiers[-1].where(F.col("total") > SPAN)
        total = F.ceil(F.col("total") / SPAN).cast("bigint").alias("total")
        above = below.select("tree", F.col("block").alias("at"), total, F.col("block").alias("item"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("other"))
        tiers.append(_tier(above, "item", f"{what}-{len(tiers)}"))
    return tiers


def build(leaves: DataFrame, key: str = "doc_id", tree: str = "source") -> Manifest:
    """The manifest over `leaves` (key, tree, leaf: hex digest, changed: hex digest of what stands in the row's place now, or null).

    Leaves of a tree ascend by key, nulls first; leaves of one key by digest. Trees ascend bytewise, null first. No leaves give no
    blocks and a null root.
    """
    narrow = leaves.select(F.col(key).alias("item"), F.col(tree).alias("tree"), F.unhex("leaf").alias("digest"), F.unhex("changed").alias("other"))
    trees = _tiers(numbered(narrow, "tree", ["item", "digest", "other"], "leaves"), "item", "blocks")
    roots = trees[0].where(F.col("total") <= SPAN)
    for tier in trees[1:]:
        roots = roots.unionByName(tier.where(F.col("total") <= SPAN).withColumn("items", F.lit(None).cast(trees[0].schema["items"].dataType)))
    roots = roots.select(F.lit(0).alias("all"), F.col("tree").alias("item"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("other"))
    top = _tiers(numbered(roots, "all", ["item"], "subroots").withColumnRenamed("all", "tree"), "item", "top")
    last = top[-1].where(F.col("total") <= SPAN).select(F.lower(F.hex("root"))).first()
    return Manifest(trees, top, last[0] if last else None)


_ABOVE = "array<struct<left: binary, right: binary>>"
_PAIR = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _children(blocks: DataFrame, subroot: bool) -> DataFrame:
    """(item, subroot, above) of every leaf of `blocks` (with `above` and `subroot`): the siblings of its path to the root."""
    kind = blocks.schema["items"].dataType.elementType
    tree = blocks.schema["tree"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n = len(b["items"])
                nodes = np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32)
                levels = LEVELS if b["total"] > SPAN else height(b["total"])
                leaves = _level(nodes, 0, n, levels)
                paths = siblings(nodes, n, levels)
                for at in range(0, n, 512):
                    part = range(at, min(n, at + 512))
                    above = [[{"left": bytes.fromhex(x), "right": bytes.fromhex(y)} for x, y in paths[i]] + b["above"] for i in part]
                    roots = [leaves[i * 64 : i * 64 + 64] for i in part] if subroot else [b["subroot"]] * len(part)
                    columns = [pa.array([b["tree"]] * len(part), to_arrow_type(tree)), pa.array(b["items"][at : at + 512], to_arrow_type(kind)), pa.array(roots), pa.array(above, _PAIR)]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "item", "subroot", "above"])

    return blocks.select("tree", "total", "items", "nodes", "above", "subroot").mapInArrow(rows, f"tree {tree.simpleString()}, item {kind.simpleString()}, subroot string, above {_ABOVE}")


def _paths(manifest: Manifest) -> DataFrame:
    """The lowest blocks with `subroot` and `above`, the siblings from the block's root up to the root."""
    start = manifest.top[-1].where(F.col("total") <= SPAN)
    down = start.withColumn("above", F.array().cast(_ABOVE)).withColumn("subroot", F.lit(None).cast("string"))
    for tier in reversed(manifest.top[:-1]):  # one tree of all subroots
        above = _children(down, False).select(F.col("item").alias("block"), "above")
        down = tier.join(above, "block").withColumn("subroot", F.lit(None).cast("string"))
    roots = stored(_children(down, True).select(F.col("item").alias("_tree"), "subroot", "above"), "above")
    upper = None
    for tier in reversed(manifest.trees):
        whole = tier.where(F.col("total") <= SPAN).join(roots, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if upper is not None:
            above = _children(upper, False).select(F.col("tree").alias("_tree"), F.col("item").alias("_block"), "subroot", "above")
            above = stored(above, "above")
            below = tier.where(F.col("total") > SPAN).join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
            whole = whole.unionByName(below.drop("_tree", "_block"))
        upper = whole
    return upper


def proofs(manifest: Manifest, key: str = "doc_id", listed: bool = False) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, digests in hex.

    proof_sha256 is the digest of the concatenated siblings on the leaf's path, folded_root what the path gives from `changed` where
    there is one, else from the leaf itself, and verified whether that is the root. With `listed` also `siblings`, the path itself: an array of
    (left, right) texts from the leaf upwards, with which anyone can fold without the manifest.
    """
    blocks = _paths(manifest)
    kind = blocks.schema["items"].dataType.elementType
    root = manifest.root
    listing = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                n = len(b["items"])
                nodes = np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32)
                levels = LEVELS if b["total"] > SPAN else height(b["total"])
                leaves = _level(nodes, 0, n, levels)
                above = [(p["left"].hex(), p["right"].hex()) for p in b["above"]]
                rest = "".join(x + y for x, y in above).encode()
                found = [[], [], [], []]
                for i, path in enumerate(siblings(nodes, n, levels)):
                    leaf = leaves[i * 64 : i * 64 + 64]
                    proof = sha256("".join([x + y for x, y in path]).encode())
                    proof.update(rest)
                    folded = b["others"][i].hex() if b["others"][i] is not None else leaf
                    for x, y in [*path, *above]:
                        folded = sha256((x + folded + y).encode()).hexdigest()
                    for column, value in zip(found, (leaf, proof.hexdigest(), folded, [*path, *above] if listed else None)):
                        column.append(value)
                leaf, proof, folded, path = found
                columns = [pa.array(b["items"], to_arrow_type(kind)), pa.array(leaf), pa.array([b["subroot"]] * n, pa.string()), pa.array([root] * n, pa.string()), pa.array(proof), pa.array(folded)]
                columns.append(pa.array([f == root for f in folded]))
                names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if listed:
                    columns.append(pa.array([[{"left": x, "right": y} for x, y in p] for p in path], listing))
                    names.append("siblings")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{key}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema += ", siblings array<struct<left: string, right: string>>" if listed else ""
    return blocks.select("items", "others", "total", "nodes", "above", "subroot").mapInArrow(rows, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed) of `documents`: the digest of (doc_id, source, lang, n_chars, text), and where 5 divides the crc32 of the
    decimal doc_id, that of the row with A-Z of its text lowered. A null doc_id is not changed."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, leaf_digest([*fields[:-1], F.translate("text", UPPER, LOWER)]))
    return docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), changed.alias("changed"))
