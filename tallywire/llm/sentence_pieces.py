"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut to words where no piece can reach across: before a run of word marks and around characters that stand in
no longer piece. Each different word of the corpus is encoded once: its substrings up to the longest piece are exploded, joined
to the piece table by equality, grouped by word and folded with a higher-order aggregate. The encodings return to the documents by
block: a block is a bounded stretch of documents with one entry per different word, so no occurrence of a word is shuffled.

Two folds: a unigram table takes the Viterbi path of the largest sum of scores. A BPE table has scores that are
merge ranks, whose sum means nothing; there the edges are folded in order of rank, an edge joining two neighbouring
pieces if it spans exactly these, which is the library's result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MARK = "▁"
#: Text of a block in bytes, about; one longer document is a block of its own.
BLOCK_BYTES = 12 << 20
#: Words up to this many characters keep their borders in the bits of a number; longer ones are folded by the Arrow batch.
SHORT = 60
#: Characters by which pieces of that length and more are indexed.
HEAD = 4
#: A code holds the rank, start and length of an edge, in this order.
RANK, START = 1 << 40, 1 << 8


@dataclass
class Pieces:
    """A piece table: ids by text, ids of the 256 bytes, texts by id, edges (text, rank or score), and whether it is BPE."""

    ids: dict[str, int]
    bytes: list[int]
    raw: list[bytes]
    scores: list[float]
    bpe: bool = True
    unknown: int = 0

    @cached_property
    def cutter(self) -> re.Pattern:
        """Cuts chunks (texts from one word mark to the next) to words that no piece reaches across: around white space that stands in no
        longer piece, and between letters and other characters if no piece has both."""
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        mixed = any(a.isalpha() != b.isalpha() for p in self.ids for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]))
        rest = f"[^{MARK}{alone}]+" if mixed else f"(?:[^\\W\\d_]+|(?:[^\\w{MARK}{alone}]|[\\d_])+)"
        return re.compile(f"{MARK}?{rest}|{MARK}" + (f"|[{alone}]" if alone else ""))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The chunks of a text without the word mark that each starts with."""
        return text.replace(MARK, " ").split(" ") if text else []

    @cached_property
    def longest_run(self) -> int:
        return max((len(p) for p in self.ids if not p.strip(MARK)), default=1)

    def marks(self, n: int) -> list[int]:
        """Ids of a run of n marks. Its pieces rank alike, so the leftmost pair that makes a piece joins first, each time anew."""
        most = self.longest_run
        sizes = [1] * (n % most)
        at = 0
        while at + 1 < len(sizes):
            if MARK * (sizes[at] + sizes[at + 1]) in self.ids:
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return self.encode_cut([MARK * s for s in [most] * (n // most) + sizes])

    def encode_cut(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def packed(self, parts: list[str]) -> bytes:
        ids = self.encode_cut(parts)
        return struct.pack(f"<{len(ids)}i", *ids)

    @cached_property
    def texts_by_id(self) -> pa.Array:
        return pa.array(self.raw, pa.large_binary())

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of consecutive stretches of ids."""
        pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.texts_by_id.take(pa.array(ids, pa.int32())))
        joined = pc.binary_join(pieces, pa.scalar(b"", pa.large_binary())).to_numpy(zero_copy_only=False)
        return [t.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ") for t in joined]


def read_pieces(path: str) -> Pieces:
    """The pieces of a SentencePiece BPE model file, read by the driver; control pieces take no part. Inner word marks are refused,
    since words would not be independent."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(MARK in names[i].lstrip(MARK) for i in plain):
        raise ValueError("a piece has a word mark inside")
    by = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    raw = [b"" if sp.is_control(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].encode() for i in range(n)]
    raw[sp.unk_id()] = " ⁇ ".encode()
    return Pieces({names[i]: i for i in plain}, [by[b] for b in range(256)] if by else [], raw, [sp.get_score(i) for i in range(n)], True, sp.unk_id())


def _ranks(pieces: Pieces) -> dict[float, int]:
    return {s: r for r, s in enumerate(sorted({pieces.scores[i] for i in pieces.ids.values()}, reverse=True))}


def edges_of(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, codes, scores) of every word with an edge: all its substrings that are pieces. `words` has a column `word`, and may have
    its length as `n`."""
    spark = words.sparkSession
    ranks = _ranks(pieces)
    least = 2 if pieces.bpe else 1  # single characters are where BPE starts
    rows = [(p, ranks[pieces.scores[i]], float(pieces.scores[i])) for p, i in pieces.ids.items() if len(p) >= least]
    table = F.broadcast(spark.createDataFrame(rows, "piece string, rank int, score double"))  # a vocabulary
    # longer pieces are looked for only where their first HEAD characters stand
    heads: dict[str, set[int]] = {}
    for p in pieces.ids:
        if len(p) >= HEAD:
            heads.setdefault(p[:HEAD], set()).add(len(p))
    longer = F.broadcast(spark.createDataFrame([(h, sorted(k)) for h, k in heads.items()] or [("", [])], "head string, sizes array<int>"))
    n = F.col("n") if "n" in words.columns else F.length("word")
    starts = words.where(n >= least).select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - least)).alias("start"))
    headed = starts.withColumn("head", F.substring("word", F.col("start") + 1, F.lit(HEAD))).join(longer, "head", "left")
    short = F.array(*[F.lit(k) for k in range(least, HEAD)])
    spans = headed.select("word", "n", "start", F.explode(F.concat(short, F.coalesce("sizes", F.array().cast("array<int>")))).alias("size"))
    spans = spans.where(F.col("start") + F.col("size") <= F.col("n"))
    parts = spans.select("word", "start", "size", F.substring("word", F.col("start") + 1, F.col("size")).alias("piece"))
    code = F.col("rank").cast("bigint") * RANK + F.col("start").cast("bigint") * START + F.col("size")
    found = parts.join(table, "piece")
    if pieces.bpe:
        return found.groupBy("word").agg(F.collect_list(code).alias("codes"))
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", "score")
    return found.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def bpe_borders(codes: Column, n: Column) -> Column:
    """The borders of a short word's pieces as bits 0 to n: edges in order of rank take away the one border inside them."""

    def step(borders: Column, code: Column) -> Column:
        start = F.pmod(F.floor(code / F.lit(START)), F.lit(RANK // START)).cast("int")
        end = start + F.pmod(code, F.lit(START)).cast("int")
        inner = borders.bitwiseAND(_bit(end) - _bit(start + 1))
        both = _bit(end) + _bit(start)
        joins = (borders.bitwiseAND(both) == both) & (F.bit_count(inner) == 1)
        return F.when(joins, borders - inner).otherwise(borders)

    return F.aggregate(F.sort_array(codes), _bit(n + 1) - 1, step)


def viterbi_starts(edges: Column, n: Column, unknown: float = -1e4) -> Column:
    """The starts of the pieces on the path with the largest sum of scores. A character that is no piece costs `unknown`; of equal
    sums the path whose last piece is longest stays."""
    nothing = F.lit(float("-inf"))
    first = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("starts"))
    blank = F.struct(nothing.alias("score"), F.array().cast("array<int>").alias("starts"))
    single = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).alias("end"), i.alias("start"), F.lit(unknown).alias("score")))
    ordered = F.sort_array(F.concat(edges, single))

    def step(best: Column, e: Column) -> Column:
        before, now = F.get(best, e["start"]), F.get(best, e["end"])
        total = before["score"] + e["score"]
        new = F.struct(total.alias("score"), F.concat(before["starts"], F.array(e["start"])).alias("starts"))
        put = F.concat(F.slice(best, F.lit(1), e["end"]), F.array(new), F.slice(best, e["end"] + 2, n + 1))
        return F.when(total > now["score"], put).otherwise(best)

    best = F.aggregate(ordered, F.concat(F.array(first), F.array_repeat(blank, n)), step)
    return F.get(best, n)["starts"]


def _long_starts(n: int, codes: list[int]) -> list[int]:
    """Starts of a long word's pieces, by the same fold over sorted codes."""
    on = bytearray(b"\x01") * (n + 1)
    for code in np.sort(np.asarray(codes, np.int64)).tolist():
        start, size = code % RANK // START, code % START
        end = start + size
        if on[start] and on[end] and on[start + 1 : end].count(1) == 1:
            on[start + 1 : end] = bytes(size - 1)
    return np.flatnonzero(np.frombuffer(on, np.uint8)[:-1]).tolist()


def folded(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, bits, more) of every word with an edge: its borders as bits, or for long BPE words their codes and for unigram tables
    the starts, as numbers joined by commas: an array column takes far longer to an Arrow batch, even where it is null."""
    n = F.length("word")
    lattice = edges_of(words, pieces)
    if not pieces.bpe:
        starts = viterbi_starts(F.col("edges"), n)
        return lattice.select("word", F.lit(None).cast("bigint").alias("bits"), F.array_join(starts.cast("array<string>"), ",").alias("more"))
    short = F.when(n <= SHORT, bpe_borders(F.col("codes"), n))
    codes = F.array_join(F.col("codes").cast("array<string>"), ",")
    return lattice.select("word", short.alias("bits"), F.when(n > SHORT, codes).alias("more"))


def _ids(p: Pieces, word: str, bits: int | None, more: str | None) -> bytes:
    """The ids of a folded word as little-endian 32-bit numbers; a word without an edge is its characters. Bits are never 0 otherwise."""
    if bits:
        starts = [i for i in range(len(word)) if bits >> i & 1]
    elif more is None:
        return p.packed(list(word))
    else:
        numbers = [int(x) for x in more.split(",")]
        starts = _long_starts(len(word), numbers) if p.bpe else numbers
    return p.packed([word[a:b] for a, b in zip(starts, [*starts[1:], len(word)])])


def dictionary(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids: little-endian 32-bit numbers) of every word with an edge."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            ids = [_ids(p, *row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["word", "ids"])

    return folded(words, pieces).mapInArrow(named, "word string, ids binary")


#: Entries that are packed together at most before they go to their blocks.
PACKED = 400_000


def _by_block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, data): the entries of each block as one compressed stream, in the order they come in."""
    table = pa.Table.from_batches(held)
    table = table.take(np.argsort(table.column("block").to_numpy(), kind="stable")).combine_chunks()
    blocks = table.column("block").to_numpy()
    edges = np.concatenate((np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1 if len(blocks) else 0)), [len(blocks)]))
    for a, b in zip(edges[:-1], edges[1:]):
        yield pa.RecordBatch.from_arrays([pa.array([blocks[a]], pa.int64()), pa.array([_stream(table.slice(a, b - a).select(["word", "ids"]))], pa.binary())], ["block", "data"])


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Bounded stretches of a task's rows, each with a number from its contents, the same whenever it is read again."""
    held, size = [], 0
    for batch in batches:
        step = max(1, min(batch.num_rows, int(batch.num_rows * BLOCK_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            held.append(part)
            size += part.nbytes
            if size >= BLOCK_BYTES:
                yield _numbered(held)
                held, size = [], 0
    if held:
        yield _numbered(held)


def _numbered(held: list[pa.RecordBatch]) -> tuple[int, pa.Table]:
    table = pa.Table.from_batches(held).combine_chunks()
    h = hashlib.md5()
    for t in table.column("body").to_pylist():
        h.update(b"\x00" if t is None else b"\x01" + t.encode("utf-8", "surrogatepass"))
    return int.from_bytes(h.digest()[:8], "little", signed=True), table


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(docs: DataFrame, pieces: Pieces, keep: list[str] | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """Per document its `keep` columns (all by default) in the struct `doc`, the text as `body`, `ids`, and with `decoded` what
    `decode` makes of these.

    The ids are those of the library without begin or end pieces. Empty and null texts have none; repeated rows stay; an empty table gives no rows.
    `docs` is read twice and must give the same rows in the same order within a partition, as files and stored tables do.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)  # a vocabulary
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("doc"), F.col(text).cast("string").alias("body"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for number, table in _blocks(batches):
            chunks: set[str] = set()
            for t in table.column("body").to_numpy():
                chunks.update(p.chunks(t or ""))
            # a word begins with a mark or holds none, so all chunks are cut as one text
            found = sorted(set(p.cutter.findall(MARK + MARK.join(chunks)))) if chunks else []
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([number] * len(part), pa.int64())], ["word", "block"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_stream(table)], pa.binary())], ["block", "data"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        held, size = [], 0
        last, part = None, b""
        for batch in batches:
            ids = []
            _, words, bits, more = batch.columns
            for w, b, m in zip(words.to_numpy(False), bits.fill_null(0).to_numpy().tolist(), more.to_numpy(False)):
                if w != last:  # rows come in order of words
                    last, part = w, _ids(p, w, b, m)
                ids.append(part)
            held.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["block", "word", "ids"]))
            size += batch.num_rows
            if size >= PACKED:
                yield from _by_block(held)
                held, size = [], 0
        if size:
            yield from _by_block(held)

    def together(held: pa.Table, entries: pa.Table) -> Iterator[pa.RecordBatch]:
        p = shared.value
        cut = p.cutter.findall
        words: dict[str, bytes] = {}
        for data in entries.column("data").to_pylist():
            part = pa.ipc.open_stream(data).read_all()
            words.update(zip(part.column("word").to_numpy(), part.column("ids").to_numpy()))

        class Known(dict[str, bytes]):
            def __missing__(self, chunk: str) -> bytes:
                made = words[MARK + chunk] if chunk.isalpha() else b"".join([words[w] for w in cut(MARK + chunk)])
                self[chunk] = made
                return made

        known = Known()
        mark = p.packed([MARK])
        for data in held.column("data").to_pylist():
            for batch in pa.ipc.open_stream(data).read_all().to_batches(max_chunksize=500):
                ids = []
                for t in batch.column("body").to_numpy(False):
                    chunks = p.chunks(t or "")
                    if "" not in chunks:
                        ids.append(np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<i4"))
                        continue
                    parts, run = [], 0
                    for c in chunks:
                        if not c:
                            run += 1
                            continue
                        part = known[c]
                        if run:  # marks join before a word whose own mark stays alone
                            own = part[:4] == mark
                            parts.append(np.array(p.marks(run + own), "<i4").tobytes())
                            part, run = part[4 * own :], 0
                        parts.append(part)
                    if run:
                        parts.append(np.array(p.marks(run), "<i4").tobytes())
                    ids.append(np.frombuffer(b"".join(parts), "<i4"))
                offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, np.int32)
                columns = [batch.column("doc"), batch.column("body"), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))]
                if decoded:
                    columns.append(pa.array(p.decode(values, offsets), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "body", "ids", "decoded"][: len(columns)])

    pairs = rows.mapInArrow(distinct, "word string, block bigint").where("word IS NOT NULL").repartition("word")
    # `first` and `n` keep all columns and filters above the exchange, so that this and the join below read the same one
    words = pairs.groupBy("word").agg(F.min("block").alias("first"), F.max(F.length("word")).alias("n")).where("first IS NOT NULL")
    entries = pairs.join(folded(words, pieces), "word", "left").select("block", "word", "bits", "more").mapInArrow(entered, "block bigint, data binary")
    held = rows.mapInArrow(packed, "block bigint, data binary")
    schema = _with(rows, "ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*schema.fields, T.StructField("decoded", T.StringType())])

    def tables(left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(together(left, right))
        return pa.Table.from_batches(made) if made else target.empty_table()

    target = to_arrow_schema(schema)
    return held.groupBy("block").cogroup(entries.groupBy("block")).applyInArrow(tables, schema)


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """`encoded` with the text of its ids as `decoded` (replacing a column of that name): word marks are blanks, the first one is left out. No ids
    give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    rest = encoded.drop("decoded")
    at = rest.columns.index(ids)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            lists = batch.column(at)
            offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())))
            decoded = pa.array(p.decode(lists.flatten().to_numpy(zero_copy_only=False), offsets), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return rest.mapInArrow(texts, _with(rest, "decoded", T.StringType()))


def model_path(spark: SparkSession, name: str = "piece_bpe_32k.model") -> str:
    from tallywire.llm.token_counts import spark_default_path

    return spark_default_path(spark, name)
