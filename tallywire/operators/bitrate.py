"""Bitrate sampled when more than a period has passed since the last sample.

The next sample after one at time t is the first packet later than t + period, so samples form a chain that depends on every sample
before it. A chunk of a stream turns the time of the last sample before it into the time of the last sample in it; only packets of
its first period (and the one after) can be its first sample, so this is a small table. Tables of FAN neighbouring chunks compose into
one, and these again, until a stream has one; then the times go down the same tree. A task holds one chunk of packets or FAN
tables; no stream is walked from its first to its last packet anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallywire.functions.arith import MICROS, as_col, micros
from tallywire.session import kept

FAN = 16


def _follow(entry: np.ndarray, out: np.ndarray, t: np.ndarray, period: int) -> np.ndarray:
    """The last sample after a part, for last samples `t` before it; unchanged if the part has no packet late enough."""
    at = np.searchsorted(entry, t + period, "right")
    inside = at < len(entry)
    return np.where(inside, out[np.minimum(at, max(len(out) - 1, 0))] if len(out) else t, t)


def _possible(times: np.ndarray, first: int, period: int) -> int:
    """How many of the sorted `times` can be the first sample of a part that begins at `first`."""
    return min(len(times), int(np.searchsorted(times, first + period, "right")) + 1)


def _chain(times: np.ndarray, period: int, starts: np.ndarray) -> np.ndarray:
    """For packets `starts` (places in `times`) taken as samples, the place of the last sample of the chain."""
    after = np.searchsorted(times, times + period, "right")
    at = starts.copy()
    while True:
        new = after[at]
        moved = new < len(times)
        if not moved.any():
            return at
        at = np.where(moved, np.minimum(new, len(times) - 1), at)


def _row(batch: pa.RecordBatch | pa.Table, schema: pa.Schema, **values) -> dict:
    return {f.name: [values[f.name]] if f.name in values else batch[f.name].slice(0, 1).to_pylist() for f in schema}


def elapsed_bitrate(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    size: Column | str = "frame_bytes",
    chunk: Sequence[str] = ("window_start", "block"),
    seconds: float = 1.0,
    fan: int = FAN,
) -> DataFrame:
    """(key, chunk, ts, bytes, elapsed_us, bitrate_bps): a sample at every first packet that is more than `seconds` later than the sample before,
    with the bytes since that sample, its own packet included; whole bits per second as a floor. The first sample counts from the
    stream's first packet on, and with it. Streams no longer than `seconds` have none.

    `chunk` columns must not decrease along the order and bound a chunk's rows, as everywhere in this library. Null sizes count 0.
    """
    key, chunk, period = list(key), list(chunk), int(round(seconds * MICROS))
    rows = df.select(*key, *[c for c in chunk if c not in key], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], micros(ts).alias("_us"), F.coalesce(as_col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("_size"))
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("_times", "_cum", "_entry", "_out")]
    plain = [rows.schema[c] for c in dict.fromkeys([*key, *chunk])]
    schema = T.StructType([*plain, *[T.StructField(c, T.LongType()) for c in ("_first", "_total")], *lists])
    arrow = to_arrow_schema(schema)

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([(f"_o{i}", "ascending") for i in range(len(order))]).combine_chunks()
        us, cum = group["_us"].to_numpy(), np.cumsum(group["_size"].to_numpy())
        new = np.append(True, us[1:] != us[:-1])  # of packets at one time the first one takes the sample
        times, at = us[new], cum[new]
        n = _possible(times, times[0], period)
        out = times[_chain(times, period, np.arange(n))]
        values = {"_first": int(times[0]), "_total": int(cum[-1]), "_times": times.tolist(), "_cum": at.tolist(), "_entry": times[:n].tolist(), "_out": out.tolist()}
        return pa.table(_row(group, arrow, **values), schema=arrow)

    parts = rows.groupBy(*[f.name for f in plain]).applyInArrow(packed, schema)
    along = Window.partitionBy(*key).orderBy(*chunk)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    numbers = (F.row_number().over(along) - 1).cast("bigint").alias("_no"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base")
    parts = kept(parts, "bitrate-chunks")
    placed = kept(parts.select(*[f.name for f in plain], "_first", "_total", *numbers, F.min("_first").over(Window.partitionBy(*key)).alias("_begin")), "bitrate-places")

    tables = T.StructType([*[rows.schema[c] for c in key], *[T.StructField(c, T.LongType()) for c in ("_no", "_first")], *lists[2:]])
    table_arrow = to_arrow_schema(tables)
    names = [f.name for f in plain]
    level = parts.drop("_first", "_total").join(placed, names).select(*key, "_no", "_first", "_entry", "_out")

    def children(group: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        group = group.sort_by("_no")
        return [(r["_no"], r["_first"], np.array(r["_entry"], np.int64), np.array(r["_out"], np.int64)) for r in group.select(["_no", "_first", "_entry", "_out"]).to_pylist()]

    def composed(group: pa.Table) -> pa.Table:
        parts = children(group)
        first, entry, out = parts[0][1], [], []
        for i, (_, _, e, o) in enumerate(parts):
            n = _possible(e, first, period)
            t = o[:n]
            for _, _, e2, o2 in parts[i + 1 :]:
                t = _follow(e2, o2, t, period)
            entry.append(e[:n])
            out.append(t)
            if n and e[n - 1] > first + period:
                break
        values = {"_no": parts[0][0] // fan, "_first": first, "_entry": np.concatenate(entry).tolist(), "_out": np.concatenate(out).tolist()}
        return pa.table(_row(group, table_arrow, **values), schema=table_arrow)

    levels = [level]
    top = placed.agg(F.max("_no")).first()[0] or 0
    while top:
        up = F.floor(F.col("_no") / fan).alias("_up")
        levels.append(kept(levels[-1].withColumn("_up", up).groupBy(*key, "_up").applyInArrow(composed, tables), "bitrate-level"))
        top //= fan

    going = T.StructType([*[rows.schema[c] for c in key], T.StructField("_no", T.LongType()), T.StructField("_t", T.LongType())])
    going_arrow = to_arrow_schema(going)

    def handed(group: pa.Table) -> pa.Table:
        t, made = np.array([group["_t"][0].as_py()]), []
        for no, _, e, o in children(group):
            made.append((no, int(t[0])))
            t = _follow(e, o, t, period)
        here = {c: group[c].slice(0, 1).to_pylist() * len(made) for c in key}
        return pa.table({**here, "_no": [n for n, _ in made], "_t": [t for _, t in made]}, schema=going_arrow)

    state = placed.where("_no = 0").select(*key, F.lit(0).cast("bigint").alias("_no"), F.col("_begin").alias("_t"))
    for below in reversed(levels[:-1]):
        up = F.floor(F.col("_no") / fan).alias("_up")
        cut = below.withColumn("_up", up).join(state.withColumnRenamed("_no", "_up"), [*key, "_up"])
        state = kept(cut.groupBy(*key, "_up").applyInArrow(handed, going), "bitrate-state")

    samples = T.StructType([*plain, *[T.StructField(c, T.LongType()) for c in ("_no", "_us", "_upto")]])
    sample_arrow = to_arrow_schema(samples)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                times, cum = (row[c][0].values.to_numpy() for c in ("_times", "_cum"))
                t, us, upto = row["_t"][0].as_py(), [], []
                while (at := int(np.searchsorted(times, t + period, "right"))) < len(times):
                    t = int(times[at])
                    us.append(t)
                    upto.append(int(cum[at]) + row["_base"][0].as_py())
                here = {c: row[c].to_pylist() * len(us) for c in (*names, "_no")}
                yield from pa.table({**here, "_us": us, "_upto": upto}, schema=sample_arrow).to_batches()

    asked = parts.drop("_first", "_total", "_entry", "_out").join(placed.drop("_first", "_total", "_begin"), names).join(state, [*key, "_no"])
    found = asked.select(*names, "_no", "_times", "_cum", "_base", "_t").mapInArrow(taken, samples)
    begin = placed.where("_no = 0").select(*key, "_begin")
    w = Window.partitionBy(*key).orderBy("_us")
    found = found.join(begin, key)
    since = F.col("_us") - F.coalesce(F.lag("_us").over(w), F.col("_begin"))
    count = F.col("_upto") - F.coalesce(F.lag("_upto").over(w), F.lit(0))
    out = found.select(*names, F.timestamp_micros("_us").alias(ts), count.alias("bytes"), since.alias("elapsed_us"))
    rate = F.floor(F.col("bytes").cast("double") * 8.0 / (F.col("elapsed_us").cast("double") / 1e6)).cast("bigint")
    return out.withColumn("bitrate_bps", rate)
