"""Helpers the operators share: words, keys, stored tables and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tallywire.session import checkpoint_root

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, although `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column | str) -> Column:
    """The words of a text in order; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder for one call below the folder that all executors share."""
    return f"{checkpoint_root(spark).rstrip('/')}/tallywire-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str | None = None) -> DataFrame:
    """The rows of `df` written once as Parquet in the shared folder and read from there: cuts the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, what)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: orderable ids) as (node, component = smallest node of the component).

    Alternating large-star and small-star steps: every step is one aggregation and one equi-join, a node's neighbours
    are never gathered, and paths shorten by half. Edges are stored after each round; the loop ends when a round
    changes nothing. Null ids and self links are ignored; no edges give no rows.
    """
    edges = edges.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stored(edges.distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.union(low.where("low < a").select("a", F.col("low").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")
        ).select("e.*").where("a > b").distinct()
        edges = stored(small, "edges")
        if before is None and edges.isEmpty():
            break
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.union(roots)


def in_order(df: DataFrame, order: list[str], what: str, by: str | None = None) -> DataFrame:
    """The rows of `df` in the order of `order` (nulls first) as a stored table with `part` (number of the range), `place` (position in its range)
    and, with `by`, `local` (position among the range's rows of that group). Groups of any size are cut at range borders, equal rows too."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in ("part", "place", "local")]])
    types = to_arrow_schema(schema)
    at = df.columns.index(by) if by else -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, group, local = TaskContext.get().partitionId(), 0, object(), 0
        for batch in batches:
            n, positions = batch.num_rows, []
            for value in batch.column(at).to_pylist() if by else ():
                local = local + 1 if value == group else 0
                group = value
                positions.append(local)
            columns = [*batch.columns, pa.array([part] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), pa.array(positions or [0] * n, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, types)], schema=types)
            place += n

    tie = "_tie"
    sorted_rows = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    return stored(sorted_rows.mapInArrow(count, schema), what)


def numbered(df: DataFrame, by: str, order: list[str], what: str) -> DataFrame:
    """The rows of `df` with `at` (position from 0 among the rows of equal `by`, in the order of `order`) and `total` (their number). A group
    of any size is spread over ranges; what is added up by group is one row a range."""
    rows = in_order(df, [by, *order], what, by)
    sizes = rows.groupBy("part", by).agg((F.max("local") + 1).alias("n"))
    group = Window.partitionBy(by)
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(sizes.select("part", F.col(by).alias("_by"), before.alias("_before"), F.sum("n").over(group).alias("total")), f"{what}-starts")
    starts = starts.withColumnRenamed("part", "_part")
    joined = rows.join(starts, (F.col("part") == F.col("_part")) & rows[by].eqNullSafe(F.col("_by")))
    return joined.select(*df.columns, (F.col("_before") + F.col("local")).alias("at"), "total")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(key values, rows) of every run of rows with equal values in the first `keys` columns. A run must fit in memory."""
    key, held = None, []
    for batch in batches:
        values = list(zip(*(batch.column(i).to_pylist() for i in range(keys))))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start]:
                continue
            if held and values[start] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = values[start]
            held.append(batch.slice(start, i - start))
            start = i
    if held:
        yield key, pa.Table.from_batches(held)
