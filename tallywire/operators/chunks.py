"""Ordered per-key work that never puts one key into one task.

A stream can hold a large part of all rows, so a window over `(key; order)` would sort it in a single task.
Every ordered operator here cuts each key into chunks instead: `chunk` is a list of columns that do not
decrease along the order (a reporting Window, a block of frame numbers, a day). The work is then

* level 1, on `(key, chunk)`: one shuffle, one sort, previous-row look-ups inside the chunk, partial results;
* level 2, on `key` ordered by chunk: one small row per chunk, which supplies the row before each chunk.

Level 2 holds as many rows per key as the key has chunks, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywire.functions.arith import as_col

Row = Mapping[str, Column]
Step = tuple[str, Callable[[Row, Row], Column]]
Total = tuple[str, Column]
Decay = tuple[float, Callable[[Row, Row], Column]]

WEIGHT_LOG = 600.0  # a segment of the closed-form fold ends before its weights pass e^600, the range of a double

COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def merge_two(how: str, left: Column, right: Column) -> Column:
    if how == "sum":
        return F.when(left.isNull(), right).when(right.isNull(), left).otherwise(left + right)
    return F.greatest(left, right) if how == "max" else F.least(left, right)


def fold_pairs(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[str],
    fields: Mapping[str, Column | str],
    steps: Mapping[str, Step],
    totals: Mapping[str, Total] | None = None,
    keep: Sequence[str] | None = None,
    decays: Mapping[str, Decay] | None = None,
    fresh: Callable[[Row, Row], Column] | None = None,
) -> DataFrame:
    """Aggregate a function of each row and the row before it, per key and chunk.

    `fields` are the values a step may look at. A step is `(combine, fn(previous, current))`; it is null for
    the first row of a key. A total is `(combine, column)`. The pair that spans two chunks counts for the later
    one. `keep` names the chunk columns of the result (default all); the others are merged away.

    A decay is `(alpha, fn)`: the moving average J += alpha * (fn - J), from 0, as it stands after each chunk. The
    recurrence is linear, so a chunk of n rows acts as J -> (1-alpha)^n J + S with S a plain weighted sum: chunks are
    summed independently and the per-chunk rows are combined in closed form. No group is ever collected.

    `fresh(previous, current)` says that a row starts a new session: its step is null like that of a first row, and
    averages start from 0 again.
    """
    key, order, chunk = list(key), list(order), list(chunk)
    totals, decays = dict(totals or {}), dict(decays or {})
    names = list(fields)

    def new(p: Row, c: Row) -> Column:
        return F.coalesce(fresh(p, c), F.lit(False)) if fresh else F.lit(False)

    def inside(fn: Callable[[Row, Row], Column]) -> Callable[[Row, Row], Column]:
        return (lambda p, c: F.when(~new(p, c), fn(p, c))) if fresh else fn

    steps = {out: (how, inside(fn)) for out, (how, fn) in steps.items()}
    decays = {out: (a, inside(fn)) for out, (a, fn) in decays.items()}
    rows = df.select(
        *[F.col(c) for c in dict.fromkeys(key + chunk)],
        *[F.col(c).alias(f"_o_{i}") for i, c in enumerate(order)],
        *[as_col(fields[n]).alias(f"_c_{n}") for n in names],
        *[c.alias(f"_t_{n}") for n, (_, c) in totals.items()],
    )
    w = Window.partitionBy(*key, *chunk).orderBy(*[f"_o_{i}" for i in range(len(order))])
    rows = rows.select(
        "*",
        *[F.lag(f"_c_{n}").over(w).alias(f"_p_{n}") for n in names],
        F.lag(F.lit(1)).over(w).isNull().alias("_head"),
        F.lead(F.lit(1)).over(w).isNull().alias("_tail"),
    )
    if decays:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_after", F.count(F.lit(1)).over(whole) - F.row_number().over(w))
    before = {n: F.col(f"_p_{n}") for n in names}
    here = {n: F.col(f"_c_{n}") for n in names}
    live = F.lit(True)
    if decays and fresh:
        later = w.rowsBetween(1, Window.unboundedFollowing)
        rows = rows.withColumn("_new", (~F.col("_head") & new(before, here)).cast("bigint"))
        rows = rows.withColumn("_later", F.coalesce(F.sum("_new").over(later), F.lit(0)))
        live = F.col("_later") == 0
    per_chunk = rows.groupBy(*key, *chunk).agg(
        *[COMBINE[how](fn(before, here)).alias(out) for out, (how, fn) in steps.items()],
        *[COMBINE[how](F.col(f"_t_{out}")).alias(out) for out, (how, _) in totals.items()],
        *[F.sum(F.when(live, fn(before, here) * F.pow(F.lit(1.0 - a), F.col("_after")))).alias(out) for out, (a, fn) in decays.items()],
        (F.sum("_new") if decays and fresh else F.lit(0)).alias("_breaks"),
        F.count(F.lit(1)).alias("_rows"),
        *[F.max(F.when(F.col("_head"), F.col(f"_c_{n}"))).alias(f"_f_{n}") for n in names],
        *[F.max(F.when(F.col("_tail"), F.col(f"_c_{n}"))).alias(f"_l_{n}") for n in names],
    )
    across = Window.partitionBy(*key).orderBy(*chunk)
    per_chunk = per_chunk.select("*", *[F.lag(f"_l_{n}").over(across).alias(f"_e_{n}") for n in names])
    edge = {n: F.col(f"_e_{n}") for n in names}
    first = {n: F.col(f"_f_{n}") for n in names}
    if decays and fresh:
        starts = ((F.col("_breaks") > 0) | new(edge, first)).cast("bigint")
        per_chunk = per_chunk.withColumn("_session", F.sum(starts).over(across))
    merged = per_chunk.select(
        *key,
        *chunk,
        *(["_session"] if decays and fresh else []),
        *[merge_two(how, F.col(out), fn(edge, first)).alias(out) for out, (how, fn) in steps.items()],
        *totals,
        *[
            (
                (
                    F.coalesce(F.col(out), F.lit(0.0))
                    + F.when(F.col("_breaks") == 0, F.coalesce(fn(edge, first), F.lit(0.0)) * F.pow(F.lit(1.0 - a), F.col("_rows") - 1))
                    .otherwise(0.0)
                )
                * a
            ).alias(out)
            for out, (a, fn) in decays.items()
        ],
        *(["_rows"] if decays else []),
    )
    if decays:
        lives = [*key, "_session"] if fresh else key
        for out, (a, _) in decays.items():  # segments depend on the rate
            merged = fold_decays(merged, lives, chunk, {out: 1.0 - a})
        merged = merged.drop("_rows", "_session")
    if keep is None or list(keep) == chunk:
        return merged
    ways = {**{o: h for o, (h, _) in steps.items()}, **{o: h for o, (h, _) in totals.items()}}
    return merged.groupBy(*key, *keep).agg(
        *[COMBINE[how](out).alias(out) for out, how in ways.items()],
        *[F.max_by(out, F.struct(*chunk)).alias(out) for out in decays],
    )


def fold_decays(per_chunk: DataFrame, key: list[str], chunk: list[str], keeps: Mapping[str, float], rows: str = "_rows") -> DataFrame:
    """Turn the weighted sums of chunks into the averages after them: earlier sums count keep^(rows since).

    Running sums are taken in segments of rows, with weights relative to the segment's start; a segment is as long as the
    smallest `keep` lets weights grow. What the segment before leaves behind is added; older ones weigh less than
    e^-WEIGHT_LOG, which no double can show. With several rates call this once for each.
    """
    least = min(keeps.values())
    span = max(1, int(WEIGHT_LOG / -math.log(least))) if 0 < least < 1 else 1
    across = Window.partitionBy(*key).orderBy(*chunk)
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    placed = per_chunk.withColumn("_at", F.sum(rows).over(upto))
    placed = placed.withColumns({"_seg": F.floor(F.col("_at") / span), "_pos": F.pmod("_at", F.lit(span))})
    seg = Window.partitionBy(*key, "_seg").orderBy(*chunk)
    so_far = seg.rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumns(
        {
            f"_v_{n}": F.sum(F.col(n) * F.pow(F.lit(k), -F.col("_pos"))).over(so_far) * F.pow(F.lit(k), F.col("_pos"))
            for n, k in keeps.items()
        }
    )
    placed = placed.select(
        "*", F.lag("_at").over(across).alias("_pat"), *[F.lag(f"_v_{n}").over(across).alias(f"_pv_{n}") for n in keeps]
    )

    def left(n: str, k: float) -> Column:
        return F.coalesce(F.first(f"_pv_{n}").over(seg) * F.pow(F.lit(k), F.col("_at") - F.first("_pat").over(seg)), F.lit(0.0))

    rest = [c for c in per_chunk.columns if c not in keeps]
    return placed.select(*rest, *[(F.col(f"_v_{n}") + left(n, k)).alias(n) for n, k in keeps.items()])


def _carry_in(
    df: DataFrame, key: list[str], order: list[str], chunk: list[str], fields: Mapping[str, str], known: bool
) -> DataFrame:
    """Per (key, chunk): each field of the last row (or the last non-null value) before the chunk.

    Partial aggregation leaves one row per key, chunk and input split to shuffle, never the rows themselves.
    """
    at = F.struct(*order)
    if not known:
        across = Window.partitionBy(*key).orderBy(*chunk)
        last = df.groupBy(*key, *chunk).agg(F.max_by(F.struct(*fields.values()), at).alias("_last"))
        prev = F.lag("_last").over(across)
        return last.select(*key, *chunk, *[prev[c].alias(f"_in_{n}") for n, c in fields.items()])
    # Only rows that carry a value need the ordered aggregate; all others just name their chunk. The chunk's own
    # values sort after its name, so they count for later chunks only.
    some = F.lit(False)
    for c in fields.values():
        some = some | F.col(c).isNotNull()
    last = df.where(some).groupBy(*key, *chunk).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_l_{n}") for n, c in fields.items()]
    )
    slots = df.select(*key, *chunk).distinct().withColumn("_side", F.lit(0))
    both = slots.unionByName(last.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    past = Window.partitionBy(*key).orderBy(*chunk, "_side").rowsBetween(Window.unboundedPreceding, -1)
    known_before = [F.last(f"_l_{n}", ignorenulls=True).over(past).alias(f"_in_{n}") for n in fields]
    return both.select(*key, *chunk, "_side", *known_before).where(F.col("_side") == 0).drop("_side")


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Sequence[str], fields: Mapping[str, str]
) -> DataFrame:
    """Add `{new: column}` of the row before, across chunk borders."""
    key, order, chunk = list(key), list(order), list(chunk)
    w = Window.partitionBy(*key, *chunk).orderBy(*order)
    local = df.select(
        "*",
        *[F.lag(c).over(w).alias(f"_w_{n}") for n, c in fields.items()],
        F.lag(F.lit(1)).over(w).isNull().alias("_head"),
    )
    joined = local.join(_carry_in(df, key, order, chunk, fields, known=False), [*key, *chunk], "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_head"), F.col(f"_in_{n}")).otherwise(F.col(f"_w_{n}")).alias(n) for n in fields],
    )


def with_last_known(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Sequence[str],
    fields: Mapping[str, str],
    include_current: bool = True,
) -> DataFrame:
    """Add `{new: column}` holding the latest non-null value up to (and with) this row, across chunks."""
    key, order, chunk = list(key), list(order), list(chunk)
    end = 0 if include_current else -1
    w = Window.partitionBy(*key, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_w_{n}") for n, c in fields.items()])
    joined = local.join(_carry_in(df, key, order, chunk, fields, known=True), [*key, *chunk], "left")
    return joined.select(
        *df.columns, *[F.coalesce(F.col(f"_w_{n}"), F.col(f"_in_{n}")).alias(n) for n in fields]
    )


def with_running_sum(
    df: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Sequence[str], fields: Mapping[str, str]
) -> DataFrame:
    """Add `{new: column}` holding the sum of a column over all rows of the key up to this one."""
    key, order, chunk = list(key), list(order), list(chunk)
    w = Window.partitionBy(*key, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*key).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", *[F.sum(c).over(w).alias(f"_w_{n}") for n, c in fields.items()])
    before = (
        df.groupBy(*key, *chunk)
        .agg(*[F.sum(c).alias(f"_s_{n}") for n, c in fields.items()])
        .select(*key, *chunk, *[F.sum(f"_s_{n}").over(across).alias(f"_in_{n}") for n in fields])
    )
    joined = local.join(before, [*key, *chunk], "left")
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_w_{n}"), zero) + F.coalesce(F.col(f"_in_{n}"), zero)).alias(n) for n in fields],
    )

