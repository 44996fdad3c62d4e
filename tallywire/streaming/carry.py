"""Ordered per-stream metrics on a stream, without a Python process per row.

Each micro-batch is an ordinary batch job over its rows plus one carried row per stream. A busy stream is therefore cut
into chunks exactly as in batch. The carried rows are a small table in the checkpoint folder, one version per batch
number, so a repeated batch reads the same input and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallywire.functions.arith import MICROS, micros, period_start
from tallywire.operators.chunks import fold_pairs
from tallywire.operators.enrich import announce_enrich
from tallywire.operators.sequence import loss_steps
from tallywire.operators.timing import iat_steps, jitter_decay, jitter_fields
from tallywire.operators.windows import WINDOW_SECONDS
from tallywire.streaming.windows import start_batches, write_batch

FIELDS = ["rtp_seq", "rtp_ts", "rtp_ssrc", "clock_hz", "frame_bytes"]


def _state_path(root: str, batch_id: int) -> str:
    return f"{root}/version={batch_id}"


def batch_metrics(
    batch: DataFrame,
    carried: DataFrame | None,
    key: Sequence[str],
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    gap_ms: float = 50.0,
    prune: float = 20,
) -> tuple[DataFrame, DataFrame]:
    """Metrics per (key, Window) of one micro-batch, and the rows to carry into the next one.

    The carried row comes first whatever its time: a late row then counts as a reorder, as it does on arrival.
    A stream that was silent for `prune` whole seconds when its Window began starts afresh, inside a batch or across batches, as in
    `stream_windows`. Silence is judged against the latest time the stream has shown, so a late row is none. Carried rows are forgotten
    after twice that silence before the newest row's Window; that only bounds the table.
    """
    key, order = list(key), list(order)
    columns = list(dict.fromkeys([*key, *order, ts, *FIELDS]))
    rows = batch.select(*columns).withColumns({"_side": F.lit(1), "_jitter": F.lit(0.0), "_seen": micros(ts)})
    if carried is not None:
        seen = F.col("_seen") if "_seen" in carried.columns else micros(ts)
        carried = carried.withColumns({"_side": F.lit(0), "_seen": seen}).select(*rows.columns)
        upto = carried.select(*key, F.col("_seen").alias("_upto"))
        rows = rows.join(upto, key, "left").withColumn("_seen", F.greatest("_seen", "_upto")).drop("_upto").unionByName(carried)
    rows = rows.withColumn("window_start", period_start(ts, seconds))
    order1, chunk = ["_side", *order], ["_side", "window_start"]
    new = (F.col("_side") == 1).cast("bigint")
    fields = {"seq": "rtp_seq", "us": micros(ts), "ssrc": "rtp_ssrc", "begin": micros("window_start"), "seen": "_seen", **jitter_fields(ts)}
    steps = {
        **loss_steps(16),
        **iat_steps(gap_ms),
        "ssrc_changes": ("sum", lambda p, c: (p["ssrc"] != c["ssrc"]).cast("bigint")),
        "_linked": ("sum", lambda p, c: p["seen"].isNotNull().cast("bigint")),
    }
    totals = {"received": ("sum", new), "bytes": ("sum", F.col("frame_bytes").cast("bigint") * new)}
    fresh = lambda p, c: F.floor((c["begin"] - p["seen"]) / MICROS) >= prune
    folded = fold_pairs(rows, key, order1, chunk, fields, steps, totals, None, {"_j": jitter_decay(32)}, fresh)
    out = folded.where(F.col("_side") == 1).drop("_side", "_linked", "_j")
    out = out.na.fill(0, ["lost", "reorders", "gap_events", "ssrc_changes"])

    last = folded.groupBy(*key).agg(
        F.max_by("_j", F.struct(*chunk)).alias("_j"), F.sum("received").alias("_rows"), F.coalesce(F.sum("_linked"), F.lit(0)).alias("_linked")
    )
    rest = [c for c in [*columns, "_jitter"] if c not in key]
    newest = rows.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order1)).alias("_last"),
        F.min_by("_jitter", F.struct(*order1)).alias("_j0"),
        F.max("_seen").alias("_seen"),
    )
    # what was carried in lives on while every row continues the session of the one before
    decayed = F.when(F.col("_linked") == F.col("_rows"), F.col("_j0") * F.pow(F.lit(15.0 / 16.0), F.col("_rows"))).otherwise(0.0)
    state = newest.join(last, key).select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in rest if c != "_jitter"], (F.col("_j") + decayed).alias("_jitter"), "_seen"
    )
    begin = rows.select(F.max(micros("window_start"))).scalar()
    kept = state.where(F.floor((begin - F.col("_seen")) / MICROS) < F.lit(2 * prune))
    return out, kept


def stream_metrics(
    packets: DataFrame,
    path: str,
    state: str,
    checkpoint: str,
    key: Sequence[str],
    order: Sequence[str] = ("ts", "frame_no"),
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    gap_ms: float = 50.0,
    prune: float = 20,
) -> StreamingQuery:
    """Run `batch_metrics` on a stream. Results go to `path`, carried rows to `state`; both by batch number."""

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(_state_path(state, batch_id - 1)) if batch_id > 0 else None
        metrics, keep = batch_metrics(batch, before, key, order, ts, seconds, gap_ms, prune)
        write_batch(metrics, path, batch_id)
        keep.write.mode("overwrite").parquet(_state_path(state, batch_id))

    return start_batches(packets, each, checkpoint)


def merged_metrics(df: DataFrame, key: Sequence[str], window: str = "window_start") -> DataFrame:
    """Add up the parts of Windows that more than one micro-batch saw."""
    sums = ["received", "bytes", "lost", "reorders", "gap_events", "ssrc_changes"]
    return df.groupBy(*key, window).agg(*[F.sum(c).alias(c) for c in sums], F.max("max_iat_us").alias("max_iat_us"))


def stream_enrich(
    packets: DataFrame,
    announcements: str,
    schema: StructType,
    path: str,
    checkpoint: str,
    order: Sequence[str] = ("ts", "frame_no"),
    chunk: Sequence[str] = ("window_start",),
) -> StreamingQuery:
    """Enrich every micro-batch with the announcement table as it is at that moment."""

    def each(batch: DataFrame, batch_id: int) -> None:
        media = batch.sparkSession.read.schema(schema).parquet(announcements)
        write_batch(announce_enrich(batch, media, order=order, chunk=chunk), path, batch_id)

    return start_batches(packets, each, checkpoint)
