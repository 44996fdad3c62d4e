"""Announcements that arrive while the stream runs: keyed state that closed Windows are looked up in.

Two streams are united by key: announcements, and one row per key and closed Window. The state function sees these rows only, never packets.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallywire.functions.arith import micros

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class Announced(StatefulProcessor):
    """Answers each Window with the newest announcement before its end, of those that have arrived."""

    def __init__(self, key: Sequence[str]) -> None:
        self.key = list(key)

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("at_us", LongType()), StructField("no", LongType()), StructField("packed", StringType())]
        self.known = handle.getListState("announced", StructType(fields))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(k) for k in self.known.get()] if self.known.exists() else []
        asked: list[tuple[int, str]] = []
        for part in rows:
            for probe, at, no, packed in zip(part["probe"], part["at_us"], part["no"], part["packed"]):
                if probe:
                    asked.append((int(at), packed))
                else:
                    known.append((int(at), int(no), packed))
        known.sort()
        times = [k[0] for k in known]
        before = [bisect_left(times, at) - 1 for at, _ in asked]
        answers = [known[b][2] if b >= 0 else None for b in before]
        if asked:  # Windows of a key come in order: what an answered Window has passed is not asked for again
            known = known[max(0, max(before)) :]
        if known:
            self.known.put(known)
        if asked:
            out = {k: [v] * len(asked) for k, v in zip(self.key, key)}
            yield pd.DataFrame(out | {"row": [p for _, p in asked], "announced": answers})

    def close(self) -> None:
        pass


def enrich_windows(
    windows: DataFrame, announcements: DataFrame, key: Sequence[str], values: Sequence[str], end: str = "window_end", ts: str = "ts", no: str = "frame_no"
) -> DataFrame:
    """Each row of the stream `windows` (one per key and closed Window) with the `values` of the announcement in force at its end.

    In force is the newest announcement (`ts`, then `no`) of the key with a time before `end`, of all that arrived with the Window's micro-batch or
    earlier; a later one changes no Window that was already given out. Without any, the values are null. The state of a key is the announcement in
    force and those after its last Window. Rows with a null key, and announcements without a time, are left out.
    """
    key, values = list(key), list(values)
    named = F.lit(True)
    for k in key:
        named = named & F.col(k).isNotNull()
    rest = [c for c in windows.columns if c not in key]
    said = announcements.where(named & F.col(ts).isNotNull()).select(
        *key, F.lit(False).alias("probe"), micros(ts).alias("at_us"), F.col(no).cast("bigint").alias("no"), F.to_json(F.struct(*values), _JSON).alias("packed")
    )
    asked = windows.where(named).select(
        *key, F.lit(True).alias("probe"), micros(end).alias("at_us"), F.lit(0).cast("bigint").alias("no"), F.to_json(F.struct(*rest), _JSON).alias("packed")
    )
    fields = [*windows.select(*key).schema.fields, StructField("row", StringType()), StructField("announced", StringType())]
    found = said.unionByName(asked).groupBy(*key).transformWithStateInPandas(Announced(key), StructType(fields), "Append", "None")
    return found.select(
        *key,
        F.from_json("row", windows.select(*rest).schema, _JSON).alias("_row"),
        F.from_json("announced", announcements.select(*values).schema, _JSON).alias("_announced"),
    ).select(*key, "_row.*", *[F.col(f"_announced.{v}").alias(v) for v in values])
