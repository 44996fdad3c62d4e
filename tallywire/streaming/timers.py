"""Silence on a stream: event-time timers per key.

The input is one row per key and closed Window, so the state functions see Windows, never packets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tallywire.functions.arith import period_micros
from tallywire.operators.windows import WINDOW_SECONDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SilenceTimers(StatefulProcessor):
    """Emits the Window end at which a key turns dead, pruned or lost, and `live` when it starts (again)."""

    def __init__(self, key: Sequence[str], rules: Sequence[tuple[str, int, bool]], length: int) -> None:
        # rules: (state, silence in µs, whether the silence must be exceeded); the last one ends the key's life
        self.key, self.rules, self.length = list(key), list(rules), length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("last_us", LongType()), StructField("done", LongType())]
        self.state = handle.getValueState("silence", StructType(fields))

    def _due(self, last_us: int, silence: int, exceed: bool) -> int:
        at = last_us + silence
        up = -at % self.length
        return at + (self.length if exceed and up == 0 else up)

    def _passed(self, last_us: int, done: int, until: int) -> list[tuple[int, str]]:
        """Transitions not yet reported that fall on Window ends up to `until`."""
        dues = [(self._due(last_us, s, x), name) for name, s, x in self.rules]
        return [d for d in dues[done:] if d[0] <= until]

    def _frame(self, key: tuple, found: list[tuple[int, str]]) -> pd.DataFrame:
        out = {k: [v] * len(found) for k, v in zip(self.key, key)}
        out |= {"at_us": [a for a, _ in found], "state": [s for _, s in found]}
        return pd.DataFrame(out)

    def _set_timers(self, last_us: int, done: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for _, silence, exceed in self.rules[done:]:
            self.handle.registerTimer(self._due(last_us, silence, exceed) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows)).sort_values("start_us")
        last, done = self.state.get() if self.state.exists() else (None, 0)
        found: list[tuple[int, str]] = []
        for start_us, last_us in zip(windows["start_us"], windows["last_us"]):
            if last is not None:
                passed = self._passed(last, done, int(start_us))
                found += passed
                done += len(passed)
            if last is None or done == len(self.rules):
                found.append((int(start_us) + self.length, "live"))
            last, done = int(last_us), 0
        self.state.update((last, done))
        self._set_timers(last, done)
        yield self._frame(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        last, done = self.state.get()
        passed = self._passed(last, done, expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999)
        if done + len(passed) == len(self.rules):
            self.state.clear()
        else:
            self.state.update((last, done + len(passed)))
        if passed:
            yield self._frame(key, passed)

    def close(self) -> None:
        pass


def stream_silence(
    closed: DataFrame,
    key: Sequence[str],
    key_schema: str,
    rules: Sequence[tuple[str, float, bool]] = (("dead", 10, True), ("pruned", 20, False)),
    seconds: float = WINDOW_SECONDS,
) -> DataFrame:
    """State changes `(key, at_us, state)` of keys from their closed Windows (see `stream_window_totals`).

    For clocks use `rules=[("lost", 5, True)]`.
    """
    exact = [(name, period_micros(s), exceed) for name, s, exceed in rules]
    rows = closed.select(
        *key, "window", F.unix_micros("window_start").alias("start_us"), F.unix_micros("last_ts").alias("last_us")
    )
    return rows.groupBy(*key).transformWithStateInPandas(
        SilenceTimers(key, exact, period_micros(seconds)), f"{key_schema}, at_us bigint, state string", "Append", "EventTime"
    )
