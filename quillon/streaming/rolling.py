"""Scores of a value against a key's earlier ones, on tables and on streams that wait for late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col
OUT = "series string, us long, score double"


@dataclass(frozen=True)
class Rolling:
    """A score of x against the last `size` earlier values that are not older than `keep_us`: in Python and as a column of (array, x)."""

    size: int
    keep_us: int
    plain: Callable[[list[float], float], float]
    column: Callable[[Column, Column], Column]


def rolling_z(size: int = 60, keep: pd.Timedelta = pd.Timedelta(days=365), least: int = 5) -> Rolling:
    """z of x, 0 with fewer than `least` earlier values or without spread."""

    def plain(held: list[float], x: float) -> float:
        if len(held) < least:
            return 0.0
        mean = sum(held) / len(held)
        sd = sqrt(sum((v - mean) ** 2 for v in held) / len(held))
        return (x - mean) / sd if sd >= 1e-12 else 0.0

    def column(held: Column, x: Column) -> Column:
        total = lambda of: F.aggregate(held, F.lit(0.0), lambda a, v: a + of(v))
        mean = total(lambda v: v) / F.size(held)
        sd = F.sqrt(total(lambda v: (v - mean) * (v - mean)) / F.size(held))
        return F.when((F.size(held) < least) | (sd < 1e-12), 0.0).otherwise((x - mean) / sd)

    return Rolling(size, keep // pd.Timedelta(microseconds=1), plain, column)


def rolling_quantile(size: int = 50, keep: pd.Timedelta = pd.Timedelta(days=365), level: float = 0.9) -> Rolling:
    """The factor of an interval: the upper quantile of the earlier values, at least 1; x itself has no part in it."""

    def plain(held: list[float], _: float) -> float:
        return max(1.0, sorted(held)[max(ceil(len(held) * level) - 1, 0)]) if held else 1.0

    def column(held: Column, _: Column) -> Column:
        at = F.greatest(F.ceil(F.size(held) * level).cast("int") - 1, F.lit(0))
        return F.greatest(F.lit(1.0), F.coalesce(F.get(F.array_sort(held), at), F.lit(1.0)))

    return Rolling(size, keep // pd.Timedelta(microseconds=1), plain, column)


def _rows(values: DataFrame) -> DataFrame:
    return values.where(c("at").isNotNull() & c("x").isNotNull()).select("series", "at", F.unix_micros("at").alias("us"), c("x").cast("double").alias("x"))


def rolling_table(values: DataFrame, rule: Rolling) -> DataFrame:
    """(series, at, x) to (series, at, score). Of rows of one series and time the least value counts; null times and values give no row."""
    w = Window.partitionBy("series").orderBy("us").rowsBetween(-rule.size, -1)
    rows = _rows(values).groupBy("series", "us").agg(F.min("x").alias("x")).withColumn("_held", F.collect_list(F.struct("us", "x")).over(w))
    held = F.transform(F.filter("_held", lambda v: v.us >= c("us") - rule.keep_us), lambda v: v.x)
    return rows.withColumn("_held", held).select("series", F.timestamp_micros("us").alias("at"), rule.column(c("_held"), c("x")).alias("score"))


class RollingProcessor(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, then are scored in the order of time; a second list is the window.

    Only the first waiting time and the end of the window's life are timers. A row not later than the last one scored is
    lost: the watermark had passed it.
    """

    def __init__(self, rule: Rolling) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, x double")
        self.held = handle.getListState("held", "us long, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        first = None
        for frame in rows:
            new = list(zip(frame["us"].tolist(), frame["x"].tolist(), strict=True))
            self.waiting.appendList(new)
            first = min([us for us, _ in new] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        passed, rule = timerValues.getCurrentWatermarkInMs(), self.rule
        held = list(self.held.get()) if self.held.exists() else []
        ready, left = {}, []
        for us, x in self.waiting.get() if self.waiting.exists() else ():
            if us // 1000 >= passed:
                left.append((us, x))
            elif not held or us > held[-1][0]:
                ready[us] = min(x, ready.get(us, x))
        out = []
        for us, x in sorted(ready.items()):
            held = [v for v in held if v[0] >= us - rule.keep_us]
            out.append((us, rule.plain([v for _, v in held], x)))
            held = [*held, (us, x)][-rule.size :]
        self.waiting.put(left) if left else self.waiting.clear()
        if left:
            self.handle.registerTimer(min(us for us, _ in left) // 1000)
        ends = (held[-1][0] + rule.keep_us) // 1000 + 1 if held else 0
        if ends > passed:
            self.held.put(held)
            self.handle.registerTimer(ends)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame({"series": key[0], "us": [us for us, _ in out], "score": [s for _, s in out]})

    def close(self) -> None:
        pass


def rolling_stream(values: DataFrame, rule: Rolling, delay: str = "1 day") -> DataFrame:
    """The rows of rolling_table for every time that the watermark has passed, in append mode; needs the RocksDB state store.

    Rows may come in any order and repeatedly within the delay. Later ones, and rows as old as the newest one scored,
    are lost, as documented. A key's state is the waiting rows of the delay and at most `size` values, and it ends
    with their life.
    """
    rows = _rows(values.withWatermark("at", delay))
    found = rows.groupBy("series").transformWithStateInPandas(RollingProcessor(rule), OUT, "Append", "EventTime")
    return found.select("series", F.timestamp_micros("us").alias("at"), "score")
