"""Online estimators and streams. Each stateful operator has a batch twin over the same step function."""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.joins import dimension_join
from quillon.sources.readers import clean_snapshots

c = F.col


def stream_snapshots(raw: DataFrame, watermark: str = "48 hours") -> DataFrame:
    """The snapshot rules on a stream, repeats within the watermark dropped; late rows past it are lost, as documented.

    A repeat is the same snapshot again, equal in every column: which of two that differ came first in a batch is left to
    chance, so both stay.
    """
    good, _ = clean_snapshots(raw)
    return good.withWatermark("capturedAt", watermark).dropDuplicatesWithinWatermark(good.columns)


def windowed_event_stats(events: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Counts and means of values over tumbling or sliding event-time windows; works on streams and tables."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    return rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(c("window.start").alias("start"), "event_type", "n", "mean")


def latest_price_state(events: DataFrame) -> DataFrame:
    """Latest value of every key, for joins; update mode on streams."""
    return events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("price"))


def valued_positions(ticks: DataFrame, positions: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Every position (user_id, quantity) at the last price of each day: day, user_id, price, value, ticks; a stream or a table.

    On a stream the ticks (user_id, ts, event_id, value) meet the positions as a static table, whose size is counted
    before it may be broadcast; ticks of users without a position are dropped before they reach the state. In update
    mode each trigger gives the days that changed. A tick later than the watermark of its day is lost, as documented:
    its day's state is gone by then.
    """
    rows = ticks.withWatermark("ts", watermark) if ticks.isStreaming else ticks
    met = dimension_join(rows.select("user_id", "ts", "event_id", "value"), positions.select("user_id", "quantity"), "user_id", how="inner")
    days = met.groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.max_by(F.struct("value", "quantity"), F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("ticks"))
    return days.select(F.to_date("w.start").alias("day"), "user_id", c("last.value").alias("price"), (c("last.value") * c("last.quantity")).alias("value"), "ticks")


def score_conformal(steps: DataFrame, window: int = 50, level: float = 0.9, block: int | None = None) -> DataFrame:
    """max(1, upper quantile of the last `window` scores before a step).

    Where t numbers the steps of a key without gaps, `block` (`window` at least) deals a key to parts of that many
    steps, each with the last `window` steps of the part before, so no task holds a whole key.
    """
    keys = ["ticker", "horizon"]
    if block is not None:
        if block < window:
            raise ValueError("a block must hold a window")
        own = F.floor(c("t") / block)
        parts = F.when(c("t") % block >= block - window, F.array(own, own + 1)).otherwise(F.array(own))
        steps, keys = steps.select("*", F.explode(parts).alias("_block")), [*keys, "_block"]
    before = F.array_sort(F.collect_list("score").over(Window.partitionBy(*keys).orderBy("t").rowsBetween(-window, -1)))
    q = F.get(before, F.greatest(F.ceil(F.size(before) * level).cast("int") - 1, F.lit(0)))
    if block is not None:
        steps = steps.select("*", before.alias("_before")).where(c("_block") == F.floor(c("t") / block))
        q = F.get("_before", F.greatest(F.ceil(F.size("_before") * level).cast("int") - 1, F.lit(0)))
    return steps.select("ticker", "horizon", "t", F.greatest(F.lit(1.0), F.coalesce(q, F.lit(1.0))).alias("factor"))


class Adwin:
    """Adaptive window over exponential buckets (count, sum, sum of squares): at a cut the oldest buckets go."""

    def __init__(self, delta: float = 0.002, per_size: int = 5, buckets: list[tuple[float, float, float]] | None = None) -> None:
        self.delta, self.per_size, self.buckets = delta, per_size, list(buckets or [])

    def add(self, x: float) -> bool:
        """Add a value; whether the window was cut."""
        self.buckets.append((1.0, x, x * x))
        size = 1.0
        while True:
            own = [i for i, b in enumerate(self.buckets) if b[0] == size]
            if len(own) <= self.per_size:
                break
            i, j = own[0], own[1]
            self.buckets[i : j + 1] = [tuple(a + b for a, b in zip(self.buckets[i], self.buckets[j], strict=True))]
            size *= 2
        cut = False
        for _ in range(5):
            if not self._differs():
                break
            self.buckets.pop(0)
            cut = True
        return cut

    def _differs(self) -> bool:
        n, s, q = (sum(b[k] for b in self.buckets) for k in range(3))
        if n < 10:
            return False
        var, log_term = max(0.0, q / n - (s / n) ** 2), log(2 * log(max(n, 3.0)) / self.delta)
        n0 = s0 = 0.0
        for b in self.buckets[:-1]:
            n0, s0 = n0 + b[0], s0 + b[1]
            n1, s1 = n - n0, s - s0
            m = 1 / (1 / n0 + 1 / n1)
            if n0 >= 5 and n1 >= 5 and abs(s0 / n0 - s1 / n1) > sqrt(2 / m * var * log_term) + 2 / (3 * m) * log_term:
                return True
        return False


class AdwinProcessor(StatefulProcessor):
    """Streaming form: the buckets of a key are its state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buckets", "n array<double>, s array<double>, q array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        held = self.state.get() if self.state.exists() else ([], [], [])
        window = Adwin(buckets=list(zip(*held, strict=True)))
        for frame in rows:
            frame = frame.sort_values(["d"])
            out = [(window.add(float(x)), sum(b[0] for b in window.buckets)) for x in frame["x"]]
            yield pd.DataFrame({"series": key[0], "d": frame["d"].to_numpy(), "cut": [x for x, _ in out], "width": [w for _, w in out]})
        self.state.update(tuple([b[k] for b in window.buckets] for k in range(3)))

    def close(self) -> None:
        pass


ADWIN_OUT = "series string, d date, cut boolean, width double"


def adwin_stream(values: DataFrame) -> DataFrame:
    """(series, d, x) as a stream to drift flags; needs the RocksDB state store."""
    return values.groupBy("series").transformWithStateInPandas(AdwinProcessor(), ADWIN_OUT, "Append", "None")


def adwin_batch(values: DataFrame) -> DataFrame:
    """The same over a table: rows of a series stream through in order, partition by partition, and only the buckets are held."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Adwin()
        for frame in frames:
            out = []
            for s, x in zip(frame["series"], frame["x"], strict=True):
                if s != key:
                    key, window = s, Adwin()
                out.append((window.add(float(x)), sum(b[0] for b in window.buckets)))
            yield pd.DataFrame({"series": frame["series"], "d": frame["d"], "cut": [x for x, _ in out], "width": [w for _, w in out]})

    return values.select("series", "d", "x").repartition("series").sortWithinPartitions("series", "d").mapInPandas(run, ADWIN_OUT)


def incremental_index(batch: DataFrame, index_path: str) -> None:
    """foreachBatch: append only chunks whose hash the index does not hold yet."""
    spark = batch.sparkSession
    new = batch.dropDuplicates(["hash"])
    try:
        known = spark.read.parquet(index_path).select("hash")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    (new if known is None else new.join(known, "hash", "left_anti")).write.mode("append").parquet(index_path)
