"""Online estimators that fold the rows of a key in order. One step function serves the table and the stream form."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ("ticker", "horizon")
KEYS_OUT = "ticker string, horizon int"
#: Rows of a key that travel to its task as one.
PACK = 512


@dataclass(frozen=True)
class Fold:
    """The state at the start, its next value after a row, and the columns made from it.

    values: columns of a row, the first of which must not be null (such rows are left out). finish gives the columns of
    `out`, in order. A state is a tuple of floats.
    """

    values: tuple[str, ...]
    zero: tuple[float, ...]
    step: Callable[..., tuple[float, ...]]
    finish: Callable[[tuple[float, ...]], tuple]
    out: str


def _complete(steps: DataFrame, fold: Fold) -> DataFrame:
    kinds = dict(steps.dtypes)
    rest = [F.coalesce(F.col(v), F.lit(False if kinds[v] == "boolean" else 0)).cast("double").alias(v) for v in fold.values[1:]]
    first = fold.values[0]
    return steps.where(F.col(first).isNotNull()).select(*KEYS, "t", F.col(first).cast("double").alias(first), *rest)


def _packed(rows: DataFrame, fold: Fold) -> DataFrame:
    """Rows sorted by (_key, t, values) over the whole cluster, PACK of one key in a row: part and n are its place, values its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in fold.values], axis=1)
            runs = pc.run_end_encode(batch.column("_key")).run_ends.to_pylist()
            starts = [x for low, high in zip([0, *runs[:-1]], runs, strict=True) for x in range(low, high, PACK)]
            ends = [*starts[1:], batch.num_rows]
            at = pa.array(starts)
            held = [values[i:j].astype("<f8").tobytes() for i, j in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x).take(at) for x in ("_key", *KEYS)], pa.array([part] * len(at), pa.int32()), pa.array(range(n, n + len(at)), pa.int64()), pa.array(held, pa.binary())], names=["_key", *KEYS, "part", "n", "held"])
            n += len(at)

    order = ("_key", "t", *fold.values)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", *KEYS, *fold.values)
    kinds = dict(rows.dtypes)
    return ranged.mapInArrow(run, f"_key string, {', '.join(f'{k} {kinds[k]}' for k in KEYS)}, part int, n long, held binary")


def fold_table(steps: DataFrame, fold: Fold) -> DataFrame:
    """Rows (ticker, horizon, t, values...) to one row for each key. Null keys are keys; equal t: by values.

    Rows are sorted over the whole cluster and packed; a key's packs stream through its task in order and only the state
    is held, so keys may be of any length. The fold of one key is sequential by definition.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, row = None, fold.zero, None
        shape = [*KEYS, *[x.split()[0] for x in fold.out.split(", ")]]
        made = lambda: pd.DataFrame([[*row, *fold.finish(state)]], columns=shape)
        for frame in frames:
            for k, ticker, horizon, held in zip(*[frame[v].tolist() for v in ("_key", *KEYS, "held")], strict=True):
                if k != key:
                    if key is not None:
                        yield made()
                    key, state, row = k, fold.zero, [ticker, None if pd.isna(horizon) else int(horizon)]
                for values in np.frombuffer(held, "<f8").reshape(-1, len(fold.values)).tolist():
                    state = fold.step(state, *values)
        if key is not None:
            yield made()

    rows = _packed(_complete(steps, fold).withColumn("_key", F.to_json(F.struct(*KEYS))), fold)
    return rows.repartition("_key").sortWithinPartitions("_key", "part", "n").mapInPandas(run, f"{KEYS_OUT}, {fold.out}")


class FoldProcessor(StatefulProcessor):
    """Streaming form: the fold's state is the state of the key; every batch reports the keys it met."""

    def __init__(self, fold: Fold) -> None:
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        fold = self.fold
        state = tuple(self.state.get()[0]) if self.state.exists() else fold.zero
        frame = pd.concat(list(rows)).sort_values(["t", *fold.values])  # the rows of one trigger
        for values in zip(*[frame[v].tolist() for v in fold.values], strict=True):
            state = fold.step(state, *values)
        self.state.update((list(state),))
        names = [x.split()[0] for x in fold.out.split(", ")]
        yield pd.DataFrame([[*key, *fold.finish(state)]], columns=[*KEYS, *names])

    def close(self) -> None:
        pass


def fold_stream(steps: DataFrame, fold: Fold) -> DataFrame:
    """The same over a stream, update mode: rows are folded in the order of t within a trigger. Needs the RocksDB state store."""
    return _complete(steps, fold).groupBy(*KEYS).transformWithStateInPandas(FoldProcessor(fold), f"{KEYS_OUT}, {fold.out}", "Update", "None")


def pid_fold(target: float = 0.9, lr: float = 0.05, kp: float = 1.0, ki: float = 0.1, kd: float = 0.1) -> Fold:
    """State: radius q, sum of errors, last error, hits, rows."""
    def step(a: tuple[float, ...], residual: float) -> tuple[float, ...]:
        q, total, last, hit, n = a
        miss = float(residual > q)
        e = miss - (1 - target)
        return max(0.0, q + lr * (kp * e + ki * (total + e) + kd * (e - last))), total + e, e, hit + 1 - miss, n + 1

    return Fold(("residual",), (0.1, 0.0, 0.0, 0.0, 0.0), step, lambda a: (a[0], a[3] / a[4]), "radius double, coverage double")


def conformal_pid(steps: DataFrame, **options: float) -> DataFrame:
    """Final radius and coverage of an online interval: q moves by lr (kp e + ki sum e + kd de), e = miss - (1 - target)."""
    return fold_table(steps, pid_fold(**options))


def conformal_pid_stream(steps: DataFrame, **options: float) -> DataFrame:
    return fold_stream(steps, pid_fold(**options))


def brier_fold(rate: float = 0.05) -> Fold:
    """State: bias, slope."""
    def step(a: tuple[float, ...], p: float, y: float) -> tuple[float, ...]:
        bias, slope = a
        held = min(max(p, 1e-6), 1 - 1e-6)
        x = log(held / (1 - held))
        q = 1 / (1 + exp(-(bias + slope * x)))
        g = 2 * (q - y) * q * (1 - q) * (2.0 if 0.4 < p < 0.6 else 1.0)
        return min(max(bias - rate * g, -2.0), 2.0), min(max(slope - rate * g * x, 0.2), 3.0)

    return Fold(("p", "y"), (0.0, 1.0), step, lambda a: a, "bias double, slope double")


def online_brier_calibrator(steps: DataFrame, rate: float = 0.05) -> DataFrame:
    """Bias and slope of a logistic calibrator after one pass of clamped gradient steps in row order; middle band doubled."""
    return fold_table(steps, brier_fold(rate))


def online_brier_stream(steps: DataFrame, rate: float = 0.05) -> DataFrame:
    return fold_stream(steps, brier_fold(rate))


def break_fold(target: float = 0.9, rate: float = 0.05, multiplier: float = 1.5, cooloff: int = 0) -> Fold:
    """State: radius, rows of cool-off left, mean residual and volatility (-1: none yet), hits, broken rows, mode, rows."""
    wide = max(1.0, sqrt(multiplier))

    def step(a: tuple[float, ...], residual: float, rv: float, flag: float) -> tuple[float, ...]:
        q, cool, res, vol, hit, broken, _, n = a
        baseline = vol if vol >= 0 else res
        shock = bool(flag) or (rv > 0 and baseline >= 0 and rv >= baseline * multiplier)
        on = shock or cool > 0
        miss = float(residual > q)
        q = max(0.0, q + (rate * multiplier if on else rate) * (miss - (1 - target)))
        cool = float(cooloff) if shock else max(0.0, cool - 1)
        res = residual if res < 0 else 0.95 * res + 0.05 * residual
        vol = vol if rv <= 0 else rv if vol < 0 else 0.9 * vol + 0.1 * rv
        return q, cool, res, vol, hit + 1 - miss, broken + on, float(on), n + 1

    finish = lambda a: (a[0], a[0] * (wide if a[6] else 1.0), a[4] / a[7], int(a[5]))
    return Fold(("residual", "rv", "is_break"), (0.1, 0.0, -1.0, -1.0, 0.0, 0.0, 0.0, 0.0), step, finish, "radius double, applied double, coverage double, breaks int")


def adaptive_conformal(steps: DataFrame, **options: float) -> DataFrame:
    """Final radius, applied radius and coverage with a break mode: after a flag or a shock the rate rises for `cooloff` rows.

    In break mode the applied radius is the radius times the root of the multiplier (never less than the radius itself).
    A shock is realised volatility at or above `multiplier` times its moving average (until one exists, the residual's).
    Residuals are not negative; a null volatility counts as none, a null flag as no break.
    """
    return fold_table(steps, break_fold(**options))


def adaptive_conformal_stream(steps: DataFrame, **options: float) -> DataFrame:
    return fold_stream(steps, break_fold(**options))
