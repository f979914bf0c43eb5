"""Table functions for SQL: the online folds called by name on a TABLE argument, in each key's order, with typed options.

Spark hands a table function row by row to Python, and a key to one task. So a row may also be a pack: its value columns
are arrays of equal length, the values of steps that follow each other, and t is the first one's. `packed_sql` makes packs.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from quillon.streaming.folds import KEYS, KEYS_OUT, PACK, Fold, break_fold, brier_fold, pid_fold

#: Names in SQL and the folds behind them; arguments of a fold are arguments of its function.
FUNCTIONS: dict[str, Callable[..., Fold]] = {"conformal_pid": pid_fold, "online_brier_calibrator": brier_fold, "adaptive_conformal": break_fold}


_KINDS = {"string": StringType(), "int": IntegerType(), "double": DoubleType()}


def _shape(columns: str) -> StructType:
    """`name kind, ...` as a schema; the worker that plans has no JVM to parse it."""
    out = StructType()
    for x in columns.split(", "):
        name, kind = x.split()
        out = out.add(name, _KINDS[kind])
    return out


def _options(make: Callable[..., Fold], given: dict[str, AnalyzeArgument]) -> dict[str, float]:
    known = inspect.signature(make).parameters
    if wrong := sorted(set(given) - set(known)):
        raise ValueError(f"no such argument: {', '.join(wrong)}; there are {', '.join(known)}")
    for name, x in given.items():
        if not x.isConstantExpression or x.value is None:
            raise ValueError(f"{name} must be a constant")
    return {k: type(known[k].default)(x.value) for k, x in given.items()}


def fold_function(make: Callable[..., Fold]) -> type:
    """A table function class of a fold: checks its arguments when the query is planned, and asks for its rows by key and in order."""

    class Folded:
        def __init__(self) -> None:
            self.fold: Fold | None = None

        @staticmethod
        def analyze(table: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            if not table.isTable or not isinstance(table.dataType, StructType):
                raise ValueError("the first argument must be a TABLE")
            fold = make(**_options(make, options))
            if missing := [x for x in (*KEYS, "t", *fold.values) if x not in table.dataType.names]:
                raise ValueError(f"the table lacks {', '.join(missing)}")
            if len({isinstance(table.dataType[x].dataType, ArrayType) for x in fold.values}) > 1:
                raise ValueError(f"all of {', '.join(fold.values)} or none must be arrays")
            return AnalyzeResult(_shape(f"{KEYS_OUT}, {fold.out}"), partitionBy=[PartitioningColumn(x) for x in KEYS], orderBy=[OrderingColumn(x) for x in ("t", *fold.values)])

        def eval(self, table, **options) -> None:  # noqa: ANN001, ANN003
            if self.fold is None:
                known = inspect.signature(make).parameters
                self.fold = make(**{k: type(known[k].default)(v) for k, v in options.items()})
                self.state, self.key = self.fold.zero, None
            first, *rest = [table[v] for v in self.fold.values]
            if first is None:
                return
            if not isinstance(first, list | np.ndarray):
                first, rest = [first], [[x] for x in rest]
            first = [None if v is None else float(v) for v in first]
            rest = [[0.0] * len(first) if x is None else [float(v or 0) for v in x] for x in rest]
            rows = [x for x in zip(first, *rest, strict=True) if x[0] is not None]
            if rows:
                self.key = [table[x] for x in KEYS]
            state, step = self.state, self.fold.step
            for row in rows:
                state = step(state, *row)
            self.state = state

        def terminate(self) -> Iterator[tuple]:
            if self.fold is not None and self.key is not None:
                yield (*self.key, *self.fold.finish(self.state))

    return Folded


def packed_sql(steps: str, values: dict[str, str], pack: int = PACK) -> str:
    """SQL of the packs of a table or view; values: name to expression. A pack has the rows of a key whose t, a number, lies in a range of `pack`.

    Packs are grouped by key and range, so they are made over the whole cluster, and only packs are sorted by key. Where
    t numbers a key's rows, a pack has `pack` of them at most.
    """
    row = ", ".join(f"{x} AS {name}" for name, x in values.items())
    arrays = ", ".join(f"transform(steps, x -> x.{name}) AS {name}" for name in values)
    keys = ", ".join(KEYS)
    # as plain rows: by t, then by values
    return f"SELECT {keys}, t, {arrays} FROM (SELECT {keys}, min(t) AS t, sort_array(collect_list(struct(t, {row}))) AS steps FROM {steps} GROUP BY {keys}, floor(t / {pack}))"


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make FUNCTIONS known to SQL: SELECT * FROM conformal_pid(TABLE(steps), lr => 0.1). Gives their names."""
    for name, make in FUNCTIONS.items():
        spark.udtf.register(prefix + name, udtf(fold_function(make)))
    return [prefix + name for name in FUNCTIONS]
