"""Regressions of many short segments at once, and clusters of their coefficients."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.ranks import exact_ranks
from quillon.operators.scratch import written

c = F.col
#: Regressors of a return: one, its three last ones, their mean, the size of the last; fixed by the definition.
REGRESSORS = ("one", "lag1", "lag2", "lag3", "mean3", "size1")
COEFFICIENTS = tuple(f"b{i}" for i in range(len(REGRESSORS)))
FEATURES = (*COEFFICIENTS, "residual_variance")


def normal_equations(windows: DataFrame) -> DataFrame:
    """Sums of r on the REGRESSORS for every (series, w): n, moments (the upper triangle, row by row), targets, squares.

    The rows of a segment are few (its window's size); lags are taken inside it.
    """
    time = Window.partitionBy("series", "w").orderBy("d")
    lags = windows.withColumns({f"lag{k}": F.lag("r", k).over(time) for k in (1, 2, 3)}).where("lag3 is not null")
    rows = lags.withColumns({"one": F.lit(1.0), "mean3": (c("lag1") + c("lag2") + c("lag3")) / 3, "size1": F.abs("lag1")})
    pairs = [(a, b) for i, a in enumerate(REGRESSORS) for b in REGRESSORS[i:]]
    return rows.groupBy("series", "w").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c(a) * c(b)) for a, b in pairs]).alias("moments"),
        F.array(*[F.sum(c(a) * c("r")) for a in REGRESSORS]).alias("targets"),
        F.sum(c("r") * c("r")).alias("squares"),
    )


def segment_coefficients(windows: DataFrame, ridge: float = 1e-6, least: int = 12) -> DataFrame:
    """(series, w, n, b0..b5, residual_variance) of segments of `least` rows or more.

    Spark sums the normal equations; the 6 x 6 systems of a batch of segments are solved together, over the sums alone.
    The mean of the lags repeats what the lags say, so it is the ridge that makes a system solvable; sums of squares left
    over come from the same sums, 0 at least, over the rows beyond the regressors, 1 at least.
    """
    p = len(REGRESSORS)
    upper = np.triu_indices(p)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat = lambda name, k: batch.column(name).flatten().to_numpy().reshape(len(batch), k)
            moments = np.zeros((len(batch), p, p))
            moments[:, upper[0], upper[1]] = flat("moments", len(upper[0]))
            full = moments + np.triu(moments, 1).transpose(0, 2, 1)
            y = flat("targets", p)
            beta = np.linalg.solve(full + ridge * np.eye(p), y[:, :, None])[:, :, 0]
            fitted = np.einsum("si,sij,sj->s", beta, full, beta) - 2 * np.einsum("si,si->s", beta, y)
            n = batch.column("n").to_numpy()
            left = np.maximum(0.0, batch.column("squares").to_numpy() + fitted) / np.maximum(1, n - p)
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("w"), batch.column("n"), *[pa.array(b) for b in beta.T], pa.array(left)], names=["series", "w", "n", *FEATURES])

    sums = normal_equations(windows).where(c("n") >= least - 3)
    kind = dict(windows.dtypes)
    shape = f"series {kind['series']}, w {kind['w']}, n long, {', '.join(f'{x} double' for x in FEATURES)}"
    return sums.mapInArrow(solve, shape)


def cluster_segments(rows: DataFrame, features: tuple[str, ...] = FEATURES, key: tuple[str, ...] = ("series", "w"), k: int = 3, iterations: int = 10) -> DataFrame:
    """(key, cluster, distance, membership): Lloyd's rounds on whole vectors, seeded at even ranks of the second feature.

    Seeds have the values at ranks round(i (n - 1) / (k - 1)) of the order of the second feature, exact at any size; of
    rows with that value the one with the least key. A round is one aggregation; its k centres are literals of the next one's expressions. The
    verdict is by the centres before the last update, as the rounds judge first and then move; the membership is a
    softmax of negative squared distances over their mean (1e-6 at least). Of equally near centres the first counts. No
    rows: an empty result. The rows are written once: float sums that are made anew differ in their last digits, and a
    seed is found by its value.
    """
    rows = written(rows, "segments")
    n = rows.count()
    names = list(key)
    if not n:
        return rows.select(*names, F.lit(0).alias("cluster"), F.lit(0.0).alias("distance"), F.lit(0.0).alias("membership"))
    k = max(1, min(k, n))
    by = features[min(1, len(features) - 1)]
    places = [math.floor(i * (n - 1) / max(1, k - 1) + 0.5) for i in range(k)]
    values = exact_ranks(rows, by, places)
    least = F.min(F.struct(*names, *[c(f).alias(f"_{f}") for f in features])).alias("seed")
    seeds = {r[by]: r["seed"] for r in rows.where(c(by).isin(values)).groupBy(by).agg(least).collect()}  # k rows at most
    centres = [[float(seeds[v][f"_{f}"]) for f in features] for v in values]

    def judged() -> DataFrame:
        one = lambda m: sum((F.pow(c(f) - float(v), 2) for f, v in zip(features[1:], m[1:], strict=True)), F.pow(c(features[0]) - float(m[0]), 2))
        d = rows.withColumn("_d", F.array(*[one(m) for m in centres]))
        return d.withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int"))

    for _ in range(iterations - 1):
        found = {r["cluster"]: r for r in judged().groupBy("cluster").agg(*[F.avg(f).alias(f) for f in features]).collect()}  # k rows
        centres = [[float(found[i][f]) for f in features] if i in found else m for i, m in enumerate(centres)]
    nearest = F.array_min("_d")
    heat = F.greatest(F.lit(1e-6), F.aggregate("_d", F.lit(0.0), lambda a, x: a + x) / k)
    part: Column = F.aggregate(F.transform("_d", lambda x: F.exp((nearest - x) / heat)), F.lit(0.0), lambda a, x: a + x)
    return judged().select(*names, "cluster", F.sqrt(nearest).alias("distance"), (1 / part).alias("membership"))
