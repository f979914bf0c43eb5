"""Iterative operators: sparse regression across assets, two-pass calibration, out-of-sample tests."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import logit, sigmoid
from quillon.operators import markets as M
from quillon.operators import series as S

c = F.col


def cross_asset_bias(returns: DataFrame, target: str, peers: list[str], horizon: int = 5, penalty: float = 0.01) -> DataFrame:
    """Lasso of the target's next-`horizon` sum on its peers' returns; the prediction of the latest complete date over the horizon.

    Rows are summed by date first; the ordered window then sees one row a date, so its one task is bounded by the calendar.
    """
    wide = returns.groupBy("d").agg(*[F.max(F.when(c("series") == s, c("r"))).alias(f"x{i}") for i, s in enumerate([target, *peers])])
    ahead = Window.orderBy("d").rowsBetween(1, horizon)
    rows = wide.na.drop().withColumns({"y": F.sum("x0").over(ahead), "k": F.count("x0").over(ahead)})
    names = [f"x{i}" for i in range(1, len(peers) + 1)]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = LinearRegression(labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(data.where(c("k") == horizon).select("features", "y"))
    latest = data.agg(F.max_by("features", "d").alias("features"), F.max("d").alias("d"))
    return model.transform(latest).select(F.lit(target).alias("series"), "d", (c("prediction") / horizon).alias("bias"))


def apply_platt(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Calibrated probabilities; regimes without a fit keep theirs."""
    met = rows.join(F.broadcast(fit), "regime", "left")  # one row for each regime
    return met.withColumn("p", F.coalesce(sigmoid(c("a") * logit(c("p")) + c("b")), c("p"))).drop("a", "b")


def two_pass_platt(rows: DataFrame, **kw) -> DataFrame:
    """(regime, a, b, a2, b2): a second fit on the first one's output, kept where both exist."""
    first = M.regime_platt(rows, **kw)
    second = M.regime_platt(apply_platt(rows, first), **kw)
    return first.join(second.select("regime", c("a").alias("a2"), c("b").alias("b2")).hint("merge"), "regime")


def excess_oos_r2(returns: DataFrame, tail: int = 20) -> DataFrame:
    """Out-of-sample R2 of the regime forecast over the last `tail` rows, less that of the historical mean.

    The regime forecast of a row is the transition-weighted mean return of the states, trained on all earlier rows.
    """
    w = Window.partitionBy("series")
    rows = returns.withColumns({"back": F.row_number().over(w.orderBy(F.desc("d"))), "n": F.count(F.lit(1)).over(w)}).where(c("n") > tail + 5)
    train = rows.where(c("back") > tail).select("series", "d", "r")
    states = S.regime_series(train)
    m, stats = S.transition_matrix(states), S.regime_stats(states)
    expected = m.join(stats.withColumnRenamed("state", "state_to").hint("merge"), ["series", "state_to"]).groupBy("series", "state_from").agg(F.sum(c("p") * c("mean")).alias("predicted"))
    t = S.adaptive_threshold(train)
    time = w.orderBy("d")
    every = rows.select("series", "d", "r", "back").withColumn("before", F.lag("r").over(time)).join(t.hint("merge"), "series")
    state = F.when(c("before") > c("threshold"), "bull").when(c("before") < -c("threshold"), "bear").otherwise("sideways")
    met = every.where(c("back") <= tail).withColumn("state_from", state).join(expected.hint("merge"), ["series", "state_from"])
    base = train.groupBy("series").agg(F.avg("r").alias("mean_r"))
    met = met.join(base.hint("merge"), "series")
    model = S.oos_r2(met.select("series", c("r").alias("actual"), "predicted"), "series").withColumnRenamed("r2", "model_r2")
    naive = S.oos_r2(met.select("series", c("r").alias("actual"), c("mean_r").alias("predicted")), "series").withColumnRenamed("r2", "naive_r2")
    return model.join(naive.hint("merge"), "series").select("series", "model_r2", "naive_r2", (c("model_r2") - c("naive_r2")).alias("excess"))
