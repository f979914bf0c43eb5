"""Survival curves P(price > level): what they expect, and a drift that meets a calibrated chance of a rise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, half_up, student_cdf, student_quantile
from quillon.operators.joins import dimension_join
from quillon.operators.markets import survival_at

c = F.col

#: Moves that bound the scenarios, and their names from below.
MOVES, SCENARIOS = (-0.05, -0.03, 0.03, 0.05), ("crash", "down", "flat", "up", "surge")


def curve_outlook(ladder: DataFrame, spots: DataFrame) -> DataFrame:
    """Scenario probabilities, chance of a rise and expected price of every spot (asset, spot) on its (asset, price, probability) curve.

    Probabilities are read off the curve by linear interpolation (none of its levels: one half; below its first level 1,
    above its last 0), never below zero. The expected price is the first level plus the trapezoids under the curve,
    the spot itself with fewer than two levels. A ladder's levels are distinct; spots are one per asset.
    """
    at = [c("spot") * (1 + m) for m in MOVES] + [c("spot")]
    points = spots.select("asset", F.explode(F.array_distinct(F.array(*at))).alias("price"))
    read = survival_at(ladder, points)
    w = Window.partitionBy("asset").orderBy("price")
    cells = ladder.withColumns({"_x": F.lead("price").over(w), "_p": F.lead("probability").over(w)})
    area = cells.groupBy("asset").agg(F.min("price").alias("_first"), F.sum((c("probability") + c("_p")) / 2 * (c("_x") - c("price"))).alias("_area"))
    met = spots.select("asset", "spot").join(read.hint("merge"), "asset").groupBy("asset", "spot").agg(*[F.max(F.when(c("price") == x, c("survival"))).alias(f"_{i}") for i, x in enumerate(at)])
    met = met.join(area.hint("merge"), "asset", "left")
    expected = F.coalesce(c("_first") + c("_area"), c("spot"))
    above = [F.lit(1.0), *[c(f"_{i}") for i in range(4)], F.lit(0.0)]
    masses = [F.greatest(F.lit(0.0), above[i] - above[i + 1]).alias(name) for i, name in enumerate(SCENARIOS)]
    return met.select("asset", *masses, half_up(c("_4"), 3).alias("p_up"), half_up(expected, 2).alias("expected_price"), half_up(expected / c("spot") - 1, 4).alias("expected_return"))


def student_survival(price: Column, spot: Column, mu: Column, sigma: Column, nu: int = 5) -> Column:
    """P(S > price) of log returns with mean mu, deviation sigma and nu degrees of freedom; a step at the spot without deviation."""
    z = clamp((F.log(price / spot) - mu) / (sigma * ((nu - 2) / nu) ** 0.5), -50, 50)
    return F.when(sigma <= 0, (price < spot).cast("double")).when(price <= 0, 1.0).otherwise(1 - student_cdf(z, nu))


def shift_drift(curve: DataFrame, params: DataFrame, nu: int = 5) -> DataFrame:
    """Calibrated curve: its drift moves until the chance of a rise is kappa * centre + (1 - kappa) * the raw one.

    curve: asset, price, probability, lower, upper, pure (a model point, not blended with a quote); params, one row an
    asset: asset, spot, mu, sigma (positive), kappa, centre. Pure points are computed anew; others move by the model's
    difference, within 0 and 1; bounds (null: the new probability) move along and hold the point. Probabilities then
    fall with the price: a point is at least the highest after it. Unlike a pull of every probability, levels far from
    the spot keep theirs. Rows of assets without params, or with null ones, stay as they are.
    """
    raw = student_survival(c("spot"), c("spot"), c("mu"), c("sigma"), nu)
    target = clamp(c("kappa") * c("centre") + (1 - c("kappa")) * raw, 0.01, 0.99)
    moved = params.where("sigma > 0").dropna(subset=["spot", "mu", "kappa", "centre"]).select("asset", "spot", "mu", "sigma", (-student_quantile(1 - target, nu) * c("sigma") * ((nu - 2) / nu) ** 0.5).alias("_mu"))
    rows = dimension_join(curve, moved, "asset")
    old, new = (student_survival(c("price"), c("spot"), m, c("sigma"), nu) for m in (c("mu"), c("_mu")))
    # least and greatest pass over nulls, so assets without params are told apart first
    own = F.when(F.coalesce("pure", F.lit(True)), new).otherwise(clamp(c("probability") + new - old, 0, 1))
    rows = rows.withColumn("_new", F.when(c("_mu").isNotNull(), own))
    shift = lambda bound: clamp(F.coalesce(bound, c("_new")) + c("_new") - c("probability"), 0, 1)
    rows = rows.withColumns({"_low": F.least(shift(c("lower")), c("_new")), "_high": F.greatest(shift(c("upper")), c("_new"))})
    ahead = Window.partitionBy("asset").orderBy(F.desc("price")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_top", F.max("_new").over(ahead))
    now = {"probability": c("_top"), "lower": c("_low"), "upper": F.greatest(c("_high"), c("_top"))}
    return reduce(lambda df, k: df.withColumn(k, F.when(c("_new").isNotNull(), now[k]).otherwise(c(k))), now, rows).select(*curve.columns)
