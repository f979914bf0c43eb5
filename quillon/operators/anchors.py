"""Price anchors from market questions: bias, relevance, trust, recalibration, and their pull on a transition matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, normal_cdf, probit
from quillon.operators import series as S

c = F.col


def yes_bias_u(p: Column) -> Column:
    """U-shaped bias: longshots lose 30 % easing to 5 % at .15, favourites above .5 lose .035, above .85 .025."""
    # fixed values: the bounds and discounts of the bias
    rising = 0.70 + (p - 0.05) / 0.10 * 0.25
    shaped = F.when(p < 0.05, 0.70 * p).when(p <= 0.15, p * rising).when(p <= 0.50, p).when(p <= 0.85, p - 0.035).otherwise(p - 0.025)
    return F.when(p.isNull() | F.isnan(p) | (p <= 0), 0.001).when(p >= 1, 0.999).otherwise(clamp(shaped, 0.001, 0.999))


#: Probit intercept and slope per log day by domain; fixed values.
DOMAINS = {"politics": (0.15, 0.05), "sports": (0.0, 0.0), "crypto": (0.05, 0.03), "macro": (0.02, 0.04)}


def recalibrate(p: Column, domain: Column, days: Column) -> Column:
    """Phi((1 + beta ln(1 + days)) probit(p) + alpha); sure prices and unknown domains stay."""
    pick = lambda i: F.coalesce(*[F.when(domain == d, v[i]) for d, v in DOMAINS.items()], F.lit(0.0))
    moved = normal_cdf((1 + pick(1) * F.log1p(F.greatest(days, F.lit(1.0)))) * probit(p) + pick(0))
    return F.when((p <= 0) | (p >= 1) | ((pick(0) == 0) & (pick(1) == 0)), clamp(p, 0, 1)).otherwise(moved)


def relevance(q: Column, name: Column, days_off: Column) -> Column:
    """Points for a dollar price, a direction, a date word, the asset's name and a near resolution; less for paths and other subjects.

    A word ends at anything but ASCII letters, digits and underscores, also at an accented letter, on every version of Java.
    """
    low = F.lower(q)
    has = lambda words: low.rlike(rf"(?<![0-9A-Za-z_])({words})(?![0-9A-Za-z_])")
    # fixed values: the word patterns and their points
    points = [
        (q.rlike(r"\$[0-9,]+"), 3), (has("above|below|less than|more than|greater than|under|over"), 2), (has("on|at"), 1), (F.contains(low, F.lower(name)), 2),
        (has("reach|hit|dip to|between|up or down|first"), -3), (has("election|sports|game|match|player|team|president|candidate"), -5),
    ]
    near = F.when(days_off.isNull(), 0.0).otherwise(4 - F.least(F.lit(4.0), F.abs(days_off)))
    return reduce(lambda a, x: a + F.when(x[0], float(x[1])).otherwise(0.0), points, near)


def trust(kind: Column, has_volume: Column, young: Column, near: Column) -> Column:
    """Weight by asset kind (other, short_crypto, long_crypto), maturity and resolution; 0 without volume."""
    # fixed values: weights by kind, maturity and nearness
    table = {("other", 0, 0): 1.0, ("other", 0, 1): 1.0, ("other", 1, 0): 0.75, ("other", 1, 1): 0.75, ("long_crypto", 0, 1): 0.9, ("long_crypto", 0, 0): 0.35, ("long_crypto", 1, 1): 0.45, ("long_crypto", 1, 0): 0.2, ("short_crypto", 0, 1): 0.9, ("short_crypto", 0, 0): 0.7, ("short_crypto", 1, 1): 0.7, ("short_crypto", 1, 0): 0.35}
    key = F.concat_ws("/", kind, young.cast("int").cast("string"), near.cast("int").cast("string"))
    found = F.element_at(F.create_map(*[F.lit(x) for k, w in table.items() for x in (f"{k[0]}/{k[1]}/{k[2]}", w)]), key)
    return F.when(has_volume, F.coalesce(found, F.lit(0.0))).otherwise(0.0)


def low_trust_reasons(kind: Column, has_volume: Column, young: Column, near: Column) -> Column:
    needs = (kind == "long_crypto") | ((kind == "short_crypto") & young)
    return F.array_compact(F.array(F.when(~has_volume, "missing_volume"), F.when(young, "young_market"), F.when(needs & ~near, "resolution_mismatch")))


def off_horizon_discount(weight: Column, offset: Column) -> Column:
    """Beyond two days off the horizon the trust loses 3 % a day, at most half."""
    return weight * F.greatest(F.lit(0.5), 1 - 0.03 * F.greatest(offset - 2, F.lit(0.0)))


def extract_levels(markets: DataFrame) -> DataFrame:
    """(asset, price, p): mean probability of every dollar level named in terminal upper-tail questions; barrier questions are left out."""
    low = F.lower("question")
    kept = markets.where(low.rlike(r"\b(above|over|exceed|more than|greater than|at least)\b") & ~low.rlike(r"\b(reach|hit|touch|dip|first|ever)\b"))
    found = kept.select("asset", "probability", F.explode(F.regexp_extract_all("question", F.lit(r"\$\s*[0-9][0-9,]*(?:\.[0-9]+)?\s*[KkMm]?"), F.lit(0))).alias("m"))
    number = F.regexp_replace("m", r"[^0-9.]", "").cast("double")
    scale = F.when(F.lower("m").endswith("k"), 1e3).when(F.lower("m").endswith("m"), 1e6).otherwise(1.0)
    return found.withColumn("price", number * scale).where("price > 0").groupBy("asset", "price").agg(F.avg("probability").alias("p"))


def nudge_row(matrix: DataFrame, current: DataFrame, target: DataFrame, horizon: int, quality: float) -> DataFrame:
    """The current state's row moves by half the quality (percent) towards what a target terminal distribution lacks."""
    strength = min(0.5 * quality / 100, 0.5)
    now = S.n_step_distribution(matrix, current, horizon)
    long = lambda df, name: df.select("series", F.explode(F.array(*[F.struct(F.lit(s).alias("state_to"), c(s).alias(name)) for s in S.STATES])).alias("x")).select("series", "x.*")
    rows = matrix.join(current.withColumnRenamed("state", "here"), "series", "left").join(long(now, "have").hint("merge"), ["series", "state_to"], "left").join(long(target, "want").hint("merge"), ["series", "state_to"], "left")
    own = c("state_from") == c("here")
    moved = F.greatest(F.lit(0.0), c("p") + F.when(own, strength * (c("want") - c("have"))).otherwise(0.0))
    rows = rows.withColumn("m", F.coalesce(moved, c("p")))
    return rows.select("series", "state_from", "state_to", (c("m") / F.sum("m").over(Window.partitionBy("series", "state_from"))).alias("p"))


def freeze_selection(markets: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidate markets whose id is in the bundle's selected ids, nested by bundle in id order."""
    ids = selected.select("bundle_id", F.explode("ids").alias("market_id")).distinct()
    met = ids.join(markets.hint("merge"), "market_id")
    return met.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("market_id", "probability"))).alias("markets"), F.count(F.lit(1)).alias("n"))


def mixture_crps(steps: DataFrame, ladder: DataFrame, *keys: str, default_sigma: float = 1.0) -> DataFrame:
    """CRPS of a (price, survival) ladder per step: trapezoids of (CDF - 1{x >= y})^2 between neighbouring nodes, y among them.

    steps (keys..., y), ladder (keys..., price, survival). All nodes of a step are one window partition: a ladder's length.
    """
    points = ladder.select(*keys, "price", (1 - c("survival")).alias("cdf"))
    nodes = points.unionByName(steps.select(*keys, c("y").alias("price"), F.lit(None).cast("double").alias("cdf"))).groupBy(*keys, "price").agg(F.max("cdf").alias("cdf"))
    up, down = Window.partitionBy(*keys).orderBy("price").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy("price").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(c("cdf").isNotNull(), F.struct("price", "cdf"))
    rows = nodes.withColumns({"a": F.last(known, ignorenulls=True).over(up), "b": F.first(known, ignorenulls=True).over(down)})
    between = c("a.cdf") + (c("b.cdf") - c("a.cdf")) * (c("price") - c("a.price")) / (c("b.price") - c("a.price"))
    # outside the ladder the end probabilities hold
    full = F.coalesce("cdf", F.when(c("a").isNull(), c("b.cdf")).when(c("b").isNull(), c("a.cdf")).otherwise(between))
    rows = rows.select(*keys, "price", full.alias("f")).join(steps.select(*keys, "y").hint("merge"), list(keys))
    gap = F.pow(c("f") - (c("price") >= c("y")).cast("int"), 2)
    w = Window.partitionBy(*keys).orderBy("price")
    rows = rows.withColumns({"g": gap, "g1": F.lead(gap).over(w), "x1": F.lead("price").over(w)})
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(0.5 * (c("g") + c("g1")) * (c("x1") - c("price"))), F.lit(0.0)).alias("crps"))
