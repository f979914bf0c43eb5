"""Prediction-market operators: all formulas are column expressions over one row per market."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, logit, normal_cdf, probit, sigmoid
from quillon.operators.joins import dimension_join, latest_n

c = F.col


def steps_of(x: Column, steps: list[tuple[float, float]], other: float) -> Column:
    """The value of the first bound that x does not pass."""
    return reduce(lambda a, s: a.when(x <= s[0], s[1]), steps[1:], F.when(x <= steps[0][0], steps[0][1])).otherwise(other)


def yes_bias(p: Column) -> Column:
    """Favourites above even odds are overpriced by .035."""
    return clamp(F.when(p > 0.5, p - 0.035).otherwise(p), 0.01, 0.99)


def depth_decay(days: Column) -> Column:
    """(days / 30) ^ .55, at least .5; 1 without days or from 30 on."""
    return F.when(days.isNull() | (days >= 30), 1.0).otherwise(F.greatest(F.lit(0.5), F.pow(days / 30, F.lit(0.55))))


def expiry_boost(days: Column) -> Column:
    return F.when(days.isNull(), 1.0).otherwise(steps_of(days, [(1, 1.5), (7, 1.2), (30, 1.0), (90, 0.85)], 0.7))


def tier_factor(tier: Column) -> Column:
    return F.when(tier == "macro", 0.90).when(tier == "electoral", 0.55).otherwise(0.75)


def spread_benchmark(tier: Column) -> Column:
    return F.when(tier == "macro", 0.07).when(tier == "electoral", 0.10).otherwise(0.14)


#: What flags of a market do to its weight; fixed values.
FLAGS = {"spike": 0.5, "transitory": 0.7, "stable": 1.1, "fast": 0.8, "jump": 0.7, "ambiguous": 0.6}


def flag_factor(flags: dict[str, Column]) -> Column:
    """The product of the factors of all set flags; a spike hides a transitory move, and both hide a stable path."""
    on = {k: F.coalesce(flags[k], F.lit(False)) if k in flags else F.lit(False) for k in FLAGS}
    on["stable"] = on["stable"] & ~on["spike"] & ~on["transitory"]
    on["transitory"] = on["transitory"] & ~on["spike"]
    return reduce(lambda a, k: a * F.when(on[k], FLAGS[k]).otherwise(1.0), FLAGS, F.lit(1.0))


#: The most that odds near 0 or 1 take off a market's quality, where they begin, and the loss from which a warning is given; fixed values.
LONGSHOT_LOSS, LONGSHOT, LONGSHOT_WARNED = 0.45, 0.07, 0.08


def microstructure() -> Column:
    """How well a market of extreme odds is made, 0..1: by spread (its own score is the ceiling), age and liquidity; without spread by the last two."""
    age = F.least(F.lit(1.0), F.coalesce("age_days", F.lit(21.0)) / 21)
    raw = F.least(F.lit(1.0), F.log10(c("volume") + 1) / 6)
    spread = F.greatest(F.lit(0.0), 1 - c("spread") / spread_benchmark(c("tier")))
    return F.when(c("spread").isNull(), 0.60 * age + 0.40 * raw).otherwise(F.least(0.60 * spread + 0.25 * age + 0.15 * raw, spread))


def longshot() -> Column:
    return (c("probability") < LONGSHOT) | (c("probability") > 1 - LONGSHOT)


def market_quality(horizon: float | None = None, **flags: Column) -> Column:
    """Weight in 0..1 of a market from age, liquidity, tier, expiry, horizon gap, spread, longshot odds and flags.

    Columns: age_days, volume, tier, days_to_expiry, spread, probability. Flags (spike, transitory, stable, fast, jump,
    ambiguous) are boolean columns; those not given, and nulls, count as not set.
    """
    if unknown := set(flags) - set(FLAGS):
        raise ValueError(f"no such flags: {sorted(unknown)}")
    age = F.least(F.lit(1.0), F.coalesce("age_days", F.lit(21.0)) / 21)
    raw = F.least(F.lit(1.0), F.log10(c("volume") + 1) / 6)
    liquidity = raw * depth_decay(c("days_to_expiry"))
    thin = 1 - F.least(F.lit(1.0), age * F.sqrt(raw))
    spread = F.when(c("spread").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - c("spread") / spread_benchmark(c("tier")) * (1 + 0.40 * thin)))
    s, a, q = spread, age, liquidity
    micro = F.when(c("spread").isNull(), 0.60 * a + 0.40 * q).otherwise(F.least(0.60 * s + 0.25 * a + 0.15 * q, s))
    longshot = F.when((c("probability") < 0.07) | (c("probability") > 0.93), 1 - 0.45 * (1 - micro)).otherwise(1.0)
    gap = F.lit(1.0) if horizon is None else F.greatest(F.lit(0.5), 1 - 0.25 * F.abs(c("days_to_expiry") - horizon))
    return clamp(age * liquidity * tier_factor(c("tier")) * expiry_boost(c("days_to_expiry")) * gap * spread * longshot * flag_factor(flags), 0, 1)


def conditional_return() -> Column:
    p = yes_bias(c("probability"))
    return p * c("delta_yes") + (1 - p) * c("delta_no")


#: Warnings by flag, with what the flag takes off; fixed values.
WARNED = {"spike": "has a price spike - quality discounted 50%", "transitory": "shows a transitory historical move - quality discounted 30%", "ambiguous": "has ambiguous resolution semantics - quality discounted 40%"}


def market_warnings(markets: DataFrame, flags: dict[str, Column] | None = None, *keys: str) -> DataFrame:
    """(keys, market_id, warning, text): a row for everything about a market (market_id, question) that lowers trust in its signal.

    Warnings: yes_bias (the correction moves the probability by more than 0.1), spike, transitory, ambiguous (flags that
    are set), longshot and favourite (extreme odds whose poor microstructure takes more than 8 % off). Rows, not lists,
    so an asset may have any number of markets.
    """
    on = flags or {}
    p, loss = c("probability"), LONGSHOT_LOSS * (1 - microstructure())
    thin = longshot() & (loss > LONGSHOT_WARNED)
    shown = F.format_string("%.3f", p)
    found = {"yes_bias": (F.abs(p - yes_bias(p)) > 0.1, F.concat(F.lit("has high YES bias (raw p="), shown, F.lit(")")))}
    found |= {k: (F.coalesce(on[k], F.lit(False)), F.lit(text)) for k, text in WARNED.items() if k in on}
    poor = lambda name: F.concat(F.lit(f"is a {name} (p="), shown, F.lit(") with poor microstructure - quality further discounted "), F.floor(loss * 100 + 0.5).cast("string"), F.lit("%"))
    found |= {"longshot": (thin & (p < LONGSHOT), poor("longshot")), "favourite": (thin & (p > 1 - LONGSHOT), poor("near-certain favourite"))}
    each = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(k).alias("warning"), text.alias("text"))) for k, (x, text) in found.items()]))
    rows = markets.select(*keys, "market_id", "question", F.explode(each).alias("w"))
    return rows.select(*keys, "market_id", "w.warning", F.concat(F.lit('Market "'), "question", F.lit('" '), "w.text").alias("text"))


def market_signal(markets: DataFrame, *keys: str, flags: dict[str, Column] | None = None) -> DataFrame:
    """Quality-weighted conditional return of every asset; null without weight. Flags lower (or raise) each market's quality."""
    rows = markets.withColumns({"q": market_quality(**(flags or {})), "r": conditional_return()})
    w = F.sum("q")
    return rows.groupBy(*keys).agg(
        F.when(w > 0, F.sum(c("q") * c("r")) / w).alias("signal"),
        F.avg("q").alias("quality"),
        F.count(F.lit(1)).alias("markets"),
        F.when(w > 0, F.sum(F.pow("q", 2) * c("probability") * (1 - c("probability")) * F.pow(c("delta_yes") - c("delta_no"), 2)) / F.pow(w, 2)).alias("variance"),
    )


#: Base weights of the signals of a blend.
BLEND = {"market": 0.40, "sentiment": 0.20, "fundamental": 0.25, "options": 0.15, "markov": 0.20}


def signal_scales(horizon: float) -> dict[str, float]:
    """The size at which each signal counts as strong; fixed values."""
    return {"market": 0.05, "sentiment": 0.04, "fundamental": max(0.01, 0.20 * horizon / 365), "options": 0.03, "markov": 0.05}


def adaptive_multipliers(own: dict[str, Column], horizon: float) -> dict[str, Column]:
    """By signal: 1 + .35 (strength - .5) + .25 (agreement - .5), between .75 and 1.25.

    Strength is its size against its scale; agreement is 1 where all other signals, by weight, point its way, 0 where
    all point the other way, a half where it, or all of them, point nowhere. own: weights, 0 where a signal is missing.
    """
    sign = {s: F.coalesce(F.signum(s), F.lit(0.0)) for s in own}
    scales = signal_scales(horizon)
    out = {}
    for s in own:
        mass = reduce(lambda a, b: a + b, [w for k, w in own.items() if k != s], F.lit(0.0))
        way = reduce(lambda a, b: a + b, [w * sign[k] for k, w in own.items() if k != s], F.lit(0.0))
        agreement = F.when((sign[s] == 0) | (mass == 0), 0.5).otherwise(clamp(0.5 + 0.5 * sign[s] * clamp(way / mass, -1, 1), 0, 1))
        strength = clamp(F.abs(F.coalesce(s, F.lit(0.0))) / scales[s], 0, 1)
        out[s] = clamp(1 + 0.35 * (strength - 0.5) + 0.25 * (agreement - 0.5), 0.75, 1.25)
    return out


def blend_signals(signals: DataFrame, *keys: str, weights: dict[str, float] | None = None, adaptive: float | None = None) -> DataFrame:
    """Mean of the present signals by base weight (the market's scaled by quality), normalised; equal weights if all are zero.

    With `adaptive` (the horizon in days) weights rise for strong signals that agree with the others.
    """
    weights = weights or BLEND
    own = {s: F.when(c(s).isNotNull(), (F.coalesce("quality", F.lit(0.0)) if s == "market" else F.lit(1.0)) * w).otherwise(0.0) for s, w in weights.items()}
    if adaptive is not None:
        more = adaptive_multipliers(own, adaptive)
        own = {s: w * more[s] for s, w in own.items()}
    total = reduce(lambda a, b: a + b, own.values())
    count = reduce(lambda a, b: a + b, [c(s).isNotNull().cast("double") for s in weights])
    part = lambda s: F.coalesce(s, F.lit(0.0))
    weighted = reduce(lambda a, b: a + b, [own[s] * part(c(s)) for s in weights]) / total
    equal = reduce(lambda a, b: a + b, [part(c(s)) for s in weights]) / count
    return signals.withColumn("forecast", F.when(total > 0, weighted).when(count > 0, equal)).withColumn("market_weight", F.when(total > 0, own["market"] / total).otherwise(0.0))


def forecast_sigma(market_weight: Column, variance: Column, sentiment: Column, horizon: float) -> Column:
    market = F.coalesce(F.pow(market_weight, 2) * variance, F.lit(0.05**2))
    floor = 0.10 * (max(1.0, horizon) / 252) ** 0.5
    return F.greatest(1.2 * F.sqrt(market + F.pow(F.coalesce(sentiment, F.lit(0.0)) * 0.01, 2)), F.lit(floor))


def grade(score: Column) -> Column:
    return F.when(score >= 75, "A").when(score >= 50, "B").when(score >= 25, "C").otherwise("D")


def asset_forecast(markets: DataFrame, other: DataFrame | None = None, horizon: float = 14) -> DataFrame:
    """Signal, blend, interval and grade of every asset: one aggregation and projections."""
    rows = market_signal(markets, "asset").withColumnRenamed("signal", "market")
    rows = rows.join(other.hint("merge"), "asset", "left") if other is not None else rows
    for s in BLEND:
        if s not in rows.columns:
            rows = rows.withColumn(s, F.lit(None).cast("double"))
    rows = blend_signals(rows, "asset").withColumn("sigma", forecast_sigma(c("market_weight"), c("variance"), c("sentiment"), horizon))
    score = clamp(100 * c("quality"), 0, 100)
    return rows.select("asset", "markets", "forecast", "sigma", (c("forecast") - 1.96 * c("sigma")).alias("low"), (c("forecast") + 1.96 * c("sigma")).alias("high"), score.alias("score"), grade(score).alias("grade"))



def _ladder() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("price")



def ladder_is_clean(ladder: DataFrame, tol: float = 0.05) -> DataFrame:
    """Two or more levels, distinct prices, and no upward step of the probability above tol."""
    rows = ladder.withColumn("up", c("probability") - F.lag("probability").over(_ladder()))
    return rows.groupBy("asset").agg(F.count(F.lit(1)).alias("levels"), ((F.count(F.lit(1)) >= 2) & (F.countDistinct("price") == F.count(F.lit(1))) & (F.coalesce(F.max("up"), F.lit(0.0)) <= tol)).alias("clean"))


def ladder_forecast(ladder: DataFrame) -> DataFrame:
    """Mean and deviation from bucket masses at midpoints; the open ends sit half a mean stride outside."""
    rows = ladder.withColumns({"next_p": F.lead("probability").over(_ladder()), "next_price": F.lead("price").over(_ladder()), "i": F.row_number().over(_ladder()), "n": F.count(F.lit(1)).over(Window.partitionBy("asset"))})
    span = Window.partitionBy("asset")
    stride = (F.max("price").over(span) - F.min("price").over(span)) / F.greatest(c("n") - 1, F.lit(1))
    rows = rows.withColumn("stride", stride)
    inner = F.struct((c("probability") - F.coalesce("next_p", F.lit(0.0))).alias("m"), F.coalesce((c("price") + c("next_price")) / 2, c("price") + c("stride") / 2).alias("x"))
    first = F.struct((1 - c("probability")).alias("m"), (c("price") - c("stride") / 2).alias("x"))
    parts = rows.withColumn("b", F.explode(F.when(c("i") == 1, F.array(first, inner)).otherwise(F.array(inner)))).withColumns({"m": F.greatest(c("b.m"), F.lit(0.0)), "x": c("b.x")})
    sums = parts.groupBy("asset").agg(F.sum("m").alias("m"), F.sum(c("m") * c("x")).alias("mx"), F.sum(c("m") * c("x") * c("x")).alias("mxx"))
    mean = c("mx") / c("m")
    return sums.select("asset", mean.alias("mean"), F.sqrt(F.greatest(c("mxx") / c("m") - mean * mean, F.lit(0.0))).alias("sd"))


def survival_at(ladder: DataFrame, points: DataFrame) -> DataFrame:
    """P(S > price) of (asset, price) points by linear interpolation: 1 at or below the first level, 0 at or above the last.

    Points and levels are united and carried both ways in windows, so no range join is needed.
    """
    both = ladder.select("asset", "price", "probability").withColumn("q", F.lit(None).cast("double")).unionByName(points.select("asset", "price", F.lit(None).cast("double").alias("probability"), c("price").alias("q")))
    back, ahead = Window.partitionBy("asset").orderBy("price").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("asset").orderBy("price").rangeBetween(0, Window.unboundedFollowing)
    level = F.when(c("probability").isNotNull(), F.struct("price", "probability"))
    rows = both.withColumns({"a": F.max(level).over(back), "b": F.min(level).over(ahead)}).where("q is not null")
    x = F.when(c("a").isNull() & c("b").isNull(), 0.5).when(c("a").isNull(), 1.0).when(c("b").isNull(), 0.0)
    return rows.select("asset", "price", c("a").alias("_a"), c("b").alias("_b"), x.alias("_x"), F.first("price").over(Window.partitionBy("asset").orderBy("price")).alias("_f")).select(
        "asset", "price", F.coalesce("_x", F.when(c("_a.price") == c("_b.price"), c("_a.probability")).otherwise(c("_a.probability") + (c("_b.probability") - c("_a.probability")) * (c("price") - c("_a.price")) / (c("_b.price") - c("_a.price")))).alias("survival"))


def price_at_probability(ladder: DataFrame, levels: tuple[float, ...] = (0.5, 0.3, 0.9, 0.2, 0.8)) -> DataFrame:
    """Price at which the ladder crosses each probability, interpolated inside the bracketing step."""
    rows = ladder.withColumns({"p1": F.lead("probability").over(_ladder()), "x1": F.lead("price").over(_ladder())}).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    met = rows.where((c("probability") >= c("level")) & (c("p1") < c("level")))
    at = c("price") + (c("x1") - c("price")) * (c("probability") - c("level")) / (c("probability") - c("p1"))
    return met.groupBy("asset", "level").agg(F.min(at).alias("price"))


def rescale_levels(ladder: DataFrame, price: float) -> DataFrame:
    """If the median level of an asset is above three times the price, scale its levels by price / median."""
    median = F.percentile("price", 0.5).over(Window.partitionBy("asset"))
    return ladder.select("asset", c("price").alias("raw"), F.when(median > 3 * price, F.round(c("price") * price / median, 2)).otherwise(c("price")).alias("price"))


def lognormal_fit(ladder: DataFrame) -> DataFrame:
    """mu and sigma of each asset from a regression of probit(1 - P) on ln price."""
    rows = ladder.where("probability > 0 and probability < 1 and price > 0").select("asset", F.log("price").alias("x"), probit(1 - c("probability")).alias("y"))
    fit = rows.groupBy("asset").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n")).where("n >= 2 and b > 0")
    return fit.select("asset", (-c("a") / c("b")).alias("mu"), (1 / c("b")).alias("sigma"))


def regime_mass(fit: DataFrame, price: Column, band: float = 0.03, floor: float = 0.01) -> DataFrame:
    """Mass above, below and within the band around the price, at least `floor` each, normalised."""
    cdf = lambda k: normal_cdf((F.log(k) - c("mu")) / c("sigma"))
    up, down = F.greatest(1 - cdf(price * (1 + band)), F.lit(floor)), F.greatest(cdf(price * (1 - band)), F.lit(floor))
    mid = F.greatest(cdf(price * (1 + band)) - cdf(price * (1 - band)), F.lit(floor))
    total = up + down + mid
    return fit.select("asset", (up / total).alias("bull"), (down / total).alias("bear"), (mid / total).alias("sideways"))


def spike_flags(snapshots: DataFrame, jump: float = 0.08, volume: float = 100_000) -> DataFrame:
    """Whether a snapshot moved by more than `jump` from the one before it on thin volume."""
    move = c("probability") - F.lag("probability").over(Window.partitionBy("market_id").orderBy("captured_at", "event_id"))
    return snapshots.select("event_id", "market_id", F.coalesce((F.abs(move) > jump) & (c("volume24h") < volume), F.lit(False)).alias("spike"))


def _ago(hours: int) -> WindowSpec:
    return Window.partitionBy("market_id").orderBy(F.unix_micros("captured_at")).rangeBetween(-hours * 3_600_000_000, 0)


def stable_path(snapshots: DataFrame, hours: int = 12, span: float = 0.06) -> DataFrame:
    """At least two snapshots in the last hours, the current one included, within `span` of each other."""
    w = _ago(hours)
    return snapshots.select("event_id", "market_id", ((F.count(F.lit(1)).over(w) >= 2) & (F.max("probability").over(w) - F.min("probability").over(w) <= span)).alias("stable"))


def velocity(snapshots: DataFrame, hours: int = 6, project: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """Slope per hour of the projected probability over the hours before each market's newest snapshot."""
    newest = F.max("captured_at").over(Window.partitionBy("market_id"))
    rows = snapshots.withColumn("newest", newest).where(F.unix_micros("newest") - F.unix_micros("captured_at") <= hours * 3_600_000_000)
    x = (F.unix_micros("captured_at") - F.unix_micros("newest")) / 3.6e9
    return rows.select("market_id", project(c("probability")).alias("y"), x.alias("x")).groupBy("market_id").agg(F.regr_slope("y", "x").alias("slope"), F.count(F.lit(1)).alias("n"))


def max_jump(snapshots: DataFrame, hours: int = 24, project: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """Largest move between neighbours whose later one lies in the last hours; the earlier one may lie before."""
    w = Window.partitionBy("market_id")
    y = project(c("probability"))
    rows = snapshots.withColumn("y", y).withColumns({"move": F.abs(c("y") - F.lag("y").over(w.orderBy("captured_at", "event_id"))), "newest": F.max("captured_at").over(w)})
    return rows.where(F.unix_micros("newest") - F.unix_micros("captured_at") <= hours * 3_600_000_000).groupBy("market_id").agg(F.coalesce(F.max("move"), F.lit(0.0)).alias("jump"))


def median_recent_move(snapshots: DataFrame, hours: int = 48) -> DataFrame:
    """Median absolute change between neighbouring snapshots of each market within so many hours of its newest one."""
    w = Window.partitionBy("market_id")
    rows = snapshots.withColumns({"move": F.abs(c("probability") - F.lag("probability").over(w.orderBy("captured_at", "event_id"))), "_newest": F.max("captured_at").over(w)})
    return rows.where(F.unix_micros("_newest") - F.unix_micros("captured_at") <= hours * 3_600_000_000).groupBy("market_id").agg(F.percentile("move", 0.5).alias("move"))


#: Gap between platforms that is flagged, points of quality it costs, and how much it widens sigma.
PLATFORM_GAP, GAP_COST, GAP_SIGMA = 0.10, 8, 1.08


def cross_platform(evidence: DataFrame, key: str) -> DataFrame:
    """What other platforms' consensus does to a forecast: (key, basis, applied, quality_delta, sigma_scale, worst, gap).

    evidence: key, source, kind, gap (of probabilities, null: 0). A consensus further off than .10 costs quality and
    widens sigma, worst named by source (of equal gaps the first by name); a near one is agreement; none, no row's fault, is `none`.
    """
    gap = F.coalesce(c("gap"), F.lit(0.0))
    told = c("kind") == "consensus"
    sums = evidence.groupBy(key).agg(F.count_if(told).alias("_n"), F.min(F.when(told, F.struct((-gap).alias("g"), "source"))).alias("_w"))
    off = F.coalesce(-c("_w.g") > PLATFORM_GAP, F.lit(False))
    return sums.select(key, F.when(off, "divergence").when(c("_n") > 0, "agreement").otherwise("none").alias("basis"), off.alias("applied"), F.when(off, -GAP_COST).otherwise(0).alias("quality_delta"),
        F.when(off, GAP_SIGMA).otherwise(1.0).alias("sigma_scale"), F.when(off, c("_w.source")).alias("worst"), F.when(off, -c("_w.g")).alias("gap"))


def unusual_volume(contracts: DataFrame, side: str, ident: str, factor: float = 3, n: int = 5) -> DataFrame:
    """The n largest volumes of each side that are positive and above `factor` times the side's mean (null volumes count as 0)."""
    volume = F.coalesce(c("volume"), F.lit(0))
    means = contracts.groupBy(side).agg(F.avg(volume).alias("_mean"))
    return latest_n(dimension_join(contracts, means, side).where((volume > 0) & (volume > factor * c("_mean"))), side, n, F.desc("volume"), c(ident)).drop("_mean")


def top_by_open_interest(contracts: DataFrame, side: str, ident: str, n: int = 10) -> DataFrame:
    return latest_n(contracts, side, n, F.desc_nulls_last("open_interest"), c(ident))


def daily_hazard(p: Column, days: Column) -> Column:
    return F.least(-F.log(1 - clamp(p, 0, 0.999999)) / days, F.lit(0.95))


def q_to_p(q: Column, mu: float, rf: float, sd: float, years: Column) -> Column:
    """Real-world from risk-neutral probability by a bounded shift of the probit."""
    return normal_cdf(probit(q) + max(-1.5, min(1.5, (mu - rf) / sd)) * F.sqrt(years))


def longshot_shrink(p: Column) -> Column:
    return F.when((p <= 0.05) | (p >= 0.95), (p + 0.5) / 2).otherwise(p)


def combine_log_odds(signals: DataFrame, key: str) -> DataFrame:
    """Weighted mean logit of the signals (p, w) of a question, one deviation either side; a lone signal gets .3."""
    rows = signals.withColumn("l", logit(clamp(c("p"), 0.001, 0.999)))
    sums = rows.groupBy(key).agg(F.sum("w").alias("sw"), F.sum(c("w") * c("l")).alias("swl"), F.sum(c("w") * c("l") * c("l")).alias("swll"), F.count(F.lit(1)).alias("n"))
    mean = c("swl") / c("sw")
    sd = F.when(c("n") > 1, F.sqrt(F.greatest(c("swll") / c("sw") - mean * mean, F.lit(0.0)))).otherwise(0.3)
    return sums.select(key, sigmoid(mean).alias("p"), sigmoid(mean - sd).alias("low"), sigmoid(mean + sd).alias("high"), (sd > 0.3).alias("divergent"), "n")


def question_semantics(q: Column) -> Column:
    """ambiguous / range / path / barrier / terminal / unknown, the first rule that holds."""
    low = F.lower(q)
    out = F.when(F.coalesce(F.trim(low) == "", F.lit(True)), "ambiguous")
    for pattern, name in (("between .* and|range", "range"), ("stay|remain|all (month|year)", "path"), ("reach|touch|hit|at any time", "barrier"), ("above|below|close|end|over|under", "terminal")):
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("unknown")


def extract_price_levels(q: Column) -> Column:
    """Distinct numbers of at least 10 in a text, with a k or m suffix applied, ascending."""
    found = F.regexp_extract_all(F.regexp_replace(q, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?[kKmM]?"), F.lit(0))
    scale = lambda x: F.when(F.lower(x).endswith("k"), 1e3).when(F.lower(x).endswith("m"), 1e6).otherwise(1.0)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, "[kKmM]", "").cast("double") * scale(x)), lambda v: v >= 10)))


def regime_platt(rows: DataFrame, iterations: int = 40, rate: float = 0.5, least: int = 18) -> DataFrame:
    """Logistic calibration (a, b) of the logit of p per regime, by gradient steps from (1, 0).

    One aggregate per step over rows that were first counted by (regime, rounded p, y), a bounded table; regimes with
    few rows or one class are left out. The coefficients of all regimes travel in one small table.
    """
    binned = rows.groupBy("regime", F.round("p", 4).alias("p"), "y").agg(F.count(F.lit(1)).alias("n")).withColumn("x", logit(c("p"))).cache()
    fit = binned.groupBy("regime").agg(F.sum("n").alias("total"), F.sum(c("n") * c("y")).alias("ones")).where(f"total >= {least} and ones > 0 and ones < total").select("regime", F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    spark = rows.sparkSession
    state = fit.collect()  # as many rows as regimes
    for _ in range(iterations):
        now = spark.createDataFrame(state, "regime string, a double, b double") if state else fit
        err = c("n") * (sigmoid(c("a") * c("x") + c("b")) - c("y"))
        grad = binned.join(F.broadcast(now), "regime").groupBy("regime", "a", "b").agg((F.sum(err * c("x")) / F.sum("n")).alias("ga"), (F.sum(err) / F.sum("n")).alias("gb"))
        state = [(r["regime"], r["a"] - rate * r["ga"], r["b"] - rate * r["gb"]) for r in grad.collect()]
    binned.unpersist()
    return spark.createDataFrame(state, "regime string, a double, b double")
