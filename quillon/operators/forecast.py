"""Distribution forecasts, walk-forward evaluation and their small parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, normal_cdf, student_cdf
from quillon.operators import joins as J
from quillon.operators import series as S
from quillon.operators.scratch import written

c = F.col


def start_state_mixture(states: DataFrame, last: int = 10, alpha: float = 0.5) -> DataFrame:
    """Share of every state among the last rows of a series, smoothed by alpha."""
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    tail = states.withColumn("back", back).where(c("back") <= last)
    n = F.count(F.lit(1))
    share = lambda s: (F.count_if(c("state") == s) + alpha) / (n + 3 * alpha)
    return tail.groupBy("series").agg(*[share(s).alias(s) for s in S.STATES])


def horizon_drift_vol(weights: DataFrame, stats: DataFrame, h: int, momentum: float = 0.0) -> DataFrame:
    """mu_n = h (sum w mu + momentum); sigma_n = sqrt(h) sqrt(sum w s^2 + variance of the means)."""
    long = weights.select("series", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), c(s).alias("w")) for s in S.STATES])).alias("x")).select("series", "x.*")
    met = long.join(stats.hint("merge"), ["series", "state"])
    sums = met.groupBy("series").agg(F.sum(c("w") * c("mean")).alias("m"), F.sum(c("w") * c("mean") * c("mean")).alias("mm"), F.sum(c("w") * c("sd") * c("sd")).alias("ss"))
    return sums.select("series", (h * (c("m") + momentum)).alias("mu"), (h**0.5 * F.sqrt(c("ss") + F.greatest(c("mm") - c("m") * c("m"), F.lit(0.0)))).alias("sigma"))


def sentiment_adjust(matrix: DataFrame, sentiment: float, alpha: float = 0.07) -> DataFrame:
    """Scale the cells into bull by 1 + alpha s and into bear by 1 - alpha s, clamp at 0, normalise rows."""
    scale = F.when(c("state_to") == "bull", 1 + alpha * sentiment).when(c("state_to") == "bear", 1 - alpha * sentiment).otherwise(1.0)
    rows = matrix.withColumn("m", F.greatest(F.lit(0.0), c("p") * scale))
    return rows.select("series", "state_from", "state_to", (c("m") / F.sum("m").over(Window.partitionBy("series", "state_from"))).alias("p"))


def blend_matrices(a: DataFrame, b: DataFrame, weight: Column) -> DataFrame:
    met = a.join(b.withColumnRenamed("p", "q").hint("merge"), ["series", "state_from", "state_to"])
    return met.select("series", "state_from", "state_to", (weight * c("p") + (1 - weight) * c("q")).alias("p"))


def garch_scales(returns: DataFrame, horizon: int = 10, low: float = 0.33, calm: float = 1.5, turbulent: float = 2.5) -> DataFrame:
    """sigma_k over the sample deviation, between `low` and a ceiling that depends on the last 20 rows' deviation."""
    back = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("d")))
    sd = returns.withColumn("back", back).groupBy("series").agg(F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(c("back") <= 20, c("r"))).alias("recent"))
    met = S.garch(returns, horizon).join(sd.hint("merge"), "series")
    ceiling = F.when(c("recent") > c("sd"), turbulent).otherwise(calm)
    return met.select("series", "k", F.greatest(F.lit(low), F.least(ceiling, c("sigma") / c("sd"))).alias("scale"))


def survival_grid(params: DataFrame, points: int = 41, nu: int | None = None) -> DataFrame:
    """P(S > K) over a grid of 3 deviations around the price: (series, price, mu, sigma) to (series, level, survival)."""
    step = 6.0 / (points - 1)
    rows = params.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("z", -3 + step * c("i"))
    level = c("price") * F.exp(c("mu") + c("z") * c("sigma"))
    cdf = normal_cdf(c("z")) if nu is None else student_cdf(c("z") * (nu / (nu - 2)) ** 0.5, nu)
    return rows.select("series", "i", level.alias("level"), (1 - cdf).alias("survival"))


def scenario_buckets(params: DataFrame) -> DataFrame:
    """Probabilities of moves below -5 %, -5 to -3 %, within 3 %, 3 to 5 %, above 5 %."""
    cdf = lambda move: normal_cdf((F.log(F.lit(1 + move)) - c("mu")) / c("sigma"))
    a, b, d, e = cdf(-0.05), cdf(-0.03), cdf(0.03), cdf(0.05)
    return params.select("series", a.alias("crash"), (b - a).alias("down"), (d - b).alias("flat"), (e - d).alias("up"), (1 - e).alias("surge"))


def action_signal(params: DataFrame, buy: float = 0.55, sell: float = 0.55) -> DataFrame:
    """BUY, SELL or HOLD from the mass above 2 % and below -2 %, with the expected return."""
    up = 1 - normal_cdf((F.log(F.lit(1.02)) - c("mu")) / c("sigma"))
    down = normal_cdf((F.log(F.lit(0.98)) - c("mu")) / c("sigma"))
    return params.select("series", up.alias("up"), down.alias("down"), (F.exp(c("mu") + c("sigma") * c("sigma") / 2) - 1).alias("expected"), F.when(up >= buy, "BUY").when(down >= sell, "SELL").otherwise("HOLD").alias("action"))


def walk_forward(prices: DataFrame, horizon: int = 5, warmup: int = 120, stride: int = 10) -> DataFrame:
    """A step table: at every stride-th row t the last `warmup` returns give an up-rate and a normal interval, met by the price at t + horizon.

    The training window is bounded, so each row serves at most warmup / stride steps: rows are dealt to their steps
    (an explode, then one aggregation on (series, step)), no range join and no history per step. Up is a later price
    above the row's own, zero or not; returns from or to a price of zero have no logarithm and train nothing, and a step
    at a price of zero has no actual return.
    """
    time = Window.partitionBy("series").orderBy("d")
    rows = prices.withColumns({"i": F.row_number().over(time) - 1, "r": F.log(F.try_divide("close", F.lag("close").over(time))), "future": F.lead("close", horizon).over(time), "moved": F.sum(F.lit(0)).over(time)}).drop("moved")
    rows = rows.withColumn("up", c("future") > c("close"))
    # step s = warmup + k * stride trains on rows s - warmup + 1 .. s, whose forward return ends by s if i + horizon <= s
    k_low = F.greatest(F.ceil((c("i") - warmup) / stride), F.lit(0))
    k_high = F.floor((c("i") - 1) / stride)
    dealt = rows.where(k_low <= k_high).select("series", "i", "r", "up", F.explode(F.sequence(k_low, k_high)).alias("k")).withColumn("step", warmup + c("k") * stride)
    known = c("i") + horizon <= c("step")
    train = dealt.groupBy("series", "step").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.avg(F.when(known, c("up").cast("double"))).alias("up"), F.count(F.lit(1)).alias("n"))
    at = rows.where("future is not null").select("series", "d", "close", "future", c("i").alias("step"))
    met = train.join(at.hint("merge"), ["series", "step"])
    half = 1.645 * c("s") * horizon**0.5
    predicted = F.exp(c("m") * horizon) - 1
    return met.select(
        c("series").alias("ticker"), "d", F.lit(horizon).alias("horizon"), c("step").alias("t"), F.coalesce("up", F.lit(0.5)).alias("predicted_prob"), predicted.alias("predicted_return"), (F.try_divide("future", "close") - 1).alias("actual_return"),
        (c("future") > c("close")).cast("int").alias("y"), c("future").alias("realized_price"), (c("close") * F.exp(c("m") * horizon - half)).alias("ci_lower"), (c("close") * F.exp(c("m") * horizon + half)).alias("ci_upper"),
        F.least(F.lit(1.0), 2 * F.abs(F.coalesce("up", F.lit(0.5)) - 0.5)).alias("confidence"), F.when(predicted > 0.005, "BUY").when(predicted < -0.005, "SELL").otherwise("HOLD").alias("recommendation"), F.lit(None).cast("string").alias("regime"),
    )


def live_average(dates: DataFrame, snapshots: DataFrame, max_age: int = 7) -> DataFrame:
    """(key, d) to the mean probability of the markets live on that day and their number: (key, d, market_p, markets).

    Snapshots: key, market, at, probability, closes (null: never). A market counts with its latest capture up to the
    day, while that is less than `max_age` days old and the market has not closed before the day. Each capture is
    therefore a span of days; spans add to running sums, so a key costs one row a day of the calendar, whatever the
    number of its markets. Equal capture times: the largest probability counts. Days without a live market: null and 0.
    """
    once = snapshots.groupBy("key", "market", "at").agg(F.max("probability").alias("p"), F.max("closes").alias("closes")).withColumn("day", F.to_date("at"))
    following = F.to_date(F.lead("at").over(Window.partitionBy("key", "market").orderBy("at")))
    spans = once.withColumn("until", F.least(following, F.date_add("day", max_age), F.date_add("closes", 1))).where("until > day")
    ends = F.array(F.struct(c("day").alias("d"), c("p"), F.lit(1).alias("n")), F.struct(c("until").alias("d"), (-c("p")).alias("p"), F.lit(-1).alias("n")))
    daily = spans.select("key", F.explode(ends).alias("e")).groupBy("key", "e.d").agg(F.sum("e.p").alias("p"), F.sum("e.n").alias("n"), F.lit(False).alias("asked"))
    asked = dates.select("key", "d", F.lit(0.0).alias("p"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")).distinct()
    so_far = Window.partitionBy("key").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = daily.unionByName(asked).withColumns({"p": F.sum("p").over(so_far), "n": F.sum("n").over(so_far)}).where("asked")
    return sums.select("key", "d", F.when(c("n") > 0, c("p") / c("n")).alias("market_p"), c("n").alias("markets"))


def walk_forward_replay(prices: DataFrame, snapshots: DataFrame, weight: float = 0.3, shock: float = 0.08, max_age: int = 7, **kw) -> DataFrame:
    """Walk-forward steps with the replayed markets of each step's date: those live then, shocks between captures left out.

    `blended` takes the markets with `weight`; where no market is live it is the model's probability.
    """
    steady = J.quality_filter(snapshots, "key", "market", "closes", at="at", value="probability", shock=shock)
    steps = walk_forward(prices, **kw)
    live = live_average(steps.select(c("ticker").alias("key"), "d"), steady, max_age)
    met = steps.join(live.withColumnRenamed("key", "ticker").hint("merge"), ["ticker", "d"], "left")
    return met.withColumn("blended", F.coalesce((1 - weight) * c("predicted_prob") + weight * c("market_p"), "predicted_prob"))


def cluster_dates(days: DataFrame, gap: int = 15, max_span: int = 60) -> DataFrame:
    """Clusters of dates by series: a gap above `gap` days, or a span above `max_span`, opens a new one.

    Every date points to the first date that a cluster which starts with it cannot hold: one after a gap, or beyond the
    span. Clusters start where the pointers lead from a series' first date, found by doubling: each round joins the
    starts known so far with pointers of 2^k steps, and the pointers with themselves, so a chain of n clusters takes
    log2 n rounds of equi-joins, and no cluster's dates are gathered. A date belongs to the last start before it. Null
    series are one series; null dates are left out.
    """
    time = Window.partitionBy("series").orderBy("day")
    rows = days.where("d is not null").select("series", F.unix_date("d").alias("day")).distinct()
    back = Window.partitionBy("series").orderBy((-c("day")).alias("back"))  # from the last date, so that a frame only grows
    ahead = F.min("day").over(back.rangeBetween(Window.unboundedPreceding, -max_span - 1))
    jump = F.min(F.when(c("fresh"), c("day"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"fresh": F.coalesce(c("day") - F.lag("day").over(time) > gap, F.lit(True)), "far": ahead})
    to = written(rows.withColumn("to", F.least(jump, "far")).select("series", "day", "to"), "next-starts")
    starts = to.groupBy("series").agg(F.min("day").alias("day"))
    links = to.where("to is not null")
    while True:
        step = links.select(c("series").alias("_s"), c("day").alias("_d"), "to")
        same = c("series").eqNullSafe(c("_s"))
        more = starts.join(step.hint("merge"), same & (c("day") == c("_d"))).select("series", c("to").alias("day"))
        starts = written(starts.union(more).distinct(), "starts")
        further = links.select("series", "day", c("to").alias("at")).join(step.hint("merge"), same & (c("at") == c("_d"))).select("series", "day", "to")
        links = written(further, "next-starts")
        if links.isEmpty():
            break
    both = to.select("series", "day", F.lit(None).cast("int").alias("start")).union(starts.select("series", "day", c("day").alias("start")))
    met = both.groupBy("series", "day").agg(F.max("start").alias("start")).withColumn("start", F.last("start", ignorenulls=True).over(time))
    return met.groupBy("series", "start").agg(F.max("day").alias("end"), F.count(F.lit(1)).cast("int").alias("days")).select("series", F.date_from_unix_date("start").alias("start"), F.date_from_unix_date("end").alias("end"), "days")


def window_offsets(steps: DataFrame, breaks: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """Rows around each break by trading-day offset: pre, at or post. Breaks are dealt to the rows they touch."""
    dealt = breaks.select("series", c("i").alias("break_i"), F.explode(F.sequence(c("i") - before, c("i") + 2 * after - 1)).alias("i"))
    met = steps.join(dealt.hint("merge"), ["series", "i"]).withColumn("offset", c("i") - c("break_i"))
    return met.withColumn("slice", F.when(c("offset") < 0, "pre").when(c("offset") < after, "at").otherwise("post"))


def composite_index(z: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum of the components' z by date; the weight of a missing component goes to the others of its group, then to all."""
    met = J.dimension_join(z.where("z is not null"), weights, "component", how="inner")
    group_all = weights.groupBy("grp").agg(F.sum("weight").alias("group_weight"))
    own = J.dimension_join(met, group_all, "grp", how="inner")
    scaled = own.withColumn("w", c("weight") / F.sum("weight").over(Window.partitionBy("d", "grp")) * c("group_weight"))
    return scaled.groupBy("d").agg((F.sum(c("z") * c("w")) / F.sum("w")).alias("index"), F.count(F.lit(1)).alias("components"))


def wacc(rows: DataFrame, sector_beta: DataFrame) -> DataFrame:
    """Cost of equity (CAPM) and blended cost of capital by row; a missing beta is the sector's, else 1."""
    met = J.dimension_join(rows, sector_beta, "sector")
    beta = F.coalesce("beta", "sector_beta", F.lit(1.0))
    ke, ev = c("rf") + beta * c("erp"), 1 / (1 + c("de"))
    return met.select("id", ke.alias("cost_of_equity"), (ev * ke + (1 - ev) * c("kd") * (1 - c("tax"))).alias("wacc"))


def reversal_probability(z_forecast: DataFrame, market_p: Column | None = None) -> DataFrame:
    """Mass of easing by state (LOW from MODERATE; LOW or MODERATE from higher), blended .4 / .6 with .95 of a market's p."""
    eased = F.when(c("state") == "LOW", 0.0).when(c("state") == "MODERATE", c("LOW")).otherwise(c("LOW") + c("MODERATE"))
    out = eased if market_p is None else F.when(market_p.isNull(), eased).otherwise(clamp(0.4 * eased + 0.6 * 0.95 * market_p, 0, 1))
    return z_forecast.select("series", out.alias("p"))


def base_rate_floor(base_rate: Column, centre: Column, crypto_short: Column, multiplier: float = 1.0, floor: float = 0.35) -> tuple[Column, Column]:
    """(margin, floor of the up probability): the margin grows from .05 to .10 with the base rate."""
    m = F.when(crypto_short, multiplier).otherwise(1.0)
    margin = F.greatest(0.05 * m, F.least(0.10 * m, 0.05 * m + (base_rate - 0.5) * 0.2 * m))
    return margin, F.greatest(F.when(crypto_short, floor).otherwise(0.35), centre - margin)


def soft_regime(mixture: DataFrame) -> DataFrame:
    """Normalised entropy of a regime mixture, with its confidence multiplier and interval scale."""
    part = lambda s: F.when(c(s) > 1e-12, -c(s) * F.log(s)).otherwise(0.0)
    e = F.least(F.lit(1.0), (part("bull") + part("bear") + part("sideways")) / F.log(F.lit(3.0)))
    return mixture.select("series", e.alias("entropy"), F.greatest(F.lit(0.65), 1 - 0.35 * e).alias("confidence"), (1 + 0.35 * e).alias("ci_scale"))


def blend_mixtures(a: DataFrame, b: DataFrame, weight: float) -> DataFrame:
    w = min(1.0, max(0.0, weight))
    met = a.join(b.select("series", *[c(s).alias(f"_{s}") for s in S.STATES]).hint("merge"), "series")
    mixed = {s: (1 - w) * c(s) + w * c(f"_{s}") for s in S.STATES}
    total = mixed["bull"] + mixed["bear"] + mixed["sideways"]
    return met.select("series", *[F.when(total > 0, m / total).otherwise(c(s)).alias(s) for s, m in mixed.items()])


def put_call_ratio(options: DataFrame, *keys: str) -> DataFrame:
    """Volume of puts over volume of calls (keys, kind, volume); null without calls."""
    of = lambda kind: F.sum(F.when(c("kind") == kind, c("volume")).otherwise(0))
    return options.groupBy(*keys).agg(F.try_divide(of("put"), of("call")).alias("ratio"))


def portfolio_totals(positions: DataFrame, prices: DataFrame, key: str) -> DataFrame:
    """Invested, worth now, gain and return in percent of each key's positions (key, series, cost) at the latest price of their series; others are left out."""
    now = prices.groupBy("series").agg(F.max_by("close", "d").alias("price"))
    sums = J.dimension_join(positions, now, "series", how="inner").groupBy(key).agg(F.sum("cost").alias("invested"), F.sum("price").alias("now"))
    gain = c("now") - c("invested")
    return sums.select(key, F.round("invested", 2).alias("invested"), F.round("now", 2).alias("now"), F.round(gain, 2).alias("pnl"), F.round(F.try_divide(gain, c("invested")) * 100, 6).alias("return_pct"))
