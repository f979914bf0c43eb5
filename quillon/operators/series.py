"""Price-series operators: every one works on many series at once, keyed by (series, d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, divided, normal_cdf

STATES = ("bull", "bear", "sideways")


def _all() -> WindowSpec:
    return Window.partitionBy("series")


def _time() -> WindowSpec:
    return _all().orderBy("d")


def _back(n: int, end: int = 0) -> WindowSpec:
    return _time().rowsBetween(-n, end)


def simple_returns(prices: DataFrame) -> DataFrame:
    """(p - previous p) / previous p; the first row of a series has none and is left out. After a price of zero it is infinite, from zero to zero NaN."""
    before = F.lag("close").over(_time())
    return prices.withColumn("r", divided(F.col("close") - before, before)).where("r is not null").select("series", "d", "r")


def log_returns(prices: DataFrame) -> DataFrame:
    return prices.withColumn("lr", F.log(F.col("close") / F.lag("close").over(_time()))).where("lr is not null").select("series", "d", "lr")


def volatility(r: Column, periods: int = 252) -> Column:
    """Annualised sample deviation; 0 below two rows."""
    return F.coalesce(F.stddev_samp(r), F.lit(0.0)) * periods**0.5


def sharpe(r: Column, rf: float = 0.05, periods: int = 252) -> Column:
    vol = volatility(r, periods)
    return F.when(vol == 0, 0.0).otherwise((F.avg(r) * periods - rf) / vol)


def tail_risk(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """Historical value at risk (minus the k-th smallest return, k = max(1, round((1 - level) n))) and expected shortfall (minus the mean of the k smallest)."""
    n = F.count(F.lit(1)).over(_all())
    k = F.greatest(F.lit(1), F.floor((1 - level) * n + 0.5))
    ranked = returns.withColumn("k", k).withColumn("i", F.row_number().over(_all().orderBy("r", "d"))).where("i <= k")
    return ranked.groupBy("series").agg((-F.max("r")).alias("var"), (-F.avg("r")).alias("shortfall"))


def max_drawdown(prices: DataFrame) -> DataFrame:
    peak = F.max("close").over(_time().rowsBetween(Window.unboundedPreceding, 0))
    return prices.withColumn("dd", (peak - F.col("close")) / peak).groupBy("series").agg(F.max("dd").alias("max_drawdown"))


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """Pearson correlation of every pair of series over common dates; 1 on the diagonal, 0 without variance."""
    a, b = returns.select(F.col("series").alias("a"), "d", F.col("r").alias("x")), returns.select(F.col("series").alias("b"), "d", F.col("r").alias("y"))
    found = a.join(b.hint("merge"), "d").groupBy("a", "b").agg(F.corr("x", "y").alias("c"))
    c = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("c").isNull() | F.isnan("c"), 0.0).otherwise(clamp(F.col("c"), -1, 1))
    return found.select("a", "b", c.alias("corr"))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the returns of each date, weights normalised over the series present."""
    return returns.join(weights, "series").groupBy("d").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"))


def risk_report(prices: DataFrame, rf: float = 0.05) -> DataFrame:
    """Volatility, Sharpe ratio, value at risk, shortfall and drawdown of each series."""
    r = simple_returns(prices)
    head = r.groupBy("series").agg(F.count(F.lit(1)).alias("n"), volatility(F.col("r")).alias("vol"), sharpe(F.col("r"), rf).alias("sharpe"))
    return head.join(tail_risk(r).hint("merge"), "series").join(max_drawdown(prices).hint("merge"), "series")


def compounded_drawdown(returns: DataFrame, key: str = "series") -> DataFrame:
    """Drawdown of the path that starts at 100 and compounds the returns, the start included."""
    w = Window.partitionBy(key).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("path", 100 * F.exp(F.sum(F.log1p("r")).over(w)))
    peak = F.greatest(F.lit(100.0), F.max("path").over(w))
    return path.withColumn("dd", (peak - F.col("path")) / peak).groupBy(key).agg(F.max("dd").alias("max_drawdown"))


def rolling_z(prices: DataFrame, window: int = 90, direction: int = 1) -> DataFrame:
    """Signed z-score against the last `window` rows, the current one included; 0 without spread."""
    w = _back(window - 1)
    sd, n = F.stddev_pop("close").over(w), F.count("close").over(w)
    z = F.when((sd < 1e-10) | (n < 2), 0.0).otherwise(direction * (F.col("close") - F.avg("close").over(w)) / sd)
    return prices.select("series", "d", z.alias("z"))


def change_over(prices: DataFrame, rows: int = 20) -> DataFrame:
    base = F.lag("close", rows).over(_time())
    return prices.select("series", "d", F.when(base != 0, F.col("close") / base - 1).alias("change"))


def momentum(prices: DataFrame, lookback: int = 20) -> DataFrame:
    """Annualised velocity, half-window acceleration and the R2 of a line through the log prices."""
    half, lp = lookback // 2, F.log("close")
    numbered = prices.withColumns({"lp": lp, "i": F.row_number().over(_time()).cast("double")})
    v = (F.col("lp") - F.lag("lp", lookback).over(_time())) / lookback * 252
    late, early = F.col("lp") - F.lag("lp", half).over(_time()), F.lag("lp", half).over(_time()) - F.lag("lp", 2 * half).over(_time())
    r2 = F.regr_r2("lp", "i").over(_back(lookback))
    return numbered.select("series", "d", v.alias("velocity"), ((late - early) / half).alias("acceleration"), r2.alias("r2")).where("velocity is not null")


def ensemble_signal(prices: DataFrame) -> DataFrame:
    """Mean reversion, trend and volatility votes over windows of 20 and 5 rows; the direction that two of three share."""
    ma20, sd20, ma5 = F.avg("close").over(_back(19)), F.stddev_pop("close").over(_back(19)), F.avg("close").over(_back(4))
    r = F.col("close") / F.lag("close").over(_time()) - 1
    rows = prices.withColumns({"r": r, "n": F.row_number().over(_time()), "z": F.when(sd20 > 1e-12, (F.col("close") - ma20) / sd20).otherwise(0.0), "trend": ma5 / ma20 - 1})
    ratio = F.stddev_pop("r").over(_back(4)) / F.stddev_pop("r").over(_back(19))
    rows = rows.withColumn("vol_ratio", F.coalesce(ratio, F.lit(1.0)))
    votes = -F.signum(F.when(F.abs("z") > 1, F.col("z")).otherwise(0.0)) + F.signum("trend") + F.when(F.col("vol_ratio") < 1, F.signum("trend")).otherwise(0.0)
    return rows.where("n > 20").select("series", "d", "z", "trend", "vol_ratio", F.when(votes >= 2, 1).when(votes <= -2, -1).otherwise(0).alias("vote"))


def adaptive_threshold(returns: DataFrame, share: float = 0.5, least: float = 0.001) -> DataFrame:
    """max(least, share times the upper median of absolute returns); upper median: place floor(n/2) + 1."""
    by_size = returns.withColumn("i", F.row_number().over(_all().orderBy(F.abs("r"), "d"))).withColumn("n", F.count(F.lit(1)).over(_all()))
    return by_size.where("i = floor(n / 2) + 1").select("series", F.greatest(F.lit(least), share * F.abs("r")).alias("threshold"))


def regime_series(returns: DataFrame) -> DataFrame:
    t = adaptive_threshold(returns)
    state = F.when(F.col("r") > F.col("threshold"), "bull").when(F.col("r") < -F.col("threshold"), "bear").otherwise("sideways")
    return returns.join(t.hint("merge"), "series").select("series", "d", "r", state.alias("state"))


def _with_all_states(df: DataFrame, *keys: str) -> DataFrame:
    """Nine (from, to) cells for each key."""
    every = F.array(*map(F.lit, STATES))
    cells = df.select(*keys).distinct().withColumn("state_from", F.explode(every)).withColumn("state_to", F.explode(every))
    return cells.join(df.hint("merge"), [*keys, "state_from", "state_to"], "left")


def transition_matrix(states: DataFrame, decay: float = 1.0, min_obs: int = 30) -> DataFrame:
    """(series, state_from, state_to, p): decayed counts plus alpha = max(0.01, 5/n), each row normalised.

    Series with fewer than min_obs states get 0.6 on the diagonal and 0.2 elsewhere.
    """
    age = F.row_number().over(_all().orderBy(F.desc("d"))) - 1
    moves = states.select("series", F.col("state").alias("state_to"), F.lag("state").over(_time()).alias("state_from"), age.alias("age"), F.count(F.lit(1)).over(_all()).alias("n"))
    moves = moves.withColumn("weight", F.when(F.col("state_from").isNotNull(), F.pow(F.lit(decay), "age")).otherwise(0.0))
    moves = moves.withColumn("state_from", F.coalesce("state_from", "state_to"))
    counts = _with_all_states(moves.groupBy("series", "state_from", "state_to").agg(F.sum("weight").alias("weight"), F.max("n").alias("own")), "series")
    n = F.max("own").over(_all())
    mass = F.coalesce("weight", F.lit(0.0)) + F.greatest(F.lit(0.01), 5 / n)
    rows = counts.select("series", "state_from", "state_to", mass.alias("mass"), n.alias("n"))
    p = F.col("mass") / F.sum("mass").over(Window.partitionBy("series", "state_from"))
    default = F.when(F.col("state_from") == F.col("state_to"), 0.6).otherwise(0.2)
    return rows.select("series", "state_from", "state_to", F.when(F.col("n") < min_obs, default).otherwise(p).alias("p"))


def wide_matrix(matrix: DataFrame) -> DataFrame:
    """One row per series: p[i][j] in the order of STATES."""
    cell = lambda i, j: F.max(F.when((F.col("state_from") == i) & (F.col("state_to") == j), F.col("p")))
    rows = matrix.groupBy("series").agg(*[cell(i, j).alias(f"p{a}{b}") for a, i in enumerate(STATES) for b, j in enumerate(STATES)])
    return rows.select("series", F.array(*[F.array(*[F.col(f"p{a}{b}") for b in range(3)]) for a in range(3)]).alias("p"))


def _step(v: Column, p: Column) -> Column:
    return F.array(*[sum((F.get(v, i) * F.get(F.get(p, i), j) for i in range(1, 3)), F.get(v, 0) * F.get(F.get(p, 0), j)) for j in range(3)])


def n_step_distribution(matrix: DataFrame, current: DataFrame, n: int) -> DataFrame:
    """Distribution over states n steps after the current one: a row of the n-th power, exactly."""
    start = F.transform(F.array(*map(F.lit, STATES)), lambda s: (s == F.col("state")).cast("double"))
    rows = wide_matrix(matrix).join(current.hint("merge"), "series")
    out = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda v, _: _step(v, F.col("p")))
    return rows.withColumn("v", out).select("series", *[F.get("v", i).alias(s) for i, s in enumerate(STATES)])


def stationary(p: Column, steps: int = 100) -> Column:
    third = F.array(*[F.lit(1 / 3)] * 3)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), third, lambda v, _: _step(v, p))


def transition_entropy(matrix: DataFrame) -> DataFrame:
    """Entropy of the rows weighted by the stationary distribution, over ln 3."""
    rows = wide_matrix(matrix).withColumn("v", stationary(F.col("p")))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    total = sum((F.get("v", i) * sum((xlogx(F.get(F.get("p", i), j)) for j in range(1, 3)), xlogx(F.get(F.get("p", i), 0))) for i in range(1, 3)), F.get("v", 0) * sum((xlogx(F.get(F.get("p", 0), j)) for j in range(1, 3)), xlogx(F.get(F.get("p", 0), 0))))
    return rows.select("series", (-total / F.log(F.lit(3.0))).alias("entropy"))


def second_eigenvalue(matrix: DataFrame) -> DataFrame:
    """The second largest absolute eigenvalue of a stochastic 3x3 matrix: one is 1, the others follow from trace and determinant."""
    g = lambda i, j: F.get(F.get("p", i), j)
    trace = g(0, 0) + g(1, 1) + g(2, 2)
    det = g(0, 0) * (g(1, 1) * g(2, 2) - g(1, 2) * g(2, 1)) - g(0, 1) * (g(1, 0) * g(2, 2) - g(1, 2) * g(2, 0)) + g(0, 2) * (g(1, 0) * g(2, 1) - g(1, 1) * g(2, 0))
    rows = wide_matrix(matrix).select("series", (trace - 1).alias("s"), det.alias("q"))
    disc = F.col("s") * F.col("s") - 4 * F.col("q")
    real = F.greatest(F.abs((F.col("s") + F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2), F.abs((F.col("s") - F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2))
    return rows.select("series", F.when(disc >= 0, real).otherwise(F.sqrt(F.abs("q"))).alias("lambda2"))


def mixing_weight(matrix: DataFrame, horizon: int) -> DataFrame:
    return second_eigenvalue(matrix).select("series", F.exp(-F.col("lambda2") * horizon).alias("weight"))


def state_counts(states: DataFrame, sparse_below: int = 5) -> DataFrame:
    """Observations of every state, absent ones included, and whether they are sparse."""
    every = states.select("series").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES))))
    found = every.join(states.groupBy("series", "state").agg(F.count(F.lit(1)).alias("c")).hint("merge"), ["series", "state"], "left")
    n = F.coalesce("c", F.lit(0))
    return found.select("series", "state", n.alias("n"), (n < sparse_below).alias("sparse"))


def regime_run_length(states: DataFrame) -> DataFrame:
    """Length of the run of equal states that ends a series."""
    flagged = states.withColumn("change", F.coalesce((F.col("state") != F.lag("state").over(_time())).cast("int"), F.lit(0)))
    islands = flagged.withColumn("island", F.sum("change").over(_time())).groupBy("series", "island").agg(F.count(F.lit(1)).alias("run"), F.max("state").alias("state"))
    return islands.groupBy("series").agg(F.max_by("state", "island").alias("state"), F.max_by("run", "island").alias("run"))


def winsorize(df: DataFrame, column: str, *keys: str, k: float = 3.0) -> DataFrame:
    """Clip to mean +- k population deviations of the group; small or flat groups stay."""
    w = Window.partitionBy(*keys)
    mean, sd, n = F.avg(column).over(w), F.stddev_pop(column).over(w), F.count(column).over(w)
    return df.withColumn(column, F.when((n < 3) | (sd < 1e-12), F.col(column)).otherwise(F.greatest(mean - k * sd, F.least(mean + k * sd, F.col(column)))))


def regime_stats(states: DataFrame, least: int = 5, cap: float = 0.004) -> DataFrame:
    """Winsorised mean (capped) and population deviation per state; defaults for states with fewer rows."""
    means = {"bull": 0.001, "bear": -0.001, "sideways": 0.0}
    found = winsorize(states, "r", "series", "state").groupBy("series", "state").agg(F.count(F.lit(1)).alias("c"), F.avg("r").alias("m"), F.stddev_pop("r").alias("s"))
    every = states.select("series").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES)))).join(found.hint("merge"), ["series", "state"], "left")
    few = F.coalesce("c", F.lit(0)) < least
    default = F.coalesce(*[F.when(F.col("state") == s, v) for s, v in means.items()])
    return every.select("series", "state", F.when(few, default).otherwise(clamp(F.col("m"), -cap, cap)).alias("mean"), F.when(few, 0.01).otherwise(F.col("s")).alias("sd"))


def regime_up_rates(states: DataFrame, horizon: int = 5) -> DataFrame:
    """Share of rows in each state after which the next `horizon` log returns sum above zero; 0.5 where there is none."""
    ahead = _time().rowsBetween(1, horizon)
    rows = states.withColumns({"s": F.sum(F.log1p("r")).over(ahead), "k": F.count("r").over(ahead)}).where(F.col("k") == horizon)
    rates = rows.groupBy("series", "state").agg(F.avg((F.col("s") > 0).cast("double")).alias("u"))
    every = states.select("series").distinct().withColumn("state", F.explode(F.array(*map(F.lit, STATES))))
    return every.join(rates.hint("merge"), ["series", "state"], "left").select("series", "state", F.coalesce("u", F.lit(0.5)).alias("up_rate"))


def structural_break(states: DataFrame, threshold: float = 0.05, least: int = 36) -> DataFrame:
    """Squared Frobenius distance between the transition matrices of the two halves of a series."""
    n, i = F.count(F.lit(1)).over(_all()), F.row_number().over(_time())
    halves = states.withColumns({"n": n, "i": i}).where(F.col("n") >= least)
    first = transition_matrix(halves.where("i <= floor(n / 2)").select("series", "d", "state"), min_obs=1).withColumnRenamed("p", "a")
    second = transition_matrix(halves.where("i > floor(n / 2)").select("series", "d", "state"), min_obs=1).withColumnRenamed("p", "b")
    met = first.join(second.hint("merge"), ["series", "state_from", "state_to"])
    return met.groupBy("series").agg(F.sum(F.pow(F.col("a") - F.col("b"), 2)).alias("divergence")).withColumn("is_break", F.col("divergence") > threshold)


def transition_gof(states: DataFrame, matrix: DataFrame) -> DataFrame:
    """Chi-square of observed transitions against the matrix (rows of 5 or more, cells with 1 or more expected), with a Wilson-Hilferty p."""
    moves = states.select("series", F.lag("state").over(_time()).alias("state_from"), F.col("state").alias("state_to")).where("state_from is not null")
    seen = moves.groupBy("series", "state_from", "state_to").agg(F.count(F.lit(1)).alias("o"))
    cells = matrix.join(seen.hint("merge"), ["series", "state_from", "state_to"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    cells = cells.withColumn("row", F.sum("o").over(Window.partitionBy("series", "state_from"))).withColumn("e", F.col("row") * F.col("p")).where("row >= 5 and e >= 1")
    rows = cells.groupBy("series", "state_from").agg(F.sum(F.pow(F.col("o") - F.col("e"), 2) / F.col("e")).alias("chi"), (F.count(F.lit(1)) - 1).alias("df"))
    out = rows.groupBy("series").agg(F.sum("chi").alias("chi2"), F.sum("df").alias("df"))
    z = (F.pow(F.col("chi2") / F.col("df"), 1 / 3) - (1 - 2 / (9 * F.col("df")))) / F.sqrt(2 / (9 * F.col("df")))
    p = F.when(F.col("df") > 0, 1 - normal_cdf(z)).otherwise(1.0)
    return out.select("series", "chi2", "df", p.alias("p_value"), (p >= 0.05).alias("passes"))


def entropy_z(values: DataFrame, window: int = 60, least: int = 5) -> DataFrame:
    """z of `close` against previous values only, and the interval scale clamp(1 + 0.15 z, 0.7, 1.4)."""
    w = _back(window, -1)
    sd = F.stddev_pop("close").over(w)
    z = F.when((F.count("close").over(w) < least) | (sd < 1e-12), 0.0).otherwise((F.col("close") - F.avg("close").over(w)) / sd)
    return values.select("series", "d", z.alias("z")).withColumn("scale", clamp(1 + 0.15 * F.col("z"), 0.7, 1.4))


def garch(returns: DataFrame, horizon: int = 10, alpha: float = 0.10, beta: float = 0.85) -> DataFrame:
    """Variance forecasts (series, k, sigma) of a GARCH(1, 1) whose level is the mean squared return; needs 5 rows."""
    fit = returns.groupBy("series").agg(F.avg(F.pow("r", 2)).alias("h0"), F.max_by("r", "d").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 5")
    omega = F.col("h0") * (1 - alpha - beta)
    h1 = omega + alpha * F.pow("last", 2) + beta * F.col("h0")
    rows = fit.select("series", "h0", h1.alias("h1"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    return rows.select("series", "k", F.sqrt(F.col("h0") + F.pow(F.lit(alpha + beta), F.col("k") - 1) * (F.col("h1") - F.col("h0"))).alias("sigma"))


def jump_days(prices: DataFrame, k: float = 3.0) -> DataFrame:
    """Days whose log return lies beyond k deviations: count, mean and deviation."""
    lr = log_returns(prices).withColumn("sd", F.stddev_samp("lr").over(_all())).withColumn("m", F.avg("lr").over(_all()))
    hit = F.abs(F.col("lr") - F.col("m")) > k * F.col("sd")
    return lr.groupBy("series").agg(F.count_if(hit).alias("jumps"), F.avg(F.when(hit, F.col("lr"))).alias("mean_jump"), F.stddev_pop(F.when(hit, F.col("lr"))).alias("sd_jump"))


def ks_distance(returns: DataFrame, split: Column) -> DataFrame:
    """Largest gap between the empirical distributions of the rows where split holds and the others."""
    rows = returns.select("series", "r", split.cast("int").alias("s"))
    by_value = rows.groupBy("series", "r").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    run = Window.partitionBy("series").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    gaps = by_value.withColumn("gap", F.abs(F.sum("a").over(run) / F.sum("a").over(_all()) - F.sum("b").over(run) / F.sum("b").over(_all())))
    return gaps.groupBy("series").agg(F.max("gap").alias("ks"))


#: Critical values by level; fixed values of the two-sample test.
KS_CRITICAL = {0.10: 1.224, 0.05: 1.358, 0.025: 1.480, 0.01: 1.628, 0.005: 1.731, 0.001: 1.949}


def drift_points(returns: DataFrame, recent: int = 50, reference: int = 50, alpha: float = 0.005, stride: int = 10) -> DataFrame:
    """The latest split at which the `recent` rows after it differ from the `reference` rows before it, per series.

    Each row is dealt to the splits whose windows hold it, so the join is an equi-join and the fan-out is bounded.
    """
    limit = KS_CRITICAL[alpha] * ((recent + reference) / (recent * reference)) ** 0.5
    rows = returns.withColumns({"i": F.row_number().over(_time()), "n": F.count(F.lit(1)).over(_all())})
    low = F.greatest(F.ceil((F.col("i") - recent) / stride), F.lit(-(-reference // stride)))
    high = F.least(F.floor((F.col("i") + reference - 1) / stride), F.floor((F.col("n") - recent) / stride))
    dealt = rows.where(low <= high).withColumn("step", F.explode(F.sequence(low, high))).withColumn("split", F.col("step") * stride)
    keyed = dealt.select(F.struct("series", "split").alias("series"), "r", (F.col("i") > F.col("split")).alias("late"), "n")
    found = ks_distance(keyed, F.col("late")).where(F.col("ks") > limit).select("series.series", "series.split", "ks")
    return found.groupBy("series").agg(F.max("split").alias("split"), F.max_by("ks", "split").alias("ks"))


def drift_trim(returns: DataFrame, least: int = 60, **kw) -> DataFrame:
    """Rows after the detected change point, at least `least` of them."""
    points = drift_points(returns, **kw)
    n, back = F.count(F.lit(1)).over(_all()), F.row_number().over(_all().orderBy(F.desc("d")))
    rows = returns.withColumns({"n": n, "back": back}).join(points.hint("merge"), "series", "left")
    keep = F.when(F.col("split").isNull(), F.col("n")).otherwise(F.greatest(F.lit(least), F.col("n") - F.col("split")))
    return rows.where(F.col("back") <= keep).select("series", "d", "r")


def first_convergence(prob: DataFrame, eps: float = 0.05) -> DataFrame:
    """First row of each series at which the probability passes 1 - eps (yes) or eps (no)."""
    hit = prob.withColumn("i", F.row_number().over(_time()) - 1).where((F.col("p") > 1 - eps) | (F.col("p") < eps))
    return hit.groupBy("series").agg(F.min("i").alias("first"), F.min_by(F.when(F.col("p") > 1 - eps, "yes").otherwise("no"), "i").alias("side"))


def segment_windows(returns: DataFrame, size: int = 48, stride: int = 24) -> DataFrame:
    """Hopping windows by row number, with a final window over the tail if the last full one ends before it."""
    rows = returns.withColumns({"i": F.row_number().over(_time()) - 1, "n": F.count(F.lit(1)).over(_all())}).where(F.col("n") >= size)
    last = F.floor((F.col("n") - size) / stride)
    low, high = F.greatest(F.ceil((F.col("i") - size + 1) / stride), F.lit(0)), F.least(F.floor(F.col("i") / stride), last)
    hops = rows.where(low <= high).select("series", "d", "r", F.explode(F.sequence(low, high)).alias("w"))
    tail = rows.where((F.col("n") - size > last * stride) & (F.col("i") >= F.col("n") - size)).select("series", "d", "r", (last + 1).alias("w"))
    return hops.unionByName(tail)


def oos_r2(df: DataFrame, *keys: str) -> DataFrame:
    """1 - SSres / SStot of (actual, predicted); 0 below two rows or without variance."""
    agg = df.groupBy(*keys).agg(F.sum(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("res"), F.var_pop("actual").alias("v"), F.count(F.lit(1)).alias("n"))
    tot = F.col("v") * F.col("n")
    return agg.select(*keys, F.when((F.col("n") < 2) | (tot < 1e-14), 0.0).otherwise(1 - F.col("res") / tot).alias("r2"))


def regime_of_pressure(z: Column) -> Column:
    return F.when(z < 0.5, "LOW").when(z < 1.5, "MODERATE").when(z < 2, "ELEVATED").otherwise("CRITICAL")


def divergence_penalty(x: Column) -> Column:
    return F.when(x < 0.05, 1.0).when(x < 0.10, 0.8).when(x < 0.20, 0.7).otherwise(0.6)


def vol_regime(x: Column) -> Column:
    return F.when(x < 15, "low").when(x < 25, "normal").otherwise("high")
