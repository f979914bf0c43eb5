"""Forecast scoring over step tables: every score is one aggregation, so all scores of a report share one shuffle.

A step has ticker, horizon, t, predicted_prob, predicted_return, actual_return, y, realized_price, ci_lower, ci_upper,
confidence, recommendation, regime.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import normal_cdf, normal_pdf
from quillon.operators.ranks import exact_ranks, key_ranks

c = F.col


def brier() -> Column:
    """Mean squared error of the probability; 1 on no rows."""
    return F.coalesce(F.avg(F.pow(c("predicted_prob") - c("y"), 2)), F.lit(1.0))


def hit(hold: float = 0.03) -> Column:
    """1 where the recommendation was right: BUY above 0, SELL below 0, HOLD within the band."""
    r = c("actual_return")
    return F.when(c("recommendation") == "BUY", r > 0).when(c("recommendation") == "SELL", r < 0).otherwise(F.abs(r) < hold).cast("double")


def actual_class(hold: float = 0.03) -> Column:
    return F.when(c("actual_return") > hold, "BUY").when(c("actual_return") < -hold, "SELL").otherwise("HOLD")


def edge() -> Column:
    r = c("actual_return")
    return F.when(c("recommendation") == "BUY", r).when(c("recommendation") == "SELL", -r).otherwise(-F.abs(r))


def covered() -> Column:
    return c("realized_price").between(c("ci_lower"), c("ci_upper")).cast("double")


def centre() -> Column:
    return c("realized_price") / (1 + c("actual_return")) * (1 + c("predicted_return"))


def sigma() -> Column:
    return F.greatest(F.abs(c("ci_upper") - c("ci_lower")) / (2 * 1.64485), F.lit(1e-9))


def step_crps() -> Column:
    """CRPS of a normal forecast with the step's centre and interval."""
    z = (c("realized_price") - centre()) / sigma()
    return F.greatest(F.lit(0.0), sigma() * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / 3.141592653589793**0.5))


def tail_weight() -> Column:
    return 1 + F.greatest(F.lit(0.0), F.abs((c("realized_price") - centre()) / sigma()) - 1.645)


def interval_parts(alpha: float = 0.10) -> dict[str, Column]:
    """Width, penalties of misses below and above, their sum, and coverage."""
    x, low, high = c("realized_price"), c("ci_lower"), c("ci_upper")
    below, above = 2 / alpha * F.greatest(low - x, F.lit(0.0)), 2 / alpha * F.greatest(x - high, F.lit(0.0))
    return {"width": F.avg(high - low), "lower_penalty": F.avg(below), "upper_penalty": F.avg(above), "total": F.avg(high - low + below + above), "coverage": F.avg(covered())}


def report_metrics(hold: float = 0.03) -> dict[str, Column]:
    p_up = (c("predicted_prob") >= 0.5).cast("int")
    corr = F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("actual_return") * F.stddev_pop("predicted_return") > 1e-12), F.corr("predicted_return", "actual_return")).otherwise(0.0)
    return {
        "steps": F.count(F.lit(1)), "brier": brier(), "accuracy": F.avg(hit(hold)), "mean_edge": F.avg(edge()), "coverage": F.avg(covered()),
        "sharpness": F.avg((c("ci_upper") - c("ci_lower")) / c("realized_price")), "crps": F.avg(step_crps()), "scaled_crps": F.avg(step_crps() / sigma()),
        "tail_crps": F.sum(step_crps() * tail_weight()) / F.sum(tail_weight()), "return_corr": corr, "p_up_accuracy": F.avg((p_up == c("y")).cast("double")),
        "mae": F.avg(F.abs(c("predicted_return") - c("actual_return"))),
    }


def report(steps: DataFrame, *keys: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """One row of metrics for each key; one shuffle, partial sums before it."""
    return steps.groupBy(*keys).agg(*[m.alias(k) for k, m in (metrics or report_metrics()).items()])


def reliability_bins(steps: DataFrame, bins: int = 10) -> DataFrame:
    """Half-open bins of the probability, the last closed; empty ones are emitted with their midpoint and frequency 0."""
    found = steps.groupBy(F.least(F.floor(c("predicted_prob") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg("predicted_prob").alias("p"), F.avg("y").alias("f"), F.count(F.lit(1)).alias("k"))
    every = steps.sparkSession.range(bins).select(c("id").cast("int").alias("bin"))
    out = every.join(F.broadcast(found), "bin", "left")  # `bins` rows
    return out.select("bin", F.coalesce("p", (c("bin") + 0.5) / bins).alias("mean_p"), F.coalesce("f", F.lit(0.0)).alias("frequency"), F.coalesce("k", F.lit(0)).alias("n"))


def max_reliability_deviation(bins: DataFrame, least: int = 3) -> DataFrame:
    return bins.where(c("n") >= least).agg(F.max(F.abs(c("mean_p") - c("frequency"))).alias("max_deviation"))


def tail_reliability_bins(steps: DataFrame) -> DataFrame:
    p = c("predicted_prob")
    label = F.when(p < 0.05, "0.00-0.05").when(p < 0.10, "0.05-0.10").when((p >= 0.90) & (p < 0.95), "0.90-0.95").when(p >= 0.95, "0.95-1.00")
    return steps.withColumn("bin", label).where("bin is not null").groupBy("bin").agg(F.avg("predicted_prob").alias("mean_p"), F.avg("y").alias("frequency"), F.count(F.lit(1)).alias("n"))


def calibration_table(steps: DataFrame, bins: int = 5) -> DataFrame:
    """Populated half-open bins only; a probability of 1 is in none."""
    return steps.where("predicted_prob < 1").groupBy(F.floor(c("predicted_prob") * bins).cast("int").alias("bin")).agg(F.avg("predicted_prob").alias("mean_p"), F.avg("y").alias("frequency"), F.count(F.lit(1)).alias("n"))


def balanced_accuracy(steps: DataFrame, *keys: str) -> DataFrame:
    """Mean over the observed actual classes of the share of right recommendations."""
    by_class = steps.groupBy(*keys, actual_class().alias("_class")).agg(F.avg(hit()).alias("recall"))
    return by_class.groupBy(*keys).agg(F.avg("recall").alias("balanced_accuracy"))


def accuracy_coherence(steps: DataFrame, weight: float = 1.0) -> DataFrame:
    """Mean squared return error plus weight times the mean relative variance of centres that target one time."""
    error = steps.groupBy("ticker").agg(F.avg(F.pow(c("predicted_return") - c("actual_return"), 2)).alias("error"))
    target = steps.groupBy("ticker", (c("t") + c("horizon")).alias("target")).agg(F.var_pop(centre()).alias("v"), F.max_by("realized_price", F.struct("t", "horizon")).alias("price"), F.count(F.lit(1)).alias("n"))
    spread = target.where("n >= 2").groupBy("ticker").agg(F.avg(c("v") / F.pow("price", 2)).alias("spread"))
    out = error.join(spread.hint("merge"), "ticker", "left")
    return out.select("ticker", "error", F.coalesce("spread", F.lit(0.0)).alias("incoherence"), (c("error") + weight * F.coalesce("spread", F.lit(0.0))).alias("score"))


def _chain(pairs: list[tuple[Column, str]], other: str) -> Column:
    return reduce(lambda a, x: a.when(*x), pairs[1:], F.when(*pairs[0])).otherwise(other)


def buckets() -> dict[str, Column]:
    """Label of every slice of the failure decomposition."""
    conf, r, p, move = c("confidence"), c("actual_return"), c("predicted_prob"), F.abs(c("actual_return"))
    return {
        "confidence": _chain([(conf < 0.2, "0.0-0.2"), (conf < 0.4, "0.2-0.4"), (conf < 0.6, "0.4-0.6"), (conf < 0.8, "0.6-0.8")], "0.8-1.0"),
        "move_magnitude": _chain([(move < 0.02, "<2%"), (move < 0.05, "2-5%"), (move < 0.10, "5-10%")], ">=10%"),
        "move_direction": _chain([(r > 0.03, "up"), (r < -0.03, "down")], "flat"),
        "recommendation": c("recommendation"),
        "regime": F.coalesce("regime", F.lit("unknown")),
        "trend_vs_chop": _chain([(c("regime").isNull(), "unknown"), (c("regime") == "sideways", "chop")], "trend"),
        "p_up_band": _chain([(p < 0.45, "<0.45"), (p < 0.50, "0.45-0.50"), (p < 0.55, "0.50-0.55"), (p < 1.0, "0.55-1.00")], "unknown"),
    }


def balanced(hold: float = 0.03) -> Column:
    """Mean over the observed actual classes of the share of right recommendations, as one aggregate."""
    recalls = [F.avg(F.when(actual_class(hold) == k, (c("recommendation") == k).cast("double"))) for k in ("BUY", "HOLD", "SELL")]
    seen = F.array_compact(F.array(*recalls))
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)).otherwise(0.0)


def bucket_metrics(hold: float = 0.03) -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "accuracy": F.avg(hit(hold)), "balanced_accuracy": balanced(hold), "brier": brier(), "coverage": F.avg(covered()), "mean_edge": F.avg(edge())}


UNKNOWN = "unknown"


def volatility_bounds(steps: DataFrame) -> tuple[float, float]:
    """The absolute returns at places floor((n - 1) / 3) and floor(2 (n - 1) / 3), by counting."""
    rows = steps.select(F.abs("actual_return").alias("m")).where("m is not null")
    n = rows.count()
    return tuple(exact_ranks(rows, "m", [(n - 1) // 3, 2 * (n - 1) // 3])) if n else (0.0, 0.0)


def slices(bounds: tuple[float, float], hold: float = 0.03) -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Every slice of the whole decomposition: its label, and the labels that are shown even without steps.

    Beyond a step's own columns: anchor_quality, validation_metric, structural_break and divergence with those of the
    original run, which win (original_break, original_divergence), hmm_converged, consensus, entropy_scale. The labels
    are fixed values.
    """
    conf, r, p, move = c("confidence"), c("actual_return"), c("predicted_prob"), F.abs(c("actual_return"))
    told = lambda x: F.coalesce(x.cast("string"), F.lit(UNKNOWN))
    among = lambda x, labels: F.when(x.isin(*labels), x).otherwise(UNKNOWN)
    broken, apart = F.coalesce("original_break", "structural_break"), F.coalesce("original_divergence", "divergence")
    anchor, metric, flags = ("good", "sparse", "none", UNKNOWN), ("daily_return", "horizon_return", UNKNOWN), ("true", "false", UNKNOWN)
    confidence = ("[0.00, 0.20)", "[0.20, 0.40)", "[0.40, 0.60)", "[0.60, 0.80)", "[0.80, 1.00]")
    size, far = ("<2%", "2–5%", "5–10%", "≥10%"), ("<0.05", "0.05–0.10", "0.10–0.20", "≥0.20")
    up = ("<0.45", "0.45–0.50", "0.50–0.55", ">0.55")
    scale = F.coalesce("entropy_scale", F.lit(1.0))
    return {
        "regime": (F.coalesce("regime", F.lit(UNKNOWN)), ()),
        "volatility": (F.when(move <= bounds[0], "low").when(move <= bounds[1], "medium").otherwise("high"), ("low", "medium", "high")),
        "moveMagnitude": (band(move, (0.02, 0.05, 0.10), size), size),
        "moveDirection": (F.when(r > hold, "up").when(r < -hold, "down").otherwise("flat"), ("up", "down", "flat")),
        "confidence": (F.when(conf.between(0, 1), band(conf, (0.2, 0.4, 0.6, 0.8), confidence)).otherwise(UNKNOWN), confidence),
        "anchorQuality": (among(c("anchor_quality"), anchor), anchor),
        "recommendation": (c("recommendation"), ("BUY", "HOLD", "SELL")),
        "trendVsChop": (F.when(F.coalesce("regime", F.lit("")) == "", UNKNOWN).when(c("regime") == "sideways", "chop").otherwise("trending"), ("trending", "chop", UNKNOWN)),
        "validationMetric": (among(c("validation_metric"), metric), metric),
        "structuralBreak": (told(broken), flags),
        "divergence": (F.coalesce(band(apart, (0.05, 0.10, 0.20), far), F.lit(UNKNOWN)), (*far, UNKNOWN)),
        "hmmConverged": (told(c("hmm_converged")), flags),
        "ensembleConsensus": (F.coalesce(band(c("consensus"), (0.4, 0.7), ("low", "medium", "high")), F.lit(UNKNOWN)), ("low", "medium", "high", UNKNOWN)),
        "pUpBand": (F.when((p >= 0) & (p < 1), band(p, (0.45, 0.50, 0.55), up)).otherwise(UNKNOWN), up),
        "entropyCiScale": (F.when(scale < 0.999, "tightened").when(scale > 1.001, "widened").otherwise("neutral"), ("tightened", "neutral", "widened")),
    }


def failure_decomposition(steps: DataFrame, labels: dict[str, Column] | None = None, hold: float = 0.03) -> DataFrame:
    """(dimension, bucket, n, fraction, accuracy, balanced_accuracy, brier, coverage, mean_edge) by grouping sets over label columns.

    Without labels: all slices(), also their shown labels without steps, as zeros. Partial sums per set come before the
    shuffle, so a step is never copied across the network once per slice. Null labels are `unknown`.
    """
    shown: dict[str, tuple[str, ...]] = {}
    if labels is None:
        every = slices(volatility_bounds(steps), hold)
        labels, shown = {k: x for k, (x, _) in every.items()}, {k: names for k, (_, names) in every.items()}
    metrics = bucket_metrics(hold)
    rows = steps.select("*", *[F.coalesce(x, F.lit(UNKNOWN)).alias(f"_{k}") for k, x in labels.items()])
    columns = [c(f"_{k}") for k in labels]
    sets = rows.groupingSets([[x] for x in columns], *columns).agg(*[m.alias(f"m_{k}") for k, m in metrics.items()], *[F.grouping(f"_{k}").alias(f"g_{k}") for k in labels])
    of = F.coalesce(*[F.when(c(f"g_{k}") == 0, F.struct(F.lit(k).alias("dimension"), c(f"_{k}").alias("bucket"))) for k in labels])
    found = sets.select(of.alias("of"), *[c(f"m_{k}").alias(k) for k in metrics]).select("of.*", *metrics)
    total = steps.agg(F.count(F.lit(1)).alias("total"))  # one row
    found = found.join(F.broadcast(total)).withColumn("fraction", c("n") / c("total")).drop("total")
    blank = [(k, x, 0, *[0.0] * 6) for k, names in shown.items() for x in names]
    names = ["dimension", "bucket", "n", "fraction", "accuracy", "balanced_accuracy", "brier", "coverage", "mean_edge"]
    if blank:
        zeros = steps.sparkSession.createDataFrame(blank, ", ".join(f"{x} {'string' if i < 2 else 'long' if i == 2 else 'double'}" for i, x in enumerate(names)))
        found = found.select(*names).unionByName(zeros).groupBy("dimension", "bucket").agg(F.max_by(F.struct(*names[2:]), "n").alias("m")).select("dimension", "bucket", "m.*")
    return found.select(*names)


def by_volatility(steps: DataFrame) -> DataFrame:
    """Terciles of absolute returns: the bounds are the values at place floor((n - 1) / 3) and floor(2 (n - 1) / 3), upper inclusive.

    Bounds are found by counting, so a ticker of any size is sorted in no task.
    """
    rows = steps.withColumn("m", F.abs("actual_return"))
    cuts = key_ranks(rows, ("ticker",), "m", {"low": F.floor((c("n") - 1) / 3), "high": F.floor(2 * (c("n") - 1) / 3)}).withColumnRenamed("ticker", "_t")
    met = rows.join(cuts.hint("merge"), c("ticker").eqNullSafe(c("_t"))).withColumn("bucket", F.when(c("m") <= c("low"), "low").when(c("m") <= c("high"), "medium").otherwise("high"))
    return met.groupBy("ticker", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("accuracy"), brier().alias("brier"))


def risk_coverage(steps: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Accuracy and coverage of the steps at or above each confidence."""
    rows = steps.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= c("confidence"))))
    total = steps.groupBy("ticker").agg(F.count(F.lit(1)).alias("total"))
    every = total.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    found = rows.groupBy("ticker", "threshold").agg(F.avg(hit()).alias("a"), F.count(F.lit(1)).alias("k"))
    out = every.join(found.hint("merge"), ["ticker", "threshold"], "left")
    n = F.coalesce("k", F.lit(0))
    return out.select("ticker", "threshold", F.coalesce("a", F.lit(0.0)).alias("accuracy"), (n / c("total")).alias("coverage"), n.alias("selected"), "total")


def selective(steps: DataFrame, least: float, right: Column, *keys: str) -> DataFrame:
    chosen = c("confidence") >= least
    return steps.groupBy(*keys).agg(F.coalesce(F.avg(F.when(chosen, right)), F.lit(0.0)).alias("accuracy"), F.avg(chosen.cast("double")).alias("coverage"), F.count_if(chosen).alias("selected"), F.count(F.lit(1)).alias("total"))


def threshold_grid(steps: DataFrame, buys: tuple[float, ...], sells: tuple[float, ...]) -> DataFrame:
    """The (buy, sell) thresholds on predicted returns with the best accuracy; the first of equals in grid order.

    Steps are first counted by which thresholds they pass, so the grid meets a bounded table and not every step.
    """
    passed = lambda grid, x: F.size(F.filter(F.array(*map(F.lit, grid)), x))
    p = c("predicted_return")
    counts = steps.groupBy(passed(sorted(buys), lambda b: p > b).alias("b"), passed(sorted(sells, reverse=True), lambda s: p < s).alias("s"), F.signum("actual_return").alias("sign"), (F.abs("actual_return") < 0.03).alias("flat")).agg(F.count(F.lit(1)).alias("n"))
    grid = steps.sparkSession.createDataFrame([(i * len(sells) + j, b, s, sorted(buys).index(b), sorted(sells, reverse=True).index(s)) for i, b in enumerate(buys) for j, s in enumerate(sells)], "place int, buy double, sell double, bi int, si int")
    met = F.broadcast(grid).join(counts)
    right = F.when(c("b") > c("bi"), c("sign") > 0).when(c("s") > c("si"), c("sign") < 0).otherwise(c("flat"))
    scored = met.groupBy("place", "buy", "sell").agg((F.sum(F.when(right, c("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return scored.agg(F.max_by(F.struct("buy", "sell", "accuracy"), F.struct("accuracy", -c("place"))).alias("best")).select("best.*")


def naive_baselines(steps: DataFrame) -> DataFrame:
    """A coin flip that always holds, and the last direction at .65 / .35 (the first row holds at .5)."""
    before = F.lag("actual_return").over(Window.partitionBy("ticker", "horizon").orderBy("t"))
    rows = steps.withColumn("before", before)
    last = rows.withColumns({"predicted_prob": F.when(c("before").isNull(), 0.5).when(c("before") > 0, 0.65).otherwise(0.35), "recommendation": F.when(c("before").isNull(), "HOLD").when(c("before") > 0, "BUY").otherwise("SELL")})
    coin = rows.withColumns({"predicted_prob": F.lit(0.5), "recommendation": F.lit("HOLD")})
    each = lambda df, name: df.groupBy("ticker", "horizon").agg(brier().alias("brier"), F.avg(hit()).alias("accuracy")).withColumn("baseline", F.lit(name))
    return each(coin, "coin").unionByName(each(last, "last_period"))


def baseline_guard(steps: DataFrame, slack: float = 0.02) -> DataFrame:
    best = naive_baselines(steps).groupBy("ticker", "horizon").agg(F.max("accuracy").alias("baseline_accuracy"))
    own = report(steps, "ticker", "horizon", metrics={"accuracy": F.avg(hit())})
    return own.join(best.hint("merge"), ["ticker", "horizon"]).withColumn("passes", c("accuracy") - c("baseline_accuracy") >= -slack)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def rank_failure_buckets(steps: DataFrame, top: int = 10) -> DataFrame:
    """Weak buckets first, the weakest of each dimension, against the overall metrics."""
    overall = steps.agg(F.avg(hit()).alias("a0"), brier().alias("b0"), F.avg(edge()).alias("e0"))
    rows = failure_decomposition(steps, buckets()).where("n >= 5").join(F.broadcast(overall))  # one row
    weak = (0.5 * (c("a0") - c("accuracy")) + 0.3 * (c("brier") - c("b0")) + 0.2 * (c("e0") - c("mean_edge"))) * (0.5 + 0.5 * F.sqrt("fraction"))
    low, high = wilson(c("accuracy") * c("n"), c("n"))
    ranked = rows.withColumn("weakness", weak).withColumn("i", F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("weakness"), "bucket"))).where("i = 1")
    return ranked.select("dimension", "bucket", "n", "weakness", low.alias("low"), high.alias("high")).orderBy(F.desc("weakness"), "dimension").limit(top)


def policy_ablation(steps: DataFrame, policies: dict[str, Callable[[Column], Column]], threshold: float = 0.3) -> DataFrame:
    """Accuracy and coverage under each confidence policy (a function of the confidence column), by regime partition."""
    adjusted = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), f(c("confidence")).alias("conf")) for k, f in policies.items()])).alias("p")
    rows = steps.select("*", adjusted).withColumn("chosen", c("p.conf") >= threshold)
    return rows.groupBy("p.policy", buckets()["trend_vs_chop"].alias("partition")).agg(F.coalesce(F.avg(F.when(c("chosen"), hit())), F.lit(0.0)).alias("accuracy"), F.avg(c("chosen").cast("double")).alias("coverage"))


def arm_deltas(scores: DataFrame, arm: str, baseline: str, *metrics: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metric differences of each arm against the baseline arm."""
    base = scores.where(c(arm) == baseline).select(*keys, *[c(m).alias(f"_{m}") for m in metrics])
    rest = scores.where(c(arm) != baseline)
    met = rest.join(base.hint("merge"), list(keys)) if keys else rest.join(F.broadcast(base))  # one baseline row
    return met.select(arm, *keys, *[(c(m) - c(f"_{m}")).alias(f"d_{m}") for m in metrics])


def bucket_report(steps: DataFrame, bucket: Column, labels: tuple[str, ...]) -> DataFrame:
    """(bucket, n, fraction, accuracy, balanced, brier, coverage, edge) of each label, also of those without steps; others are `unknown`."""
    known = steps.withColumn("bucket", F.when(bucket.isin(*labels), bucket).otherwise("unknown"))
    found = known.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(hit()).alias("accuracy"), balanced().alias("balanced"), brier().alias("brier"), F.avg(covered()).alias("coverage"), F.avg(edge()).alias("edge"))
    every = steps.sparkSession.createDataFrame([(x,) for x in dict.fromkeys([*labels, "unknown"])], "bucket string")
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # as many rows as labels
    out = every.join(found.hint("merge"), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.withColumn("fraction", F.when(total > 0, c("n") / total).otherwise(0.0))
    return out.select("bucket", "n", "fraction", "accuracy", "balanced", "brier", "coverage", "edge")


def band(x: Column, cuts: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """The label of the first cut that x is below, else the last one; null: null."""
    out = F.when(x < cuts[0], labels[0])
    for cut, label in zip(cuts[1:], labels[1:-1], strict=True):
        out = out.when(x < cut, label)
    return F.when(x.isNotNull(), out.otherwise(labels[-1]))
