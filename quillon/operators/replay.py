"""Labels of recorded forecasts, their benchmarks and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp, half_up
from quillon.operators import joins as J

c = F.col
HORIZONS = (1, 2, 3)
#: Gates by horizon: labelled, traded, abstain rate, Brier score; fixed values of the readiness rule.
GATES = {1: (30, 15, 0.45, 0.24), 2: (25, 12, 0.50, 0.25), 3: (20, 10, 0.55, 0.26)}


def label_markets(markets: DataFrame, prices: DataFrame) -> DataFrame:
    """Outcome of each market (key, market_id, captured, target, level, high_level, semantics) from its price path.

    terminal: settled at or above the level; barrier: touched it; range: settled between the two. A market whose
    target lies after the last price is not labelled (null); one whose key has no price has no row.
    """
    settled = J.settlement(markets, prices, "key")
    path = J.path_in_window(markets, prices, "key").select("key", "captured", "target", "high")
    last = prices.groupBy("key").agg(F.max("at").alias("last"))
    sums = markets.join(settled.hint("shuffle_merge"), ["key", "target"]).join(path.hint("shuffle_merge"), ["key", "captured", "target"], "left").join(last.hint("shuffle_merge"), "key")
    hit = F.when(c("semantics") == "terminal", c("settled") >= c("level")).when(c("semantics") == "barrier", c("high") >= c("level")).when(c("semantics") == "range", c("settled").between(c("level"), c("high_level")))
    return sums.select("market_id", "semantics", (c("last") >= c("target")).alias("ready"), F.when(c("last") >= c("target"), F.when(hit, "yes").when(~hit, "no")).alias("outcome"))


def label_bundles(bundles: DataFrame, labels: DataFrame) -> DataFrame:
    """Bundles (bundle_id, markets array) with their markets' outcomes nested again; unready bundles pass through."""
    long = bundles.select("bundle_id", F.posexplode("markets").alias("pos", "market_id"))
    met = long.join(labels.hint("merge"), "market_id", "left")
    nested = met.groupBy("bundle_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "market_id", "outcome"))), lambda x: F.struct(x.market_id.alias("market_id"), x.outcome.alias("outcome"))).alias("semantic"), F.bool_and(F.coalesce("ready", F.lit(False))).alias("ready"))
    return bundles.join(nested.hint("merge"), "bundle_id", "left").withColumn("semantic", F.when(c("ready"), c("semantic")))


def evidence(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 2, "thin").otherwise("rich")


def implied_probability(richness: Column) -> Column:
    return F.when(richness == "rich", 0.78).when(richness == "thin", 0.68).otherwise(0.58)


#: Fixed values of the trade score: weight of a market's meaning, and what whales, flat outlooks, breaks and leverage cost.
MEANING, MEANING_OTHER = {"terminal": 1.0, "barrier_touch": 0.4, "path_dependent": 0.4, "ambiguous": 0.5}, 0.7
WHALE, FLAT, BREAK, LEVER = 0.0025, 0.006, 0.0025, 0.00035


def trade_scores(rows: DataFrame, *keys: str) -> DataFrame:
    """Long and short score of every row: (keys, direction, edge_pct, score, leverage_pnl_pct, risk_reward).

    Rows: model_return, model_weight, market_return, market_weight, semantics, flat, is_break, whale (long, short or
    neutral), whale_confidence, leverage, price, low, high. A side's edge is its signed weighted return, the market's
    by what its question means, more or less by the whales; a flat outlook above 0.55, a break and leverage from 5
    on cost score. Risk and reward: the edge, 0.004 at least, over the way to the interval's bound against the side
    (no bound: 1.5 times the edge, 0.006 at least); null without a price. Null returns, weights, flags and whales count as none.
    """
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sides = rows.withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    long = c("direction") == "long"
    meaning = F.coalesce(*[F.when(c("semantics") == k, v) for k, v in MEANING.items()], F.lit(MEANING_OTHER))
    whale = F.when(F.coalesce("whale", F.lit("neutral")) == "neutral", 0.0).when(c("whale") == c("direction"), WHALE).otherwise(-WHALE) * zero(c("whale_confidence"))
    total = zero(c("model_return")) * zero(c("model_weight")) + zero(c("market_return")) * zero(c("market_weight")) * meaning
    edge = F.when(long, total).otherwise(-total) + whale
    lever = F.coalesce(c("leverage"), F.lit(1.0))
    cost = FLAT * clamp(zero(c("flat")) - 0.55, 0.0, 0.4) + F.when(F.coalesce("is_break", F.lit(False)), BREAK).otherwise(0.0) + F.when(lever >= 5, LEVER * (lever - 4)).otherwise(0.0)
    move = F.greatest(F.abs(c("edge")), F.lit(0.004))
    bound = F.when(long & (c("low") != 0), F.try_divide(c("price") - c("low"), "price")).when(~long & (c("high") != 0), F.try_divide(c("high") - c("price"), "price"))
    against = F.coalesce(F.greatest(F.when(bound.isNotNull(), F.lit(0.001)), bound), F.greatest(F.lit(0.006), 1.5 * move))
    return sides.withColumn("edge", edge).select(
        *keys, "direction", half_up(100 * c("edge"), 3).alias("edge_pct"), half_up(c("edge") - cost, 5).alias("score"), half_up(100 * c("edge") * lever, 2).alias("leverage_pnl_pct"),
        F.when(c("price") > 0, half_up(move / against, 2)).alias("risk_reward"),
    )


def replay_slices(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Total, traded, accuracy over traded, Brier over all and abstain rate of every slice: one aggregation."""
    long = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("bucket")) for k, v in slices.items()])).alias("s")).select("*", "s.slice", "s.bucket").drop("s")
    traded = c("action") != "HOLD"
    return long.groupBy("slice", "bucket").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(traded).alias("traded"), F.coalesce(F.avg(F.when(traded, c("right").cast("double"))), F.lit(0.0)).alias("accuracy"),
        F.avg(F.pow(c("p") - c("y"), 2)).alias("brier"), F.avg((~traded).cast("double")).alias("abstain_rate"),
    )


def compare_gate(scores: DataFrame, candidate: str, baseline: str, tolerance: float = 0.02) -> DataFrame:
    """Whether a candidate's accuracy, Brier score and abstain rate hold against the baseline, with reasons."""
    a, b = scores.where(c("evaluator") == candidate), scores.where(c("evaluator") == baseline).select("horizon", *[c(x).alias(f"b_{x}") for x in ("accuracy", "brier", "abstain_rate")])
    met = a.join(b.hint("merge"), "horizon")
    reasons = F.array_compact(F.array(F.when(c("accuracy") < c("b_accuracy") - tolerance, "accuracy"), F.when(c("brier") > c("b_brier") + tolerance, "brier"), F.when(c("abstain_rate") > c("b_abstain_rate") + tolerance, "abstain")))
    return met.select("horizon", (F.size(reasons) == 0).alias("passes"), F.array_join(reasons, ",").alias("reasons"))


def horizon_benchmark(rows: DataFrame, horizons: tuple[int, ...] = HORIZONS, *keys: str) -> DataFrame:
    """Counts and rates by horizon (and keys), absent horizons included."""
    traded = c("action") != "HOLD"
    found = rows.groupBy("horizon", *keys).agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("labelled"), F.count_if(traded).alias("traded"), F.avg(F.when(traded, c("right").cast("double"))).alias("accuracy"), F.avg(F.pow(c("p") - c("y"), 2)).alias("brier"), F.avg((~traded).cast("double")).alias("abstain_rate"))
    every = rows.select(*keys).distinct() if keys else rows.sparkSession.range(1)
    grid = every.select(*keys, F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    return grid.join(found.hint("merge"), ["horizon", *keys], "left").select("horizon", *keys, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "labelled", "traded")], "accuracy", "brier", "abstain_rate")


def readiness_gate(bench: DataFrame, gates: dict[int, tuple[float, ...]] = GATES) -> DataFrame:
    """pass or hold for each horizon, with reasons."""
    at = lambda i: F.coalesce(*[F.when(c("horizon") == h, float(g[i])) for h, g in gates.items()])
    reasons = F.array_compact(F.array(F.when(c("labelled") < at(0), "labelled"), F.when(c("traded") < at(1), "traded"), F.when(c("abstain_rate") > at(2), "abstain"), F.when(F.coalesce("brier", F.lit(1.0)) > at(3), "brier")))
    return bench.where(c("horizon").isin(*gates)).select("horizon", F.when(F.size(reasons) == 0, "pass").otherwise("hold").alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


def rank_variants(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Variants by kept - regressed + a quarter of their share of attempts, with a health class; untried ones included."""
    found = ledger.groupBy("variant").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(c("decision") == "keep").alias("kept"), F.count_if(c("decision") == "regress").alias("regressed"))
    rows = catalog.join(found.hint("merge"), "variant", "left").select("variant", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("attempts", "kept", "regressed")])
    total = F.greatest(F.sum("attempts").over(Window.partitionBy()), F.lit(1))
    score = c("kept") - c("regressed") + 0.25 * c("attempts") / total
    health = F.when(c("attempts") == 0, "untried").when(c("kept") > c("regressed"), "healthy").when(c("kept") == c("regressed"), "mixed").otherwise("failing")
    return rows.select("variant", "attempts", "kept", "regressed", score.alias("score"), health.alias("health"))


def promote_labelled(rows: DataFrame, gate: DataFrame, path: str) -> bool:
    """Write a labelled set once all its horizons passed; whether it was written."""
    if not gate.where("verdict <> 'pass'").isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True
