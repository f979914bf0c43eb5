"""Whole labels of recorded forecasts: realised prices, outcomes of their markets, frozen selections, promotion with a receipt."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp
from quillon.operators import joins as J
from quillon.operators.markets import extract_price_levels, question_semantics
from quillon.operators.scratch import written

c = F.col

#: Meanings of a question, in the order in which equal counts are ranked.
MEANINGS = ("terminal", "barrier_touch", "range", "path_dependent", "ambiguous", "unknown")
#: Words of a question that turn its comparison round; without any it asks for a price above the level.
AT_LEAST, AT_MOST, BELOW = "at least|not below", "at most|not above", "below|under|less than"
FALLS, TRADES_AT, NEAR = "dip|drop below|fall below|below|under", "trade at", 0.0025
#: Implied probability by confidence, and the least quality of rich evidence.
IMPLIED, RICH_QUALITY = {"low": 0.58, "medium": 0.68, "high": 0.78}, 60
RECEIPT = "replay-label-promotion-receipt.v1"

# Prices near a level are looked up in logarithmic bands narrower than the tolerance: the level's own band lies within
# it, and the two on either side hold the rest of it.
_BAND = math.log1p(0.8 * NEAR)


def _says(question: Column, words: str) -> Column:
    return F.coalesce(F.lower(question).rlike(rf"\b(?:{words})\b"), F.lit(False))


def terminal_hit(question: Column, level: Column, settled: Column) -> Column:
    """Whether the settled price answers a terminal question with yes."""
    strict = F.when(_says(question, BELOW), settled < level).otherwise(settled > level)
    return F.when(_says(question, AT_LEAST), settled >= level).when(_says(question, AT_MOST), settled <= level).otherwise(strict)


def barrier_hit(question: Column, level: Column, low: Column, high: Column, near: Column) -> Column:
    """Whether a path (lowest, highest price, and if one came near the level) answers a barrier question; null without a path."""
    crossed = F.when(_says(question, FALLS), low <= level).otherwise(high >= level)
    return F.when(_says(question, TRADES_AT), F.coalesce(near, F.lit(False))).otherwise(crossed)


def came_near(targets: DataFrame, prices: DataFrame) -> DataFrame:
    """(key, captured, target, level) whose path between capture and target has a price within 0.25 % of the level.

    Price bands stand beside the key, so the path join that serves ranges of time serves this rectangle of time and
    price: of a band below the level only the highest price matters, of one above only the lowest.
    """
    band = lambda price: F.floor(F.log(price) / _BAND)
    key = lambda k, b: F.struct(k.alias("key"), b.alias("band")).alias("k")
    here = band(c("level"))
    want = targets.where("level > 0").select("key", "captured", "target", "level", F.explode(F.sequence(here - 2, here + 2)).alias("band"))
    want = want.select(key(c("key"), c("band")), "captured", "target", "level")
    path = J.path_in_window(want, prices.select(key(c("key"), band(c("price"))), "at", "price"), "k")
    met = want.join(path.hint("shuffle_merge"), ["k", "captured", "target"])
    within = lambda price: F.abs(price - c("level")) / c("level") <= NEAR
    return met.where(within(c("low")) | within(c("high"))).select(c("k.key").alias("key"), "captured", "target", "level").distinct()


def label_replay(bundles: DataFrame, prices: DataFrame) -> DataFrame:
    """Bundles with the labels that a price history allows, the rest passed through with the reasons why they wait.

    bundles: bundle_id (unique), key, captured, horizon_days, price, markets array of (market_id, question, semantics,
    levels, target); prices: key, at, price. A market without a target has the forecast's. Added columns: ready,
    pending (reasons, comma-joined), realised_price, realised_return, actual (1 above zero), and semantic, an array of
    (market_id, semantics, outcome) with outcome yes, no or unsupported; all null but pending unless ready. Ready are
    bundles with a price whose forecast and markets (ambiguous ones apart) end by the last price of the key. Null or
    non-positive prices are no history. A question is unsupported without a first level (range: two levels), without
    a path, or with another meaning. Null markets are none; bundles repeated under one id would share their labels.
    """
    points = prices.where((c("price") > 0) & c("key").isNotNull() & c("at").isNotNull()).select("key", c("at").cast("timestamp").alias("at"), "price")
    last = points.groupBy("key").agg(F.max("at").alias("last"))
    start = c("captured").cast("timestamp")
    ends = start + F.make_interval(days=c("horizon_days").cast("int"))
    own = bundles.select("bundle_id", "key", start.alias("captured"), ends.alias("ends"), "price", F.posexplode_outer("markets").alias("pos", "m"))
    own = own.select("*", F.coalesce(c("m.target").cast("timestamp"), c("ends")).alias("target"))
    long = J.dimension_join(own, last, "key", how="left")

    wanted = long.where("price is not null and last >= ends")
    targets = wanted.select("key", c("ends").alias("target")).unionByName(wanted.where("last >= target").select("key", "target"))
    settled = written(J.settlement(targets, points, "key"), "settled")  # two joins read it
    barriers = wanted.where("m.semantics = 'barrier_touch' and last >= target").select("key", "captured", "target", F.get(c("m.levels"), F.lit(0)).alias("level"), c("m.question").alias("question"))
    path = J.path_in_window(barriers, points, "key").select("key", "captured", "target", "low", "high")
    near = came_near(barriers.where(_says(c("question"), TRADES_AT)), points).withColumn("near", F.lit(True))

    level = F.get(c("m.levels"), F.lit(0))
    level = F.when(~F.isnan(level), level)
    ordered = F.array_sort(F.filter("m.levels", lambda x: x.isNotNull() & ~F.isnan(x)))
    meaning, question = c("m.semantics"), c("m.question")
    hit = F.when(meaning == "terminal", terminal_hit(question, level, c("settled")))
    hit = hit.when(meaning == "barrier_touch", F.when(c("low").isNotNull() & level.isNotNull(), barrier_hit(question, level, c("low"), c("high"), c("near"))))
    hit = hit.when((meaning == "range") & (F.size(ordered) > 1), c("settled").between(F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))))
    rows = long.withColumn("level", level).join(settled.hint("shuffle_merge"), ["key", "target"], "left")
    rows = rows.join(path.hint("shuffle_merge"), ["key", "captured", "target"], "left").join(near.hint("shuffle_merge"), ["key", "captured", "target", "level"], "left")
    outcome = F.when(hit, "yes").when(~hit, "no").otherwise("unsupported")
    nested = rows.groupBy("bundle_id").agg(
        F.array_sort(F.collect_list(F.when(c("m").isNotNull(), F.struct("pos", c("m.market_id").alias("market_id"), meaning.alias("semantics"), outcome.alias("outcome"))))).alias("found"),
        F.first("key").alias("key"), F.first("ends").alias("target"), F.first("price").alias("_price"), F.first("last").alias("_last"),
        F.bool_and(c("m").isNull() | (meaning == "ambiguous") | F.coalesce(c("last") >= c("target"), F.lit(False))).alias("_markets"),
    )
    done = nested.join(settled.hint("shuffle_merge"), ["key", "target"], "left")
    late = F.coalesce(c("_last") < c("target"), F.lit(True))
    why = F.when(c("_last").isNull(), "no_history").otherwise(
        F.array_join(F.array_compact(F.array(F.when(c("_price").isNull(), "no_price").when(late, "forecast_open"), F.when(~c("_markets"), "market_open"))), ","))
    ready = c("pending") == ""
    gain = F.try_divide(c("settled") - c("_price"), c("_price"))
    labels = done.withColumn("pending", why).select(
        "bundle_id", ready.alias("ready"), "pending", F.when(ready, c("settled")).alias("realised_price"), F.when(ready, gain).alias("realised_return"), F.when(ready, (gain > 0).cast("int")).alias("actual"),
        F.when(ready, F.transform("found", lambda x: x.dropFields("pos"))).alias("semantic"),
    )
    return bundles.join(labels.hint("merge"), "bundle_id", "left")


def primary_semantics(meanings: Column) -> Column:
    """The most frequent meaning of an array; of equals, and without any, the first in the fixed order."""
    found = F.coalesce(meanings, F.array().cast("array<string>"))
    times = lambda name: F.size(F.filter(found, lambda x: x == name))
    counts = [F.struct(times(m).alias("n"), F.lit(-i).alias("rank"), F.lit(m).alias("name")) for i, m in enumerate(MEANINGS)]
    return F.array_max(F.array(*counts))["name"]


def evidence_richness(markets: Column, quality: Column, warnings: Column) -> Column:
    """none without markets; rich with two or more, a quality of 60 and no warning; else thin. Nulls count as zero."""
    n, q, w = (F.coalesce(x, F.lit(0)) for x in (markets, quality, warnings))
    return F.when(n == 0, "none").when((n >= 2) & (q >= RICH_QUALITY) & (w == 0), "rich").otherwise("thin")


def implied_probability(confidence: Column, direction: Column, enters: Column) -> Column:
    """Probability of a rise behind a verdict: by confidence for long, its complement for short, even without a trade."""
    up = F.coalesce(*[F.when(confidence == k, v) for k, v in IMPLIED.items()])
    return F.when(~F.coalesce(enters, F.lit(False)), 0.5).when(direction == "long", up).when(direction == "short", 1 - up).otherwise(0.5)


def freeze_bundles(selected: DataFrame, markets: DataFrame) -> DataFrame:
    """The chosen markets of every bundle as they were, in the order chosen, with meaning and price levels of their questions.

    selected: bundle_id, ids array; markets: market_id (unique), asset_id, question, probability, target. Ids without a
    market, blank ids and markets without an asset_id are left out and counted in `skipped`; an id chosen twice stays twice.
    """
    ids = selected.select("bundle_id", F.posexplode_outer("ids").alias("pos", "market_id"))
    rows = markets.select("market_id", "asset_id", "question", "probability", "target")
    met = ids.join(rows.hint("merge"), "market_id", "left")
    kind = question_semantics(c("question"))
    kind = F.when(kind == "barrier", "barrier_touch").when(kind == "path", "path_dependent").otherwise(kind)
    kept = (F.trim(c("market_id").cast("string")) != "") & (F.trim(c("asset_id").cast("string")) != "")
    row = F.struct("pos", "market_id", "question", "probability", "target", kind.alias("semantics"), extract_price_levels(c("question")).alias("levels"))
    out = met.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.when(kept, row))).alias("m"), F.count_if(c("pos").isNotNull() & ~F.coalesce(kept, F.lit(False))).alias("skipped"))
    return out.select("bundle_id", F.transform("m", lambda x: x.dropFields("pos")).alias("markets"), "skipped")


#: Fixed values of the whale verdict: lead that one side needs, confidence without and with direction, its slope and top.
WHALE_LEAD, WHALE_NONE, WHALE_BASE, WHALE_SLOPE, WHALE_MOST = 1.1, 0.35, 0.40, 0.45, 0.9


def whale_flow(transfers: DataFrame, *keys: str, exchanges: tuple[str, ...]) -> DataFrame:
    """Direction and confidence of large transfers (keys, value_usd, from_owner, to_owner), one aggregation.

    Money that leaves an exchange is long, money that comes to one is short, any other unresolved; an owner is an
    exchange if it holds one of the markers. Null, NaN and non-positive values count nothing.
    """
    at = lambda owner: F.coalesce(F.lower(owner).rlike("|".join(rf"\Q{x}\E" for x in exchanges)), F.lit(False))
    out, to = at(c("from_owner")), at(c("to_owner"))
    usd = F.when((c("value_usd") > 0) & ~F.isnan("value_usd"), c("value_usd")).otherwise(0.0)
    total = lambda when: F.sum(F.when(when, usd).otherwise(0.0))
    sums = transfers.groupBy(*keys).agg(total(out & ~to).alias("long_usd"), total(to & ~out).alias("short_usd"), total(out == to).alias("unresolved_usd"))
    directed = c("long_usd") + c("short_usd")
    side = F.when(c("long_usd") > WHALE_LEAD * c("short_usd"), "long").when(c("short_usd") > WHALE_LEAD * c("long_usd"), "short").otherwise("neutral")
    sure = clamp(WHALE_BASE + WHALE_SLOPE * F.try_divide(F.abs(c("long_usd") - c("short_usd")), directed), 0.0, WHALE_MOST)
    return sums.select("*", F.when(directed > 0, side).otherwise("neutral").alias("direction"), F.when(directed > 0, sure).otherwise(WHALE_NONE).alias("confidence"))


def promote(staged: str, target: str, receipt: str, gate: DataFrame, at: datetime | str, raw: str | None = None) -> DataFrame | None:
    """Copy a labelled set (Parquet, with realised_price) to its place once all its horizons passed, with a receipt (JSON).

    The receipt is written last, from the rows read back, so a set without one is not promoted; a failed run can be
    repeated. Returns the receipt, or None if a horizon is on hold. Places that coincide (the raw capture's included)
    and an empty gate are errors; they are compared as given, without a closing slash.
    """
    spark = gate.sparkSession
    places = [x.rstrip("/") for x in (staged, target, receipt, raw) if x]
    if len(set(places)) < len(places):
        raise ValueError(f"staged, promoted, receipt and raw places must differ: {places}")
    verdicts = {r[0] for r in gate.select("verdict").distinct().collect()}
    if not verdicts:
        raise ValueError("no gate row: nothing was judged")
    if verdicts != {"pass"}:
        return None
    spark.read.parquet(staged).write.mode("overwrite").parquet(target)
    counts = spark.read.parquet(target).agg(F.count(F.lit(1)).alias("bundles"), F.count("realised_price").alias("labelled"))
    row = counts.select(F.lit(RECEIPT).alias("version"), F.lit(str(at)).alias("promoted_at"), F.lit(staged).alias("source"), F.lit(target).alias("target"), "bundles", "labelled")
    row.coalesce(1).write.mode("overwrite").json(receipt)
    return spark.read.schema(row.schema).json(receipt)
