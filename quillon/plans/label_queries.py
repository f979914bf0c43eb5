"""Queries over whole labels of recorded forecasts, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import labels as L
from quillon.operators import replay as P
from quillon.plans.base import ORACLES, QUERIES, duck, query, shared_folder, tidy, view

c = F.col

_ASKED = ("Will it close above it", "Will it be at least there", "Will it be at most there", "Will it end below it", "Will it drop below it", "Will it reach it", "Will it trade at it")
_MEANS = ("terminal", "barrier_touch", "range", "path_dependent", "ambiguous")


def bundles_of(orders: DataFrame) -> DataFrame:
    """A forecast per customer, made at the first order: totals of later orders are its prices."""
    first = orders.groupBy(c("o_custkey").alias("key")).agg(F.to_date(F.min("o_orderdate")).alias("captured"), F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("p"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    market = lambda k: F.struct((4 * c("key") + k).alias("market_id"), pick(_ASKED, c("key") + 2 * k).alias("question"), pick(_MEANS, c("key") + k).alias("semantics"), F.array((10 - k) * c("p") / 10, (10 + k) * c("p") / 10).alias("levels"), F.when(c("key") % 4 > 0, F.date_add("captured", 150 * (k + 1))).alias("target"))
    return first.select(c("key").alias("bundle_id"), "key", "captured", (100 + c("key") % 400).cast("int").alias("horizon_days"), F.when(c("key") % 9 > 0, c("p")).alias("price"), F.when(c("key") % 11 > 0, F.array(*[market(k) for k in range(4)])).alias("markets"))


def prices_of(orders: DataFrame) -> DataFrame:
    return orders.select(c("o_custkey").alias("key"), F.to_date("o_orderdate").alias("at"), c("o_totalprice").alias("price"))


_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_BUNDLES = f"""f AS (SELECT o_custkey AS key, min(o_orderdate)::DATE AS captured, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS p, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1), b AS (SELECT *, captured + (100 + key % 400)::INT AS ends FROM f),
    m AS (SELECT *, {_LIST(_ASKED)}[(key + 2 * k) % 7 + 1] AS q, {_LIST(_MEANS)}[(key + k) % 5 + 1] AS s, (10 - k) * p / 10 AS low, (10 + k) * p / 10 AS top, CASE WHEN key % 4 > 0 THEN captured + 150 * (k + 1) ELSE ends END AS target FROM (SELECT *, unnest([0, 1, 2, 3]) AS k FROM b WHERE key % 11 > 0))"""
_OUTCOMES = f"""WITH {_BUNDLES}, w AS (SELECT key, k, any_value(q) AS q, any_value(s) AS s, any_value(low) AS low, any_value(top) AS top, any_value(target) AS target, any_value(last) AS last, min_by(o_totalprice, (o_orderdate, o_totalprice)) FILTER (o_orderdate::DATE >= target) AS settled,
        min(o_totalprice) FILTER (o_orderdate::DATE BETWEEN captured AND target) AS lo, max(o_totalprice) FILTER (o_orderdate::DATE BETWEEN captured AND target) AS hi, coalesce(bool_or(abs(o_totalprice - low) / low <= 0.0025::DOUBLE) FILTER (o_orderdate::DATE BETWEEN captured AND target), false) AS near FROM m JOIN orders ON o_custkey = key GROUP BY key, k),
    o AS (SELECT *, CASE s WHEN 'terminal' THEN CASE WHEN q LIKE '%at least%' THEN settled >= low WHEN q LIKE '%at most%' THEN settled <= low WHEN q LIKE '%below%' THEN settled < low ELSE settled > low END
        WHEN 'barrier_touch' THEN CASE WHEN q LIKE '%trade at%' THEN near WHEN q LIKE '%below%' THEN lo <= low ELSE hi >= low END WHEN 'range' THEN settled BETWEEN low AND top END AS hit FROM w),
    g AS (SELECT key, bool_and(s = 'ambiguous' OR last >= target) AS markets, string_agg(4 * key + k || ':' || CASE WHEN hit THEN 'yes' WHEN NOT hit THEN 'no' ELSE 'unsupported' END, ',' ORDER BY k) AS labels FROM o GROUP BY 1),
    r AS (SELECT b.key, CASE WHEN b.key % 9 > 0 THEN p END AS price, coalesce(labels, '') AS labels, min_by(o_totalprice, (o_orderdate, o_totalprice)) FILTER (o_orderdate::DATE >= ends) AS settled, concat_ws(',', CASE WHEN b.key % 9 = 0 THEN 'no_price' WHEN any_value(last) < any_value(ends) THEN 'forecast_open' END, CASE WHEN NOT any_value(markets) THEN 'market_open' END) AS pending FROM b LEFT JOIN g USING (key) JOIN orders ON o_custkey = b.key GROUP BY b.key, p, labels)"""
_LABELLED = f"""{_OUTCOMES} SELECT key AS bundle_id, (pending = '')::INT AS ready, pending, CASE WHEN pending = '' THEN round(settled, 8) END AS realised_price, CASE WHEN pending = '' THEN round((settled - price) / price, 8) END AS realised_return,
    CASE WHEN pending = '' THEN (settled > price)::INT END AS actual, CASE WHEN pending = '' THEN labels END AS labels FROM r"""
_SHOWN = ("bundle_id", "ready", "pending", "realised_price", "realised_return", "actual")
query("mkt_38_label_replay", "orders", sql=_LABELLED)(
    lambda o: L.label_replay(bundles_of(o), prices_of(o)).select(*_SHOWN, F.array_join(F.transform("semantic", lambda x: F.concat_ws(":", x.market_id.cast("string"), x.outcome)), ",").alias("labels")))
query("mkt_39_primary_semantics", "orders", sql=f"""WITH {_BUNDLES}, n AS (SELECT key, s, count(*) AS n FROM m GROUP BY ALL), t AS (SELECT key, max_by(s, (n, -list_position({_LIST(L.MEANINGS)}, s))) AS s FROM n GROUP BY 1)
    SELECT key AS bundle_id, coalesce(s, 'terminal') AS primary, CASE WHEN key % 11 = 0 THEN 'none' WHEN key % 100 >= 60 AND key % 3 = 0 THEN 'rich' ELSE 'thin' END AS evidence, round(CASE WHEN key % 5 = 0 OR key % 3 = 2 THEN 0.5 WHEN key % 3 = 0 THEN [0.58, 0.68, 0.78][key % 2 + 1] ELSE 1 - [0.58, 0.68, 0.78][key % 2 + 1] END::DOUBLE, 8) AS p FROM b LEFT JOIN t USING (key)""")(
    lambda o: bundles_of(o).select("bundle_id", L.primary_semantics(c("markets.semantics")).alias("primary"), L.evidence_richness(F.array_size("markets"), c("key") % 100, c("key") % 3).alias("evidence"),
        L.implied_probability(F.get(F.array(F.lit("low"), F.lit("medium")), (c("key") % 2).cast("int")), F.get(F.array(F.lit("long"), F.lit("short"), F.lit("neutral")), (c("key") % 3).cast("int")), c("key") % 5 > 0).alias("p")))

_Q = "CASE CAST(market_id % 6 AS INT) WHEN 0 THEN 'Will it close above $' WHEN 1 THEN 'Will it reach $' WHEN 2 THEN 'Between $5 and $' WHEN 3 THEN 'Can it stay near $' WHEN 4 THEN 'What of $' ELSE '' END || CASE WHEN market_id % 6 = 5 THEN '' ELSE market_id || 'k?' END"
_FROZEN = f"""WITH s AS (SELECT market_id, asset, probability, market_id % 7 > 0 AS named, {_Q} AS q FROM {{v_markets}})
    SELECT asset AS bundle_id, count(*) FILTER (NOT named) AS skipped, string_agg(market_id || ':' || ['terminal', 'barrier_touch', 'range', 'path_dependent', 'unknown', 'ambiguous'][market_id % 6 + 1] || ':' || CASE WHEN market_id % 6 = 5 THEN '' ELSE (market_id * 1000)::BIGINT::VARCHAR END, ',' ORDER BY market_id) FILTER (named) AS markets FROM s GROUP BY 1"""


@query("mkt_44_freeze_bundles", "v_markets", sql=_FROZEN)
def _freeze(m):  # noqa: ANN001, ANN202
    rows = m.select("market_id", F.when(c("market_id") % 7 > 0, "token").otherwise(" ").alias("asset_id"), F.expr(_Q).alias("question"), "probability", F.lit(None).cast("date").alias("target"))
    chosen = m.groupBy(c("asset").alias("bundle_id")).agg(F.array_sort(F.collect_list("market_id")).alias("ids"))
    text = F.transform("markets", lambda x: F.concat_ws(":", x.market_id.cast("string"), x.semantics, F.array_join(F.transform(x.levels, lambda v: v.cast("long").cast("string")), "/")))
    return L.freeze_bundles(chosen, rows).select("bundle_id", "skipped", F.array_join(text, ",").alias("markets"))


# Markers of an exchange in an owner's name.
EXCHANGES = ("exchange", "binance", "coinbase", "kraken", "bitfinex", "okx", "bybit", "gemini", "huobi", "kucoin")
_OWNER = lambda x: f"CASE CAST({x} AS INT) WHEN 0 THEN 'Kraken hot 3' WHEN 1 THEN 'my vault' WHEN 2 THEN 'some EXCHANGE' WHEN 3 THEN NULL ELSE '' END"
_VALUE = "CASE WHEN event_id % 13 = 0 THEN -value WHEN event_id % 17 > 0 THEN value END"
query("mkt_44_whale_flow", "events", sql=f"""WITH t AS (SELECT user_id, CASE WHEN {_VALUE} > 0 THEN value ELSE 0 END AS v, event_id % 5 IN (0, 2) AS f, (event_id // 5) % 5 IN (0, 2) AS t FROM events),
    g AS (SELECT user_id, coalesce(sum(v) FILTER (f AND NOT t), 0) AS l, coalesce(sum(v) FILTER (t AND NOT f), 0) AS s, coalesce(sum(v) FILTER (f = t), 0) AS u FROM t GROUP BY 1)
    SELECT user_id, round(l, 6) AS long_usd, round(s, 6) AS short_usd, round(u, 6) AS unresolved_usd, CASE WHEN l + s = 0 THEN 'neutral' WHEN l > 1.1::DOUBLE * s THEN 'long' WHEN s > 1.1::DOUBLE * l THEN 'short' ELSE 'neutral' END AS direction, round(CASE WHEN l + s > 0 THEN least(0.9, 0.4 + 0.45 * abs(l - s) / (l + s)) ELSE 0.35 END::DOUBLE, 6) AS confidence FROM g""")(
    lambda e: L.whale_flow(e.select("user_id", F.expr(_VALUE).alias("value_usd"), F.expr(_OWNER("event_id % 5")).alias("from_owner"), F.expr(_OWNER("(event_id div 5) % 5")).alias("to_owner")), "user_id", exchanges=EXCHANGES)
    .select("user_id", "direction", *[F.round(x, 6).alias(x) for x in ("long_usd", "short_usd", "unresolved_usd", "confidence")]))


def _promotion(spark, sf_dir):  # noqa: ANN001, ANN202
    orders, at = view(spark, sf_dir, "orders"), f"{shared_folder(spark)}/promotion-{uuid.uuid4().hex}"
    L.label_replay(bundles_of(orders), prices_of(orders)).write.parquet(f"{at}/staged")
    rows = spark.read.parquet(f"{at}/staged").select((c("bundle_id") % 3 + 1).cast("int").alias("horizon"), c("actual").alias("y"), F.lit("BUY").alias("action"), (c("actual") > 0).alias("right"), F.lit(0.5).alias("p"))
    # the gate asks the labels: a promotion needs ten labelled rows a horizon
    gate = P.readiness_gate(P.horizon_benchmark(rows), {h: (10, 10, 0.9, 0.6) for h in P.HORIZONS})
    done = L.promote(f"{at}/staged", f"{at}/promoted", f"{at}/receipt", gate, "2024-05-01T00:00:00Z", raw=f"{at}/raw")
    empty = spark.createDataFrame([], "version string, promoted_at string, bundles long, labelled long")
    return tidy(empty if done is None else done.select("version", "promoted_at", "bundles", "labelled"))


QUERIES["mkt_45_promotion"] = _promotion
ORACLES["mkt_45_promotion"] = duck(f"""{_OUTCOMES}, h AS (SELECT key % 3 AS h, count(*) FILTER (pending = '') AS n, count(*) AS rows FROM r GROUP BY 1)
    SELECT '{L.RECEIPT}' AS version, '2024-05-01T00:00:00Z' AS promoted_at, sum(rows)::BIGINT AS bundles, sum(n)::BIGINT AS labelled FROM h HAVING min(n) >= 10""")
