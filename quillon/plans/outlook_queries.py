"""Queries over curves, posts, platforms and contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import curves as V
from quillon.operators import filters as X
from quillon.operators import markets as M
from quillon.operators import text as T
from quillon.plans.base import query

c = F.col

_AT = ", ".join(f"({i}, {m}::DOUBLE)" for i, m in enumerate((*V.MOVES, 0.0)))
query("ser_53_curve_outlook", "v_ladder", sql=f"""WITH s AS (SELECT asset, 0.95::DOUBLE * median(price) AS spot FROM {{v_ladder}} GROUP BY 1), q AS (SELECT asset, spot, i, CASE WHEN i = 4 THEN spot ELSE spot * (1 + m) END AS x FROM s CROSS JOIN (VALUES {_AT}) t(i, m)),
    n AS (SELECT asset, spot, i, x, max(l.price) FILTER (l.price <= x) AS ax, arg_max(l.probability, l.price) FILTER (l.price <= x) AS ap, min(l.price) FILTER (l.price >= x) AS bx, arg_min(l.probability, l.price) FILTER (l.price >= x) AS bp FROM q JOIN {{v_ladder}} l USING (asset) GROUP BY ALL),
    p AS (SELECT asset, any_value(spot) AS spot, list(CASE WHEN ax IS NULL THEN 1 WHEN bx IS NULL THEN 0 WHEN ax = bx THEN ap ELSE ap + (bp - ap) * (x - ax) / (bx - ax) END::DOUBLE ORDER BY i) AS p FROM n GROUP BY 1),
    t AS (SELECT asset, price, (probability + lead(probability) OVER w) / 2 * (lead(price) OVER w - price) AS area FROM {{v_ladder}} WINDOW w AS (PARTITION BY asset ORDER BY price)), e AS (SELECT asset, min(price) + sum(area) AS expected FROM t GROUP BY 1)
    SELECT asset, round(greatest(0, 1 - p[1]), 8) AS crash, round(greatest(0, p[1] - p[2]), 8) AS down, round(greatest(0, p[2] - p[3]), 8) AS flat, round(greatest(0, p[3] - p[4]), 8) AS up, round(greatest(0, p[4]), 8) AS surge,
    floor(p[5] * 1000 + 0.5) / 1000 AS p_up, floor(coalesce(expected, spot) * 100 + 0.5) / 100 AS expected_price, floor((coalesce(expected, spot) / spot - 1) * 10000 + 0.5) / 10000 AS expected_return FROM p JOIN e USING (asset)""")(
    lambda x: V.curve_outlook(x, x.groupBy("asset").agg((0.95 * F.percentile("price", 0.5)).alias("spot"))))

# four degrees of freedom: there both the CDF and its inverse have closed forms
_T4 = lambda z: f"(0.5::DOUBLE + 0.5::DOUBLE * ({z}) / sqrt(({z}) ** 2 + 4) * (1.5::DOUBLE - 0.5::DOUBLE * ({z}) ** 2 / (({z}) ** 2 + 4)))"
_S4 = lambda mu: f"(1 - {_T4(f'((ln(price / spot) - {mu}) / (sigma * sqrt(0.5::DOUBLE)))')})"
query("ser_57_shift_drift", "v_ladder", sql=f"""WITH s AS (SELECT asset, median(price) AS spot, count(*) AS n FROM {{v_ladder}} GROUP BY 1), a AS (SELECT asset, spot, (n % 7 - 3) / 50::DOUBLE AS mu, 0.02::DOUBLE + (n % 3) / 20::DOUBLE AS sigma, 0.15::DOUBLE + (n % 5) / 10::DOUBLE AS kappa, 0.3::DOUBLE + (n % 4) / 8::DOUBLE AS centre, n FROM s WHERE n % 6 > 0),
    g AS (SELECT *, greatest(0.01, least(0.99, kappa * centre + (1 - kappa) * (1 - {_T4('(-mu / (sigma * sqrt(0.5::DOUBLE)))')}))) AS goal FROM a), h AS (SELECT *, 4 * goal * (1 - goal) AS al FROM g),
    d AS (SELECT asset, spot, mu, sigma, -sign(0.5 - goal) * 2 * sqrt(greatest(0, cos(acos(sqrt(al)) / 3) / sqrt(al) - 1)) * sigma * sqrt(0.5::DOUBLE) AS nm FROM h),
    r AS (SELECT asset, price, probability, floor(price)::INT % 3 > 0 AS pure, CASE WHEN floor(price)::INT % 2 = 0 THEN probability - 0.1 END AS lo, CASE WHEN floor(price)::INT % 2 = 0 THEN probability + 0.1 END AS hi FROM {{v_ladder}}),
    n AS (SELECT r.*, spot, CASE WHEN spot IS NULL THEN NULL WHEN pure THEN {_S4('nm')} ELSE greatest(0, least(1, probability + {_S4('nm')} - {_S4('mu')})) END AS np FROM r LEFT JOIN d USING (asset)),
    o AS (SELECT *, max(np) OVER (PARTITION BY asset ORDER BY price DESC) AS top, least(np, greatest(0, least(1, coalesce(lo, np) + np - probability))) AS nl, greatest(np, greatest(0, least(1, coalesce(hi, np) + np - probability))) AS nh FROM n)
    SELECT asset, round(price, 8) AS price, round(CASE WHEN spot IS NULL THEN probability ELSE top END, 7) AS probability, round(CASE WHEN spot IS NULL THEN lo ELSE nl END, 7) AS lower, round(CASE WHEN spot IS NULL THEN hi ELSE greatest(nh, top) END, 7) AS upper FROM o""")(
    lambda x: _shifted(x).select("asset", "price", *[F.round(k, 7).alias(k) for k in ("probability", "lower", "upper")]))


def _shifted(x):  # noqa: ANN001, ANN202
    n = c("n")
    params = x.groupBy("asset").agg(F.percentile("price", 0.5).alias("spot"), F.count(F.lit(1)).alias("n")).where(n % 6 > 0)
    params = params.select("asset", "spot", ((n % 7 - 3) / 50).alias("mu"), (0.02 + (n % 3) / 20).alias("sigma"), (0.15 + (n % 5) / 10).alias("kappa"), (0.3 + (n % 4) / 8).alias("centre"))
    even = F.floor("price") % 2 == 0
    return V.shift_drift(x.select("asset", "price", "probability", F.when(even, c("probability") - 0.1).alias("lower"), F.when(even, c("probability") + 0.1).alias("upper"), (F.floor("price") % 3 > 0).alias("pure")), params, nu=4)


# texts of the table with posts behind four of five
_POST = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN text || ' 🚀🚀 to the MOON, puts 💀' WHEN 1 THEN text || ' Crash! sell-off; don''t BUY_now 📉🗑️' WHEN 2 THEN text || ' weak rally' WHEN 3 THEN '💎🔥 hodl café' ELSE text END"
_WORDS = lambda names, signs: f"len([x FOR x IN regexp_split_to_array(lower(t), '[^a-z0-9_]+') IF x IN ({', '.join(map(repr, names))})]) + len(regexp_extract_all(t, '[{signs}]'))"
_SENT = f"p AS (SELECT doc_id, source, {_POST} AS t FROM documents), n AS (SELECT doc_id, source, {_WORDS(T.BULLISH, T.BULLISH_SIGNS)} AS g, {_WORDS(T.BEARISH, T.BEARISH_SIGNS)} AS b FROM p), s AS (SELECT doc_id, source, CASE WHEN g + b > 0 THEN (g - b) / (g + b) ELSE 0 END::DOUBLE AS score FROM n), k AS (SELECT *, CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM s)"
_posts = lambda d: d.select("doc_id", "source", T.social_sentiment(F.expr(_POST.replace("''", "\\'"))).alias("s")).select("doc_id", "source", "s.*")
query("txt_21_social_sentiment", "documents", sql=f"WITH {_SENT} SELECT doc_id, round(score, 8) AS score, sentiment FROM k")(lambda d: _posts(d).drop("source"))
query("agg_55_social_stats", "documents", sql=f"""WITH {_SENT}, m AS (SELECT *, 1 + (doc_id % 50) / greatest(1, max(doc_id % 50) OVER (PARTITION BY source))::DOUBLE AS w FROM k), g AS (SELECT source, count(*) AS total, count(*) FILTER (sentiment = 'bullish') AS bullish, count(*) FILTER (sentiment = 'bearish') AS bearish, floor(round(100 * sum(score * w) / sum(w), 9) + 0.5)::BIGINT AS avg_score FROM m GROUP BY 1)
    SELECT source, total, bullish, bearish, total - bullish - bearish AS neutral, floor(100 * bullish / total + 0.5)::BIGINT AS bullish_pct, floor(100 * bearish / total + 0.5)::BIGINT AS bearish_pct, (100 - floor(100 * bullish / total + 0.5) - floor(100 * bearish / total + 0.5))::BIGINT AS neutral_pct, avg_score FROM g""")(
    lambda d: T.sentiment_stats(_posts(d).select("source", "sentiment", c("score").alias("sentiment_score"), (c("doc_id") % 50).alias("votes")), "source"))

query("mkt_35_platform_adjustment", "v_markets", sql="""WITH e AS (SELECT asset || CASE WHEN market_id % 2 = 0 THEN '' ELSE '+' END AS asset, 's' || market_id AS source, CASE WHEN market_id % 10 < 8 THEN 'event' ELSE 'consensus' END AS kind, CASE WHEN market_id % 6 > 0 THEN abs(probability - 0.5) / 4 ELSE 0 END AS gap FROM {v_markets}),
    g AS (SELECT asset, count(*) FILTER (kind = 'consensus') AS n, max(gap) FILTER (kind = 'consensus') AS m, min((-gap, source)) FILTER (kind = 'consensus') AS w FROM e GROUP BY 1)
    SELECT asset, CASE WHEN m > 0.1::DOUBLE THEN 'divergence' WHEN n > 0 THEN 'agreement' ELSE 'none' END AS basis, coalesce(m > 0.1::DOUBLE, false)::INT AS applied, CASE WHEN m > 0.1::DOUBLE THEN -8 ELSE 0 END AS quality_delta, CASE WHEN m > 0.1::DOUBLE THEN 1.08 ELSE 1 END::DOUBLE AS sigma_scale, CASE WHEN m > 0.1::DOUBLE THEN w[2] END AS worst, CASE WHEN m > 0.1::DOUBLE THEN round(m, 8) END AS gap FROM g""")(
    lambda m: M.cross_platform(m.select(F.concat("asset", F.when(c("market_id") % 2 == 0, "").otherwise("+")).alias("asset"), F.concat(F.lit("s"), "market_id").alias("source"), F.when(c("market_id") % 10 < 8, "event").otherwise("consensus").alias("kind"), F.when(c("market_id") % 6 > 0, F.abs(c("probability") - 0.5) / 4).alias("gap")), "asset"))

_CONTRACTS = "SELECT event_type AS side, event_id AS contract, CAST(floor(value * value) AS BIGINT) AS volume, event_id * 7919 % 10007 AS open_interest FROM events"
query("top_08_contracts", "events", sql=f"""WITH k AS ({_CONTRACTS}), m AS (SELECT side, avg(volume) AS mean FROM k GROUP BY 1), u AS (SELECT 'volume' AS list, side, contract, row_number() OVER (PARTITION BY side ORDER BY volume DESC, contract) AS rn FROM k JOIN m USING (side) WHERE volume > 0 AND volume > 3 * mean), o AS (SELECT 'interest' AS list, side, contract, row_number() OVER (PARTITION BY side ORDER BY open_interest DESC, contract) AS rn FROM k)
    SELECT * FROM u WHERE rn <= 5 UNION ALL SELECT * FROM o WHERE rn <= 10""")(
    lambda e: (lambda k: M.unusual_volume(k, "side", "contract").select(F.lit("volume").alias("list"), "side", "contract", "rn").unionByName(M.top_by_open_interest(k, "side", "contract").select(F.lit("interest").alias("list"), "side", "contract", "rn")))(
        e.select(c("event_type").alias("side"), c("event_id").alias("contract"), F.floor(c("value") * c("value")).alias("volume"), (c("event_id") * 7919 % 10007).alias("open_interest"))))

query("top_13_recent_rows", "events", sql="SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")(lambda e: X.recent_rows(e, 25, F.desc("ts"), F.desc("event_id")).select("event_id", "user_id"))
query("top_13_rows_by_hash", "documents", sql="SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")(
    lambda d: X.rows_by_hash(d.select("doc_id", F.sha2("text", 256).alias("h")), "h", d.where("lang = 'en'").select(F.sha2("text", 256).alias("hash"))).select("doc_id"))
