"""Queries of prediction markets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import mathcols as X
from quillon.operators import markets as M
from quillon.plans.base import query

c = F.col
_YES = "greatest(0.01::DOUBLE, least(0.99::DOUBLE, CASE WHEN probability > 0.5 THEN probability - 0.035::DOUBLE ELSE probability END))"
_DEPTH = "CASE WHEN days_to_expiry >= 30 THEN 1 ELSE greatest(0.5::DOUBLE, (days_to_expiry / 30) ** 0.55::DOUBLE) END::DOUBLE"
_EXP = "CASE WHEN days_to_expiry <= 1 THEN 1.5 WHEN days_to_expiry <= 7 THEN 1.2 WHEN days_to_expiry <= 30 THEN 1.0 WHEN days_to_expiry <= 90 THEN 0.85 ELSE 0.7 END::DOUBLE"
_TIER = "CASE tier WHEN 'macro' THEN 0.9 WHEN 'electoral' THEN 0.55 ELSE 0.75 END::DOUBLE"
_BENCH = "CASE tier WHEN 'macro' THEN 0.07 WHEN 'electoral' THEN 0.10 ELSE 0.14 END::DOUBLE"
_Q = f"""q1 AS (SELECT *, least(1, age_days / 21)::DOUBLE AS age, least(1, log10(volume + 1) / 6)::DOUBLE AS raw, {_YES} AS yb FROM {{v_markets}}), q2 AS (SELECT *, raw * {_DEPTH} AS liq, greatest(0, 1 - spread / {_BENCH} * (1 + 0.4::DOUBLE * (1 - least(1, age * sqrt(raw)))))::DOUBLE AS sp FROM q1),
    q3 AS (SELECT *, CASE WHEN probability < 0.07 OR probability > 0.93 THEN 1 - 0.45::DOUBLE * (1 - least(0.6::DOUBLE * sp + 0.25::DOUBLE * age + 0.15::DOUBLE * liq, sp)) ELSE 1 END AS ls FROM q2),
    q AS (SELECT *, greatest(0, least(1, age * liq * {_TIER} * {_EXP} * sp * ls))::DOUBLE AS q, yb * delta_yes + (1 - yb) * delta_no AS r FROM q3)"""
_SIG = "sg AS (SELECT asset, sum(q * r) / sum(q) AS signal, avg(q) AS quality, count(*) AS markets, sum(q * q * probability * (1 - probability) * (delta_yes - delta_no) ** 2) / sum(q) ** 2 AS variance FROM q GROUP BY 1)"

query("mkt_01_yes_bias", "v_markets", sql=f"SELECT market_id, round({_YES}, 8) AS p FROM {{v_markets}}")(lambda m: m.select("market_id", M.yes_bias(c("probability")).alias("p")))
query("mkt_03_depth_decay", "v_markets", sql=f"SELECT market_id, round({_DEPTH}, 8) AS decay FROM {{v_markets}}")(lambda m: m.select("market_id", M.depth_decay(c("days_to_expiry")).alias("decay")))
query("mkt_04_expiry_boost", "v_markets", sql=f"SELECT market_id, round({_EXP}, 8) AS boost FROM {{v_markets}}")(lambda m: m.select("market_id", M.expiry_boost(c("days_to_expiry")).alias("boost")))
query("mkt_05_market_quality", "v_markets", sql=f"WITH {_Q} SELECT market_id, round(q, 8) AS q FROM q")(lambda m: m.select("market_id", M.market_quality().alias("q")))
query("mkt_06_spread_benchmark", "v_markets", sql=f"SELECT market_id, round({_BENCH}, 8) AS benchmark FROM {{v_markets}}")(lambda m: m.select("market_id", M.spread_benchmark(c("tier")).alias("benchmark")))
query("mkt_07_market_signal", "v_markets", sql=f"WITH {_Q}, {_SIG} SELECT asset, round(signal, 8) AS signal, round(quality, 8) AS quality, markets, round(variance, 8) AS variance FROM sg")(lambda m: M.market_signal(m, "asset"))


def _other(m):  # noqa: ANN001, ANN202
    return m.groupBy("asset").agg((F.avg("probability") - 0.5).alias("sentiment"), F.lit(0.01).alias("fundamental"), F.lit(None).cast("double").alias("options"), (F.avg("age_days") / 1000).alias("markov"))


_BLEND = f"""{_Q}, {_SIG}, ot AS (SELECT asset, avg(probability) - 0.5::DOUBLE AS sentiment, 0.01::DOUBLE AS fundamental, avg(age_days) / 1000 AS markov FROM {{v_markets}} GROUP BY 1),
    bl AS (SELECT *, 0.4::DOUBLE * quality + 0.2::DOUBLE + 0.25::DOUBLE + 0.2::DOUBLE AS t, (0.4::DOUBLE * quality * signal + 0.2::DOUBLE * sentiment + 0.25::DOUBLE * fundamental + 0.2::DOUBLE * markov) / t AS forecast, 0.4::DOUBLE * quality / t AS mw FROM sg JOIN ot USING (asset)),
    fs AS (SELECT *, greatest(1.2::DOUBLE * sqrt(mw * mw * variance + (sentiment * 0.01::DOUBLE) ** 2), 0.10::DOUBLE * sqrt(14.0::DOUBLE / 252)) AS sigma FROM bl)"""
query("mkt_08_blend_signals", "v_markets", sql=f"WITH {_BLEND} SELECT asset, round(forecast, 8) AS forecast, round(mw, 8) AS market_weight FROM bl")(lambda m: M.blend_signals(M.market_signal(m, "asset").withColumnRenamed("signal", "market").join(_other(m), "asset")).select("asset", "forecast", "market_weight"))
query("mkt_09_11_asset_forecast", "v_markets", sql=f"WITH {_BLEND} SELECT asset, markets, round(forecast, 8) AS forecast, round(sigma, 8) AS sigma, round(forecast - 1.96::DOUBLE * sigma, 8) AS low, round(forecast + 1.96::DOUBLE * sigma, 8) AS high, round(100 * quality, 8) AS score, CASE WHEN 100 * quality >= 75 THEN 'A' WHEN 100 * quality >= 50 THEN 'B' WHEN 100 * quality >= 25 THEN 'C' ELSE 'D' END AS grade FROM fs")(lambda m: M.asset_forecast(m, _other(m)))
_LW = "OVER (PARTITION BY asset ORDER BY price)"
query("mkt_12_ladder_is_clean", "v_ladder", sql=f"SELECT asset, count(*) AS levels, (count(*) >= 2 AND coalesce(max(up), 0) <= 0.05)::INT AS clean FROM (SELECT asset, p - lag(p) {_LW} AS up FROM (SELECT asset, price, probability + (floor(price)::INT % 5) * 0.02::DOUBLE AS p FROM {{v_ladder}})) GROUP BY 1")(lambda x: M.ladder_is_clean(x.withColumn("probability", c("probability") + (F.floor("price") % 5) * 0.02)))
query("mkt_13_ladder_forecast", "v_ladder", sql=f"""WITH a AS (SELECT *, lead(probability) {_LW} AS np, lead(price) {_LW} AS nx, row_number() {_LW} AS i, (max(price) OVER (PARTITION BY asset) - min(price) OVER (PARTITION BY asset)) / greatest(count(*) OVER (PARTITION BY asset) - 1, 1) AS st FROM {{v_ladder}}),
    b AS (SELECT asset, greatest(probability - coalesce(np, 0), 0) AS m, coalesce((price + nx) / 2, price + st / 2) AS x FROM a UNION ALL SELECT asset, greatest(1 - probability, 0), price - st / 2 FROM a WHERE i = 1) SELECT asset, round(sum(m * x) / sum(m), 4) AS mean, round(sqrt(sum(m * x * x) / sum(m) - (sum(m * x) / sum(m)) ** 2), 4) AS sd FROM b GROUP BY 1""")(lambda x: M.ladder_forecast(x).select("asset", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd")))
query("ser_52_survival_at", "v_ladder", "part", sql="""WITH p AS (SELECT DISTINCT p_brand AS asset, 900 + (p_partkey % 40) * 6.5::DOUBLE AS price FROM part), e AS (SELECT asset, min(price) AS lo, max(price) AS hi FROM {v_ladder} GROUP BY 1),
    a AS (SELECT p.asset, p.price, max_by(l.price, l.price) AS ax, max_by(l.probability, l.price) AS ap FROM p LEFT JOIN {v_ladder} l ON l.asset = p.asset AND l.price <= p.price GROUP BY ALL), b AS (SELECT p.asset, p.price, min(l.price) AS bx, min_by(l.probability, l.price) AS bp FROM p LEFT JOIN {v_ladder} l ON l.asset = p.asset AND l.price >= p.price GROUP BY ALL)
    SELECT asset, price, round(CASE WHEN ax IS NULL THEN 1 WHEN bx IS NULL THEN 0 WHEN ax = bx THEN ap ELSE ap + (bp - ap) * (price - ax) / (bx - ax) END::DOUBLE, 8) AS survival FROM a JOIN b USING (asset, price)""")(
    lambda x, p: M.survival_at(x, p.select(c("p_brand").alias("asset"), (900 + (c("p_partkey") % 40) * 6.5).alias("price")).distinct()))
query("ser_54_price_at_probability", "v_ladder", sql=f"""WITH a AS (SELECT *, lead(probability) {_LW} AS p1, lead(price) {_LW} AS x1 FROM {{v_ladder}}), k AS (SELECT unnest([0.5, 0.3, 0.9, 0.2, 0.8])::DOUBLE AS level)
    SELECT asset, level, round(min(price + (x1 - price) * (probability - level) / (probability - p1)), 8) AS price FROM a JOIN k ON probability >= level AND p1 < level GROUP BY ALL""")(M.price_at_probability)
query("mkt_20_rescale_levels", "v_ladder", sql="SELECT asset, price AS raw, CASE WHEN median(price) OVER (PARTITION BY asset) > 300 THEN round(price * 100 / median(price) OVER (PARTITION BY asset), 2) ELSE price END AS price FROM {v_ladder}")(lambda x: M.rescale_levels(x, 100.0))
query("mkt_21_spike_flag", "v_snapshots", sql="SELECT event_id, market_id, coalesce(abs(probability - lag(probability) OVER (PARTITION BY market_id ORDER BY captured_at, event_id)) > 0.08 AND volume24h < 100000, false)::INT AS spike FROM {v_snapshots}")(M.spike_flags)
_W12 = "OVER (PARTITION BY market_id ORDER BY captured_at RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)"
query("mkt_23_stable_path", "v_snapshots", sql=f"SELECT event_id, market_id, (count(*) {_W12} >= 2 AND max(probability) {_W12} - min(probability) {_W12} <= 0.06::DOUBLE)::INT AS stable FROM {{v_snapshots}}")(M.stable_path)
query("mkt_24_median_recent_move", "v_snapshots", sql="WITH m AS (SELECT market_id, captured_at, abs(probability - lag(probability) OVER (PARTITION BY market_id ORDER BY captured_at, event_id)) AS move, max(captured_at) OVER (PARTITION BY market_id) AS newest FROM {v_snapshots}) SELECT market_id, round(median(move), 8) AS move FROM m WHERE newest - captured_at <= INTERVAL 48 HOUR GROUP BY 1")(
    M.median_recent_move)
query("mkt_25_price_velocity", "v_snapshots", sql="WITH m AS (SELECT market_id, probability AS y, epoch_us(captured_at) - max(epoch_us(captured_at)) OVER (PARTITION BY market_id) AS x FROM {v_snapshots}) SELECT market_id, round(regr_slope(y, x / 3.6e9), 6) AS slope, count(*) AS n FROM m WHERE x >= -96 * 3600000000 GROUP BY 1")(lambda s: M.velocity(s, 96).withColumn("slope", F.round("slope", 6)))
query("mkt_26_max_jump", "v_snapshots", sql="WITH m AS (SELECT market_id, abs(probability - lag(probability) OVER (PARTITION BY market_id ORDER BY captured_at, event_id)) AS move, epoch_us(captured_at) - max(epoch_us(captured_at)) OVER (PARTITION BY market_id) AS x FROM {v_snapshots}) SELECT market_id, round(coalesce(max(move), 0), 8) AS jump FROM m WHERE x >= -24 * 3600000000 GROUP BY 1")(M.max_jump)
query("mkt_26_max_logit_jump", "v_snapshots", sql="WITH l AS (SELECT *, ln(greatest(0.01, least(0.99, probability)) / (1 - greatest(0.01, least(0.99, probability))))::DOUBLE AS y FROM {v_snapshots}), m AS (SELECT market_id, abs(y - lag(y) OVER (PARTITION BY market_id ORDER BY captured_at, event_id)) AS move, epoch_us(captured_at) - max(epoch_us(captured_at)) OVER (PARTITION BY market_id) AS x FROM l) SELECT market_id, round(coalesce(max(move), 0), 8) AS jump FROM m WHERE x >= -24 * 3600000000 GROUP BY 1")(lambda s: M.max_jump(s, 24, lambda p: X.logit(p, 0.01)))
query("mkt_28_daily_hazard", "v_markets", sql="SELECT market_id, round(least(-ln(1 - greatest(0, least(0.999999, probability))) / greatest(days_to_expiry, 1), 0.95)::DOUBLE, 8) AS hazard FROM {v_markets}")(lambda m: m.select("market_id", M.daily_hazard(c("probability"), F.greatest("days_to_expiry", F.lit(1.0))).alias("hazard")))
query("mkt_29_q_to_p", "v_markets")(lambda m: m.select("market_id", M.q_to_p(c("probability"), 0.08, 0.04, 0.2, c("days_to_expiry") / 365).alias("p")))
query("mkt_30_longshot_shrink", "v_markets", sql="SELECT market_id, round(CASE WHEN probability <= 0.05 OR probability >= 0.95 THEN (probability + 0.5) / 2 ELSE probability END, 8) AS p FROM {v_markets}")(lambda m: m.select("market_id", M.longshot_shrink(c("probability")).alias("p")))
query("mkt_32_lognormal_fit", "v_ladder")(M.lognormal_fit)
query("mkt_33_regime_mass", "v_ladder")(lambda x: M.regime_mass(M.lognormal_fit(x), F.lit(1000.0)))
query("mkt_35_cross_platform", "v_markets", sql="SELECT asset, max_by(market_id, (abs(probability - age_days / 60), -market_id)) AS worst, bool_or(abs(probability - age_days / 60) > 0.1)::INT AS flagged FROM {v_markets} GROUP BY 1")(lambda m: m.withColumn("gap", F.abs(c("probability") - c("age_days") / 60)).groupBy("asset").agg(F.max_by("market_id", F.struct("gap", -c("market_id"))).alias("worst"), F.bool_or(c("gap") > 0.1).alias("flagged")))
query("mkt_41_combine_log_odds", "v_markets", sql="""WITH l AS (SELECT asset, volume AS w, ln(greatest(0.001, least(0.999, probability)) / (1 - greatest(0.001, least(0.999, probability))))::DOUBLE AS l FROM {v_markets}), s AS (SELECT asset, sum(w * l) / sum(w) AS m, sqrt(sum(w * l * l) / sum(w) - (sum(w * l) / sum(w)) ** 2) AS sd, count(*) AS n FROM l GROUP BY 1)
    SELECT asset, round(1 / (1 + exp(-m)), 8) AS p, round(1 / (1 + exp(-(m - sd))), 8) AS low, round(1 / (1 + exp(-(m + sd))), 8) AS high, (sd > 0.3)::INT AS divergent, n FROM s""")(lambda m: M.combine_log_odds(m.select("asset", c("probability").alias("p"), c("volume").alias("w")), "asset"))
query("mkt_15_extract_price_levels", "documents")(lambda d: d.select("doc_id", F.size(M.extract_price_levels(c("text"))).alias("levels")))
query("mkt_16_question_semantics", "documents", sql="""SELECT doc_id, CASE WHEN trim(l) = '' THEN 'ambiguous' WHEN regexp_matches(l, 'between .* and|range') THEN 'range' WHEN regexp_matches(l, 'stay|remain|all (month|year)') THEN 'path' WHEN regexp_matches(l, 'reach|touch|hit|at any time') THEN 'barrier' WHEN regexp_matches(l, 'above|below|close|end|over|under') THEN 'terminal' ELSE 'unknown' END AS semantics FROM (SELECT doc_id, lower(text) AS l FROM documents)""")(lambda d: d.select("doc_id", M.question_semantics(c("text")).alias("semantics")))
query("mkt_42_regime_platt", "v_steps")(lambda s: M.regime_platt(s.select("regime", c("predicted_prob").alias("p"), "y")))


# flags reach the signal, and warnings say which markets they lower
_FLAGS = {"spike": "market_id % 5 = 0", "transitory": "market_id % 3 = 0", "stable": "market_id % 2 = 0", "fast": "market_id % 7 = 0", "jump": "market_id % 11 = 0", "ambiguous": "market_id % 13 = 0"}
_FACTOR = "(CASE WHEN market_id % 5 = 0 THEN 0.5 WHEN market_id % 3 = 0 THEN 0.7 WHEN market_id % 2 = 0 THEN 1.1 ELSE 1 END * CASE WHEN market_id % 7 = 0 THEN 0.8 ELSE 1 END * CASE WHEN market_id % 11 = 0 THEN 0.7 ELSE 1 END * CASE WHEN market_id % 13 = 0 THEN 0.6 ELSE 1 END)::DOUBLE"
_FLAGGED = _Q.replace("* sp * ls))", f"* sp * ls * {_FACTOR}))")
query("mkt_07_flagged_signal", "v_markets", sql=f"WITH {_FLAGGED}, {_SIG} SELECT asset, round(signal, 8) AS signal, round(quality, 8) AS quality, markets, round(variance, 8) AS variance FROM sg")(
    lambda m: M.market_signal(m, "asset", flags={k: F.expr(v) for k, v in _FLAGS.items()}))
_EXTREME = "CASE market_id % 4 WHEN 0 THEN probability * 0.05D WHEN 1 THEN 1 - probability * 0.05D ELSE probability END"
_LOSS = f"0.45::DOUBLE * (1 - least(0.6::DOUBLE * sp + 0.25::DOUBLE * least(1, age_days / 21) + 0.15::DOUBLE * least(1, log10(volume + 1) / 6), sp))"
query("mkt_07_warnings", "v_markets", sql=f"""WITH e AS (SELECT * REPLACE ({_EXTREME.replace("0.05D", "0.05::DOUBLE")} AS probability) FROM {{v_markets}}), s AS (SELECT *, greatest(0, 1 - spread / {_BENCH})::DOUBLE AS sp FROM e), l AS (SELECT *, {_LOSS} AS loss, {_YES} AS yb FROM s),
    w AS (SELECT *, 'spike' AS warning, 'has a price spike - quality discounted 50%' AS t FROM l WHERE market_id % 5 = 0 UNION ALL SELECT *, 'transitory', 'shows a transitory historical move - quality discounted 30%' FROM l WHERE market_id % 3 = 0
        UNION ALL SELECT *, 'ambiguous', 'has ambiguous resolution semantics - quality discounted 40%' FROM l WHERE market_id % 13 = 0 UNION ALL SELECT *, 'yes_bias', 'has high YES bias (raw p=' || printf('%.3f', probability) || ')' FROM l WHERE abs(probability - yb) > 0.1::DOUBLE
        UNION ALL SELECT *, CASE WHEN probability < 0.5 THEN 'longshot' ELSE 'favourite' END, CASE WHEN probability < 0.5 THEN 'is a longshot' ELSE 'is a near-certain favourite' END || ' (p=' || printf('%.3f', probability) || ') with poor microstructure - quality further discounted ' || floor(loss * 100 + 0.5)::BIGINT || '%'
            FROM l WHERE (probability < 0.07::DOUBLE OR probability > 0.93::DOUBLE) AND loss > 0.08::DOUBLE)
    SELECT asset, market_id, warning, 'Market "Q' || market_id || '" ' || t AS text FROM w""")(
    lambda m: M.market_warnings(m.withColumns({"probability": F.expr(_EXTREME), "question": F.concat(F.lit("Q"), "market_id")}), {k: F.expr(v) for k, v in _FLAGS.items()}, "asset"))


def _adaptive_sql() -> str:
    """Multipliers of the five signals, one of which is always missing."""
    base = {"market": "0.4::DOUBLE * quality", "sentiment": "0.2::DOUBLE", "fundamental": "0.25::DOUBLE", "markov": "0.2::DOUBLE"}
    scale = {"market": 0.05, "sentiment": 0.04, "fundamental": 0.01, "markov": 0.05}
    mult = []
    for s in base:
        mass, way = " + ".join(base[k] for k in base if k != s), " + ".join(f"{base[k]} * sign({k})" for k in base if k != s)
        agree = f"CASE WHEN sign({s}) = 0 OR {mass} = 0 THEN 0.5 ELSE greatest(0, least(1, 0.5 + 0.5 * sign({s}) * greatest(-1, least(1, ({way}) / ({mass}))))) END"
        mult.append(f"{base[s]} * greatest(0.75::DOUBLE, least(1.25::DOUBLE, 1 + 0.35::DOUBLE * (least(1, abs({s}) / {scale[s]}::DOUBLE) - 0.5) + 0.25::DOUBLE * ({agree} - 0.5))) AS w_{s}")
    total = " + ".join(f"w_{s}" for s in base)
    return f"""{_Q}, {_SIG}, ot AS (SELECT asset, avg(probability) - 0.5::DOUBLE AS sentiment, 0.01::DOUBLE AS fundamental, avg(age_days) / 1000 AS markov FROM {{v_markets}} GROUP BY 1), j AS (SELECT *, signal AS market FROM sg JOIN ot USING (asset)), am AS (SELECT *, {', '.join(mult)} FROM j)
        SELECT asset, round(({' + '.join(f'w_{s} * {s}' for s in base)}) / ({total}), 8) AS forecast, round(w_market / ({total}), 8) AS market_weight FROM am"""


query("mkt_08_adaptive_blend", "v_markets", sql=f"WITH {_adaptive_sql()}")(
    lambda m: M.blend_signals(M.market_signal(m, "asset").withColumnRenamed("signal", "market").join(_other(m).hint("merge"), "asset"), "asset", adaptive=7).select("asset", "forecast", "market_weight"))
