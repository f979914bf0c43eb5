"""Queries of forecasts, walk-forward steps and replays, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import confidence as K
from quillon.operators import forecast as W
from quillon.operators import replay as P
from quillon.operators import scoring as A
from quillon.operators import series as S
from quillon.operators.series import regime_series, simple_returns
from quillon.plans.base import query
from quillon.plans.series_queries import _R, _S, _STATES, _WINS, _matrix

c = F.col


def _states(p):  # noqa: ANN001, ANN202
    return regime_series(simple_returns(p))


def _params(p):  # noqa: ANN001, ANN202
    """(series, price, mu, sigma) of ten-row log returns."""
    lr = S.log_returns(p).groupBy("series").agg((10 * F.avg("lr")).alias("mu"), (10**0.5 * F.stddev_samp("lr")).alias("sigma"))
    return lr.join(p.groupBy("series").agg(F.max_by("close", "d").alias("price")), "series")


_MIX = "mx AS (SELECT series, (count(*) FILTER (state = 'bull') + 0.5) / (count(*) + 1.5) AS bull, (count(*) FILTER (state = 'bear') + 0.5) / (count(*) + 1.5) AS bear, (count(*) FILTER (state = 'sideways') + 0.5) / (count(*) + 1.5) AS sideways FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back FROM st) WHERE back <= 10 GROUP BY 1)"
query("ser_31_start_state_mixture", "v_prices", sql=f"WITH {_S}, {_MIX} SELECT series, round(bull::DOUBLE, 8) AS bull, round(bear::DOUBLE, 8) AS bear, round(sideways::DOUBLE, 8) AS sideways FROM mx")(lambda p: W.start_state_mixture(_states(p)))
query("ser_30_horizon_drift_vol", "v_prices", sql=f"""WITH {_S}, {_STATES}, {_MIX}, {_WINS}, g AS (SELECT series, state, greatest(-0.004::DOUBLE, least(0.004::DOUBLE, avg(r))) AS mean, stddev_pop(r) AS sd FROM ws GROUP BY ALL HAVING count(*) >= 5), wl AS (SELECT series, unnest(['bull', 'bear', 'sideways']) AS state, unnest([bull, bear, sideways])::DOUBLE AS w FROM mx)
    SELECT series, round(10 * sum(w * mean), 8) AS mu, round(sqrt(10::DOUBLE) * sqrt(sum(w * sd * sd) + greatest(sum(w * mean * mean) - sum(w * mean) ** 2, 0)), 8) AS sigma FROM wl JOIN g USING (series, state) GROUP BY 1""")(lambda p: W.horizon_drift_vol(W.start_state_mixture(_states(p)), S.regime_stats(_states(p)), 10))
query("ser_32_sentiment_adjust", "v_prices", sql=f"WITH {_S}, {_STATES}, {_matrix()}, a AS (SELECT series, state_from, state_to, p * CASE state_to WHEN 'bull' THEN 1.035 WHEN 'bear' THEN 0.965 ELSE 1 END::DOUBLE AS x FROM m) SELECT series, state_from, state_to, round(x / sum(x) OVER (PARTITION BY series, state_from), 8) AS p FROM a")(lambda p: W.sentiment_adjust(S.transition_matrix(_states(p)), 0.5))
query("ser_33_blend_matrices", "v_prices", sql=f"WITH {_S}, {_STATES}, {_matrix()} SELECT series, state_from, state_to, round(0.7::DOUBLE * p + 0.3::DOUBLE / 3, 8) AS p FROM m")(lambda p: W.blend_matrices(S.transition_matrix(_states(p)), S.transition_matrix(_states(p)).withColumn("p", F.lit(1 / 3)), F.lit(0.7)))
query("ser_39_garch_scales", "v_prices", sql=f"""WITH {_R}, g AS (SELECT series, avg(r * r) AS h0, max_by(r, d) AS l FROM r GROUP BY 1), k AS (SELECT unnest(range(1, 11)) AS k), s AS (SELECT series, stddev_samp(r) AS sd, stddev_samp(r) FILTER (back <= 20) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back FROM r) GROUP BY 1)
    SELECT series, k::INT AS k, round(greatest(0.33::DOUBLE, least(CASE WHEN recent > sd THEN 2.5 ELSE 1.5 END::DOUBLE, sqrt(h0 + 0.95 ** (k - 1) * (h0 * (1 - 0.10 - 0.85) + 0.10 * l * l + 0.85 * h0 - h0)) / sd)), 6) AS scale FROM g JOIN s USING (series) CROSS JOIN k""")(lambda p: W.garch_scales(simple_returns(p)).withColumn("scale", F.round("scale", 6)))
query("ser_49_vol_regime", "v_prices", sql=f"WITH {_R}, v AS (SELECT series, stddev_samp(r) * sqrt(252) * 2 AS x FROM r GROUP BY 1) SELECT series, CASE WHEN x < 15 THEN 'low' WHEN x < 25 THEN 'normal' ELSE 'high' END AS regime FROM v")(lambda p: simple_returns(p).groupBy("series").agg((S.volatility(c("r")) * 2).alias("x")).select("series", S.vol_regime(c("x")).alias("regime")))
_WF = """x AS (SELECT series, d, close, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS r, lead(close, 5) OVER w AS future FROM {v_prices} WINDOW w AS (PARTITION BY series ORDER BY d)), st AS (SELECT series, i AS step, close, future FROM x WHERE i >= 120 AND (i - 120) % 10 = 0 AND future IS NOT NULL),
    tr AS (SELECT st.series, st.step, avg(r) AS m, stddev_samp(r) AS s, avg((x.future > x.close)::INT::DOUBLE) FILTER (x.i + 5 <= st.step) AS up FROM st JOIN x ON x.series = st.series AND x.i > st.step - 120 AND x.i <= st.step GROUP BY ALL),
    wf AS (SELECT tr.series AS ticker, tr.step AS t, up, exp(5 * m) - 1 AS pr, future / close - 1 AS ar, close * exp(5 * m - 1.645::DOUBLE * s * sqrt(5::DOUBLE)) AS lo, close * exp(5 * m + 1.645::DOUBLE * s * sqrt(5::DOUBLE)) AS hi, future FROM tr JOIN st USING (series, step))"""
query("ser_50_walk_forward", "v_prices", sql=f"WITH {_WF} SELECT ticker, t, round(up, 8) AS predicted_prob, round(pr, 6) AS predicted_return, round(ar, 6) AS actual_return, round(lo, 2) AS ci_lower, round(hi, 2) AS ci_upper FROM wf")(
    lambda p: W.walk_forward(p).select("ticker", "t", "predicted_prob", F.round("predicted_return", 6).alias("predicted_return"), F.round("actual_return", 6).alias("actual_return"), F.round("ci_lower", 2).alias("ci_lower"), F.round("ci_upper", 2).alias("ci_upper")))
query("ser_50_walk_forward_report", "v_prices", sql=f"WITH {_WF} SELECT ticker, count(*) AS steps, round(avg((up - (ar > 0)::INT) ** 2), 6) AS brier, round(avg((future BETWEEN lo AND hi)::INT::DOUBLE), 6) AS coverage FROM wf GROUP BY 1")(lambda p: A.report(W.walk_forward(p), "ticker", metrics={"steps": F.count(F.lit(1)), "brier": F.round(A.brier(), 6), "coverage": F.round(F.avg(A.covered()), 6)}))
query("ser_53_scenario_buckets", "v_prices")(lambda p: W.scenario_buckets(_params(p)))
query("ser_55_action_signal", "v_prices")(lambda p: W.action_signal(_params(p)))
query("ser_56_survival_grid", "v_prices")(lambda p: W.survival_grid(_params(p)).select("series", "i", F.log("level").alias("log_level"), "survival"))
query("ser_56_student_grid", "v_prices")(lambda p: W.survival_grid(_params(p), nu=4).select("series", "i", F.log("level").alias("log_level"), "survival"))
query("ser_57_shrink_to_base_rate", "v_numbered_steps", sql="""WITH k AS (SELECT *, greatest(0.15, least(0.55, 1.1::DOUBLE * (0.45 - 0.07 * (t % 4) - CASE WHEN t > 60 THEN least(0.08, 0.04 * log2(t / 60.0)) ELSE 0 END - CASE WHEN t % 3 = 0 THEN 0.03 ELSE 0 END)
    + CASE WHEN regime = 'bull' AND t % 5 = 0 THEN 0.10 WHEN regime IN ('bull', 'bear') THEN -0.03 ELSE 0.03 END)) AS k FROM {v_steps}) SELECT ticker, horizon, t, round(k * greatest(0.25, least(0.80, confidence)) + (1 - k) * predicted_prob, 8) AS p FROM k""")(
    lambda s: s.select("ticker", "horizon", "t", K.shrink_to_base_rate(c("predicted_prob"), c("confidence"), c("t") % 4, c("t"), c("t") % 3 == 0, c("regime"), (c("regime") == "bull") & (c("t") % 5 == 0), scale=1.1).alias("p")))
def _confidence(**kw):  # noqa: ANN003, ANN202
    t = c("t")
    asset = F.get(F.array(*map(F.lit, ("etf", "crypto", "commodity", "equity"))), (c("horizon") % 4).cast("int"))
    return K.prediction_confidence(
        c("predicted_prob"), t % 4, t % 30, c("confidence"), converged=t % 3 == 0, calibrated=c("predicted_prob"), base_rate=c("confidence"), is_break=c("structural_break"), divergence=c("divergence"), regime=c("regime"),
        asset=asset, volatility=c("divergence") / 5, entropy=(c("entropy_scale") - 0.5) * 0.73105857, anchors=t % 4, horizon=t % 28, r2=F.when(t % 5 > 0, (t % 12 - 8) / 100.0), **kw)


_TRUST = """CASE WHEN is_break THEN {broken} ELSE 1 END * CASE asset WHEN 'crypto' THEN {crypto} WHEN 'commodity' THEN 0.85 WHEN 'etf' THEN 1.1 ELSE 1 END * {calm} * greatest(0.65, 1 - 0.35 * entropy)"""
_MILD = "CASE WHEN short AND helped THEN CASE WHEN r2 IS NULL THEN 0.85 WHEN r2 >= -0.05 THEN 0.8 ELSE 0.6 END ELSE 0.6 END"
_CALM = "CASE WHEN vol > 0.02 THEN greatest(0.7, 1 - 5 * (vol - 0.02)) ELSE 1 END"
_LEGACY_CRYPTO = "CASE WHEN short AND helped THEN 0.85 ELSE 0.7 END"
query("ser_59_prediction_confidence", "v_numbered_steps", sql=f"""WITH a AS (SELECT *, coalesce(structural_break, false) AS is_break, CASE horizon % 4 WHEN 0 THEN 'etf' WHEN 1 THEN 'crypto' WHEN 2 THEN 'commodity' ELSE 'equity' END AS asset, divergence / 5 AS vol, (entropy_scale - 0.5) * 0.73105857::DOUBLE AS entropy, t % 4 >= 2 AS helped, CASE WHEN t % 5 > 0 THEN (t % 12 - 8) / 100.0::DOUBLE END AS r2 FROM {{v_steps}}),
    b AS (SELECT *, asset = 'crypto' AND t % 28 <= 14 AS short FROM a),
    s AS (SELECT *, 0.30 * 2 * abs(predicted_prob - 0.5) + 0.15 * (t % 4) / 3 + CASE WHEN t % 3 = 0 THEN 0.10 ELSE 0 END + 0.15 * least(1, (t % 30) / 20.0) + 0.10 * confidence + CASE WHEN (predicted_prob >= 0.5) = (confidence >= 0.5) THEN 0.20 ELSE -0.08 END * 2 * abs(confidence - 0.5) + CASE WHEN short AND r2 BETWEEN -0.02 AND 0.02 THEN 0.08 ELSE 0 END AS parts FROM b)
    SELECT ticker, horizon, t, round(greatest(0, least(1, parts * {_TRUST.format(broken=_MILD, crypto=_LEGACY_CRYPTO, calm=_CALM)}))::DOUBLE, 6) AS conf,
    round(greatest(0, least(1, parts * {_TRUST.format(broken="CASE WHEN divergence < 0.05 THEN 1 WHEN divergence < 0.1 THEN 0.8 WHEN divergence < 0.2 THEN 0.7 ELSE 0.6 END", crypto=_LEGACY_CRYPTO, calm=_CALM)}))::DOUBLE, 6) AS conf_by_divergence,
    round(greatest(0, least(1, (parts + CASE WHEN short THEN CASE WHEN helped THEN 0.05 ELSE 0.03 END WHEN helped THEN 0.02 ELSE 0 END) * {_TRUST.format(
        broken=f"CASE WHEN regime = 'sideways' THEN 1 ELSE {_MILD} END",
        crypto="CASE WHEN short THEN 1.6 * CASE WHEN helped AND r2 IS NULL THEN 0.95 WHEN helped AND r2 >= -0.05 THEN 0.92 ELSE 0.82 END ELSE 1.35 * 0.74 END",
        calm=f"CASE WHEN short AND vol > 0.02 THEN greatest(0.85, 1 - 3 * (vol - 0.02)) ELSE {_CALM} END")}))::DOUBLE, 6) AS conf_rebalanced FROM s""")(
    lambda s: s.select("ticker", "horizon", "t", *[F.round(_confidence(**kw), 6).alias(name) for name, kw in {"conf": {}, "conf_by_divergence": {"break_policy": "divergence_weighted"}, "conf_rebalanced": {"break_policy": "trend_penalty_only", "rebalanced": True}}.items()]))
query("ser_62_window_offsets", "v_prices", sql="WITH x AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) AS i FROM {v_prices}), b AS (SELECT series, i AS break_i FROM x WHERE i % 400 = 0) SELECT x.series, d, x.i - break_i AS off, CASE WHEN x.i < break_i THEN 'pre' WHEN x.i - break_i < 5 THEN 'at' ELSE 'post' END AS slice FROM x JOIN b ON x.series = b.series AND x.i BETWEEN break_i - 10 AND break_i + 9")(
    lambda p: (lambda x: W.window_offsets(x, x.where("i % 400 = 0").select("series", "i")).select("series", "d", c("offset").alias("off"), "slice"))(p.select("series", "d", F.row_number().over(S._time()).alias("i"))))
query("ser_63_cluster_dates", "orders")(lambda o: W.cluster_dates(o.select((c("o_custkey") % 50).cast("string").alias("series"), F.to_date("o_orderdate").alias("d"))))
query("ser_64_yield_spread", "v_prices", sql="SELECT d, round(max(CASE WHEN series = '1-URGENT' THEN close END) - max(CASE WHEN series = '2-HIGH' THEN close END), 4) AS spread FROM {v_prices} WHERE series IN ('1-URGENT', '2-HIGH') GROUP BY 1")(lambda p: p.where("series in ('1-URGENT', '2-HIGH')").groupBy("d").agg(F.round(F.max(F.when(c("series") == "1-URGENT", c("close"))) - F.max(F.when(c("series") == "2-HIGH", c("close"))), 4).alias("spread")))
query("ser_65_put_call_ratio", "part", sql="SELECT p_brand, round(sum(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 0 END) / nullif(sum(CASE WHEN p_partkey % 2 = 1 THEN p_size ELSE 0 END), 0), 8) AS ratio FROM part GROUP BY 1")(lambda p: W.put_call_ratio(p.select("p_brand", F.when(c("p_partkey") % 2 == 0, "put").otherwise("call").alias("kind"), c("p_size").alias("volume")), "p_brand"))
query("ser_66_portfolio_totals", "orders", "v_prices", sql="WITH p AS (SELECT series, max_by(close, d) AS price FROM {v_prices} GROUP BY 1), t AS (SELECT o_custkey, sum(o_totalprice) AS invested, sum(price) AS now FROM orders JOIN p ON series = o_orderpriority GROUP BY 1) SELECT o_custkey, round(invested, 2) AS invested, round(now, 2) AS now, round(now - invested, 2) AS pnl, round((now - invested) / invested * 100, 6) AS return_pct FROM t")(
    lambda o, p: W.portfolio_totals(o.select("o_custkey", c("o_orderpriority").alias("series"), c("o_totalprice").alias("cost")), p, "o_custkey"))
query("ser_67_wacc_breakdown", "customer", sql="SELECT c_custkey AS id, round(0.04 + b * 0.05, 8) AS cost_of_equity, round(1 / (1 + de) * (0.04 + b * 0.05) + (1 - 1 / (1 + de)) * 0.06 * 0.79, 8) AS wacc FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 1.1 WHEN 'MACHINERY' THEN 1.3 ELSE 1.0 END ELSE (c_custkey % 20) / 10.0 END::DOUBLE AS b, (c_custkey % 7) / 5.0::DOUBLE AS de FROM customer)")(
    lambda k: W.wacc(k.select(c("c_custkey").alias("id"), c("c_mktsegment").alias("sector"), F.when(c("c_custkey") % 4 > 0, (c("c_custkey") % 20) / 10).alias("beta"), F.lit(0.04).alias("rf"), F.lit(0.05).alias("erp"), ((c("c_custkey") % 7) / 5).alias("de"), F.lit(0.06).alias("kd"), F.lit(0.21).alias("tax")), k.sparkSession.createDataFrame([("BUILDING", 1.1), ("MACHINERY", 1.3)], "sector string, sector_beta double")))
_CW = "(VALUES ('1-URGENT', 'a', 0.3::DOUBLE), ('2-HIGH', 'a', 0.2::DOUBLE), ('3-MEDIUM', 'b', 0.4::DOUBLE), ('5-LOW', 'b', 0.1::DOUBLE)) w(component, grp, weight)"
query("ser_13_composite_index", "v_prices", sql=f"""WITH m AS (SELECT d, component, grp, weight, close / 100000 AS z FROM {{v_prices}} JOIN {_CW} ON series = component), g AS (SELECT grp, sum(weight) AS gw FROM {_CW} GROUP BY 1), s AS (SELECT d, z, weight / sum(weight) OVER (PARTITION BY d, m.grp) * gw AS x FROM m JOIN g USING (grp)) SELECT d, round(sum(z * x) / sum(x), 4) AS index, count(*) AS components FROM s GROUP BY 1""")(
    lambda p: W.composite_index(p.select("d", c("series").alias("component"), (c("close") / 100000).alias("z")), p.sparkSession.createDataFrame([("1-URGENT", "a", 0.3), ("2-HIGH", "a", 0.2), ("3-MEDIUM", "b", 0.4), ("5-LOW", "b", 0.1)], "component string, grp string, weight double")).withColumn("index", F.round("index", 4)))


def _targets(o):  # noqa: ANN001, ANN202
    """One market per customer: will the order total be at or above a level a year after the first order?"""
    first = o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("captured"), F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("level"))
    kind = F.when(c("o_custkey") % 3 == 0, "terminal").when(c("o_custkey") % 3 == 1, "barrier").otherwise("range")
    return first.select(c("o_custkey").alias("key"), c("o_custkey").alias("market_id"), "captured", F.date_add("captured", 365).alias("target"), "level", (c("level") * 2).alias("high_level"), kind.alias("semantics"))


def _path(o):  # noqa: ANN001, ANN202
    return o.select(c("o_custkey").alias("key"), F.to_date("o_orderdate").alias("at"), c("o_totalprice").alias("price"))


_LAB = """t AS (SELECT o_custkey AS k, min(o_orderdate)::DATE AS captured, min(o_orderdate)::DATE + 365 AS target, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS level FROM orders GROUP BY 1), g AS (SELECT k, level, target, min_by(o_totalprice, (o_orderdate, o_totalprice)) FILTER (o_orderdate::DATE >= target) AS settled, max(o_totalprice) FILTER (o_orderdate::DATE BETWEEN captured AND target) AS high, max(o_orderdate)::DATE AS last FROM t JOIN orders ON o_custkey = k GROUP BY ALL),
    lb AS (SELECT k AS market_id, CASE k % 3 WHEN 0 THEN 'terminal' WHEN 1 THEN 'barrier' ELSE 'range' END AS semantics, last >= target AS ready, CASE WHEN last >= target THEN CASE WHEN CASE k % 3 WHEN 0 THEN settled >= level WHEN 1 THEN high >= level ELSE settled BETWEEN level AND 2 * level END THEN 'yes' ELSE 'no' END END AS outcome FROM g)"""
query("mkt_36_37_label_markets", "orders", sql=f"WITH {_LAB} SELECT market_id, semantics, ready::INT AS ready, outcome FROM lb")(lambda o: P.label_markets(_targets(o), _path(o)))
query("mkt_38_label_bundles", "orders", sql=f"WITH {_LAB}, b AS (SELECT market_id % 300 AS bundle_id, bool_and(ready) AS ready, string_agg(market_id || ':' || outcome, ',' ORDER BY market_id) AS labels FROM lb GROUP BY 1) SELECT bundle_id, ready::INT AS ready, CASE WHEN ready THEN labels END AS labels FROM b")(
    lambda o: P.label_bundles(_targets(o).groupBy((c("market_id") % 300).alias("bundle_id")).agg(F.array_sort(F.collect_list("market_id")).alias("markets")), P.label_markets(_targets(o), _path(o))).select("bundle_id", "ready", F.array_join(F.transform("semantic", lambda x: F.concat_ws(":", x.market_id.cast("string"), x.outcome)), ",").alias("labels")))
query("join_19_labels_to_markets", "orders", sql=f"WITH {_LAB} SELECT semantics, outcome, count(*) AS n FROM lb WHERE outcome IS NOT NULL GROUP BY ALL")(lambda o: P.label_markets(_targets(o), _path(o)).where("outcome in ('yes', 'no')").groupBy("semantics", "outcome").agg(F.count(F.lit(1)).alias("n")))
query("mkt_39_bundle_features", "orders", sql="WITH n AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'thin' ELSE 'rich' END AS evidence, CASE WHEN n = 0 THEN 0.58 WHEN n <= 2 THEN 0.68 ELSE 0.78 END::DOUBLE AS p FROM n")(lambda o: o.groupBy("o_custkey").agg(P.evidence(F.count_if(c("o_orderstatus") == "P")).alias("evidence")).withColumn("p", P.implied_probability(c("evidence"))))
query("mkt_40_trade_score", "v_numbered_steps", sql="""WITH s AS (SELECT *, unnest(['long', 'short']) AS direction, CASE t % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' ELSE 'neutral' END AS whale, (t % 10)::DOUBLE AS lever FROM {v_steps}),
    w AS (SELECT *, predicted_return * 0.6::DOUBLE + actual_return * 0.4::DOUBLE * CASE t % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.4 WHEN 2 THEN 0.5 ELSE 0.7 END::DOUBLE AS total, CASE WHEN whale = 'neutral' THEN 0 WHEN whale = direction THEN 0.0025 ELSE -0.0025 END::DOUBLE * confidence AS boost FROM s),
    e AS (SELECT *, CASE WHEN direction = 'long' THEN total ELSE -total END + boost AS edge, 0.006::DOUBLE * greatest(0, least(0.4::DOUBLE, predicted_prob - 0.55::DOUBLE)) + CASE WHEN structural_break THEN 0.0025 ELSE 0 END::DOUBLE + CASE WHEN lever >= 5 THEN 0.00035::DOUBLE * (lever - 4) ELSE 0 END AS cost,
        greatest(0.001, CASE WHEN direction = 'long' THEN (realized_price - ci_lower) / realized_price ELSE (ci_upper - realized_price) / realized_price END) AS against FROM w)
    SELECT ticker, horizon, t, direction, floor(100::DOUBLE * edge * 1000 + 0.5) / 1000 AS edge_pct, floor((edge - cost) * 100000 + 0.5) / 100000 AS score, floor(100::DOUBLE * edge * lever * 100 + 0.5) / 100 AS leverage_pnl_pct, floor(greatest(abs(edge), 0.004) / against * 100 + 0.5) / 100 AS risk_reward FROM e""")(
    lambda s: P.trade_scores(s.select(
        "ticker", "horizon", "t", c("predicted_return").alias("model_return"), F.lit(0.6).alias("model_weight"), c("actual_return").alias("market_return"), F.lit(0.4).alias("market_weight"), F.get(F.array(*map(F.lit, ("terminal", "path_dependent", "ambiguous", "range"))), (c("t") % 4).cast("int")).alias("semantics"), c("predicted_prob").alias("flat"), c("structural_break").alias("is_break"),
        F.get(F.array(*map(F.lit, ("long", "short", "neutral"))), (c("t") % 3).cast("int")).alias("whale"), c("confidence").alias("whale_confidence"), (c("t") % 10).cast("double").alias("leverage"), c("realized_price").alias("price"), c("ci_lower").alias("low"), c("ci_upper").alias("high")), "ticker", "horizon", "t"))


def _replay(s):  # noqa: ANN001, ANN202
    return s.select("ticker", "horizon", "regime", "confidence", c("recommendation").alias("action"), A.hit().cast("int").alias("right"), c("predicted_prob").alias("p"), "y")


_HITI = "(CASE recommendation WHEN 'BUY' THEN actual_return > 0 WHEN 'SELL' THEN actual_return < 0 ELSE abs(actual_return) < 0.03 END)::INT::DOUBLE"
_RM = f"count(*) FILTER (recommendation <> 'HOLD') AS traded, round(coalesce(avg({_HITI}) FILTER (recommendation <> 'HOLD'), 0), 8) AS accuracy, round(avg((predicted_prob - y) ** 2), 8) AS brier, round(avg((recommendation = 'HOLD')::INT::DOUBLE), 8) AS abstain_rate"
query("agg_49_replay_slices", "v_steps", sql=f"SELECT 'regime' AS slice, regime AS bucket, count(*) AS total, {_RM} FROM {{v_steps}} GROUP BY ALL UNION ALL SELECT 'sure', CASE WHEN confidence >= 0.5 THEN 'yes' ELSE 'no' END, count(*), {_RM} FROM {{v_steps}} GROUP BY ALL")(lambda s: P.replay_slices(_replay(s), {"regime": c("regime"), "sure": F.when(c("confidence") >= 0.5, "yes").otherwise("no")}))
query("agg_50_compare_gate", "v_steps", sql=f"WITH a AS (SELECT ticker AS e, horizon, {_RM} FROM {{v_steps}} GROUP BY ALL) SELECT x.horizon, (x.accuracy >= b.accuracy - 0.02 AND x.brier <= b.brier + 0.02 AND x.abstain_rate <= b.abstain_rate + 0.02)::INT AS passes, concat_ws(',', CASE WHEN x.accuracy < b.accuracy - 0.02 THEN 'accuracy' END, CASE WHEN x.brier > b.brier + 0.02 THEN 'brier' END, CASE WHEN x.abstain_rate > b.abstain_rate + 0.02 THEN 'abstain' END) AS reasons FROM a x JOIN a b USING (horizon) WHERE x.e = 'O' AND b.e = 'F'")(
    lambda s: P.compare_gate(_replay(s).withColumn("traded", c("action") != "HOLD").groupBy(c("ticker").alias("evaluator"), "horizon").agg(F.avg(F.when(c("traded"), c("right").cast("double"))).alias("accuracy"), F.avg(F.pow(c("p") - c("y"), 2)).alias("brier"), F.avg((~c("traded")).cast("double")).alias("abstain_rate")), "O", "F"))
query("agg_51_horizon_benchmark", "v_steps", sql=f"SELECT horizon, count(*) AS n, count(y) AS labelled, {_RM} FROM {{v_steps}} WHERE horizon <= 3 GROUP BY 1")(lambda s: P.horizon_benchmark(_replay(s)))
query("agg_52_combined_benchmark", "v_steps", sql=f"SELECT h.horizon::INT AS horizon, e.ticker AS evaluator, count(s.y) AS n, count(s.y) AS labelled, count(*) FILTER (recommendation <> 'HOLD') AS traded, round(avg({_HITI}) FILTER (recommendation <> 'HOLD'), 8) AS accuracy, round(avg((predicted_prob - y) ** 2), 8) AS brier, round(avg((recommendation = 'HOLD')::INT::DOUBLE), 8) AS abstain_rate FROM (SELECT unnest([1, 2, 3, 7, 14]) AS horizon) h CROSS JOIN (SELECT DISTINCT ticker FROM {{v_steps}}) e LEFT JOIN {{v_steps}} s ON s.horizon = h.horizon AND s.ticker = e.ticker GROUP BY ALL")(lambda s: P.horizon_benchmark(_replay(s).withColumnRenamed("ticker", "evaluator"), (1, 2, 3, 7, 14), "evaluator"))
query("agg_53_readiness_gate", "v_steps", sql="""WITH h AS (SELECT horizon, count(y) AS labelled, count(*) FILTER (recommendation <> 'HOLD') AS traded, avg((recommendation = 'HOLD')::INT::DOUBLE) AS ab, avg((predicted_prob - y) ** 2) AS br FROM {v_steps} WHERE horizon <= 3 GROUP BY 1), g AS (SELECT *, concat_ws(',', CASE WHEN labelled < [30, 25, 20][horizon] THEN 'labelled' END, CASE WHEN traded < [15, 12, 10][horizon] THEN 'traded' END,
    CASE WHEN ab > [0.45, 0.5, 0.55][horizon] THEN 'abstain' END, CASE WHEN br > [0.24, 0.25, 0.26][horizon] THEN 'brier' END) AS reasons FROM h) SELECT horizon, CASE WHEN reasons = '' THEN 'pass' ELSE 'hold' END AS verdict, reasons FROM g""")(lambda s: P.readiness_gate(P.horizon_benchmark(_replay(s))))
query("agg_54_rank_variants", "events", sql="WITH l AS (SELECT user_id % 7 AS variant, CASE WHEN value > 60 THEN 'keep' WHEN value < 20 THEN 'regress' ELSE 'same' END AS decision FROM events WHERE user_id % 7 < 5), g AS (SELECT variant, count(*) AS attempts, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'regress') AS regressed FROM l GROUP BY 1) SELECT v.variant, coalesce(attempts, 0) AS attempts, coalesce(kept, 0) AS kept, coalesce(regressed, 0) AS regressed, round(coalesce(kept, 0) - coalesce(regressed, 0) + 0.25 * coalesce(attempts, 0) / sum(attempts) OVER (), 8) AS score, CASE WHEN attempts IS NULL THEN 'untried' WHEN kept > regressed THEN 'healthy' WHEN kept = regressed THEN 'mixed' ELSE 'failing' END AS health FROM (SELECT DISTINCT user_id % 7 AS variant FROM events) v LEFT JOIN g USING (variant)")(
    lambda e: P.rank_variants(e.select((c("user_id") % 7).alias("variant")).distinct(), e.where("user_id % 7 < 5").select((c("user_id") % 7).alias("variant"), F.when(c("value") > 60, "keep").when(c("value") < 20, "regress").otherwise("same").alias("decision"))))
