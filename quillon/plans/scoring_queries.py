"""Queries that score the step table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import scoring as A
from quillon.plans.base import query

c = F.col
_ERF = "(sign(x) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)))"
_HIT = "(CASE recommendation WHEN 'BUY' THEN actual_return > 0 WHEN 'SELL' THEN actual_return < 0 ELSE abs(actual_return) < 0.03 END)::INT::DOUBLE"
_EDGE = "CASE recommendation WHEN 'BUY' THEN actual_return WHEN 'SELL' THEN -actual_return ELSE -abs(actual_return) END"
_BRIER = "avg((predicted_prob - y) ** 2)"
_COV = "avg((realized_price BETWEEN ci_lower AND ci_upper)::INT::DOUBLE)"
_CRPS = f"""s1 AS (SELECT *, greatest(abs(ci_upper - ci_lower) / (2 * 1.64485::DOUBLE), 1e-9::DOUBLE) AS sg, realized_price / (1 + actual_return) * (1 + predicted_return) AS ce FROM {{v_steps}}),
    s2 AS (SELECT *, (realized_price - ce) / sg AS z, z / sqrt(2::DOUBLE) AS x FROM s1), s3 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t9 FROM s2),
    s4 AS (SELECT *, greatest(0, sg * (z * {_ERF.replace(' t ', ' t9 ').replace('* t)', '* t9)')} + 2 * exp(-0.5 * z * z) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS cr, 1 + greatest(0, abs(z) - 1.645::DOUBLE) AS tw FROM s3)"""

query("agg_01_brier", "v_steps", sql=f"SELECT ticker, round({_BRIER}, 8) AS brier FROM {{v_steps}} GROUP BY 1")(lambda s: A.report(s, "ticker", metrics={"brier": A.brier()}))
_BINS = "bins AS (SELECT b.bin::INT AS bin, coalesce(avg(predicted_prob), (b.bin + 0.5) / 10)::DOUBLE AS mean_p, coalesce(avg(y), 0)::DOUBLE AS frequency, count(y) AS n FROM range(10) b(bin) LEFT JOIN {v_steps} ON least(floor(predicted_prob * 10), 9) = b.bin GROUP BY b.bin)"
query("agg_02_reliability_bins", "v_steps", sql=f"WITH {_BINS} SELECT bin, round(mean_p, 8) AS mean_p, round(frequency, 8) AS frequency, n FROM bins")(A.reliability_bins)
query("agg_03_tail_reliability_bins", "v_steps", sql="SELECT CASE WHEN predicted_prob < 0.05 THEN '0.00-0.05' WHEN predicted_prob < 0.1 THEN '0.05-0.10' WHEN predicted_prob < 0.95 THEN '0.90-0.95' ELSE '0.95-1.00' END AS bin, round(avg(predicted_prob), 8) AS mean_p, round(avg(y), 8) AS frequency, count(*) AS n FROM {v_steps} WHERE predicted_prob < 0.1 OR predicted_prob >= 0.9 GROUP BY 1")(A.tail_reliability_bins)
query("agg_04_max_reliability_deviation", "v_steps", sql=f"WITH {_BINS} SELECT round(max(abs(mean_p - frequency)), 8) AS max_deviation FROM bins WHERE n >= 3")(lambda s: A.max_reliability_deviation(A.reliability_bins(s)))
query("agg_05_calibration_table", "v_steps", sql="SELECT floor(predicted_prob * 5)::INT AS bin, round(avg(predicted_prob), 8) AS mean_p, round(avg(y), 8) AS frequency, count(*) AS n FROM {v_steps} WHERE predicted_prob < 1 GROUP BY 1")(A.calibration_table)
query("agg_06_ci_coverage", "v_steps", sql=f"SELECT ticker, horizon, round({_COV}, 8) AS coverage FROM {{v_steps}} GROUP BY ALL")(lambda s: A.report(s, "ticker", "horizon", metrics={"coverage": F.avg(A.covered())}))
query("agg_07_central_coverage", "v_numbered_steps", sql="SELECT ticker, round(avg((realized_price BETWEEN CASE WHEN t % 3 = 0 THEN ci_lower * 0.99 ELSE ci_lower END AND CASE WHEN t % 3 = 0 THEN ci_upper * 1.01 ELSE ci_upper END)::INT::DOUBLE), 8) AS coverage FROM {v_steps} GROUP BY 1")(
    lambda s: A.report(s.withColumns({"lo": F.when(c("t") % 3 == 0, c("ci_lower") * 0.99), "hi": F.when(c("t") % 3 == 0, c("ci_upper") * 1.01)}).withColumns({"ci_lower": F.when(c("lo").isNull() | c("hi").isNull(), c("ci_lower")).otherwise(c("lo")), "ci_upper": F.when(c("lo").isNull() | c("hi").isNull(), c("ci_upper")).otherwise(c("hi"))}), "ticker", metrics={"coverage": F.avg(A.covered())}))
query("agg_08_10_crps", "v_steps", sql=f"WITH {_CRPS} SELECT ticker, horizon, round(avg(cr), 4) AS crps, round(avg(cr / sg), 4) AS scaled_crps, round(sum(cr * tw) / sum(tw), 4) AS tail_crps FROM s4 WHERE sg > 1 GROUP BY ALL")(
    lambda s: A.report(s.where(A.sigma() > 1), "ticker", "horizon", metrics={k: F.round(A.report_metrics()[k], 4) for k in ("crps", "scaled_crps", "tail_crps")}))
query("agg_13_accuracy_coherence", "v_numbered_steps", sql="""WITH e AS (SELECT ticker, avg((predicted_return - actual_return) ** 2) AS error FROM {v_steps} GROUP BY 1),
    g AS (SELECT ticker, t + horizon AS target, var_pop(realized_price / (1 + actual_return) * (1 + predicted_return)) AS v, max_by(realized_price, t) AS price, count(*) AS n FROM {v_steps} GROUP BY ALL), s AS (SELECT ticker, avg(v / price ** 2) AS spread FROM g WHERE n >= 2 GROUP BY 1)
    SELECT ticker, round(error, 8) AS error, round(spread, 8) AS incoherence, round(error + spread, 8) AS score FROM e JOIN s USING (ticker)""")(A.accuracy_coherence)
query("agg_14_interval_score", "v_steps", sql=f"SELECT ticker, horizon, round(avg(ci_upper - ci_lower), 4) AS width, round(avg(20 * greatest(ci_lower - realized_price, 0)), 4) AS lower_penalty, round(avg(20 * greatest(realized_price - ci_upper, 0)), 4) AS upper_penalty, round(avg(ci_upper - ci_lower + 20 * greatest(ci_lower - realized_price, 0) + 20 * greatest(realized_price - ci_upper, 0)), 4) AS total, round({_COV}, 4) AS coverage FROM {{v_steps}} GROUP BY ALL")(
    lambda s: A.report(s, "ticker", "horizon", metrics={k: F.round(v, 4) for k, v in A.interval_parts().items()}))
query("agg_15_directional_accuracy", "v_steps", sql=f"SELECT ticker, horizon, round(avg({_HIT}), 8) AS accuracy FROM {{v_steps}} GROUP BY ALL")(lambda s: A.report(s, "ticker", "horizon", metrics={"accuracy": F.avg(A.hit())}))
query("agg_16_balanced_accuracy", "v_steps", sql=f"SELECT ticker, round(avg(a), 8) AS balanced_accuracy FROM (SELECT ticker, CASE WHEN actual_return >= 0.03 THEN 'B' WHEN actual_return <= -0.03 THEN 'S' ELSE 'H' END AS k, avg({_HIT}) AS a FROM {{v_steps}} GROUP BY ALL) GROUP BY 1")(lambda s: A.balanced_accuracy(s, "ticker"))
query("agg_17_mean_edge", "v_steps", sql=f"SELECT ticker, horizon, round(avg({_EDGE}), 8) AS mean_edge FROM {{v_steps}} GROUP BY ALL")(lambda s: A.report(s, "ticker", "horizon", metrics={"mean_edge": F.avg(A.edge())}))
query("agg_20_by_volatility", "v_steps", sql=f"""WITH x AS (SELECT *, abs(actual_return) AS m, count(*) OVER (PARTITION BY ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY abs(actual_return), horizon, t) - 1 AS i FROM {{v_steps}}),
    k AS (SELECT ticker, max(m) FILTER (i = (n - 1) // 3) AS low, max(m) FILTER (i = 2 * (n - 1) // 3) AS high FROM x GROUP BY 1) SELECT ticker, CASE WHEN m <= low THEN 'low' WHEN m <= high THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n, round(avg({_HIT}), 8) AS accuracy, round({_BRIER}, 8) AS brier FROM x JOIN k USING (ticker) GROUP BY ALL""")(A.by_volatility)
_LABELS = {
    "confidence": "CASE WHEN confidence < 0.2 THEN '0.0-0.2' WHEN confidence < 0.4 THEN '0.2-0.4' WHEN confidence < 0.6 THEN '0.4-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END",
    "move_magnitude": "CASE WHEN abs(actual_return) < 0.02 THEN '<2%' WHEN abs(actual_return) < 0.05 THEN '2-5%' WHEN abs(actual_return) < 0.1 THEN '5-10%' ELSE '>=10%' END",
    "move_direction": "CASE WHEN actual_return > 0.03 THEN 'up' WHEN actual_return < -0.03 THEN 'down' ELSE 'flat' END",
    "recommendation": "recommendation",
    "regime": "regime",
    "trend_vs_chop": "CASE WHEN regime = 'sideways' THEN 'chop' ELSE 'trend' END",
    "p_up_band": "CASE WHEN predicted_prob < 0.45 THEN '<0.45' WHEN predicted_prob < 0.5 THEN '0.45-0.50' WHEN predicted_prob < 0.55 THEN '0.50-0.55' WHEN predicted_prob < 1 THEN '0.55-1.00' ELSE 'unknown' END",
}


_CLASSES = ("BUY", "actual_return > 0.03"), ("HOLD", "abs(actual_return) <= 0.03"), ("SELL", "actual_return < -0.03")
_BALANCED = f"coalesce(list_avg([x FOR x IN [{', '.join(f'avg((recommendation = {chr(39)}{k}{chr(39)})::INT::DOUBLE) FILTER ({x})' for k, x in _CLASSES)}] IF x IS NOT NULL]), 0)"


def _bucket_sql(dims: list[str], labels: dict[str, str] | None = None) -> str:
    labels = labels or _LABELS
    return "fd AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {labels[d]} AS bucket, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM {{v_steps}}) AS fraction, avg({_HIT}) AS accuracy, {_BALANCED} AS balanced_accuracy, {_BRIER} AS brier, {_COV} AS coverage, avg({_EDGE}) AS mean_edge FROM {{v_steps}} GROUP BY ALL" for d in dims) + ")"


_SHOW = "SELECT dimension, bucket, n, round(fraction, 8) AS fraction, round(accuracy, 8) AS accuracy, round(balanced_accuracy, 8) AS balanced_accuracy, round(brier, 8) AS brier, round(coverage, 8) AS coverage, round(mean_edge, 8) AS mean_edge FROM fd"
for _name, _dim in (("agg_19_by_confidence", "confidence"), ("agg_21_by_move_magnitude", "move_magnitude"), ("agg_22_by_move_direction", "move_direction"), ("agg_23_by_recommendation", "recommendation"), ("agg_24_by_regime", "regime"), ("agg_25_by_trend_vs_chop", "trend_vs_chop"), ("agg_29_by_p_up_band", "p_up_band")):
    query(_name, "v_steps", sql=f"WITH {_bucket_sql([_dim])} {_SHOW}")(lambda s, d=_dim: A.failure_decomposition(s, {d: A.buckets()[d]}))
query("agg_31_failure_decomposition", "v_steps", sql=f"WITH {_bucket_sql(list(_LABELS))} {_SHOW}")(lambda s: A.failure_decomposition(s, A.buckets()))


def _slices_sql() -> dict[str, tuple[str, list[str]]]:
    """Label and shown labels of all fifteen slices; `cuts` holds the bounds of volatility."""
    known = lambda x, labels: f"CASE WHEN {x} IN ({', '.join(repr(y) for y in labels)}) THEN {x} ELSE 'unknown' END"
    flag = lambda x: f"CASE WHEN {x} THEN 'true' WHEN NOT {x} THEN 'false' ELSE 'unknown' END"
    m, far, flags = "abs(actual_return)", "coalesce(original_divergence, divergence)", ["true", "false", "unknown"]
    return {
        "regime": ("coalesce(regime, 'unknown')", []),
        "volatility": (f"CASE WHEN {m} <= (SELECT low FROM cuts) THEN 'low' WHEN {m} <= (SELECT high FROM cuts) THEN 'medium' ELSE 'high' END", ["low", "medium", "high"]),
        "moveMagnitude": (f"CASE WHEN {m} < 0.02 THEN '<2%' WHEN {m} < 0.05 THEN '2–5%' WHEN {m} < 0.1 THEN '5–10%' ELSE '≥10%' END", ["<2%", "2–5%", "5–10%", "≥10%"]),
        "moveDirection": (_LABELS["move_direction"], ["up", "down", "flat"]),
        "confidence": ("CASE WHEN confidence < 0.2 THEN '[0.00, 0.20)' WHEN confidence < 0.4 THEN '[0.20, 0.40)' WHEN confidence < 0.6 THEN '[0.40, 0.60)' WHEN confidence < 0.8 THEN '[0.60, 0.80)' ELSE '[0.80, 1.00]' END", ["[0.00, 0.20)", "[0.20, 0.40)", "[0.40, 0.60)", "[0.60, 0.80)", "[0.80, 1.00]"]),
        "anchorQuality": (known("anchor_quality", ["good", "sparse", "none"]), ["good", "sparse", "none", "unknown"]),
        "recommendation": ("recommendation", ["BUY", "HOLD", "SELL"]),
        "trendVsChop": ("CASE WHEN regime IS NULL THEN 'unknown' WHEN regime = 'sideways' THEN 'chop' ELSE 'trending' END", ["trending", "chop", "unknown"]),
        "validationMetric": (known("validation_metric", ["daily_return", "horizon_return"]), ["daily_return", "horizon_return", "unknown"]),
        "structuralBreak": (flag("coalesce(original_break, structural_break)"), flags),
        "divergence": (f"CASE WHEN {far} < 0.05 THEN '<0.05' WHEN {far} < 0.1 THEN '0.05–0.10' WHEN {far} < 0.2 THEN '0.10–0.20' WHEN {far} IS NULL THEN 'unknown' ELSE '≥0.20' END", ["<0.05", "0.05–0.10", "0.10–0.20", "≥0.20", "unknown"]),
        "hmmConverged": (flag("hmm_converged"), flags),
        "ensembleConsensus": ("CASE WHEN consensus < 0.4 THEN 'low' WHEN consensus < 0.7 THEN 'medium' WHEN consensus IS NULL THEN 'unknown' ELSE 'high' END", ["low", "medium", "high", "unknown"]),
        "pUpBand": ("CASE WHEN predicted_prob < 0.45 THEN '<0.45' WHEN predicted_prob < 0.5 THEN '0.45–0.50' WHEN predicted_prob < 0.55 THEN '0.50–0.55' WHEN predicted_prob < 1 THEN '>0.55' ELSE 'unknown' END", ["<0.45", "0.45–0.50", "0.50–0.55", ">0.55"]),
        "entropyCiScale": ("CASE WHEN coalesce(entropy_scale, 1) < 0.999 THEN 'tightened' WHEN coalesce(entropy_scale, 1) > 1.001 THEN 'widened' ELSE 'neutral' END", ["tightened", "neutral", "widened"]),
    }


_SLICES = _slices_sql()
_SLICE_LABELS = {k: x for k, (x, _) in _SLICES.items()}


def _all_slices_sql() -> str:
    shown = ", ".join(f"('{k}', '{x}')" for k, (_, names) in _SLICES.items() for x in names)
    values = ", ".join(f"round(coalesce({x}, 0), 8)::DOUBLE AS {x}" for x in ("fraction", "accuracy", "balanced_accuracy", "brier", "coverage", "mean_edge"))
    return f"""WITH o AS (SELECT abs(actual_return) AS m, row_number() OVER (ORDER BY abs(actual_return)) - 1 AS i, count(*) OVER () AS n FROM {{v_steps}}), cuts AS (SELECT max(m) FILTER (i = (n - 1) // 3) AS low, max(m) FILTER (i = 2 * (n - 1) // 3) AS high FROM o),
        {_bucket_sql(list(_SLICES), _SLICE_LABELS)}, l(dimension, bucket) AS (VALUES {shown})
        SELECT dimension, bucket, coalesce(n, 0) AS n, {values} FROM fd FULL JOIN l USING (dimension, bucket)"""


query("agg_31_all_slices", "v_steps", sql=_all_slices_sql())(A.failure_decomposition)
for _name, _dim in (("agg_26_original_break", "structuralBreak"), ("agg_26_by_hmm_converged", "hmmConverged")):
    query(_name, "v_steps", sql=f"WITH {_bucket_sql([_dim], _SLICE_LABELS)} {_SHOW}")(lambda s, d=_dim: A.failure_decomposition(s, {d: A.slices((0.0, 0.0))[d][0]}))
query("agg_32_selective_accuracy", "v_steps", sql=f"SELECT ticker, round(avg({_HIT}) FILTER (confidence >= 0.3), 8) AS accuracy, round(avg((confidence >= 0.3)::INT::DOUBLE), 8) AS coverage, count(*) FILTER (confidence >= 0.3) AS selected, count(*) AS total FROM {{v_steps}} GROUP BY 1")(lambda s: A.selective(s, 0.3, A.hit(), "ticker"))
query("agg_33_risk_coverage", "v_steps", sql=f"SELECT ticker, k.threshold::DOUBLE AS threshold, round(coalesce(avg({_HIT}) FILTER (confidence >= k.threshold::DOUBLE), 0), 8) AS accuracy, round(avg((confidence >= k.threshold::DOUBLE)::INT::DOUBLE), 8) AS coverage, count(*) FILTER (confidence >= k.threshold::DOUBLE) AS selected, count(*) AS total FROM {{v_steps}} CROSS JOIN (SELECT unnest([0.0, 0.2, 0.3, 0.4, 0.5]) AS threshold) k GROUP BY ALL")(A.risk_coverage)
query("agg_34_return_correlation", "v_steps", sql="SELECT ticker, horizon, round(corr(predicted_return, actual_return), 8) AS return_corr FROM {v_steps} GROUP BY ALL")(lambda s: A.report(s, "ticker", "horizon", metrics={"return_corr": A.report_metrics()["return_corr"]}))
query("agg_35_sharpness", "v_steps", sql="SELECT ticker, horizon, round(avg((ci_upper - ci_lower) / realized_price), 8) AS sharpness FROM {v_steps} GROUP BY ALL")(lambda s: A.report(s, "ticker", "horizon", metrics={"sharpness": A.report_metrics()["sharpness"]}))
query("agg_36_gof_pass_rate", "v_numbered_steps", sql="SELECT ticker, round(avg(CASE WHEN t % 5 > 0 THEN (t % 2 = 0)::INT::DOUBLE END), 8) AS pass_rate FROM {v_steps} GROUP BY 1")(lambda s: s.withColumn("gof", F.when(c("t") % 5 > 0, c("t") % 2 == 0)).groupBy("ticker").agg(F.avg(c("gof").cast("double")).alias("pass_rate")))
_WIDE = ("steps", "brier", "accuracy", "mean_edge", "coverage", "sharpness", "return_corr", "p_up_accuracy", "mae")
query("agg_37_backtest_report", "v_steps", sql=f"""SELECT ticker, horizon, count(*) AS steps, round({_BRIER}, 8) AS brier, round(avg({_HIT}), 8) AS accuracy, round(avg({_EDGE}), 8) AS mean_edge, round({_COV}, 8) AS coverage, round(avg((ci_upper - ci_lower) / realized_price), 8) AS sharpness,
    round(corr(predicted_return, actual_return), 8) AS return_corr, round(avg(((predicted_prob >= 0.5)::INT = y)::INT::DOUBLE), 8) AS p_up_accuracy, round(avg(abs(predicted_return - actual_return)), 8) AS mae FROM {{v_steps}} GROUP BY ALL""")(lambda s: A.report(s, "ticker", "horizon", metrics={k: A.report_metrics()[k] for k in _WIDE}))
_BUY, _SELL = (0.0, 0.01, 0.02, 0.025, 0.03, 0.04, 0.05), (-0.01, -0.02, -0.025, -0.03, -0.04)
query("agg_39_threshold_grid", "v_steps", sql=f"""WITH g AS (SELECT b, s, row_number() OVER () AS place FROM (SELECT unnest({list(_BUY)}::DOUBLE[]) AS b) CROSS JOIN (SELECT unnest({list(_SELL)}::DOUBLE[]) AS s)),
    a AS (SELECT b, s, avg((CASE WHEN predicted_return > b THEN actual_return > 0 WHEN predicted_return < s THEN actual_return < 0 ELSE abs(actual_return) < 0.03 END)::INT::DOUBLE) AS accuracy FROM {{v_steps}} CROSS JOIN g GROUP BY ALL)
    SELECT b AS buy, s AS sell, round(accuracy, 8) AS accuracy FROM a ORDER BY accuracy DESC, b, s DESC LIMIT 1""")(lambda s: A.threshold_grid(s, _BUY, _SELL))
query("agg_40_p_up_accuracy", "v_steps", sql="SELECT ticker, round(avg(((predicted_prob >= 0.5)::INT = y)::INT::DOUBLE), 8) AS p_up_accuracy FROM {v_steps} GROUP BY 1")(lambda s: A.report(s, "ticker", metrics={"p_up_accuracy": A.report_metrics()["p_up_accuracy"]}))
query("agg_41_selective_p_up_accuracy", "v_steps", sql="SELECT ticker, round(avg(((predicted_prob >= 0.5)::INT = y)::INT::DOUBLE) FILTER (confidence >= 0.3), 8) AS accuracy, round(avg((confidence >= 0.3)::INT::DOUBLE), 8) AS coverage, count(*) FILTER (confidence >= 0.3) AS selected, count(*) AS total FROM {v_steps} GROUP BY 1")(lambda s: A.selective(s, 0.3, ((c("predicted_prob") >= 0.5).cast("int") == c("y")).cast("double"), "ticker"))
_BASE = f"""lp AS (SELECT * EXCLUDE (predicted_prob, recommendation), CASE WHEN b IS NULL THEN 0.5 WHEN b > 0 THEN 0.65 ELSE 0.35 END::DOUBLE AS predicted_prob, CASE WHEN b IS NULL THEN 'HOLD' WHEN b > 0 THEN 'BUY' ELSE 'SELL' END AS recommendation FROM (SELECT *, lag(actual_return) OVER (PARTITION BY ticker, horizon ORDER BY t) AS b FROM {{v_steps}})),
    nb AS (SELECT ticker, horizon, avg((0.5 - y) ** 2) AS brier, avg((abs(actual_return) < 0.03)::INT::DOUBLE) AS accuracy, 'coin' AS baseline FROM {{v_steps}} GROUP BY ALL UNION ALL SELECT ticker, horizon, {_BRIER}, avg({_HIT}), 'last_period' FROM lp GROUP BY ALL)"""
query("agg_42_naive_baselines", "v_numbered_steps", sql=f"WITH {_BASE} SELECT ticker, horizon, round(brier, 8) AS brier, round(accuracy, 8) AS accuracy, baseline FROM nb")(A.naive_baselines)
query("agg_43_baseline_guard", "v_numbered_steps", sql=f"WITH {_BASE}, o AS (SELECT ticker, horizon, avg({_HIT}) AS accuracy FROM {{v_steps}} GROUP BY ALL), m AS (SELECT ticker, horizon, max(accuracy) AS b FROM nb GROUP BY ALL) SELECT ticker, horizon, round(accuracy, 8) AS accuracy, round(b, 8) AS baseline_accuracy, (accuracy - b >= -0.02)::INT AS passes FROM o JOIN m USING (ticker, horizon)")(A.baseline_guard)
query("agg_44_mae_and_sharpe", "v_steps", sql="SELECT ticker, round(avg(abs(predicted_return - actual_return)), 8) AS mae, round(avg(actual_return) / stddev_samp(actual_return), 8) AS sharpe FROM {v_steps} GROUP BY 1")(lambda s: s.groupBy("ticker").agg(A.report_metrics()["mae"].alias("mae"), (F.avg("actual_return") / F.stddev_samp("actual_return")).alias("sharpe")))
query("agg_45_rank_failure_buckets", "v_steps", sql=f"""WITH {_bucket_sql(list(_LABELS))}, o AS (SELECT avg({_HIT}) AS a0, {_BRIER} AS b0, avg({_EDGE}) AS e0 FROM {{v_steps}}),
    w AS (SELECT dimension, bucket, n, accuracy AS p, (0.5 * (a0 - accuracy) + 0.3 * (brier - b0) + 0.2 * (e0 - mean_edge)) * (0.5 + 0.5 * sqrt(fraction)) AS weakness FROM fd CROSS JOIN o WHERE n >= 5), k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY weakness DESC, bucket) = 1)
    SELECT dimension, bucket, n, round(weakness, 8) AS weakness, round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n))::DOUBLE, 8) AS low, round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n))::DOUBLE, 8) AS high FROM k ORDER BY weakness DESC, dimension LIMIT 10""")(A.rank_failure_buckets)
_POL = {"none": lambda x: x, "soft": lambda x: x * 0.8, "hard": lambda x: x * 0.6, "floor": lambda x: F.greatest(x - 0.1, F.lit(0.0))}
query("agg_46_policy_ablation", "v_steps", sql=f"""WITH p AS (SELECT *, 'none' AS policy, confidence AS conf FROM {{v_steps}} UNION ALL SELECT *, 'soft', confidence * 0.8::DOUBLE FROM {{v_steps}} UNION ALL SELECT *, 'hard', confidence * 0.6::DOUBLE FROM {{v_steps}} UNION ALL SELECT *, 'floor', greatest(confidence - 0.1::DOUBLE, 0) FROM {{v_steps}})
    SELECT policy, {_LABELS['trend_vs_chop']} AS partition, round(coalesce(avg({_HIT}) FILTER (conf >= 0.3::DOUBLE), 0), 8) AS accuracy, round(avg((conf >= 0.3::DOUBLE)::INT::DOUBLE), 8) AS coverage FROM p GROUP BY ALL""")(lambda s: A.policy_ablation(s, _POL))
query("agg_47_arm_deltas", "v_steps", sql=f"WITH a AS (SELECT horizon, ticker AS arm, {_BRIER} AS brier, avg({_HIT}) AS accuracy FROM {{v_steps}} GROUP BY ALL) SELECT x.arm, x.horizon, round(x.brier - b.brier, 8) AS d_brier, round(x.accuracy - b.accuracy, 8) AS d_accuracy FROM a x JOIN a b ON b.arm = 'F' AND x.horizon = b.horizon WHERE x.arm <> 'F'")(
    lambda s: A.arm_deltas(A.report(s.withColumnRenamed("ticker", "arm"), "arm", "horizon", metrics={"brier": A.brier(), "accuracy": F.avg(A.hit())}), "arm", "F", "brier", "accuracy", keys=("horizon",)))
query("agg_48_metric_block", "v_steps", sql=f"SELECT ticker, round({_BRIER}, 8) AS brier, round(avg({_HIT}), 8) AS accuracy, round({_COV}, 8) AS coverage, round(avg(predicted_prob), 8) AS mean_p, round(avg(y), 8) AS base_rate FROM {{v_steps}} GROUP BY 1")(lambda s: A.report(s, "ticker", metrics={"brier": A.brier(), "accuracy": F.avg(A.hit()), "coverage": F.avg(A.covered()), "mean_p": F.avg("predicted_prob"), "base_rate": F.avg("y")}))
