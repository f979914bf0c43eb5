"""Queries of the policy ablation and of resampled intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import ablation as B
from quillon.operators import scoring as A
from quillon.plans.base import query
from quillon.plans.scoring_queries import _BRIER, _COV, _EDGE, _HIT

c = F.col
_BREAK = "coalesce(original_break, structural_break, false)"
_FLAG = "(t % 3 = 0)"
_PRE = f"greatest(0, least(1, CASE WHEN {_BREAK} AND NOT ({_FLAG} AND regime = 'sideways') THEN confidence / 0.6::DOUBLE ELSE confidence END))"
_TREND, _FAR = "regime IN ('bull', 'bear')", "coalesce(original_divergence, divergence, 0.05::DOUBLE)"
_POLICIES = {
    "reduced_penalty_075": f"{_PRE} * 0.75::DOUBLE", "no_break_penalty": _PRE, "aggressive_penalty_040": f"{_PRE} * 0.4::DOUBLE", "cap_029": f"least({_PRE}, 0.29::DOUBLE)",
    "trend_penalty_only": f"CASE WHEN {_TREND} THEN {_PRE} * 0.6::DOUBLE ELSE {_PRE} END", "chop_penalty_only": f"CASE WHEN regime = 'sideways' THEN {_PRE} * 0.6::DOUBLE ELSE {_PRE} END",
    "divergence_relief_bucketed": f"{_PRE} * CASE WHEN {_FAR} >= 0.2::DOUBLE THEN 0.9::DOUBLE WHEN {_FAR} >= 0.1::DOUBLE THEN 0.75::DOUBLE ELSE 0.6::DOUBLE END",
}
_PARTS = {"overall": "true", "break": _BREAK, "non_break": f"NOT {_BREAK}", "break_trending": f"{_BREAK} AND {_TREND}", "break_chop": f"{_BREAK} AND regime = 'sideways'", "break_large_move": f"{_BREAK} AND abs(actual_return) >= 0.1::DOUBLE"}
_FIGURES = ("mean_confidence", "brier", "ci_coverage", "accuracy", "coverage", "selective_accuracy", "selective_p_up")


def _ablation_sql(policies: dict[str, str]) -> str:
    conf = " UNION ALL ".join(f"SELECT *, '{k}' AS policy, greatest(0, least(1, CASE WHEN {_BREAK} THEN {x} ELSE confidence END)) AS conf FROM {{v_steps}}" for k, x in policies.items())
    parts = " UNION ALL ".join(f"SELECT *, '{k}' AS partition FROM p WHERE {x}" for k, x in _PARTS.items())
    sel, up = "conf >= threshold", "((predicted_prob >= 0.5)::INT = y)::INT::DOUBLE"
    return f"""p AS ({conf}), q AS ({parts}), k AS (SELECT unnest({list(B.THRESHOLDS)}::DOUBLE[]) AS threshold),
        ab AS (SELECT policy, partition, threshold, count(*) AS steps, avg(conf) AS mean_confidence, {_BRIER} AS brier, {_COV} AS ci_coverage, avg({_HIT}) AS accuracy, count(*) FILTER ({sel}) AS selected, avg(({sel})::INT::DOUBLE) AS coverage,
            coalesce(avg({_HIT}) FILTER ({sel}), 0) AS selective_accuracy, coalesce(avg({up}) FILTER ({sel}), 0) AS selective_p_up FROM q CROSS JOIN k GROUP BY ALL)"""


def _flagged(s: DataFrame) -> DataFrame:
    return s.withColumn("trend_only", c("t") % 3 == 0)


_SHOWN = f"policy, partition, threshold, steps, selected, {', '.join(f'round({x}, 8) AS {x}' for x in _FIGURES)}"
query("agg_46_ablation", "v_numbered_steps", sql=f"WITH {_ablation_sql({'baseline': 'confidence'} | _POLICIES)} SELECT {_SHOWN} FROM ab")(lambda s: B.policy_ablation(_flagged(s)))
_DELTAS = ("mean_confidence", "brier", "accuracy", "coverage", "selective_accuracy", "selective_p_up")
query("agg_46_deltas", "v_numbered_steps", sql=f"WITH {_ablation_sql({'baseline': 'confidence'} | _POLICIES)} SELECT a.policy, a.partition, a.threshold, {', '.join(f'round(a.{x} - b.{x}, 8) + 0.0::DOUBLE AS d_{x}' for x in _DELTAS)} FROM ab a JOIN ab b ON b.policy = 'baseline' AND a.policy <> 'baseline' AND a.partition = b.partition AND a.threshold = b.threshold")(
    lambda s: B.policy_deltas(B.policy_ablation(_flagged(s))).withColumns({f"d_{x}": F.round(f"d_{x}", 8) + F.lit(0.0) for x in _DELTAS}))  # fmt: skip  (no negative zeros)
# a policy of the user's: the confidence shrinks with the divergence, and by half where the run did not converge
_OWN = "confidence * (1 - least(0.9::DOUBLE, 2 * coalesce(divergence, 0))) * CASE WHEN hmm_converged THEN 1 ELSE 0.5::DOUBLE END"
query("udf_02_user_policy", "v_steps", sql=f"WITH {_ablation_sql({'own': _OWN}).replace(f'CASE WHEN {_BREAK} THEN {_OWN} ELSE confidence END', _OWN)} SELECT {_SHOWN} FROM ab")(
    lambda s: B.policy_ablation(_flagged(s), {"own": c("confidence") * (1 - F.least(F.lit(0.9), 2 * F.coalesce("divergence", F.lit(0.0)))) * F.when(F.coalesce("hmm_converged", F.lit(False)), 1.0).otherwise(0.5)}))


def _bootstrap_sql(metrics: dict[str, str], replicates: int, seed: int = 7) -> str:
    """Weights by md5 in blocks of four replicates, sums by replicate, then the values at the three places."""
    bounds = ", ".join(f"{float(x)!r}" for x in B._POISSON)
    sums = ", ".join(f"sum(w * ({x})) / sum(w) AS {k}" for k, x in metrics.items())
    long = " UNION ALL ".join(f"SELECT ticker, '{k}' AS metric, list_sort(list({k})) AS v FROM e GROUP BY 1" for k in metrics)
    at = lambda q: f"round(v[{int(q * replicates) + 1}], 6)"
    return f"""WITH h AS (SELECT s.*, i, md5('{seed}|' || ticker || '|' || horizon || '|' || t || '|' || i) AS h FROM {{v_steps}} s CROSS JOIN range({-(-replicates // 4)}) g(i)),
        r AS (SELECT *, 4 * i + j AS replicate, (('0x' || substr(h, 8 * j::INT + 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u FROM h CROSS JOIN range(4) q(j) WHERE 4 * i + j < {replicates}),
        w AS (SELECT *, len([b FOR b IN [{bounds}]::DOUBLE[] IF b <= u])::DOUBLE AS w FROM r), e AS (SELECT ticker, replicate, {sums} FROM w GROUP BY ALL), l AS ({long})
        SELECT ticker, metric, {at(0.025)} AS low, {at(0.5)} AS mid, {at(0.975)} AS high FROM l"""


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({x: F.round(x, 6) for x in ("low", "mid", "high")})


_METRICS = {"brier": "(predicted_prob - y) ** 2", "accuracy": f"({_HIT})::DOUBLE", "coverage": "(realized_price BETWEEN ci_lower AND ci_upper)::INT::DOUBLE"}
query("agg_38_bootstrap", "v_numbered_steps", sql=_bootstrap_sql(_METRICS, 200))(lambda s: _rounded(B.bootstrap(s, {"brier": F.pow(c("predicted_prob") - c("y"), 2), "accuracy": A.hit(), "coverage": A.covered()})))
# a metric of the user's: the mean edge
query("udf_01_user_metric", "v_numbered_steps", sql=_bootstrap_sql({"edge": _EDGE}, 50))(lambda s: _rounded(B.bootstrap(s, {"edge": A.edge()}, replicates=50)))
