"""Queries over price series, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import series as S
from quillon.plans.base import query

_W = "OVER (PARTITION BY series ORDER BY d)"
_R = f"r0 AS (SELECT series, d, (close - lag(close) {_W}) / lag(close) {_W} AS r FROM {{v_prices}}), r AS (SELECT * FROM r0 WHERE r IS NOT NULL)"
_T = "th AS (SELECT series, greatest(0.001, 0.5 * abs(r)) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(r), d) AS i, count(*) OVER (PARTITION BY series) AS n FROM r) WHERE i = n // 2 + 1)"
_S = f"{_R}, {_T}, st AS (SELECT r.series, d, r, CASE WHEN r > threshold THEN 'bull' WHEN r < -threshold THEN 'bear' ELSE 'sideways' END AS state FROM r JOIN th USING (series))"
_STATES = "states AS (SELECT unnest(['bull', 'bear', 'sideways']) AS state)"


def _matrix(src: str = "st", name: str = "m", least: int = 30) -> str:
    """CTEs of a transition matrix over src(series, d, state)."""
    return f"""{name}0 AS (SELECT series, state AS state_to, lag(state) {_W} AS state_from, count(*) OVER (PARTITION BY series) AS n FROM {src}),
        {name}1 AS (SELECT series, state_from, state_to, count(*)::DOUBLE AS c FROM {name}0 WHERE state_from IS NOT NULL GROUP BY ALL),
        {name}2 AS (SELECT k.series, a.state AS state_from, b.state AS state_to, coalesce(c, 0) + greatest(0.01, 5.0 / n) AS mass, n FROM (SELECT series, max(n) AS n FROM {name}0 GROUP BY 1) k CROSS JOIN states a CROSS JOIN states b
            LEFT JOIN {name}1 x ON x.series = k.series AND x.state_from = a.state AND x.state_to = b.state),
        {name} AS (SELECT series, state_from, state_to, CASE WHEN n < {least} THEN CASE WHEN state_from = state_to THEN 0.6 ELSE 0.2 END ELSE mass / sum(mass) OVER (PARTITION BY series, state_from) END::DOUBLE AS p FROM {name}2)"""


query("ser_01_simple_returns", "v_prices", sql=f"WITH {_R} SELECT series, d, round(r, 8) AS r FROM r")(S.simple_returns)
query("ser_02_log_returns", "v_prices", sql=f"WITH x AS (SELECT series, d, ln(close / lag(close) {_W}) AS lr FROM {{v_prices}}) SELECT series, d, round(lr, 8) AS lr FROM x WHERE lr IS NOT NULL")(S.log_returns)
query("ser_03_volatility", "v_prices", sql=f"WITH {_R} SELECT series, round(stddev_samp(r) * sqrt(252), 8) AS vol FROM r GROUP BY 1")(lambda p: S.simple_returns(p).groupBy("series").agg(S.volatility(F.col("r")).alias("vol")))
query("ser_04_sharpe", "v_prices", sql=f"WITH {_R} SELECT series, round((avg(r) * 252 - 0.05) / (stddev_samp(r) * sqrt(252)), 8) AS sharpe FROM r GROUP BY 1")(lambda p: S.simple_returns(p).groupBy("series").agg(S.sharpe(F.col("r")).alias("sharpe")))
_TAIL = "tr AS (SELECT series, -max(r) AS var, -avg(r) AS shortfall FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r, d) AS i, greatest(1, floor(0.05 * count(*) OVER (PARTITION BY series) + 0.5)) AS k FROM r) WHERE i <= k GROUP BY 1)"
query("ser_05_06_tail_risk", "v_prices", sql=f"WITH {_R}, {_TAIL} SELECT series, round(var, 8) AS var, round(shortfall, 8) AS shortfall FROM tr")(lambda p: S.tail_risk(S.simple_returns(p)))
_DD = "dd AS (SELECT series, max((peak - close) / peak) AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY series ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM {v_prices}) GROUP BY 1)"
query("ser_07_max_drawdown", "v_prices", sql=f"WITH {_DD} SELECT series, round(max_drawdown, 8) AS max_drawdown FROM dd")(S.max_drawdown)
query("ser_08_correlation_matrix", "v_prices", sql=f"WITH {_R} SELECT a.series AS a, b.series AS b, round(CASE WHEN a.series = b.series THEN 1.0 ELSE coalesce(corr(a.r, b.r), 0) END::DOUBLE, 8) AS corr FROM r a JOIN r b USING (d) GROUP BY a.series, b.series")(lambda p: S.correlation_matrix(S.simple_returns(p)))


def _weights(p):  # noqa: ANN001, ANN202
    return p.select("series").distinct().withColumn("w", F.left("series", F.lit(1)).cast("double"))


_PR = f"{_R}, pr AS (SELECT d, sum(left(series, 1)::DOUBLE * r) / sum(left(series, 1)::DOUBLE) AS r FROM r GROUP BY d)"
query("ser_09_portfolio_returns", "v_prices", sql=f"WITH {_PR} SELECT d, round(r, 8) AS r FROM pr")(lambda p: S.portfolio_returns(S.simple_returns(p), _weights(p)))
query("ser_10_risk_report", "v_prices", sql=f"""WITH {_R}, {_TAIL}, {_DD} SELECT series, n, round(vol, 8) AS vol, round(sharpe, 8) AS sharpe, round(var, 8) AS var, round(shortfall, 8) AS shortfall, round(max_drawdown, 8) AS max_drawdown
    FROM (SELECT series, count(*) AS n, stddev_samp(r) * sqrt(252) AS vol, (avg(r) * 252 - 0.05) / (stddev_samp(r) * sqrt(252)) AS sharpe FROM r GROUP BY 1) JOIN tr USING (series) JOIN dd USING (series)""")(S.risk_report)
query("ser_10_portfolio_drawdown", "v_prices", sql=f"""WITH {_PR}, pa AS (SELECT d, 100 * exp(sum(ln(1 + r)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS path FROM pr),
    pk AS (SELECT path, greatest(100, max(path) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS peak FROM pa) SELECT 'all' AS portfolio, round(max((peak - path) / peak), 6) AS max_drawdown FROM pk""")(
    lambda p: S.compounded_drawdown(S.portfolio_returns(S.simple_returns(p), _weights(p)).withColumn("portfolio", F.lit("all")), "portfolio").withColumn("max_drawdown", F.round("max_drawdown", 6)))
query("ser_11_rolling_z", "v_prices", sql="""SELECT series, d, round(CASE WHEN sd < 1e-10 OR n < 2 THEN 0 ELSE (close - m) / sd END, 6) AS z FROM (SELECT *, stddev_pop(close) OVER w AS sd, avg(close) OVER w AS m, count(*) OVER w AS n
    FROM {v_prices} WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))""")(lambda p: S.rolling_z(p).withColumn("z", F.round("z", 6)))
query("ser_12_monthly_change", "v_prices", sql=f"SELECT series, d, round(CASE WHEN lag(close, 20) {_W} <> 0 THEN close / lag(close, 20) {_W} - 1 END, 8) AS change FROM {{v_prices}}")(S.change_over)
query("ser_14_pressure_regime", "v_prices", sql="""SELECT series, d, CASE WHEN z < 0.5 THEN 'LOW' WHEN z < 1.5 THEN 'MODERATE' WHEN z < 2 THEN 'ELEVATED' ELSE 'CRITICAL' END AS regime FROM (SELECT series, d, round(CASE WHEN stddev_pop(close) OVER w < 1e-10 OR count(*) OVER w < 2 THEN 0 ELSE (close - avg(close) OVER w) / stddev_pop(close) OVER w END, 6) AS z
    FROM {v_prices} WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))""")(lambda p: S.rolling_z(p).select("series", "d", S.regime_of_pressure(F.round("z", 6)).alias("regime")))
query("ser_16_momentum", "v_prices", sql=f"""WITH x AS (SELECT series, d, ln(close) AS lp, row_number() {_W}::DOUBLE AS i FROM {{v_prices}})
    SELECT series, d, round(v, 6) AS velocity, round(a, 6) AS acceleration, round(r2, 6) AS r2 FROM (SELECT series, d, (lp - lag(lp, 20) {_W}) / 20 * 252 AS v, ((lp - lag(lp, 10) {_W}) - (lag(lp, 10) {_W} - lag(lp, 20) {_W})) / 10 AS a,
    regr_r2(lp, i) OVER (PARTITION BY series ORDER BY d ROWS BETWEEN 20 PRECEDING AND CURRENT ROW) AS r2 FROM x) WHERE v IS NOT NULL""")(lambda p: S.momentum(p).select("series", "d", *[F.round(c, 6).alias(c) for c in ("velocity", "acceleration", "r2")]))
query("ser_17_ensemble_signal", "v_prices", sql=f"""WITH x AS (SELECT series, d, close, close / lag(close) {_W} - 1 AS r FROM {{v_prices}}),
    y AS (SELECT series, d, row_number() {_W} AS n, round(CASE WHEN stddev_pop(close) OVER w20 > 1e-12 THEN (close - avg(close) OVER w20) / stddev_pop(close) OVER w20 ELSE 0 END, 6) AS z, round(avg(close) OVER w5 / avg(close) OVER w20 - 1, 6) AS trend, round(coalesce(stddev_pop(r) OVER w5 / stddev_pop(r) OVER w20, 1), 6) AS vol_ratio
    FROM x WINDOW w20 AS (PARTITION BY series ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w5 AS (PARTITION BY series ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    v AS (SELECT *, -sign(CASE WHEN abs(z) > 1 THEN z ELSE 0 END) + sign(trend) + CASE WHEN vol_ratio < 1 THEN sign(trend) ELSE 0 END AS votes FROM y)
    SELECT series, d, z, trend, vol_ratio, CASE WHEN votes >= 2 THEN 1 WHEN votes <= -2 THEN -1 ELSE 0 END AS vote FROM v WHERE n > 20""")(lambda p: S.ensemble_signal(p).select("series", "d", *[F.round(c, 6).alias(c) for c in ("z", "trend", "vol_ratio")], "vote"))
query("ser_18_adaptive_threshold", "v_prices", sql=f"WITH {_R}, {_T} SELECT series, round(threshold, 8) AS threshold FROM th")(lambda p: S.adaptive_threshold(S.simple_returns(p)))


def _states(p):  # noqa: ANN001, ANN202
    return S.regime_series(S.simple_returns(p))


query("ser_19_regime_series", "v_prices", sql=f"WITH {_S} SELECT series, d, round(r, 8) AS r, state FROM st")(_states)
query("ser_20_transition_matrix", "v_prices", sql=f"WITH {_S}, {_STATES}, {_matrix()} SELECT series, state_from, state_to, round(p, 8) AS p FROM m")(lambda p: S.transition_matrix(_states(p)))
query("ser_20_user_transition_matrix", "v_prices_short", sql=f"WITH {_S.replace('v_prices', 'v_prices_short')}, {_STATES}, {_matrix()} SELECT series, state_from, state_to, round(p, 8) AS p FROM m")(lambda p: S.transition_matrix(_states(p)))


def _last(states):  # noqa: ANN001, ANN202
    return states.groupBy("series").agg(F.max_by("state", "d").alias("state"))


_STEP2 = "p2 AS (SELECT a.series, a.state_from, b.state_to, sum(a.p * b.p) AS p FROM m a JOIN m b ON a.series = b.series AND a.state_to = b.state_from GROUP BY ALL), p4 AS (SELECT a.series, a.state_from, b.state_to, sum(a.p * b.p) AS p FROM p2 a JOIN p2 b ON a.series = b.series AND a.state_to = b.state_from GROUP BY ALL)"
query("ser_21_n_step_distribution", "v_prices", sql=f"""WITH {_S}, {_STATES}, {_matrix()}, {_STEP2}, cur AS (SELECT series, max_by(state, d) AS state FROM st GROUP BY 1)
    SELECT series, round(sum(CASE WHEN state_to = 'bull' THEN p END), 8) AS bull, round(sum(CASE WHEN state_to = 'bear' THEN p END), 8) AS bear, round(sum(CASE WHEN state_to = 'sideways' THEN p END), 8) AS sideways FROM p4 JOIN cur USING (series) WHERE state_from = cur.state GROUP BY 1""")(
    lambda p: S.n_step_distribution(S.transition_matrix(_states(p)), _last(_states(p)), 4))
_WINS = "ws AS (SELECT series, state, CASE WHEN n < 3 OR sd < 1e-12 THEN r ELSE greatest(m - 3 * sd, least(m + 3 * sd, r)) END AS r FROM (SELECT *, avg(r) OVER q AS m, stddev_pop(r) OVER q AS sd, count(*) OVER q AS n FROM st WINDOW q AS (PARTITION BY series, state)))"
query("ser_22_regime_stats", "v_prices", sql=f"""WITH {_S}, {_STATES}, {_WINS}, g AS (SELECT series, state, count(*) AS c, avg(r) AS m, stddev_pop(r) AS s FROM ws GROUP BY ALL)
    SELECT k.series, states.state, round(CASE WHEN coalesce(c, 0) < 5 THEN CASE states.state WHEN 'bull' THEN 0.001 WHEN 'bear' THEN -0.001 ELSE 0 END ELSE greatest(-0.004, least(0.004, m)) END::DOUBLE, 8) AS mean, round(CASE WHEN coalesce(c, 0) < 5 THEN 0.01 ELSE s END::DOUBLE, 8) AS sd
    FROM (SELECT DISTINCT series FROM st) k CROSS JOIN states LEFT JOIN g ON g.series = k.series AND g.state = states.state""")(lambda p: S.regime_stats(_states(p)))
query("ser_23_regime_up_rates", "v_prices", sql=f"""WITH {_S}, {_STATES}, f AS (SELECT series, state, sum(ln(1 + r)) OVER w AS s, count(*) OVER w AS k FROM st WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
    u AS (SELECT series, state, avg((s > 0)::INT::DOUBLE) AS u FROM f WHERE k = 5 GROUP BY ALL) SELECT k.series, states.state, round(coalesce(u, 0.5), 8) AS up_rate FROM (SELECT DISTINCT series FROM st) k CROSS JOIN states LEFT JOIN u ON u.series = k.series AND u.state = states.state""")(lambda p: S.regime_up_rates(_states(p)))
query("ser_24_structural_break", "v_prices", sql=f"""WITH {_S}, {_STATES}, h AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY series) AS n FROM st), h1 AS (SELECT * FROM h WHERE n >= 36 AND i <= n // 2), h2 AS (SELECT * FROM h WHERE n >= 36 AND i > n // 2), {_matrix('h1', 'ma', 1)}, {_matrix('h2', 'mb', 1)}
    SELECT series, round(sum((a.p - b.p) ** 2), 8) AS divergence, (sum((a.p - b.p) ** 2) > 0.05)::INT AS is_break FROM ma a JOIN mb b USING (series, state_from, state_to) GROUP BY 1""")(lambda p: S.structural_break(_states(p)))
query("ser_25_transition_gof", "v_prices")(lambda p: S.transition_gof(_states(p), S.transition_matrix(_states(p))))
query("ser_26_state_counts", "v_prices", sql=f"WITH {_S}, {_STATES}, g AS (SELECT series, state, count(*) AS c FROM st GROUP BY ALL) SELECT k.series, states.state, coalesce(c, 0) AS n, (coalesce(c, 0) < 5)::INT AS sparse FROM (SELECT DISTINCT series FROM st) k CROSS JOIN states LEFT JOIN g ON g.series = k.series AND g.state = states.state")(lambda p: S.state_counts(_states(p)))
query("ser_27_transition_entropy", "v_prices")(lambda p: S.transition_entropy(S.transition_matrix(_states(p))))
query("ser_28_entropy_z", "v_prices", sql="""WITH x AS (SELECT series, d, round(CASE WHEN n < 5 OR sd < 1e-12 THEN 0 ELSE (close - m) / sd END, 6) AS z FROM (SELECT *, stddev_pop(close) OVER w AS sd, avg(close) OVER w AS m, count(*) OVER w AS n FROM {v_prices} WINDOW w AS (PARTITION BY series ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)))
    SELECT series, d, z, round(greatest(0.7, least(1.4, 1 + 0.15::DOUBLE * z)), 8) AS scale FROM x""")(lambda p: S.entropy_z(p).withColumn("z", F.round("z", 6)).withColumn("scale", F.greatest(F.lit(0.7), F.least(F.lit(1.4), 1 + 0.15 * F.col("z")))))
query("ser_29_regime_run_length", "v_prices", sql=f"""WITH {_S}, c AS (SELECT *, coalesce((state <> lag(state) {_W})::INT, 0) AS ch FROM st), i AS (SELECT *, sum(ch) {_W} AS island FROM c), g AS (SELECT series, island, count(*) AS run, max(state) AS state FROM i GROUP BY ALL)
    SELECT series, max_by(state, island) AS state, max_by(run, island) AS run FROM g GROUP BY 1""")(lambda p: S.regime_run_length(_states(p)))
query("ser_34_divergence_penalty", "v_prices", sql=f"WITH {_R} SELECT series, d, round(CASE WHEN abs(r) < 0.05 THEN 1.0 WHEN abs(r) < 0.10 THEN 0.8 WHEN abs(r) < 0.20 THEN 0.7 ELSE 0.6 END::DOUBLE, 8) AS penalty FROM r")(lambda p: S.simple_returns(p).select("series", "d", S.divergence_penalty(F.abs("r")).alias("penalty")))
query("ser_35_oos_r2", "v_steps", sql="SELECT ticker, horizon, round(1 - sum((actual_return - predicted_return) ** 2) / (var_pop(actual_return) * count(*)), 8) AS r2 FROM {v_steps} GROUP BY ALL")(lambda s: S.oos_r2(s.withColumnsRenamed({"actual_return": "actual", "predicted_return": "predicted"}), "ticker", "horizon"))
query("ser_37_38_garch", "v_prices", sql=f"""WITH {_R}, g AS (SELECT series, avg(r * r) AS h0, max_by(r, d) AS l FROM r GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT unnest(range(1, 11)) AS k)
    SELECT series, k::INT AS k, round(sqrt(h0 + 0.95 ** (k - 1) * (h0 * (1 - 0.10 - 0.85) + 0.10 * l * l + 0.85 * h0 - h0)), 8) AS sigma FROM g CROSS JOIN k""")(lambda p: S.garch(S.simple_returns(p)))
query("ser_40_ks_distance", "v_prices", sql=f"""WITH {_R}, s AS (SELECT series, r, (d >= DATE '1998-01-01')::INT AS s FROM r), v AS (SELECT series, r, sum(s) AS a, sum(1 - s) AS b FROM s GROUP BY ALL),
    g AS (SELECT series, abs(sum(a) OVER w / sum(a) OVER q - sum(b) OVER w / sum(b) OVER q) AS gap FROM v WINDOW w AS (PARTITION BY series ORDER BY r ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY series)) SELECT series, round(max(gap), 8) AS ks FROM g GROUP BY 1""")(lambda p: S.ks_distance(S.simple_returns(p), F.col("d") >= F.lit("1998-01-01").cast("date")))
_KS = f"""{_R}, nr AS (SELECT *, row_number() {_W} AS i, count(*) OVER (PARTITION BY series) AS n FROM r), sp AS (SELECT DISTINCT series, x.s AS split, n FROM nr, unnest(range(50, n - 49, 10)) x(s)),
    dl AS (SELECT nr.series, split, r, (i > split)::INT AS late FROM nr JOIN sp ON sp.series = nr.series AND i > split - 50 AND i <= split + 50), v AS (SELECT series, split, r, sum(late) AS a, sum(1 - late) AS b FROM dl GROUP BY ALL),
    g AS (SELECT series, split, abs(sum(a) OVER w / 50 - sum(b) OVER w / 50) AS gap FROM v WINDOW w AS (PARTITION BY series, split ORDER BY r ROWS UNBOUNDED PRECEDING)), k AS (SELECT series, split, max(gap) AS ks FROM g GROUP BY ALL HAVING max(gap) > 1.731 * sqrt(100.0 / 2500))"""
query("ser_41_drift_points", "v_prices", sql=f"WITH {_KS} SELECT series, max(split) AS split, round(max_by(ks, split), 8) AS ks FROM k GROUP BY 1")(lambda p: S.drift_points(S.simple_returns(p)))
query("ser_42_drift_trim", "v_prices", sql=f"WITH {_KS}, pt AS (SELECT series, max(split) AS split FROM k GROUP BY 1) SELECT nr.series, d, round(r, 8) AS r FROM nr LEFT JOIN pt USING (series) WHERE n - i + 1 <= CASE WHEN split IS NULL THEN n ELSE greatest(60, n - split) END")(lambda p: S.drift_trim(S.simple_returns(p)))
query("ser_43_jump_days", "v_prices", sql=f"""WITH x AS (SELECT series, d, ln(close / lag(close) {_W}) AS lr FROM {{v_prices}}), y AS (SELECT series, lr, abs(lr - avg(lr) OVER q) > 2 * stddev_samp(lr) OVER q AS hit FROM x WHERE lr IS NOT NULL WINDOW q AS (PARTITION BY series))
    SELECT series, count(*) FILTER (hit) AS jumps, round(avg(lr) FILTER (hit), 8) AS mean_jump, round(stddev_pop(lr) FILTER (hit), 8) AS sd_jump FROM y GROUP BY 1""")(lambda p: S.jump_days(p, 2.0))
query("ser_44_first_convergence", "v_snapshots", sql="""WITH x AS (SELECT market_id AS series, probability AS p, row_number() OVER (PARTITION BY market_id ORDER BY captured_at, event_id) - 1 AS i FROM {v_snapshots}) SELECT series, min(i) AS first, min_by(CASE WHEN p > 0.95 THEN 'yes' ELSE 'no' END, i) AS side FROM x WHERE p > 0.95 OR p < 0.05 GROUP BY 1""")(
    lambda s: S.first_convergence(s.select(F.col("market_id").alias("series"), F.struct("captured_at", "event_id").alias("d"), F.col("probability").alias("p"))))
query("ser_45_segment_windows", "v_prices", sql=f"""WITH {_R}, x AS (SELECT *, row_number() {_W} - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM r), w AS (SELECT DISTINCT series, n, unnest(range(0, (n - 48) // 24 + 1)) AS w FROM x WHERE n >= 48),
    e AS (SELECT series, w, w * 24 AS a FROM w UNION ALL SELECT series, (n - 48) // 24 + 1, n - 48 FROM (SELECT DISTINCT series, n FROM w) WHERE n - 48 > (n - 48) // 24 * 24) SELECT x.series, d, round(r, 8) AS r, w FROM x JOIN e ON e.series = x.series AND i >= a AND i < a + 48""")(lambda p: S.segment_windows(S.simple_returns(p)))
query("ser_61_mixing_weight", "v_prices")(lambda p: S.mixing_weight(S.transition_matrix(_states(p)), 5))
query("flt_10_winsorize", "v_prices", sql=f"WITH {_S}, {_WINS} SELECT series, state, round(r, 8) AS r FROM ws")(lambda p: S.winsorize(_states(p), "r", "series", "state").select("series", "state", "r"))
