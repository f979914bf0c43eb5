"""SQL of queries that stand on closed forms, small fixed-point rounds or gradient steps, written from their formulas."""

from __future__ import annotations

from quillon.functions.mathcols import ERF, PROBIT
from quillon.operators.anchors import DOMAINS
from quillon.plans.base import ORACLES, QUERIES, duck
from quillon.plans.series_queries import _R, _S, _STATES, _T, _WINS, _matrix


def _add(name: str, sql: str, recursive: bool = False) -> None:
    if name not in QUERIES:
        raise ValueError(f"no query named {name}")
    text = duck(sql)
    ORACLES[name] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text


def _num(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def _poly(x: str, *cs: float) -> str:
    out = _num(cs[0])
    for v in cs[1:]:
        out = f"({out} * {x} + {_num(v)})"
    return out


def _cdf(x: str) -> str:
    """The normal CDF over a column or expression x, by the approximation of mathcols.erf."""
    z, (p, a) = f"(({x}) / sqrt(2::DOUBLE))", ERF
    t = f"(1 / (1 + {_num(p)} * abs({z})))"
    return f"(0.5::DOUBLE * (1 + sign({z}) * (1 - {_poly(t, *a[::-1])} * {t} * exp(-{z} * {z}))))"


def _probit(p: str) -> str:
    a, b, c, d = PROBIT
    low, q = _num(0.02425), f"({p} - 0.5::DOUBLE)"
    tail = lambda x: f"({_poly(x, *c)} / {_poly(x, *d, 1.0)})"
    middle = f"({_poly(f'({q} * {q})', *a)} * {q} / {_poly(f'({q} * {q})', *b, 1.0)})"
    return f"CASE WHEN {p} < {low} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} <= 1 - {low} THEN {middle} ELSE -{tail(f'sqrt(-2 * ln(1 - {p}))')} END"


# distributions of ten-row moves
_PARAMS = """lr AS (SELECT series, ln(close / lag(close) OVER (PARTITION BY series ORDER BY d)) AS x FROM {v_prices}),
    pm AS (SELECT series, max_by(close, d) AS price FROM {v_prices} GROUP BY 1), ps AS (SELECT series, price, 10 * avg(x) AS mu, sqrt(10::DOUBLE) * stddev_samp(x) AS sigma FROM lr JOIN pm USING (series) GROUP BY ALL)"""
_at = lambda move: _cdf(f"(ln({_num(1 + move)}) - mu) / sigma")
_add("ser_53_scenario_buckets", f"""WITH {_PARAMS}, x AS (SELECT series, {_at(-0.05)} AS a, {_at(-0.03)} AS b, {_at(0.03)} AS d, {_at(0.05)} AS e FROM ps)
    SELECT series, round(a, 8) AS crash, round(b - a, 8) AS down, round(d - b, 8) AS flat, round(e - d, 8) AS up, round(1 - e, 8) AS surge FROM x""")
_add("ser_55_action_signal", f"""WITH {_PARAMS}, x AS (SELECT series, 1 - {_at(0.02)} AS up, {_at(-0.02)} AS down, exp(mu + sigma * sigma / 2) - 1 AS expected FROM ps)
    SELECT series, round(up, 8) AS up, round(down, 8) AS down, round(expected, 8) AS expected, CASE WHEN up >= 0.55 THEN 'BUY' WHEN down >= 0.55 THEN 'SELL' ELSE 'HOLD' END AS action FROM x""")
_GRID = f"{_PARAMS}, g AS (SELECT series, i, price * exp(mu + z * sigma) AS level, z FROM (SELECT ps.*, i::INT AS i, -3 + {_num(6 / 40)} * i AS z FROM ps CROSS JOIN range(41) k(i)))"
_add("ser_56_survival_grid", f"WITH {_GRID} SELECT series, i, round(ln(level), 8) AS log_level, round(1 - {_cdf('z')}, 8) AS survival FROM g")
_add("ser_56_student_grid", f"WITH {_GRID}, s AS (SELECT *, z * {_num(2**0.5)} / sqrt(z * {_num(2**0.5)} * z * {_num(2**0.5)} + 4) AS s FROM g) SELECT series, i, round(ln(level), 8) AS log_level, round(1 - (0.5::DOUBLE + 0.5::DOUBLE * s * (1.5::DOUBLE - 0.5::DOUBLE * s * s)), 8) AS survival FROM s")

# transition matrices
_Z = "((chi2 / df) ** (1 / 3.0::DOUBLE) - (1 - 2 / (9 * df)::DOUBLE)) / sqrt(2 / (9 * df)::DOUBLE)"
_add("ser_25_transition_gof", f"""WITH {_S}, {_STATES}, {_matrix()}, mv AS (SELECT series, lag(state) OVER (PARTITION BY series ORDER BY d) AS state_from, state AS state_to FROM st),
    o AS (SELECT series, state_from, state_to, count(*) AS o FROM mv WHERE state_from IS NOT NULL GROUP BY ALL), ce AS (SELECT m.series, m.state_from, p, coalesce(o, 0) AS o FROM m LEFT JOIN o USING (series, state_from, state_to)),
    e AS (SELECT *, sum(o) OVER (PARTITION BY series, state_from) AS n FROM ce), ro AS (SELECT series, state_from, sum((o - n * p) ** 2 / (n * p)) AS chi, count(*) - 1 AS df FROM e WHERE n >= 5 AND n * p >= 1 GROUP BY ALL),
    x AS (SELECT series, sum(chi) AS chi2, sum(df)::BIGINT AS df FROM ro GROUP BY 1), y AS (SELECT *, CASE WHEN df > 0 THEN 1 - {_cdf(_Z)} ELSE 1 END::DOUBLE AS p FROM x)
    SELECT series, round(chi2, 8) AS chi2, df, round(p, 8) AS p_value, (p >= 0.05)::INT AS passes FROM y""")
_NAMES = ("bull", "bear", "sideways")
_CELLS = ", ".join(f"max(p) FILTER (state_from = '{a}' AND state_to = '{b}') AS p{i}{j}" for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES))
_WIDE = f"{_S}, {_STATES}, {_matrix()}, wm AS (SELECT series, {_CELLS} FROM m GROUP BY 1)"
_moved = lambda j: f"v0 * p0{j} + v1 * p1{j} + v2 * p2{j}"
_LOGS = " + ".join(f"v{i} * (" + " + ".join(f"CASE WHEN p{i}{j} > 0 THEN p{i}{j} * ln(p{i}{j}) ELSE 0 END" for j in range(3)) + ")" for i in range(3))
_add("ser_27_transition_entropy", f"""WITH {_WIDE}, sv AS (SELECT series, 0 AS k, 1 / 3.0::DOUBLE AS v0, 1 / 3.0::DOUBLE AS v1, 1 / 3.0::DOUBLE AS v2 FROM wm UNION ALL SELECT series, k + 1, {_moved(0)}, {_moved(1)}, {_moved(2)} FROM sv JOIN wm USING (series) WHERE k < 100)
    SELECT series, round(-({_LOGS}) / ln(3::DOUBLE), 8) AS entropy FROM sv JOIN wm USING (series) WHERE k = 100""", recursive=True)
_DET = "p00 * (p11 * p22 - p12 * p21) - p01 * (p10 * p22 - p12 * p20) + p02 * (p10 * p21 - p11 * p20)"
_add("ser_61_mixing_weight", f"""WITH {_WIDE}, e AS (SELECT series, p00 + p11 + p22 - 1 AS s, {_DET} AS q FROM wm),
    l AS (SELECT series, CASE WHEN s * s - 4 * q >= 0 THEN greatest(abs(s + sqrt(greatest(s * s - 4 * q, 0))), abs(s - sqrt(greatest(s * s - 4 * q, 0)))) / 2 ELSE sqrt(abs(q)) END AS l FROM e) SELECT series, round(exp(-5 * l), 8) AS weight FROM l""")
_R2 = lambda x: f"CASE WHEN count(*) < 2 OR var_pop(r) * count(*) < 1e-14 THEN 0 ELSE 1 - sum((r - {x}) ** 2) / (var_pop(r) * count(*)) END"
_add("ser_36_excess_oos_r2", f"""WITH {_R.replace(', r AS', ', every AS')}, b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d DESC) AS back, count(*) OVER (PARTITION BY series) AS n, lag(r) OVER (PARTITION BY series ORDER BY d) AS before FROM every),
    r AS (SELECT series, d, r FROM b WHERE n > 25 AND back > 20), {_T}, {_S[_S.index('st AS ('):]}, {_STATES}, {_matrix()}, {_WINS}, g AS (SELECT series, state, count(*) AS c, avg(r) AS m FROM ws GROUP BY ALL),
    me AS (SELECT k.series, states.state, CASE WHEN coalesce(c, 0) < 5 THEN CASE states.state WHEN 'bull' THEN 0.001 WHEN 'bear' THEN -0.001 ELSE 0 END ELSE greatest(-0.004, least(0.004, m)) END::DOUBLE AS mean FROM (SELECT DISTINCT series FROM st) k CROSS JOIN states LEFT JOIN g ON g.series = k.series AND g.state = states.state),
    ex AS (SELECT m.series, state_from, sum(p * mean) AS predicted FROM m JOIN me ON me.series = m.series AND me.state = m.state_to GROUP BY ALL), ba AS (SELECT series, avg(r) AS mean_r FROM r GROUP BY 1),
    te AS (SELECT b.series, b.r, predicted, mean_r FROM b JOIN th USING (series) JOIN ex ON ex.series = b.series AND state_from = CASE WHEN before > threshold THEN 'bull' WHEN before < -threshold THEN 'bear' ELSE 'sideways' END JOIN ba ON ba.series = b.series WHERE n > 25 AND back <= 20),
    q AS (SELECT series, ({_R2('predicted')})::DOUBLE AS model, ({_R2('mean_r')})::DOUBLE AS naive FROM te GROUP BY 1) SELECT series, round(model, 8) AS model_r2, round(naive, 8) AS naive_r2, round(model - naive, 8) AS excess FROM q""")

# markets
_add("mkt_29_q_to_p", f"WITH x AS (SELECT market_id, {_probit('probability')} + {_num((0.08 - 0.04) / 0.2)} * sqrt(days_to_expiry / 365) AS z FROM {{v_markets}}) SELECT market_id, round({_cdf('z')}, 8) AS p FROM x")
_domain = lambda i: f"CASE tier WHEN 'electoral' THEN {_num(DOMAINS['politics'][i])} WHEN 'macro' THEN {_num(DOMAINS['macro'][i])} ELSE 0 END"
_add("mkt_31_domain_recalibration", f"""WITH x AS (SELECT market_id, tier, probability AS q, (1 + {_domain(1)} * ln(1 + greatest(days_to_expiry, 1))) * ({_probit('probability')}) + {_domain(0)} AS z FROM {{v_markets}})
    SELECT market_id, round(CASE WHEN q <= 0 OR q >= 1 OR tier = 'other' THEN greatest(0, least(1, q)) ELSE {_cdf('z')} END, 8) AS p FROM x""")
_FIT = f"""pt AS (SELECT asset, ln(price)::DOUBLE AS x, 1 - probability AS q FROM {{v_ladder}} WHERE probability > 0 AND probability < 1 AND price > 0), py AS (SELECT asset, x, {_probit('q')} AS y FROM pt),
    ab AS (SELECT asset, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM py GROUP BY 1), fit AS (SELECT asset, -a / b AS mu, 1 / b AS sigma FROM ab WHERE n >= 2 AND b > 0)"""
_add("mkt_32_lognormal_fit", f"WITH {_FIT} SELECT asset, round(mu, 8) AS mu, round(sigma, 8) AS sigma FROM fit")
_below = lambda k: _cdf(f"(ln({_num(k)}) - mu) / sigma")
_add("mkt_33_regime_mass", f"""WITH {_FIT}, x AS (SELECT asset, {_below(1000.0 * 1.03)} AS hi, {_below(1000.0 * 0.97)} AS lo FROM fit), y AS (SELECT asset, greatest(1 - hi, 0.01) AS up, greatest(lo, 0.01) AS down, greatest(hi - lo, 0.01) AS mid FROM x)
    SELECT asset, round(up / (up + down + mid), 8) AS bull, round(down / (up + down + mid), 8) AS bear, round(mid / (up + down + mid), 8) AS sideways FROM y""")
_SCALE = "CASE WHEN lower(v) LIKE '%k' THEN 1e3 WHEN lower(v) LIKE '%m' THEN 1e6 ELSE 1 END::DOUBLE"
_COMMA = r"'([0-9]),([0-9]{3})', '\1\2', 'g'"
_add("mkt_15_extract_price_levels", f"""WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(text, {_COMMA}), {_COMMA}), '[0-9]+(?:\\.[0-9]+)?[kKmM]?') AS f FROM documents)
    SELECT doc_id, len(list_filter(list_distinct(list_transform(f, lambda v: regexp_replace(v, '[kKmM]', '')::DOUBLE * {_SCALE})), lambda v: v >= 10))::INT AS levels FROM x""")
_CRPS = ORACLES["agg_11_mixture_crps"].rsplit(" SELECT asset, round(sum(a), 6) AS crps FROM h GROUP BY 1", 1)[0]
_FAR = "greatest(0, abs(1003.3::DOUBLE - (lo + hi) / 2) - (hi - lo) / 2) / ((hi - lo) / 2)"
_add("agg_12_tail_weighted_mixture_crps", f"""{_CRPS}, s AS (SELECT asset, sum(a) AS crps FROM h GROUP BY 1), e AS (SELECT asset, min(price) AS lo, max(price) AS hi FROM v_ladder GROUP BY 1), w AS (SELECT crps, 1 + 1.645::DOUBLE * {_FAR} AS w FROM s JOIN e USING (asset))
    SELECT round(sum(w * crps) / sum(w), 8) AS crps FROM w""")

# calibration by gradient steps
_logit = lambda p: f"ln(greatest(1e-6::DOUBLE, least({_num(1 - 1e-6)}, {p})) / (1 - greatest(1e-6::DOUBLE, least({_num(1 - 1e-6)}, {p}))))"


def _platt(name: str, rows: str, steps: int) -> str:
    """CTEs up to {name}(regime, a, b), from rows(regime, p, y)."""
    err = "n * (1 / (1 + exp(-(a * x + b))) - y)"
    return f"""{name}b AS (SELECT regime, y, n, {_logit('p')} AS x FROM (SELECT regime, round(p, 4) AS p, y, count(*) AS n FROM {rows} GROUP BY ALL)),
        {name}k AS (SELECT regime FROM {name}b GROUP BY 1 HAVING sum(n) >= 18 AND sum(n * y) > 0 AND sum(n * y) < sum(n)),
        {name}s AS (SELECT regime, 0 AS k, 1::DOUBLE AS a, 0::DOUBLE AS b FROM {name}k UNION ALL SELECT regime, k + 1, a - 0.5::DOUBLE * (sum({err} * x) / sum(n)), b - 0.5::DOUBLE * (sum({err}) / sum(n)) FROM {name}s JOIN {name}b USING (regime) WHERE k < {steps} GROUP BY regime, k, a, b),
        {name} AS (SELECT regime, a, b FROM {name}s WHERE k = {steps})"""


_ROWS = "rows0 AS (SELECT regime, predicted_prob AS p, y FROM {v_steps})"
_add("mkt_42_regime_platt", f"WITH {_ROWS}, {_platt('f', 'rows0', 40)} SELECT regime, round(a, 8) AS a, round(b, 8) AS b FROM f", recursive=True)
_add("mkt_43_two_pass_platt", f"""WITH {_ROWS}, {_platt('f', 'rows0', 15)}, rows1 AS (SELECT regime, coalesce(1 / (1 + exp(-(a * {_logit('p')} + b))), p) AS p, y FROM rows0 LEFT JOIN f USING (regime)), {_platt('g', 'rows1', 15)}
    SELECT f.regime, round(f.a, 8) AS a, round(f.b, 8) AS b, round(g.a, 8) AS a2, round(g.b, 8) AS b2 FROM f JOIN g USING (regime)""", recursive=True)

_add("ser_63_cluster_dates", """WITH ds AS (SELECT series, d, row_number() OVER (PARTITION BY series ORDER BY d) AS i FROM (SELECT DISTINCT (o_custkey % 50)::VARCHAR AS series, o_orderdate::DATE AS d FROM orders)),
    cl AS (SELECT series, i, d, d AS a FROM ds WHERE i = 1 UNION ALL SELECT n.series, n.i, n.d, CASE WHEN n.d - cl.d > 15 OR n.d - cl.a > 60 THEN n.d ELSE cl.a END FROM cl JOIN ds n ON n.series = cl.series AND n.i = cl.i + 1)
    SELECT series, a AS start, max(d) AS "end", count(*)::INT AS days FROM cl GROUP BY ALL""", recursive=True)
