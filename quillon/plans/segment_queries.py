"""Queries of segment regressions and their clusters, with SQL that solves and clusters too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import segments as G
from quillon.operators import series as S
from quillon.plans.base import query
from quillon.plans.forecast_queries import _R

c = F.col
_P = len(G.REGRESSORS)
#: Larger than the operator's own: the returns of the test tables are so wide that sums in another order would show in the fourth place.
RIDGE = 1e-3

_WINDOWS = """x AS (SELECT series, d, close / lag(close) OVER (PARTITION BY series ORDER BY d) - 1 AS r FROM {v_prices}),
    y AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM x WHERE r IS NOT NULL),
    win AS (SELECT y.*, w FROM y, range(0, 1000) g(w) WHERE n >= 48 AND w <= (n - 48) // 24 AND i >= 24 * w AND i < 24 * w + 48 UNION ALL SELECT *, (n - 48) // 24 + 1 FROM y WHERE n >= 48 AND n - 48 > (n - 48) // 24 * 24 AND i >= n - 48)"""


def _solve_sql() -> str:
    """Elimination of the 6 x 6 systems, one step a table, then substitution; positive definite, so without pivots."""
    xs = ["1.0::DOUBLE", "l1", "l2", "l3", "(l1 + l2 + l3) / 3", "abs(l1)"]
    sums = [f"sum({a} * {b}){f' + {RIDGE}' if i == j else ''} AS m{i}{j}" for i, a in enumerate(xs) for j, b in enumerate(xs)] + [f"sum({a} * r) AS y{i}" for i, a in enumerate(xs)]
    plain = [f"sum({a} * {b}) AS a{i}{j}" for i, a in enumerate(xs) for j, b in enumerate(xs)] + [f"sum({a} * r) AS t{i}" for i, a in enumerate(xs)]
    out = ["lagged AS (SELECT *, lag(r) OVER q AS l1, lag(r, 2) OVER q AS l2, lag(r, 3) OVER q AS l3 FROM win WINDOW q AS (PARTITION BY series, w ORDER BY d))"]
    out.append(f"e0 AS MATERIALIZED (SELECT series, w, count(*) AS n, sum(r * r) AS yy, {', '.join(sums + plain)} FROM lagged WHERE l3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 9)")
    for k in range(_P - 1):
        less = [f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}" for i in range(k + 1, _P) for j in range(k + 1, _P)] + [f"y{i} - m{i}{k} * y{k} / m{k}{k} AS y{i}" for i in range(k + 1, _P)]
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(less)}) FROM e{k})")
    last = f"e{_P - 1}"
    for k in reversed(range(_P)):
        known = "".join(f" - m{k}{j} * b{j}" for j in range(k + 1, _P))
        out.append(f"s{k} AS MATERIALIZED (SELECT *, (y{k}{known}) / m{k}{k} AS b{k} FROM {last})")
        last = f"s{k}"
    fit = " + ".join(f"b{i} * b{j} * a{i}{j}" for i in range(_P) for j in range(_P)) + "".join(f" - 2 * b{i} * t{i}" for i in range(_P))
    out.append(f"coef AS MATERIALIZED (SELECT series, w, n, {', '.join(f'b{i}' for i in range(_P))}, greatest(0, yy + {fit}) / greatest(1, n - {_P}) AS residual_variance FROM s0)")
    return f"{_WINDOWS}, {', '.join(out)}"


def _cluster_sql(k: int = 3, rounds: int = 10) -> str:
    out = [f"v AS MATERIALIZED (SELECT series, w, [{', '.join(G.FEATURES)}] AS v, row_number() OVER (ORDER BY b1) - 1 AS place, count(*) OVER () AS n FROM coef)"]
    out.append(f"c0 AS MATERIALIZED (SELECT j, v AS m FROM range({k}) g(j) JOIN v ON place = floor(j * (n - 1) / ({k} - 1)::DOUBLE + 0.5))")
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED (SELECT series, w, v, arg_min(j, list_distance(v, m)) AS j, min(list_distance(v, m)) AS near, list(list_distance(v, m) ** 2) AS d FROM v CROSS JOIN c{i} GROUP BY ALL)")
        mean = ", ".join(f"avg(v[{x + 1}])" for x in range(_P + 1))
        out.append(f"c{i + 1} AS MATERIALIZED (SELECT j, coalesce(u.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT j, [{mean}] AS m FROM a{i} GROUP BY 1) u USING (j))")
    last = f"a{rounds - 1}"
    return f"{', '.join(out)} SELECT series, w, j::INT AS cluster, round(near, 4) AS distance, round(1 / list_sum([exp((near ** 2 - x) / greatest(1e-6, list_sum(d) / {k})) FOR x IN d]), 4) AS membership FROM {last}"


def _coefficients(p: DataFrame) -> DataFrame:
    return G.segment_coefficients(S.segment_windows(S.simple_returns(p)), RIDGE)


query("ser_46_segment_coefficients", "v_prices", sql=f"WITH {_solve_sql()} SELECT series, w, n, {', '.join(f'round({x}, 4) AS {x}' for x in G.FEATURES)} FROM coef")(
    lambda p: _coefficients(p).select("series", "w", "n", *[F.round(x, 4).alias(x) for x in G.FEATURES]))
query("ser_47_cluster_segments", "v_prices", sql=f"WITH {_solve_sql()}, {_cluster_sql()}")(
    lambda p: G.cluster_segments(_coefficients(p)).withColumns({"distance": F.round("distance", 4), "membership": F.round("membership", 4)}))
query("ser_46_segment_moments", "v_prices", sql=f"WITH {_R}, x AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY d) - 1) // 48 AS w FROM r), l AS (SELECT *, lag(r) OVER q AS x1, lag(r, 3) OVER q AS x3 FROM x WINDOW q AS (PARTITION BY series, w ORDER BY d)) SELECT series, w, count(*) AS n, round(sum(x1 * x3), 8) AS s13, round(sum(x1 * r), 8) AS s1y FROM l WHERE x3 IS NOT NULL GROUP BY ALL")(
    lambda p: G.normal_equations(S.simple_returns(p).withColumn("w", F.floor((F.row_number().over(S._time()) - 1) / 48))).select("series", "w", "n", c("moments")[8].alias("s13"), c("targets")[1].alias("s1y")))
