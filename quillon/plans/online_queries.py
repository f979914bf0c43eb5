"""Queries of the online folds. Their SQL reduces the ordered list of a key's rows, which DuckDB may hold whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.plans.base import query
from quillon.streaming import folds as Z

c = F.col


def _num(v: float) -> str:
    return f"{v!r}::DOUBLE"


def _reduced(fields: dict[str, str], rows: dict[str, str], step: dict[str, str], out: str) -> str:
    """SQL of a fold: fields (name to start value), rows (name to a column of v_steps), step (name to the next value of a from a and x)."""
    start = ", ".join(f"'{k}': {v}" for k, v in (fields | {k: "0::DOUBLE" for k in rows}).items())
    item = ", ".join(f"'{k}': {v}" for k, v in (fields | rows).items())
    moved = ", ".join(f"'{k}': {v}" for k, v in (step | {k: f"x.{k}" for k in rows}).items())
    return f"""WITH g AS (SELECT ticker, horizon, list({{{item}}} ORDER BY t) AS rows FROM {{v_steps}} GROUP BY ALL),
        f AS (SELECT ticker, horizon, list_reduce(rows, lambda a, x: {{{moved}}}, {{{start}}}) AS a FROM g) SELECT ticker, horizon, {out} FROM f"""


_MISS = "CASE WHEN x.r > a.q THEN 1 ELSE 0 END::DOUBLE"
_E = f"({_MISS} - {_num(1 - 0.9)})"
_RESIDUAL = "abs(actual_return - predicted_return)"
_PID = _reduced(
    {"q": _num(0.1), "i": _num(0.0), "e": _num(0.0), "hit": _num(0.0), "n": _num(0.0)},
    {"r": _RESIDUAL},
    {"q": f"greatest({_num(0.0)}, a.q + {_num(0.05)} * ({_num(1.0)} * {_E} + {_num(0.1)} * (a.i + {_E}) + {_num(0.1)} * ({_E} - a.e)))", "i": f"a.i + {_E}", "e": _E, "hit": f"a.hit + 1 - {_MISS}", "n": "a.n + 1"},
    "round(a.q, 8) AS radius, round(a.hit / a.n, 8) AS coverage",
)
query("str_03_conformal_pid", "v_numbered_steps", sql=_PID)(lambda s: Z.conformal_pid(s.withColumn("residual", F.abs(c("actual_return") - c("predicted_return")))))

_HELD = f"greatest({_num(1e-6)}, least({_num(1 - 1e-6)}, x.p))"
_X = f"ln({_HELD} / (1 - {_HELD}))"
_Q = f"(1 / (1 + exp(-(a.bias + a.slope * {_X}))))"
_G = f"(2 * ({_Q} - x.y) * {_Q} * (1 - {_Q}) * CASE WHEN x.p > {_num(0.4)} AND x.p < {_num(0.6)} THEN 2 ELSE 1 END)"
_BRIER = _reduced(
    {"bias": _num(0.0), "slope": _num(1.0)},
    {"p": "predicted_prob", "y": "y::DOUBLE"},
    {"bias": f"greatest({_num(-2.0)}, least({_num(2.0)}, a.bias - {_num(0.05)} * {_G}))", "slope": f"greatest({_num(0.2)}, least({_num(3.0)}, a.slope - {_num(0.05)} * {_G} * {_X}))"},
    "round(a.bias, 8) AS bias, round(a.slope, 8) AS slope",
)
query("str_06_online_brier", "v_numbered_steps", sql=_BRIER)(lambda s: Z.online_brier_calibrator(s.select("ticker", "horizon", "t", c("predicted_prob").alias("p"), c("y").cast("double").alias("y"))))

_BASE = "CASE WHEN a.vol >= 0 THEN a.vol ELSE a.res END"
_SHOCK = f"(x.brk > 0 OR (x.rv > 0 AND {_BASE} >= 0 AND x.rv >= {_BASE} * {_num(1.5)}))"
_ON = f"({_SHOCK} OR a.cool > 0)"
_BREAK = _reduced(
    {"q": _num(0.1), "cool": _num(0.0), "res": _num(-1.0), "vol": _num(-1.0), "hit": _num(0.0), "broken": _num(0.0), "mode": _num(0.0), "n": _num(0.0)},
    {"r": _RESIDUAL, "rv": "abs(actual_return)", "brk": "(t % 97 = 0)::INT::DOUBLE"},
    {
        "q": f"greatest({_num(0.0)}, a.q + CASE WHEN {_ON} THEN {_num(0.05 * 1.5)} ELSE {_num(0.05)} END * {_E})",
        "cool": f"CASE WHEN {_SHOCK} THEN {_num(3.0)} ELSE greatest({_num(0.0)}, a.cool - 1) END",
        "res": f"CASE WHEN a.res < 0 THEN x.r ELSE {_num(0.95)} * a.res + {_num(0.05)} * x.r END",
        "vol": f"CASE WHEN x.rv <= 0 THEN a.vol WHEN a.vol < 0 THEN x.rv ELSE {_num(0.9)} * a.vol + {_num(0.1)} * x.rv END",
        "hit": f"a.hit + 1 - {_MISS}", "broken": f"a.broken + {_ON}::INT", "mode": f"{_ON}::INT::DOUBLE", "n": "a.n + 1",
    },
    f"round(a.q, 8) AS radius, round(a.q * CASE WHEN a.mode > 0 THEN sqrt({_num(1.5)}) ELSE 1 END, 8) AS applied, round(a.hit / a.n, 8) AS coverage, a.broken::INT AS breaks",
)
query("str_04_adaptive_conformal", "v_numbered_steps", sql=_BREAK)(lambda s: Z.adaptive_conformal(s.select("ticker", "horizon", "t", F.abs(c("actual_return") - c("predicted_return")).alias("residual"), F.abs("actual_return").alias("rv"), (c("t") % 97 == 0).alias("is_break")), cooloff=3))
