"""Closed-form maths as column expressions: no Python runs per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# fixed values: the published coefficients
ERF = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))
PROBIT = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01),
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00),
)


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def divided(a: Column, b: Column) -> Column:
    """a / b as floats divide everywhere but in ANSI SQL: by zero it is infinite, or no number where a is zero too."""
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a.isNotNull() & b.isNotNull(), float("nan"))


def erf(x: Column) -> Column:
    """Error function by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    p, a = ERF
    t = 1 / (1 + p * F.abs(x))
    poly = F.lit(a[4])
    for c in (a[3], a[2], a[1], a[0]):
        poly = poly * t + c
    return F.signum(x) * (1 - poly * t * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def normal_pdf(x: Column) -> Column:
    return F.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)


def probit(p: Column) -> Column:
    """Inverse normal CDF by Acklam's rational approximation; p is clamped to (0, 1)."""
    a, b, c, d = PROBIT
    p = clamp(p, 1e-12, 1 - 1e-12)

    def poly(cs: tuple[float, ...], x: Column, last: float | None = None) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out if last is None else out * x + last

    def tail(q: Column) -> Column:
        return poly(c, q) / poly(d, q, 1.0)

    low, q = 0.02425, p - 0.5
    r = q * q
    middle = poly(a, r) * q / poly(b, r, 1.0)
    return F.when(p < low, tail(F.sqrt(-2 * F.log(p)))).when(p <= 1 - low, middle).otherwise(-tail(F.sqrt(-2 * F.log(1 - p))))


def student_cdf(t: Column, nu: int) -> Column:
    """Student-t CDF in closed form for 3, 4 and 5 degrees of freedom."""
    if nu == 3:
        u = t / math.sqrt(3)
        return 0.5 + (u / (1 + u * u) + F.atan(u)) / math.pi
    if nu == 4:
        s = t / F.sqrt(t * t + 4)
        return 0.5 + 0.5 * s * (1.5 - 0.5 * s * s)
    if nu == 5:
        u = t / math.sqrt(5)
        w = 1 + u * u
        return 0.5 + (u / w * (1 + 2 / (3 * w)) + F.atan(u)) / math.pi
    raise ValueError("closed form only for 3, 4 and 5 degrees of freedom")


def student_quantile(p: Column, nu: int) -> Column:
    """Inverse of student_cdf between -50 and 50, by halving; exact to 1e-13 of that range."""
    start = F.struct(F.lit(-50.0).alias("low"), F.lit(50.0).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        below = student_cdf(middle, nu) < p
        return F.struct(F.when(below, middle).otherwise(state["low"]).alias("low"), F.when(below, state["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(50)), start, halve, lambda state: (state["low"] + state["high"]) / 2)
    return F.when(p.isNotNull(), found)


def logit(p: Column, eps: float = 1e-6) -> Column:
    p = clamp(p, eps, 1 - eps)
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
