"""How far a forecast is pulled to its base rate, and how much it is trusted: column arithmetic, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.mathcols import clamp

#: Fixed values of the shrinkage weight: start, less for each agreeing signal, most for long data and per doubling of it,
#: converged, regime, mature bull, and the bounds of the weight and of the centre.
KAPPA, PER_SIGNAL, MOST_DATA, PER_DOUBLING, CONVERGED, REGIME, MATURE = 0.45, 0.07, 0.08, 0.04, 0.03, 0.03, 0.10
KAPPA_RANGE, CENTRE_RANGE = (0.15, 0.55), (0.25, 0.80)
#: Fixed values of the confidence: weights of its parts, and multipliers by kind of asset.
WEIGHTS = {"decisive": 0.30, "consensus": 0.15, "converged": 0.10, "stable": 0.15, "momentum": 0.10, "with_base": 0.20, "against_base": -0.08, "near_zero_r2": 0.08}
ASSETS = {"crypto": 0.7, "commodity": 0.85, "etf": 1.1}
#: Fixed steps of the divergence penalty: below each bound the factor; from the last on, the lowest.
DIVERGENCE, DIVERGENCE_LOWEST = ((0.05, 1.0), (0.10, 0.80), (0.20, 0.70)), 0.60


def _is(flag: Column | None) -> Column:
    return F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))


def _or(value: Column | None, other: float) -> Column:
    return F.lit(other) if value is None else F.coalesce(value, F.lit(other))


def shrink_to_base_rate(p: Column, base_rate: Column | None = None, consensus: Column | None = None, days: Column | None = None, converged: Column | None = None, regime: Column | None = None, mature_bull: Column | None = None, scale: float = 1.0) -> Column:
    """kappa * centre + (1 - kappa) * p, kappa smaller with agreeing signals (0 to 3), data and convergence, by regime.

    One kappa for all levels of a curve keeps the curve monotone. Absent or null inputs: base rate 0.5, no signal,
    60 days, not converged, no regime.
    """
    n = _or(days, 60.0).cast("double")
    data = F.when(n > 60, F.least(F.lit(MOST_DATA), PER_DOUBLING * F.log2(n / 60))).otherwise(0.0)
    start = (KAPPA - PER_SIGNAL * _or(consensus, 0.0) - data - F.when(_is(converged), CONVERGED).otherwise(0.0)) * scale
    state = F.lit(None).cast("string") if regime is None else regime
    shift = F.when(_is(mature_bull), MATURE).when(state.isin("bull", "bear"), -REGIME).when(state == "sideways", REGIME).otherwise(0.0)
    kappa = clamp(start + shift, *KAPPA_RANGE)
    return kappa * clamp(_or(base_rate, 0.5), *CENTRE_RANGE) + (1 - kappa) * p


def divergence_penalty(divergence: Column) -> Column:
    """Factor of a break by the divergence of the two halves' matrices."""
    return F.coalesce(*[F.when(divergence < bound, factor) for bound, factor in DIVERGENCE], F.lit(DIVERGENCE_LOWEST))


def prediction_confidence(
    p: Column, consensus: Column, run: Column, agreement: Column | None = None, *, converged: Column | None = None, calibrated: Column | None = None, base_rate: Column | None = None, is_break: Column | None = None,
    divergence: Column | None = None, break_policy: str = "default", regime: Column | None = None, asset: Column | None = None, volatility: Column | None = None, entropy: Column | None = None,
    anchors: Column | None = None, horizon: Column | None = None, r2: Column | None = None, rebalanced: bool = False,
) -> Column:
    """Weighted parts times the multipliers of break, asset, volatility and regime uncertainty, within 0 and 1.

    Parts: decisiveness, consensus (0 to 3), convergence, regime run over 20, momentum agreement, and the calibrated p
    (where given) with or against the base rate. `break_policy`: default (0.6; milder for a crypto forecast of at most
    14 days with two trusted anchors, by its out-of-sample R2), trend_penalty_only (none in a sideways regime) or
    divergence_weighted. `rebalanced` weighs anchors and scales crypto anew. Absent or null inputs leave their factor 1;
    a null p, consensus or run gives null.
    """
    if break_policy not in ("default", "trend_penalty_only", "divergence_weighted"):
        raise ValueError(f"no such break policy: {break_policy}")
    none = F.lit(None).cast("double")
    kind, fit = F.lit("") if asset is None else F.coalesce(asset, F.lit("")), none if r2 is None else r2
    short = (kind == "crypto") & _is(None if horizon is None else horizon <= 14)
    helped, bad = _or(anchors, 0) >= 2, F.coalesce(fit < -0.05, F.lit(False))

    parts = WEIGHTS["decisive"] * F.least(F.lit(1.0), 2 * F.abs(p - 0.5)) + WEIGHTS["consensus"] * consensus / 3 + F.when(_is(converged), WEIGHTS["converged"]).otherwise(0.0)
    parts = parts + WEIGHTS["stable"] * F.least(F.lit(1.0), run / 20) + WEIGHTS["momentum"] * _or(agreement, 0.0)
    if calibrated is not None and base_rate is not None:
        side = F.when((calibrated >= 0.5) == (base_rate >= 0.5), WEIGHTS["with_base"]).otherwise(WEIGHTS["against_base"])
        parts = parts + F.coalesce(side * 2 * F.abs(base_rate - 0.5), F.lit(0.0))
    parts = parts + F.when(short & fit.between(-0.02, 0.02), WEIGHTS["near_zero_r2"]).otherwise(0.0)
    if rebalanced:
        parts = parts + F.when(short, F.when(helped, 0.05).otherwise(0.03)).when(helped, 0.02).otherwise(0.0)

    if break_policy == "divergence_weighted":
        broken = divergence_penalty(_or(divergence, 0.20))
    else:
        broken = F.when(short & helped, F.when(fit.isNull(), 0.85).when(~bad, 0.80).otherwise(0.60)).otherwise(0.60)
    spared = _is(regime == "sideways") if break_policy == "trend_penalty_only" and regime is not None else F.lit(False)
    crypto = F.when(short & helped, 0.85).otherwise(ASSETS["crypto"])
    if rebalanced:
        crypto = F.when(short, F.when(helped & fit.isNull(), 0.95).when(helped & ~bad, 0.92).otherwise(0.82)).otherwise(0.74)
    of_asset = F.when(kind == "crypto", crypto).when(kind == "commodity", ASSETS["commodity"]).when(kind == "etf", ASSETS["etf"]).otherwise(1.0)
    extra = _or(volatility, 0.0) - 0.02
    calm = F.greatest(F.lit(0.7), 1 - 5 * extra)
    if rebalanced:
        calm = F.when(short, F.greatest(F.lit(0.85), 1 - 3 * extra)).otherwise(calm)
        of_asset = of_asset * F.when(short, 1.6).when(kind == "crypto", 1.35).otherwise(1.0)
    sure = F.greatest(F.lit(0.65), 1 - 0.35 * _or(entropy, 0.0))
    total = clamp(parts * F.when(_is(is_break) & ~spared, broken).otherwise(1.0) * of_asset * F.when(extra > 0, calm).otherwise(1.0) * sure, 0, 1)
    return F.when(parts.isNotNull(), total)
