"""Distribution formulas written as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIES_TERMS = 20


def kolmogorov_tail(lam: Column) -> Column:
    """P(K > lam) for the Kolmogorov distribution.

    The alternating series converges fast from 0.2 on; below that the tail is 1 to
    double precision.
    """
    terms = F.array(*[F.lit(float(k)) for k in range(1, SERIES_TERMS + 1)])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, k: acc + F.when(
        F.pmod(k, F.lit(2.0)) == 1.0, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def ks_p_value(distance: Column, n_eff: Column) -> Column:
    """Tail probability of a two-sample distance with a finite-size correction."""
    root = F.sqrt(n_eff)
    scaled = root * distance
    return kolmogorov_tail(scaled + 1.0 / (F.lit(6.0) * root) + (scaled - 1.0) / (F.lit(4.0) * n_eff))


def kolmogorov_quantile(alpha: float) -> float:
    """The lam with tail probability alpha (a plan-time constant)."""
    lam = math.sqrt(-math.log(alpha / 2.0) / 2.0)
    for _ in range(20):
        rest = sum((-1) ** k * math.exp(-2.0 * k * k * lam * lam) for k in range(2, 8))
        lam = math.sqrt(-math.log(alpha / 2.0 + rest) / 2.0)
    return lam


def ks_critical(alpha: float, n_eff: Column) -> Column:
    """Distance exceeded with probability alpha, the inverse of ``ks_p_value``."""
    lam = kolmogorov_quantile(alpha)
    n = F.greatest(F.floor(n_eff).cast("double"), F.lit(1.0))
    root = F.sqrt(n)
    return (F.lit(lam) - 1.0 / (F.lit(6.0) * root) + 1.0 / (F.lit(4.0) * n)) / (
        root * (1.0 + 1.0 / (F.lit(4.0) * n)))
