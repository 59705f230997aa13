"""Normal distribution and annualisation helpers as Column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trading days in a year (a fixed convention of all annualised figures).
YEAR = 252
EULER_GAMMA = 0.5772156649015329
#: Coefficients of the erf approximation 7.1.26 of Abramowitz and Stegun (absolute error up to 1.5e-7), fixed values.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def phi(x: Column) -> Column:
    """Standard normal distribution function, JVM-side."""
    z = F.abs(x) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    half = F.lit(0.5) * poly * F.exp(-z * z)
    return F.when(x >= 0, F.lit(1.0) - half).otherwise(half)


def phi_inverse(p: float) -> float:
    return NormalDist().inv_cdf(p)


def expected_max_sharpe(trials: int, deviation: float) -> float:
    """Expected largest Sharpe ratio among independent trials without skill whose estimates have this standard deviation."""
    if trials < 2:
        return 0.0
    return deviation * ((1 - EULER_GAMMA) * phi_inverse(1 - 1 / trials) + EULER_GAMMA * phi_inverse(1 - 1 / (trials * math.e)))


def sharpe_error(sr: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    """Standard error of a per-period Sharpe ratio under skew and (non-excess) kurtosis."""
    inner = F.greatest(F.lit(1.0) - skew * sr + (kurtosis - 1) / 4 * sr * sr, F.lit(1e-12))
    return F.sqrt(inner / F.greatest(n - 1, F.lit(1)))


def over(x: Column, y: Column, unbounded: bool = False) -> Column:
    """x / y: null where y is 0 or, ``unbounded``, infinite with the sign of x there (0 / 0 is not a number)."""
    if not unbounded:
        return x / F.nullif(y, F.lit(0.0))
    ends = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x == 0, float("nan"))
    return F.when(y == 0, ends).otherwise(x / F.nullif(y, F.lit(0.0)))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate of the rows that have both; null, not an error, where either does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def safe_beta(y: Column | str, x: Column | str) -> Column:
    """Slope of y on x as an aggregate; null where x does not vary."""
    return F.covar_samp(y, x) / F.nullif(F.var_samp(x), F.lit(0.0))


def chi_square_tail(x: Column, freedom: int) -> Column:
    """The probability that a chi-square figure of so many degrees of freedom is over ``x``: a finite sum of the incomplete gamma function."""
    z = F.greatest(x, F.lit(0.0)) / 2
    odd = freedom % 2
    out = 2 * phi(-F.sqrt(2 * z)) if odd else F.lit(0.0)
    for i in range(freedom // 2):
        power = i + odd / 2
        out = out + F.exp(-z) * F.pow(z, F.lit(float(power))) / math.gamma(power + 1)
    return out
