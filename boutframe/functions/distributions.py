"""Normality test and power transform as native expressions.

D'Agostino (1970) for skewness, Anscombe and Glynn (1983) for kurtosis, combined by
D'Agostino and Pearson; Yeo and Johnson (2000) for the transform.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEAR_ZERO = 1e-12
MIN_SAMPLE = 8


def skewness_z(n: Column, skew: Column) -> Column:
    """Approximately normal score of a population skewness."""
    y = skew * F.sqrt((n + 1) * (n + 3) / ((n - 2) * 6))
    beta = (n * n + n * 27 - 70) * (n + 1) * (n + 3) * 3 / (
        (n - 2) * (n + 5) * (n + 7) * (n + 9)
    )
    w2 = F.sqrt((beta - 1) * 2) - 1
    return F.asinh(y / F.sqrt(F.lit(2.0) / (w2 - 1))) / F.sqrt(F.log(w2) * 0.5)


def kurtosis_z(n: Column, excess: Column) -> Column:
    """Approximately normal score of a population excess kurtosis."""
    expected = (n - 1) * 3 / (n + 1)
    variance = n * (n - 2) * (n - 3) * 24 / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - expected) / F.sqrt(variance)
    ratio = (n * n - n * 5 + 2) * 6 / ((n + 7) * (n + 9))
    third = ratio * F.sqrt((n + 3) * (n + 5) * 6 / (n * (n - 2) * (n - 3)))
    a = F.lit(8.0) / third * (F.lit(2.0) / third + F.sqrt(F.lit(4.0) / (third * third) + 1)) + 6
    inner = (F.lit(1.0) - F.lit(2.0) / a) / (x * F.sqrt(F.lit(2.0) / (a - 4)) + 1)
    slope = F.lit(2.0) / (a * 9)
    return (F.lit(1.0) - slope - F.cbrt(inner)) / F.sqrt(slope)


def normality_k2(n: Column, skew: Column, excess: Column) -> Column:
    """Omnibus statistic; null for small samples and constant columns."""
    size = n.cast("double")
    zs, zk = skewness_z(size, skew), kurtosis_z(size, excess)
    return F.when(n >= MIN_SAMPLE, zs * zs + zk * zk)


def normality_p(k2: Column) -> Column:
    """Upper tail of chi-square with two degrees of freedom."""
    return F.exp(k2 * -0.5)


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Power transform for either sign, continuous in ``lam``.

    Both signs are one formula: sign(x) * ((1 + |x|)^e - 1) / e with e = lam for
    positive and 2 - lam for negative values, and the logarithm where e is zero.
    """
    return signed_power(F.signum(x), F.log1p(F.abs(x)), lam)


def signed_power(sign: Column, log_size: Column, lam: Column) -> Column:
    """The transform from the sign and ``log1p(|x|)``, for callers that try many lambdas."""
    power = F.when(sign < 0, F.lit(2.0) - lam).otherwise(lam)
    grown = F.expm1(power * log_size) / power
    return sign * F.when(F.abs(power) < NEAR_ZERO, log_size).otherwise(grown)


def centred_power(x: Column, lam: Column, side: Column, centre: Column) -> Column:
    """The transform up to a positive factor and a shift, exact where the plain one is not.

    Far from zero all values of a feature have nearly the same power, and differences of the plain
    transform are rounding noise. ``side`` is 1 or -1 for a feature with values of that sign only,
    with its mean ``log1p(|x|)`` as ``centre``, and 0, with a centre of 0, for any other feature.
    A value of the other sign gets the same factor and shift.
    """
    return centred_size(F.signum(x), F.log1p(F.abs(x)), lam, side, centre)


def centred_size(sign: Column, log_size: Column, lam: Column, side: Column, centre: Column) -> Column:
    """:func:`centred_power` from the sign and ``log1p(|x|)``, for callers that try many lambdas."""
    own = F.when(side < 0, F.lit(2.0) - lam).otherwise(lam)
    flat = F.abs(own) < NEAR_ZERO

    def grown(length: Column) -> Column:
        return F.when(flat, length).otherwise(F.expm1(own * length) / own)

    plain = signed_power(sign, log_size, lam)
    other = (plain - side * grown(centre)) * F.exp(-own * centre)
    return F.when(side == 0, plain).when(sign * side < 0, other).otherwise(side * grown(log_size - centre))
