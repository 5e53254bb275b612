"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column) -> Column:
    """Complementary error function by the rational Chebyshev fit of Numerical Recipes (relative error below 1.2e-7)."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    # coefficients of the published fit (fixed values)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def normal_cdf(x: Column) -> Column:
    return 0.5 * erfc(-x / math.sqrt(2))


def chi2_tail(x: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return F.when(x <= 0, 1.0).otherwise(erfc(F.sqrt(x / 2)))


def ln_gamma(x: Column) -> Column:
    """ln gamma for x > 0: Stirling's series after a shift by eight."""
    shift = F.log(x)
    for i in range(1, 8):
        shift = shift + F.log(x + i)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, 5)) - shift


def ln_choose(n: Column, k: Column) -> Column:
    return ln_gamma(n + 1.0) - ln_gamma(k + 1.0) - ln_gamma(n - k + 1.0)


def binomial_tail(n: int, k: int, p: Column) -> Column:
    """P(X >= k) of Binomial(n, p): the Beta(k, n - k + 1) distribution function at p."""
    terms = [math.comb(n, j) * F.pow(p, j) * F.pow(1 - p, n - j) for j in range(k, n + 1)]
    return sum(terms[1:], terms[0])


def correlation(x, y) -> Column:
    """Aggregate: Pearson's correlation of two columns; null where one of them is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
