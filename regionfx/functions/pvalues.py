"""Tail probabilities by published formulas, as vectorised functions for small result tables."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 1000):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + n * d or 1e-300)
            c = 1 + n / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, dof: float) -> float:
    return upper_gamma(dof / 2, x / 2)


def correlation_p(rho: float, n: float) -> float:
    """Two-sided p of a rank correlation by the t distribution; null below three pairs."""
    if n < 3:
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    v = n - 2
    return beta_tail(v / 2, 0.5, v / (v + rho * rho * v / (1 - rho * rho)))


@lru_cache(maxsize=256)
def rank_counts(n1: int, n2: int) -> list[int]:
    """In how many of the orders of n1 and n2 values without ties U is 0, 1, ... n1 * n2: the coefficients of a Gaussian binomial."""
    top = n1 * n2
    ways = [1] + [0] * top
    for i in range(1, n1 + 1):
        for u in range(top, n2 + i - 1, -1):  # times 1 - q ** (n2 + i)
            ways[u] -= ways[u - n2 - i]
        for u in range(i, top + 1):  # over 1 - q ** i
            ways[u] += ways[u - i]
    return ways


def exact_rank_p(u: float, n1: float, n2: float) -> float:
    """Two-sided p of U among all orders of the values, which has no ties."""
    a, b = sorted((int(n1), int(n2)))
    ways, far = rank_counts(a, b), max(u, a * b - u)
    return min(1.0, 2 * sum(ways[math.ceil(far) :]) / math.comb(a + b, a))


def exact_rank_test_p(u: Column, n1: Column, n2: Column) -> Column:
    """exact_rank_p, null where an argument is."""

    @F.pandas_udf("double")
    def g(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if any(map(pd.isna, r)) else exact_rank_p(*r) for r in zip(x, a, b, strict=True)], dtype="float64")

    return g(u.cast("double"), n1.cast("double"), n2.cast("double"))


def _udf(f):
    @F.pandas_udf("double")
    def g(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if pd.isna(x) or pd.isna(y) else f(x, y) for x, y in zip(a, b, strict=True)]
        return pd.Series([None if x is None or math.isnan(x) else x for x in out], dtype="float64")

    return g


def chi2_p(x: Column, dof: Column) -> Column:
    return _udf(chi2_tail)(x.cast("double"), dof.cast("double"))


def normal_p(z: Column) -> Column:
    return _udf(lambda x, _: normal_two_sided(x))(z.cast("double"), F.lit(0.0))


def rank_correlation_p(rho: Column, n: Column) -> Column:
    return _udf(correlation_p)(rho.cast("double"), n.cast("double"))
