"""Sample statistics as aggregate columns; Spark's own are population-biased or fail under ANSI."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sample_skewness(value: Column) -> Column:
    """Bias-corrected skewness: null below three values, 0 for a constant."""
    n = F.count(value).cast("double")
    corrected = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.skewness(value)
    return F.when(n >= 3, F.coalesce(corrected, F.lit(0.0)))


def sample_kurtosis(value: Column) -> Column:
    """Bias-corrected excess kurtosis: null below four values, 0 for a constant."""
    n = F.count(value).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = scale * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def chi_square_tail(statistic: float, degrees: int) -> float:
    """Probability that a chi-square variable of so many degrees exceeds the statistic: the upper incomplete gamma function.

    A series below the mean, a continued fraction above it; both converge in about the root of the degrees.
    """
    a, x = degrees / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(scale))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h, i = d, 0
    while True:
        i += 1
        step = i * (a - i)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + step / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1) < 1e-16 or i > 1_000_000:
            return h * math.exp(scale)
