"""Distribution functions as column expressions and as driver scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erf_col(z: Column, terms: int = 160) -> Column:
    """The error function of a non-negative column by its series of positive terms."""
    start = F.struct(z.cast("double").alias("t"), z.cast("double").alias("s"))

    def step(acc: Column, k: Column) -> Column:
        t = acc["t"] * 2.0 * z * z / (2.0 * k + 1.0)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["s"])
    return F.when(z > 6.0, 1.0).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * total)


def two_sided_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return F.greatest(F.lit(0.0), 1.0 - erf_col(F.abs(z) / math.sqrt(2.0)))


def chi2_1_p(x: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return two_sided_p(F.sqrt(F.greatest(x, F.lit(0.0))))


def p_of_z(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse of the standard normal distribution by bisection."""
    low, high = -10.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
