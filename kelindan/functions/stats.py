"""Statistics as column expressions, and Fisher's exact test as a pandas UDF."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n trials, within [0, 1]; null for n = 0."""
    p, d = F.try_divide(k, n), 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / d
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def wilson_or_census(k: Column, n: Column, pool: Column) -> tuple[Column, Column]:
    """As ``wilson``, but the bare proportion where the sample is the whole pool."""
    whole, p = (n > 0) & (n >= pool), F.try_divide(k, n)
    lo, hi = wilson(k, n)
    return F.when(whole, p).otherwise(lo), F.when(whole, p).otherwise(hi)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6,371 km radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 12742.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p of a 2 x 2 table: the mass of all tables with its margins that are no more likely."""
    n, row, col = a + b + c + d, a + b, a + c
    lf = math.lgamma
    base = lf(row + 1) + lf(n - row + 1) + lf(col + 1) + lf(n - col + 1) - lf(n + 1)

    def log_p(x: int) -> float:
        return base - lf(x + 1) - lf(row - x + 1) - lf(col - x + 1) - lf(n - row - col + x + 1)

    seen = log_p(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, row + col - n), min(row, col) + 1) if (p := log_p(x)) <= seen + 1e-7))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, t)) for t in zip(a, b, c, d)])
