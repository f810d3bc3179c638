"""Guarded statistics as aggregate or scalar columns, and p-values without external libraries."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The smallest denominator of a relative error: the distance from 1 to the next double.
EPSILON = 2.220446049250313e-16


def rounded(x, places: int = 6) -> Column:
    """Rounded, with negative zero made positive."""
    return F.round(x, places) + F.lit(0.0)


def safe_divide(a, b, default: float | None = 0.0) -> Column:
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def pearson(x, y) -> Column:
    """Aggregate: correlation; 0 where either side is constant or has no rows."""
    return safe_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mse(y, p) -> Column:
    return F.avg((y - p) * (y - p))


def mae(y, p) -> Column:
    return F.avg(F.abs(y - p))


def mape(y, p) -> Column:
    """Aggregate: mean absolute error relative to the true value, a fraction."""
    return F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON)))


def r2(y, p) -> Column:
    """Aggregate: 1 - SSres/SStot; for a constant target 1 if it is met exactly, else 0."""
    res, tot = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    return F.when(tot > 0, 1 - F.try_divide(res, tot)).when(res == 0, 1.0).otherwise(0.0)


def average_rank(x: str, by: list[str]) -> Column:
    """Rank of column x among the rows that agree in ``by``, ties sharing their mean rank."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (ties - 1) / 2


def cv(x) -> Column:
    """Aggregate: coefficient of variation with the population deviation."""
    return safe_divide(F.stddev_pop(x), F.avg(x), None)


def stars(p, none: str = "") -> Column:
    """Significance marks of a p-value."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(none)


def assessment(r) -> Column:
    """Bucket of a correlation by fixed limits 0.4, 0.3 and 0.2."""
    return F.when(r >= 0.4, "excellent").when(r >= 0.3, "good").when(r >= 0.2, "moderate").otherwise("weak")


# ---- p-values -------------------------------------------------------------------------------------------------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def correlation_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of n pairs; NaN below three pairs."""
    if n < 3 or r is None or math.isnan(r):
        return math.nan
    return incomplete_beta((n - 2) / 2, 0.5, max(0.0, 1 - r * r))


def p_value(r, n) -> Column:
    """correlation_p as a column; meant for small results of aggregates."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(r, n):
        import pandas as pd

        return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")

    return run(r, n)


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of an array."""
    _, number, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[number]
