"""Moments and line fits as aggregate Columns that survive constant input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def skewness_adjusted(c: Column) -> Column:
    """Sample skewness G1: NULL below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n < 3, None).when(flat, F.lit(0.0)).otherwise(factor * F.skewness(c))


def kurtosis_adjusted(c: Column) -> Column:
    """Sample excess kurtosis G2: NULL below four values, 0 for a constant column."""
    n = F.count(c).cast("double")
    flat = F.min(c) == F.max(c)
    factor = F.try_divide(n - 1, (n - 2) * (n - 3))
    return (
        F.when(n < 4, None)
        .when(flat, F.lit(0.0))
        .otherwise(factor * ((n + 1) * F.kurtosis(c) + 6))
    )


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; NULL when either is constant there.

    Built from covariance and deviations because `corr` divides by zero on constants.
    """
    xs = F.when(y.isNotNull(), x)
    ys = F.when(x.isNotNull(), y)
    r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(xs) * F.stddev_samp(ys))
    flat = (F.min(xs) == F.max(xs)) | (F.min(ys) == F.max(ys))
    return F.when(~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fit_line(x: Column, y: Column) -> tuple[Column, Column]:
    """Least-squares slope and intercept; NULL when x is constant."""
    return F.regr_slope(y, x), F.regr_intercept(y, x)
