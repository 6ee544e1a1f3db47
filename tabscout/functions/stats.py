"""Statistics as column expressions that raise on no input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: str | Column, whole: str | Column) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null when a side is constant."""
    x, y = F.when(b.isNotNull(), a.cast("double")), F.when(a.isNotNull(), b.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").otherwise("weak")


def skewness(c: Column) -> Column:
    """Bias-corrected sample skewness; null below three values or on a constant."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurtosis(c: Column) -> Column:
    """Bias-corrected sample excess kurtosis; null below four values or on a constant."""
    n = F.count(c).cast("double")
    return F.when(n > 3, F.try_divide(((n + 1) * F.kurtosis(c) + 6) * (n - 1), (n - 2) * (n - 3)))


def fence(q1: Column, q3: Column, k: float = 1.5) -> tuple[Column, Column]:
    return q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
