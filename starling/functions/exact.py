"""Column helpers whose result does not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def avg(x) -> Column:
    """Average as exact sum over count: integers and decimals add without rounding, so every
    partitioning gives the same double.  Null for an empty group."""
    return F.try_divide(F.sum(_c(x)).cast("double"), F.count(_c(x)).cast("double"))


def ratio(a, b) -> Column:
    """Double quotient; null when the divisor is zero or null."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def sum_if(cond: Column, x) -> Column:
    return F.sum(F.when(cond, _c(x)))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def stddev_samp(x, digits: int = 4) -> Column:
    """Sample deviation, rounded because its last bits depend on merge order."""
    return F.round(F.stddev_samp(_c(x)), digits)


def moments(x, name: str) -> list[Column]:
    """Count, exact sum and exact sum of squares of a column of at most two decimals."""
    v = _c(x).cast("decimal(18,2)")
    return [F.count(_c(x)).alias(f"n_{name}"), F.sum(v).alias(f"s_{name}"),
            F.sum(v * v).alias(f"q_{name}")]


def stddev_of_moments(name: str) -> Column:
    """Sample deviation from summed ``moments``; the numerator is exact, so nothing cancels."""
    n, s, q = _c(f"n_{name}").cast("decimal(20,0)"), _c(f"s_{name}"), _c(f"q_{name}")
    spread, pairs = (n * q - s * s).cast("double"), (n * (n - 1)).cast("double")
    return F.when(n > 1, F.sqrt(F.try_divide(spread, pairs)))
