"""Rounding and averaging with results that do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Fraction of rows where ``condition`` holds; a null condition counts as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """``part / whole`` in percent, half-even rounded; null when ``whole`` is zero."""
    return F.bround(F.try_divide(part, whole) * 100, places)


def decimal_mean(col: Column, places: int) -> Column:
    """Mean of a double that carries at most ``places`` decimals, summed as integers and therefore exact."""
    scaled = F.round(col * 10**places).cast("long")
    return F.try_divide(F.sum(scaled), F.count(col) * 10**places)


def sample_stddev(col: Column) -> Column:
    """Sample standard deviation of an integer column from two exact sums; null for a single row."""
    n = F.count(col).cast("double")
    total = F.sum(col.cast("long")).cast("double")
    squares = F.sum(col.cast("long") * col.cast("long")).cast("double")
    return F.sqrt(F.try_divide(n * squares - total * total, n * (n - 1)))
