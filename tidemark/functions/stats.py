"""Guarded statistics as column expressions; none raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def safe_stddev(c: Column) -> Column:
    """Sample standard deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation of a group; 0 where either side is constant."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def min_max(c: Column, low: Column, high: Column, middle: float = 0.5) -> Column:
    """To [0, 1]; a constant goes to ``middle``."""
    return F.coalesce(F.try_divide(c - low, high - low), F.lit(middle))


def zscore_over(c: Column, w: W) -> Column:
    """Standard score within a window; a constant gives 0."""
    return ratio(c - F.avg(c).over(w), F.stddev_samp(c).over(w))


def square_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(square_distance(a, b))
