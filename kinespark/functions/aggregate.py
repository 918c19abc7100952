"""Whole-channel aggregates; NULL, NaN and infinite samples are skipped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import finite, nan


def _kept(v: Column) -> Column:
    return F.when(finite(v), v)


def _or_nan(c: Column) -> Column:
    return F.coalesce(c, nan())


def percentile(v: Column, q: float) -> Column:
    """Exact percentile, q in 0..100, linear between order statistics."""
    return _or_nan(F.percentile(_kept(v), F.lit(q / 100.0)))


#: Aggregates of one channel: (value, order column) to a column.
AGGREGATES = {
    "count": lambda v, i: F.count(_kept(v)).cast("double"),
    "sum": lambda v, i: F.coalesce(F.sum(_kept(v)), F.lit(0.0)),
    "mean": lambda v, i: _or_nan(F.avg(_kept(v))),
    "max": lambda v, i: _or_nan(F.max(_kept(v))),
    "min": lambda v, i: _or_nan(F.min(_kept(v))),
    "rms": lambda v, i: _or_nan(F.sqrt(F.avg(_kept(v) * _kept(v)))),
    "std": lambda v, i: _or_nan(F.stddev_pop(_kept(v))),
    "median": lambda v, i: percentile(v, 50.0),
    "first": lambda v, i: _or_nan(F.min_by(_kept(v), F.when(finite(v), i))),
    "last": lambda v, i: _or_nan(F.max_by(_kept(v), F.when(finite(v), i))),
}


def dynamic_sag(value: Column, stationary: Column) -> Column:
    """Median over finite samples that are not stationary; NULL without any."""
    return F.percentile(F.when(~stationary & finite(value), value), F.lit(0.5))


def bias(axis: Column, static: Column) -> Column:
    """Mean of an axis over static samples; NULL without any."""
    return F.avg(F.when(static, axis))
