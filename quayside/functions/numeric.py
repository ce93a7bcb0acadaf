"""Numeric clean-up, scaling, rounding and vector helpers."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = sys.float_info.max


def finite(value: Column) -> Column:
    """NaN and null become 0, infinities the largest finite double of their sign."""
    number = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), number))


def absent(value: Column, kind: str = "double") -> Column:
    """True for null and, in a column of a floating type, for NaN."""
    return value.isNull() | F.isnan(value) if kind in ("double", "float") else value.isNull()


def metric_round(value: Column, digits: int = 4) -> Column:
    """Half-even rounding, the convention of all quality metrics."""
    return F.bround(value, digits)


def standardise(value: Column, mean: Column, deviation: Column) -> Column:
    """Distance from the mean in population deviations; a constant column is only centred."""
    return (value - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def squared_distance(left: Column, right: Column) -> Column:
    steps = F.zip_with(left, right, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def euclidean(left: Column, right: Column) -> Column:
    return F.sqrt(squared_distance(left, right))


def top_mean(values: Column, count: int) -> Column:
    """Mean of the ``count`` largest entries of an array (all of them if it is shorter)."""
    best = F.slice(F.sort_array(values, asc=False), 1, count)
    return F.aggregate(best, F.lit(0.0), lambda t, v: t + v) / F.size(best)


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values)


def array_variance(values: Column) -> Column:
    """Population variance of an array."""
    mean = array_mean(values)
    return array_mean(F.transform(values, lambda v: (v - mean) * (v - mean)))


def whole_second(value: Column) -> Column:
    """Integer part, cut towards zero."""
    return value.cast("int")


def try_double(value: Column) -> Column:
    """Number from text; null when the text is no number."""
    return value.try_cast("double")


def cpu_percentage(usage_delta: Column, system_delta: Column, cpus: Column) -> Column:
    """Share of the machine used between two readings of cumulative counters, in percent of one cpu."""
    return F.try_divide(usage_delta, system_delta) * cpus * 100.0
