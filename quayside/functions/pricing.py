"""Cost functions, and the registry that picks one per row by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_MB = 1048576.0
SECONDS_PER_MINUTE = 60.0


def quality_cost(price: Column, pre: Column, post: Column) -> Column:
    """Price of an improvement, scaled by the starting performance; never negative."""
    return F.greatest(F.lit(0.0), price * (post - pre) * pre)


def resource_cost(
    by_minute: Column, minutes: Column, cpu_price: Column, cpu: Column, memory_price: Column, memory_mb: Column
) -> Column:
    """Minutes times the priced peak usage; an absent price counts as zero."""
    usage = F.coalesce(cpu_price, F.lit(0.0)) * cpu + F.coalesce(memory_price, F.lit(0.0)) * memory_mb
    return by_minute * minutes * usage


def total_cost(context: Column, quality_of_data: Column, quality_of_model: Column, resource: Column) -> Column:
    """Sum of the four cost parts; null when one is missing."""
    return context + quality_of_data + quality_of_model + resource


def improvement(pre: Column, post: Column) -> Column:
    return post - pre


def bytes_to_mb(value: Column) -> Column:
    return value / F.lit(BYTES_PER_MB)


def seconds_to_minutes(value: Column) -> Column:
    return value / F.lit(SECONDS_PER_MINUTE)


class CostFunctions:
    """Named cost functions over a set of argument columns.

    ``choose`` turns the registry into one CASE expression on the name column, so a
    per-row choice of function needs no Python worker. An unknown name gives null.
    """

    def __init__(self, functions: Mapping[str, Callable[[Mapping[str, Column]], Column]] | None = None):
        self._functions = dict(functions or {})

    def register(self, name: str, function: Callable[[Mapping[str, Column]], Column]) -> CostFunctions:
        return CostFunctions({**self._functions, name: function})

    @property
    def names(self) -> list[str]:
        return list(self._functions)

    def choose(self, name: Column, arguments: Mapping[str, Column]) -> Column:
        result = F.lit(None).cast("double")
        for known, function in reversed(self._functions.items()):
            result = F.when(name == known, function(arguments)).otherwise(result)
        return result


# fixed values: the function names that price tables refer to
BY_TRAIN_PERFORMANCE = "qom_cost_by_train_performance"
BY_CPU_AND_MEMORY = "resource_cost_by_cpu_mem"

STANDARD_COSTS = CostFunctions(
    {
        BY_TRAIN_PERFORMANCE: lambda a: quality_cost(a["performance_price"], a["pre"], a["post"]),
        BY_CPU_AND_MEMORY: lambda a: resource_cost(
            a["by_minute"], a["minutes"], a["cpu_price"], a["cpu"], a["memory_price"], a["memory_mb"]
        ),
    }
)


def static_quality_price(metric_sum: Column) -> Column:
    """Listed price of a dataset from the sum of its quality metrics."""
    return F.round(metric_sum * F.lit(3) * F.lit(0.99), 2)
