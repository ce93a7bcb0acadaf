"""Declarative filters, projections and request checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "*"


def _bound(value) -> bool:
    return value is not None and value != OPEN


def range_predicate(filters: Mapping | None) -> Column | None:
    """``{operator, constraints: [{feature_name, from, to}]}`` to one Column, or None when nothing is constrained.

    Bounds are inclusive; ``*`` or null leaves a side open. ``and`` (also when no operator
    is given), ``or``, and ``not`` = none of "all constraints hold together".
    """
    if not filters:
        return None
    tests = []
    for constraint in filters.get("constraints") or []:
        column = F.col(f"`{constraint['feature_name']}`")
        low, high = constraint.get("from"), constraint.get("to")
        sides = [column >= F.lit(low)] * _bound(low) + [column <= F.lit(high)] * _bound(high)
        if sides:
            tests.append(reduce(lambda a, b: a & b, sides))
    if not tests:
        return None
    operator = (filters.get("operator") or "and").lower()
    if operator == "or":
        return reduce(lambda a, b: a | b, tests)
    together = reduce(lambda a, b: a & b, tests)
    if operator == "and":
        return together
    if operator == "not":
        return ~together
    raise ValueError(f"unknown filter operator {operator!r}")


def apply_filters(df: DataFrame, filters: Mapping | None) -> DataFrame:
    predicate = range_predicate(filters)
    return df if predicate is None else df.filter(predicate)


def project(df: DataFrame, features: Sequence[Mapping], label: Mapping | None) -> DataFrame:
    """Requested features by index, then the label; an empty request keeps every column."""
    if not features:
        return df
    names = [f["name"] for f in sorted(features, key=lambda f: f["index"])]
    if label:
        names.append(label["name"])
    return df.select(*[F.col(f"`{n}`") for n in names])


def split_label(df: DataFrame, label: str, drop: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Feature array plus label column, without the label and the dropped columns among the features."""
    names = [c for c in df.columns if c != label and c not in drop]
    return df.select(
        F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias(features), F.col(label).alias("label")
    )


def accepted_requests(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests whose owner and dataset match a provider's configuration."""
    return requests.join(providers, ["owner_id", "dataset_id"], "left_semi")


def rejected_requests(requests: DataFrame, providers: DataFrame) -> DataFrame:
    return requests.join(providers, ["owner_id", "dataset_id"], "left_anti")


def meets_constraints(metrics: DataFrame, constraints: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Per dataset, whether every ``{metric_name, min_value}`` constraint holds.

    ``metrics`` is long (key, metric_name, value). A metric that a dataset lacks fails
    its constraint, which shows as fewer matches than constraints.
    """
    wanted = constraints.count()
    checked = metrics.join(constraints, "metric_name", "inner")
    return (
        metrics.select(key)
        .distinct()
        .join(
            checked.groupBy(key).agg(
                F.count(F.lit(1)).alias("checked"),
                F.sum((F.coalesce(F.col("value") >= F.col("min_value"), F.lit(False))).cast("long")).alias("passed"),
            ),
            key,
            "left",
        )
        .select(key, (F.coalesce("passed", F.lit(0)) == F.lit(wanted)).alias("accepted"))
    )


def without(df: DataFrame, *private: str) -> DataFrame:
    """Remove internal or secret fields before handing records out."""
    return df.drop(*private)
