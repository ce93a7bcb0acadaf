"""Registry documents, requests and responses as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.ordered import ranked


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest record of each key. Only one candidate per key and task crosses the network."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest"))
    return newest.select(*keys, "_newest.*").select(*df.columns)


def fresh(df: DataFrame, time: str, as_of: Column, seconds: int = 600) -> DataFrame:
    """Records younger than the limit at the given moment."""
    return df.filter(F.col(time) > as_of - F.expr(f"interval {seconds} seconds"))


def newest_first(df: DataFrame, time: str, condition: Column, ties: Sequence[str] = ()) -> DataFrame:
    """Matching records in descending time."""
    return df.filter(condition).orderBy(F.col(time).desc(), *ties)


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch rows to append: all of them, or none when any key exists already.

    The test is a semi join reduced to one boolean, evaluated as a scalar subquery.
    """
    clashes = batch.join(existing.select(key), key, "left_semi")
    clean = clashes.agg(F.count(F.lit(1)).alias("n")).select(F.col("n") == 0)
    return batch.filter(clean.scalar())


def clashing_keys(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return batch.join(existing.select(key), key, "left_semi").select(key)


def updated(existing: DataFrame, changes: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """New snapshot: fields set in ``changes`` (non-null) replace the stored ones.

    Of several changes of one key the last value of each field counts, in the ``order`` of columns of ``changes``;
    without an order several changes of one key are an error. Changes without a key change nothing.
    """
    changed = [c for c in changes.columns if c != key and c in existing.columns]
    place = F.struct(*[F.col(c) for c in order])
    several = F.raise_error(F.concat(F.lit(f"several changes of one {key}: "), F.first(F.col(key).cast("string"))))

    def value(name: str) -> Column:
        if order:
            return F.max_by(name, F.when(F.col(name).isNotNull(), place))
        return F.when(F.count(F.lit(1)) > 1, several).otherwise(F.first(name))

    if not changed:
        return existing
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*[value(c).alias(f"_new_{c}") for c in changed])
    merged = existing.join(last, key, "left")
    return merged.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in existing.columns]
    )


def deleted(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """New snapshot without the given keys."""
    return existing.join(keys, key, "left_anti")


def deleted_count(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys, key, "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def pending(expected: DataFrame, responses: DataFrame, on: Sequence[str] = ("request_id", "edge_id")) -> DataFrame:
    """Expected responders that have not answered yet."""
    return expected.join(responses.select(*on), list(on), "left_anti")


def per_dataset_configs(requests: DataFrame, datasets: str = "datasets") -> DataFrame:
    """One configuration record per dataset of a request."""
    return requests.withColumn("_dataset", F.explode(datasets)).drop(datasets).select("*", "_dataset.*").drop("_dataset")


def with_request_id(requests: DataFrame, name: str = "request_id") -> DataFrame:
    """A fresh random id per request."""
    return requests.withColumn(name, F.uuid())


def status_of(kind: Column, code: Column) -> Column:
    """Request status after an event: errors win, a response starts a request, a report finishes it."""
    return (
        F.when(kind == "init", "initializing")
        .when(code != 0, "error")
        .when(kind == "response", "started")
        .when(kind.isin("qod_report", "service"), "finished")
    )


def request_status(log: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    """Current state per request from its transition events (request_id, kind, code, at).

    Results are counted here; ``request_results`` lists them, one row each, so that a
    request with very many responders never becomes one huge array.
    """
    kind = F.col("kind")
    return log.groupBy("request_id").agg(
        F.max_by(status_of(kind, F.col("code")), F.struct(*order)).alias("status"),
        F.min(F.when(kind == "init", F.col("at"))).alias("init_at"),
        F.max(F.when(kind == "response", F.col("at"))).alias("start_at"),
        F.max(F.when(kind.isin("qod_report", "service"), F.col("at"))).alias("finish_at"),
        F.count_if(kind == "response").alias("results"),
        F.count_if(kind == "qod_report").alias("reports"),
    )


def request_results(log: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    """Responses in arrival order, with their position inside the request."""
    return ranked(log.filter(F.col("kind") == "response"), ["request_id"], order, "place")


def container_status(details: DataFrame, keys: Sequence[str] = ("request_id",)) -> DataFrame:
    """Sum of container exit codes per response; zero means that all are up."""
    return details.groupBy(*keys).agg(F.sum("code").alias("status"), F.count(F.lit(1)).alias("containers"))
