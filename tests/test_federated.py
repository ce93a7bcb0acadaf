import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import federated
from quayside.operators.federated import (
    averaged_parameters,
    federated_average,
    local_round,
    softmax_regression,
    weighted_metric,
)
from quayside.plans.federated_training import train
from quayside.schemas import MESSAGE


def test_average_ignores_providers_without_examples(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 3), (1, [9.0, 9.0], 0)]
    df = spark.createDataFrame(rows, "round int, weights array<double>, n int")
    assert federated_average(df, ["round"]).first()["weights"] == [2.5, 5.0]
    assert averaged_parameters(df.filter("n = 0"), ["round"]).count() == 0


def test_weighted_metric_without_examples_is_null(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 1.0, 3), (2, 0.5, 0)], "g int, m double, n int")
    assert dict(map(tuple, weighted_metric(df, ["g"], "m").collect())) == {1: 0.875, 2: None}


@pytest.fixture(scope="module")
def shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5).astype(int)
    rows = [("big" if i % 3 else "small", p.tolist(), int(c)) for i, (p, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "provider string, x array<double>, y int").repartition(6).cache()


def test_a_local_round_equals_training_in_one_place(shards):
    model = softmax_regression(3, 3)
    got = {r["provider"]: r for r in local_round(shards, model.initial(), model, epochs=3).collect()}
    for provider in ("big", "small"):
        part = shards.filter(F.col("provider") == provider).toPandas()
        x, y = np.stack(part["x"]), part["y"].to_numpy()
        weights = model.initial()
        for _ in range(3):
            weights = model.step(weights, model.gradient(weights, x, y), len(y))
        assert got[provider]["n"] == len(y) and np.allclose(got[provider]["weights"], weights)
        correct, loss = model.score(weights, x, y)
        assert got[provider]["post_performance"] == pytest.approx(correct / len(y))
        assert got[provider]["post_loss"] == pytest.approx(loss / len(y)) and got[provider]["post_loss"] < got[provider]["pre_loss"]


def test_providers_in_portions(shards, monkeypatch):
    model = softmax_regression(3, 3)
    whole = {r["provider"]: r["weights"] for r in local_round(shards, model.initial(), model, epochs=2).collect()}
    monkeypatch.setattr(federated, "HELD_BYTES", 1)
    parts = {r["provider"]: r["weights"] for r in local_round(shards, model.initial(), model, epochs=2).collect()}
    assert all(np.allclose(whole[p], parts[p]) for p in whole)


def test_a_large_provider_is_cut_into_parts(shards, monkeypatch):
    model = softmax_regression(3, 3)
    whole = {r["provider"]: r for r in local_round(shards, model.initial(), model, epochs=3).collect()}
    monkeypatch.setattr(federated, "PART_ROWS", 25)
    sizes = federated.parted(shards).groupBy("provider", "part").count().collect()
    assert len({r["part"] for r in sizes if r["provider"] == "big"}) == 7 and max(r["count"] for r in sizes) < 60
    parts = {r["provider"]: r for r in local_round(shards, model.initial(), model, epochs=3).collect()}
    for provider, row in whole.items():
        assert np.allclose(row["weights"], parts[provider]["weights"]) and row["n"] == parts[provider]["n"]
        assert row["post_loss"] == pytest.approx(parts[provider]["post_loss"])
    monkeypatch.setattr(federated, "MOST_LARGE", 0)
    joined = {r["provider"]: r["n"] for r in local_round(shards, model.initial(), model).collect()}
    assert joined == {p: r["n"] for p, r in whole.items()}


def test_many_providers_without_collecting_their_weights(spark, monkeypatch):
    model = softmax_regression(2, 2)
    rows = spark.range(6000).select(
        F.concat(F.lit("p"), (F.col("id") % 2000).cast("string")).alias("provider"),
        F.array((F.col("id") % 7 - 3).cast("double"), (F.col("id") % 5 - 2).cast("double")).alias("x"),
        (F.col("id") % 7 > 2).cast("int").alias("y"),
    )
    data = rows.unionByName(spark.createDataFrame([(None, [0.0, 0.0], 0)], rows.schema))

    def refuse(*_):
        raise AssertionError("collected")

    with monkeypatch.context() as patched:
        patched.setattr(type(data), "collect", refuse)
        updates = local_round(data, model.initial(), model, epochs=2)
    assert updates.count() == 2000
    some = updates.filter("provider = 'p17'").first()
    part = rows.filter("provider = 'p17'").toPandas()
    x, y, weights = np.stack(part["x"]), part["y"].to_numpy(), model.initial()
    for _ in range(2):
        weights = model.step(weights, model.gradient(weights, x, y), len(y))
    assert some["n"] == 3 and np.allclose(some["weights"], weights)


def test_a_round_over_no_rows(spark):
    empty = spark.createDataFrame([], "provider string, x array<double>, y int")
    model = softmax_regression(2, 2)
    assert local_round(empty, model.initial(), model, epochs=2).collect() == []


def test_rounds_improve_and_report(shards):
    done = train(shards, softmax_regression(3, 3), rounds=3, held_out=shards.select("x", "y"))
    losses = {r["round"]: r["test_loss"] for r in done.history.collect()}
    assert losses[3] < losses[2] < losses[1]
    assert done.messages.count() == 6
    sent = done.messages.first()
    assert sent["metadata"]["application_name"] == "model" and sent["report"]["resource_monitor"] is None
    assert set(done.messages.schema["report"].dataType.fieldNames()) == set(MESSAGE["report"].dataType.fieldNames())
    got = done.messages.schema["report"].dataType["quality_of_model"].dataType.fieldNames()
    assert got == MESSAGE["report"].dataType["quality_of_model"].dataType.fieldNames()
