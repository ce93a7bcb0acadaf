from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayside.operators.ordered import Skew
from quayside.operators.predicates import apply_filters, meets_constraints, range_predicate
from quayside.operators.sampling import contiguous_folds, sample_with_replacement
from quayside.operators.splits import chronological_split, provider_partitions
from quayside.operators.windows import (
    beside,
    bucket_of,
    features_with_series_width,
    series_widths,
    short_series,
    window_features,
    with_windows,
)
from quayside.plans.feature_engineering import FeatureOptions, feature_table, labelled_features, provider_shares, train_test


def series(spark, **lengths):
    rows = [(name, p, float(p), p // 4) for name, n in lengths.items() for p in range(n)]
    return spark.createDataFrame(rows, "s string, pos long, v double, second long")


def test_windows_of_ten(spark):
    placed = with_windows(series(spark, a=10), "pos", 4, 2).filter("window_id <= 3")
    got = {}
    for r in placed.collect():
        got.setdefault(r["window_id"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in got.items()} == {0: [0, 1, 2, 3], 1: [2, 3, 4, 5], 2: [4, 5, 6, 7], 3: [6, 7, 8, 9]}
    assert window_features(series(spark, a=10), ["s"], "pos", "v", 4, 2, 2, "second").count() == 4


def test_buckets_of_ten(spark):
    df = spark.range(10).withColumn("w", F.lit(10).cast("long")).select(bucket_of("id", "w", 3).alias("b"))
    assert Counter(r["b"] for r in df.collect()) == {0: 4, 1: 3, 2: 3}


def test_window_values(spark):
    row = window_features(series(spark, a=8), ["s"], "pos", "v", 8, 4, 2, "second").first()
    assert (row["b0"], row["b1"], row["mean"], row["time"]) == (1.5, 5.5, 3.5, 0)
    assert row["std"] == pytest.approx(2.449489742783178)


def test_short_series_are_dropped_reported_or_refused(spark):
    df = series(spark, long=16, short=5)
    done = features_with_series_width(df, ["s"], "pos", "v", "second", 2, 0.5, 2)
    assert {r["s"] for r in done.collect()} == {"long"}
    assert [r["s"] for r in short_series(df, ["s"], 8).collect()] == ["short"]
    with pytest.raises(ValueError):
        features_with_series_width(df, ["s"], "pos", "v", "second", 2, 0.5, 2, strict=True)


def test_feature_table_has_noise_only_where_marked(spark):
    names = ["BR_CC_ND_A1.csv", "BR_CC_ND_N_H1.csv", "BR_CC_ND_NN_H1.csv", "LO_NL_Transient_N_H2.csv", "N_H1.csv", "N_H2.csv"]
    rows = [(n, p, p // 4, float(p * (i + 1))) for i, n in enumerate(names) for p in range(16)]
    df = spark.createDataFrame(rows, "file_name string, pos long, second long, value double")
    wide = feature_table(df, FeatureOptions(seconds=2, buckets=2)).cache()
    got = {(r["condition"], r["topology"]): r for r in wide.filter("window_id = 0").collect()}
    assert set(got) == {("BC3", "BR"), ("BC4", "BR"), ("BC5", "LO")}
    assert got["BC3", "BR"]["A1_mean"] == 3.5 and got["BC3", "BR"]["H1_mean"] == 10.5 and got["BC3", "BR"]["H1_N_mean"] is None
    assert got["BC4", "BR"]["H1_mean"] == 7.0 and got["BC4", "BR"]["H1_N_mean"] == 17.5
    assert got["BC5", "LO"]["H2_N_mean"] == 21.0
    labels = labelled_features(wide).filter("window_id = 0 AND BC5 = 1").first()
    assert (labels["topology"], labels["target"], labels["BC4"]) == (0, 0, 0)
    assert train_test(wide).groupBy("split").count().count() == 2
    shares = provider_shares(labelled_features(wide).withColumn("k", F.hash("window_id", "BC3", "BC4", "target")), ["k"], FeatureOptions(providers=2))
    assert shares.count() == wide.count() and {r[0] for r in shares.select("provider").collect()} <= {1, 2}


@pytest.mark.parametrize("times,fraction,train", [([0, 0, 1, 1, 1, 2], 0.2, 5), ([0, 1, 2, 2, 2, 3], 1.0, 4), ([0, 1], 0.0, 2)])
def test_chronological_split(spark, times, fraction, train):
    df = spark.createDataFrame(list(enumerate(times)), "id int, t int")
    whole = chronological_split(df, [], "t", ["id"], fraction)
    grouped = chronological_split(df.withColumn("g", F.lit("x")), ["g"], "t", ["id"], fraction)
    for split in (whole, grouped):
        assert sorted(r["id"] for r in split.filter("split = 'train'").collect()) == list(range(train))


@pytest.mark.parametrize("sizes", [{0: 13, 1: 20, 2: 7}, {0: 1, 1: 3}, {1: 50}])
def test_provider_partitions_cover_the_input_once(spark, sizes):
    rows = [(i, y) for i, y in enumerate(y for y, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "id long, y int")
    got = provider_partitions(df, "y", ["id"], 4, 0.2).collect()
    assert sorted((r["id"], r["y"]) for r in got) == sorted(rows)
    assert all(r["pool"] == "even" for r in got if r["y"] == 0)
    for pool in ("skewed", "even"):
        counts = Counter(r["provider"] for r in got if r["pool"] == pool)
        every = [counts.get(p, 0) for p in range(1, 5)]
        assert max(every) - min(every) <= 1 and every == sorted(every, reverse=True)
    kept = Counter(r["y"] for r in got if r["pool"] == "skewed")
    assert kept == {y: int(n * (1 - 0.2)) for y, n in sizes.items() if y and int(n * 0.8)}


def test_folds_and_sample(spark):
    df = spark.range(11).withColumn("v", F.col("id") * 2)
    folds = Counter(r["fold"] for r in contiguous_folds(df, ["id"]).collect())
    assert [folds[f] for f in range(5)] == [2, 2, 2, 2, 3]
    assert Counter(r["fold"] for r in contiguous_folds(spark.range(9), ["id"]).collect()) == dict.fromkeys(range(9), 1)
    with pytest.raises(ValueError):
        contiguous_folds(spark.range(4), ["id"])
    assert sample_with_replacement(df, 20, ["id"]).count() == 11
    drawn = sample_with_replacement(df, 7, ["id"]).collect()
    assert len(drawn) == 7 and all(r["v"] == 2 * r["id"] for r in drawn)
    assert drawn == sample_with_replacement(df, 7, ["id"]).collect()


def test_filter_builder(spark):
    df = spark.createDataFrame([(0, 9), (1, 9), (0, 5)], "a int, b int")

    def ids(operator, *constraints):
        named = [dict(zip(("feature_name", "from", "to"), c)) for c in constraints]
        return [tuple(r) for r in apply_filters(df, {"operator": operator, "constraints": named}).collect()]

    assert ids("or", ("a", 1, "*"), ("b", "*", 5)) == [(1, 9), (0, 5)]
    assert ids("and", ("a", 0, 0), ("b", 6, None)) == [(0, 9)]
    assert ids("", ("a", 0, 0), ("b", 6, None)) == [(0, 9)]
    assert ids("not", ("a", 0, 0), ("b", 6, None)) == [(1, 9), (0, 5)]
    assert range_predicate({"operator": "and", "constraints": [{"feature_name": "a", "from": "*", "to": None}]}) is None
    assert range_predicate({"operator": "and", "constraints": []}) is None and range_predicate(None) is None
    with pytest.raises(ValueError):
        range_predicate({"operator": "xor", "constraints": [{"feature_name": "a", "from": 1, "to": 2}]})


def test_missing_metric_fails_its_constraint(spark):
    metrics = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.5), ("b", "x", 1.0)], "dataset_id string, metric_name string, value double")
    bounds = spark.createDataFrame([("x", 0.9), ("y", 0.5)], "metric_name string, min_value double")
    assert dict(map(tuple, meets_constraints(metrics, bounds).collect())) == {"a": True, "b": False}


def test_first_recording_of_a_group_gives_the_whole_block(spark):
    rows = [("f_N", "H1", 0, 50.0, 1), ("f_N", "H1", 1, 40.0, 2), ("f_NN", "H1", 0, 90.0, 3), ("f_NN", "H1", 2, 80.0, 4), ("g", "A1", 0, 5.0, 1)]
    df = spark.createDataFrame(rows, "file_name string, sensor string, window_id int, mean double, time int").withColumn("g", F.lit("x"))
    got = {r.window_id: (r.H1_mean, r.A1_mean) for r in beside(df, ["g"], ["A1", "H1"], ["mean"]).collect()}
    assert got == {0: (50.0, 5.0), 1: (40.0, None)}


def test_series_without_second_0_are_reported(spark):
    df = spark.createDataFrame([("a", i, 1.0, 3 + i // 10) for i in range(100)], "s string, pos int, value double, second int")
    sized = df.crossJoin(series_widths(df, ["s"], "second", 2).select("width"))
    assert [r.s for r in short_series(sized, ["s"], "width").collect()] == ["a"]
    with pytest.raises(ValueError):
        features_with_series_width(df, ["s"], "pos", "value", "second", 2, 0.5, 2, strict=True)


def test_hot_split_without_a_group(spark):
    df = spark.createDataFrame([(i, i % 400) for i in range(2000)], "id long, t long")
    plain = chronological_split(df, [], "t", ["id"], 0.2, skew=None)
    hot = chronological_split(df, [], "t", ["id"], 0.2, skew=Skew(0.01, 50))
    assert sorted(map(tuple, hot.select("id", "split").collect())) == sorted(map(tuple, plain.select("id", "split").collect()))
