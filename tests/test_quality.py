import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.operators.neighbours import link_members, nearest_neighbours, tomek_links
from quayside.operators.ordered import Skew
from quayside.operators.quality import (
    class_overlap,
    class_parity,
    completeness,
    correlation_pairs,
    feature_correlation,
    filled,
    label_issues,
    label_purity,
    minority_class,
    standardised,
)


def one(df):
    return df.first()[0]


def test_class_parity(spark):
    df = spark.createDataFrame([(c,) for c in "aaaabbcc"], "y string")
    assert one(class_parity(df, "y")) == 0.7778


def test_completeness_counts_nan_and_null(spark):
    nan = float("nan")
    rows = [(1.0, None, 1.0, 1.0, 1.0), (1.0, 1.0, nan, 1.0, 1.0), (1.0, 1.0, 1.0, None, 1.0), (1.0,) * 5]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    assert one(completeness(df, df.columns)) == 0.85


def test_fill(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (float("-inf"),), (2.0,)], "a double")
    assert [r["a"] for r in filled(df, ["a"]).collect()] == [0.0, 0.0, -1.7976931348623157e308, 2.0]


def test_correlation_matches_numpy_and_skips_constants(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(200, 5))
    data[:, 1] += data[:, 0]
    data[:, 3] = 7.0
    data[:, 4] = -2 * data[:, 2]
    df = spark.createDataFrame(data.tolist(), ["a", "b", "c", "d", "e"]).repartition(5)
    got = {(r["left"], r["right"]): r["r"] for r in correlation_pairs(df, df.columns).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(data.T)
    assert got[0, 1] == pytest.approx(want[0, 1]) and got[2, 4] == pytest.approx(-1) and got[0, 3] is None
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5) if 3 not in (i, j) and (i, j) != (2, 4)]
    score = 1 - 2 * sum(abs(want[p]) for p in pairs) / 10
    assert one(feature_correlation(df, df.columns)) == pytest.approx(score, abs=1e-4)
    grouped = feature_correlation(df.withColumn("g", F.lit(1)), ["a", "b", "c", "d", "e"], ["g"])
    assert grouped.first()["feature_correlation"] == pytest.approx(score, abs=1e-4)


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    rows = standardised(df, ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def cloud(seed, n, width, copies):
    rng = np.random.default_rng(seed)
    points = rng.integers(0, 6, size=(n, width)).astype(float) if seed % 2 else rng.normal(size=(n, width))
    points[: int(n * copies)] = points[0]
    return points


def brute(points):
    square = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    return square.argmin(axis=1)


@pytest.mark.parametrize("seed,n,width,copies,block", [(1, 150, 3, 0.35, 8), (2, 200, 2, 0.0, 16), (4, 120, 8, 0.34, 2048)])
def test_nearest_neighbours_equal_brute_force(spark, seed, n, width, copies, block):
    points = cloud(seed, n, width, copies)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, x array<double>")
    got = {r["id"]: r["neighbour"] for r in nearest_neighbours(df, "id", "x", block, Skew(0.1, 10)).collect()}
    assert got == dict(enumerate(brute(points).tolist()))


def test_links_and_overlap_equal_brute_force(spark):
    points = cloud(6, 120, 2, 0.0)
    labels = (np.arange(120) % 3).tolist()
    df = spark.createDataFrame(
        [(i, p.tolist(), y) for i, (p, y) in enumerate(zip(points, labels))], "id long, x array<double>, y int"
    )
    near = brute(points)
    want = {(i, int(j)) for i, j in enumerate(near) if i < j and near[j] == i and labels[i] != labels[j]}
    links = tomek_links(df, "id", "x", "y").cache()
    assert {(r["low"], r["high"]) for r in links.collect()} == want
    assert minority_class(df, "y").first()[0] == 0
    dropped = sum(labels[k] != 0 for pair in want for k in pair)
    assert one(class_overlap(df, "id", "x", "y", links)) == pytest.approx(1 - dropped / 120)
    issues = link_members(links).filter("label = 1").select("id")
    flagged = sum(labels[k] == 1 for pair in want for k in pair)
    assert one(label_purity(df, "id", "x", "y", links, issues)) == round(1 - flagged / 120, 4)
    # the rows kept after dropping hold no member of class 1
    assert one(label_purity(df, "id", "x", "y", links, issues, overlap="kept")) == 1.0


def test_only_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 9)], "id long, x array<double>")
    got = {r["id"]: r["neighbour"] for r in nearest_neighbours(df, "id", "x").collect()}
    assert got == {3: 5, 5: 3, 9: 3}


def test_label_issues_same_with_hot_classes(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], size=300)
    rows = [(i, int(rng.integers(3)), q.tolist()) for i, q in enumerate(p)]
    df = spark.createDataFrame(rows, "id long, class int, p array<double>")
    plain = sorted(r["id"] for r in label_issues(df, 3).collect())
    hot = sorted(r["id"] for r in label_issues(df, 3, Skew(0.1, 20, 5)).collect())
    assert plain == hot and plain


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_correlation_with_gaps_does_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(3)
    cells = rng.normal(size=(200, 3))
    cells[:, 1] += cells[:, 0]
    cells[5, 0] = np.nan
    rows = [(None if i % 17 == 3 else float(a), float(b), float(c), 7.5) for i, (a, b, c) in enumerate(cells)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(parts)
    got = {(r["left"], r["right"]): r["r"] for r in correlation_pairs(df, ["a", "b", "c", "d"]).collect()}
    want = pd.DataFrame(rows, columns=list("abcd")).astype("float64").corr()
    for (i, j), r in got.items():
        assert r is None if j == 3 else r == pytest.approx(want.iloc[i, j], abs=1e-12)
    assert len(got) == 6


def test_completeness_of_mixed_types(spark):
    rows = [("x", 1, float("nan")), (None, 2, 1.0), ("y", None, 2.0), ("z", 4, None)]
    df = spark.createDataFrame(rows, "a string, b int, c double").withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    assert completeness(df, ["a", "b", "c", "t"]).first()[0] == 0.75


def test_neighbours_of_unusable_and_very_large_vectors(spark):
    bad = spark.createDataFrame([(0, [1.0]), (1, [float("nan")])], "id long, x array<double>")
    with pytest.raises(ValueError):
        nearest_neighbours(bad, "id", "x")
    large = spark.createDataFrame([(0, [1.7e308, 0.0]), (1, [-1.7e308, 1.0]), (2, [1.6e308, 5.0])], "id long, x array<double>")
    assert {r.id: r.neighbour for r in nearest_neighbours(large, "id", "x").collect()} == {0: 2, 1: 2, 2: 0}
