"""Neighbours in hashed orders, in ball trees and within datasets; correlations within datasets."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.operators import neighbours
from quayside.operators.correlations import Moments, correlations_by
from quayside.operators.grouped_neighbours import nearest_neighbours_by
from quayside.operators.hashed_neighbours import Hashing, exact_of, recall_of
from quayside.operators.neighbours import nearest_neighbours
from quayside.operators.quality import class_overlap, class_overlap_by, feature_correlation
from quayside.operators.runs import runs, whole_runs
from quayside.operators.vectors import all_nearest, nearest_between, nearest_of


def brute(x, ids):
    """id to (neighbour, distance); ties to the lowest id."""
    out = {}
    for i, own in enumerate(x):
        far = np.sqrt(((x - own) ** 2).sum(axis=1))
        others = [(far[j], ids[j]) for j in range(len(x)) if ids[j] != ids[i]]
        if others:
            out[int(ids[i])] = (int(min(others)[1]), float(min(others)[0]))
    return out


def points(seed, rows, dims, grid=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (rows, dims)).astype(float) if grid else rng.standard_normal((rows, dims))
    return x, rng.permutation(rows).astype(np.int64) * 3


def frame(spark, x, ids, **more):
    return spark.createDataFrame(pd.DataFrame({"id": ids, "x": [list(map(float, v)) for v in x], **more}))


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("search", [lambda x, ids: nearest_of(x, ids, x, ids), lambda x, ids: all_nearest(x, ids, 8)])
def test_in_memory_searches_equal_brute_force(search, grid):
    for rows, dims in ((1, 2), (2, 3), (150, 2), (300, 7)):
        x, ids = points(rows, rows, dims, grid)
        squares, names = search(x, ids)
        found = {int(i): (int(n), float(np.sqrt(s))) for i, n, s in zip(ids, names, squares) if n >= 0}
        want = brute(x, ids)
        assert {i: n for i, (n, _) in found.items()} == {i: n for i, (n, _) in want.items()}
        assert all(abs(found[i][1] - want[i][1]) < 1e-9 for i in want)


def test_far_from_the_origin_is_exact():
    x, ids = points(4, 200, 5)
    squares, names = nearest_of(x + 1e7, ids, x + 1e7, ids)
    want = brute(x + 1e7, ids)
    assert [int(n) for n in names] == [want[int(i)][0] for i in ids]


def test_hashed_orders_reach_the_recall(spark):
    x, ids = points(7, 3000, 24)
    x = np.concatenate([x, x[:5], x[:5]])
    ids = np.concatenate([ids, np.arange(10) + 10**6])
    rows = frame(spark, x, ids)
    hashing = Hashing(orders=4, block=64, recall=0.9, queries=400)
    exact = {r.id: r for r in nearest_neighbours(rows, "id", "x").collect()}
    found = nearest_neighbours(rows, "id", "x", method="hashed", hashing=hashing).collect()
    assert len(found) == len(x) == len({r.id for r in found})
    true = sum(r.distance <= exact[r.id].distance * (1 + 1e-9) for r in found)
    assert true >= 0.85 * len(x) and all(r.distance >= exact[r.id].distance * (1 - 1e-9) for r in found)
    # copies are folded before, so they are always found
    assert all(r.neighbour == exact[r.id].neighbour for r in found if exact[r.id].distance == 0)


def test_hashed_warns_where_the_recall_is_not_reached(spark):
    x, ids = points(9, 1500, 40)
    rows = frame(spark, x, ids)
    with pytest.warns(UserWarning, match="orders found"):
        nearest_neighbours(rows, "id", "x", method="hashed", hashing=Hashing(orders=1, block=16, most_orders=1)).count()


def test_few_rows_are_exact_in_one_order(spark):
    for rows in (0, 1, 2, 40):
        x, ids = points(1, rows, 3)
        rows = frame(spark, x, ids) if rows else spark.createDataFrame([], "id long, x array<double>")
        found = {r.id: (r.neighbour, r.distance) for r in nearest_neighbours(rows, "id", "x", method="hashed").collect()}
        want = brute(x, ids)
        assert {i: n for i, (n, _) in found.items()} == {i: n for i, (n, _) in want.items()}


def test_recall_is_measured_against_all_rows(spark):
    x, ids = points(2, 300, 4)
    rows = frame(spark, x, ids)
    exact = exact_of(rows.limit(50).toPandas(), rows)
    want = brute(x, ids)
    assert all(abs(np.sqrt(r.square) - want[r.id][1]) < 1e-9 for r in exact.itertuples())
    found = nearest_neighbours(rows, "id", "x").select("id", (F.col("distance") * F.col("distance")).alias("square"))
    assert recall_of(found, exact) == 1.0
    assert recall_of(found.withColumn("square", F.col("square") * 2), exact) == 0.0


def test_unknown_method(spark):
    with pytest.raises(ValueError, match="method"):
        nearest_neighbours(frame(spark, *points(1, 3, 2)), "id", "x", method="other")


@pytest.mark.parametrize("most", [20_000, 30])
def test_within_datasets(spark, most):
    x, _ = points(5, 400, 3, grid=True)
    x[::2] += np.random.default_rng(6).random((200, 3))
    of = [None if i % 7 == 0 else "big" if i % 3 else f"d{i % 19}" for i in range(400)]
    of[3] = "alone"
    ids = np.arange(400)[::-1] // 2 * 2 + np.arange(400) % 2
    rows = frame(spark, x, ids, by=of)
    found = {(r.by, r.id): (r.neighbour, r.distance) for r in nearest_neighbours_by(rows, "by", "id", "x", most).collect()}
    want = {}
    for name in set(of):
        at = [i for i in range(400) if of[i] == name]
        want |= {(name, i): v for i, v in brute(x[at], ids[at]).items()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(found[k][1] - want[k][1]) < 1e-9 for k in want)


@pytest.mark.parametrize("most", [20_000, 10])
def test_overlap_of_each_dataset_is_that_of_the_dataset_alone(spark, most):
    x, ids = points(8, 120, 2)
    rows = frame(spark, x, ids, by=[f"d{i % 4}" for i in range(120)], y=[i // 4 % 3 for i in range(120)])
    found = {r.by: r.class_overlap for r in class_overlap_by(rows, "by", "id", "x", "y", most).collect()}
    for name in found:
        alone = class_overlap(rows.filter(F.col("by") == name), "id", "x", "y").first()[0]
        assert abs(found[name] - alone) < 1e-12


def test_very_many_small_datasets(spark):
    rows = spark.range(30_000).select(F.col("id"), F.floor(F.col("id") / 3).alias("by"), F.array((F.col("id") % 3 * F.col("id") % 3).cast("double"), F.lit(1.0)).alias("x"))
    assert nearest_neighbours_by(rows, "by", "id", "x").count() == 30_000


def test_runs_meet_across_frames_and_nulls():
    frames = [pd.DataFrame({"k": k, "v": range(len(k))}) for k in (["a", "a", None], [None, None, "b"], [], ["b"], ["c"])]
    assert [len(r) for r in whole_runs(iter(frames), ["k"])] == [2, 3, 2, 1]
    assert [new for new, _ in runs(iter(frames), ["k"])] == [True, True, False, True, False, True]


def gappy(rows, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((rows, 6)) + 1e6
    x[:, 1] = x[:, 0] * 2 + rng.standard_normal(rows)
    x[:, 4] = 7.1
    x[rng.random(x.shape) < 0.1] = np.nan
    return x


def expected(x):
    out = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = x[~np.isnan(x[:, i]) & ~np.isnan(x[:, j])][:, [i, j]]
            flat = len(both) < 2 or (both == both[0]).all(axis=0).any()
            out.append(None if flat else float(np.corrcoef(both.T)[0, 1]))
    return out


@pytest.mark.parametrize("lane_rows", [100_000, 40])
def test_correlations_with_gaps(spark, lane_rows):
    x, names = gappy(300), [f"f{i}" for i in range(6)]
    of = [None if i % 5 == 0 else "a" if i % 5 < 4 else f"s{i % 3}" for i in range(300)]
    rows = spark.createDataFrame(pd.DataFrame({**{n: x[:, i] for i, n in enumerate(names)}, "by": of, "zone": [i % 2 for i in range(300)]}))
    found = {(r.by, r.zone): r for r in correlations_by(rows, names, ["by", "zone"], lane_rows).collect()}
    for key, r in found.items():
        at = [i for i in range(300) if (of[i], i % 2) == key]
        assert r.rows == len(at)
        for a, b in zip(r.r, expected(x[at]), strict=True):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6)


def test_moments_merge_like_one_pass():
    x = gappy(200)
    total = Moments(6)
    for part in np.array_split(x, 7):
        total.add(Moments(6, Moments.of(part).packed()))
    np.testing.assert_allclose(total.correlations(), Moments.of(x).correlations(), atol=1e-7)


def test_wide_score_equals_expressions(spark, monkeypatch):
    names = [f"f{i}" for i in range(6)]
    rows = spark.createDataFrame(pd.DataFrame({**{n: gappy(200)[:, i] for i, n in enumerate(names)}, "by": [i % 3 for i in range(200)]}))
    # NaN is absent in the packed form, the expressions expect null
    rows = rows.select("by", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in names])
    plain = {r.by: r.feature_correlation for r in feature_correlation(rows, names, ["by"]).collect()}
    monkeypatch.setattr("quayside.operators.quality.MOST_PAIR_EXPRESSIONS", 0)
    assert {r.by: r.feature_correlation for r in feature_correlation(rows, names, ["by"]).collect()} == plain


def test_infinite_cells_and_empty_tables(spark):
    with pytest.raises(ValueError, match="infinite"):
        correlations_by(spark.createDataFrame([(1, float("inf"), 1.0)], "k int, a double, b double"), ["a", "b"], ["k"])
    assert correlations_by(spark.createDataFrame([], "k int, a double, b double"), ["a", "b"], ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_both_sides_of_a_product_get_their_nearest(seed):
    rng = np.random.default_rng(seed)
    # few different values: many equal distances
    x = rng.integers(0, 4, (90, 3)).astype(float)
    ids = rng.permutation(90) // 2 * 2 if seed % 2 else rng.permutation(90)
    asks, known = rng.random(90) < 0.7, np.where(rng.random(90) < 0.5, np.inf, rng.integers(0, 4, 90))
    one, other = slice(0, 50), slice(50, 90)
    found = nearest_between(x[one], ids[one], asks[one], known[one], x[other], ids[other], asks[other], known[other])
    want = set()
    for mine, theirs in ((one, other), (other, one)):
        for i in range(90)[mine]:
            square, name = min((((x[i] - x[j]) ** 2).sum(), ids[j]) for j in range(90)[theirs] if ids[j] != ids[i])
            if asks[i] and square <= known[i]:
                want.add((ids[i], name, square))
    assert set(zip(*found, strict=True)) == want


@pytest.mark.parametrize("block", [8, 40, None])
def test_blocks_of_any_size_give_the_exact_neighbour(spark, block):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (150, 4)), rng.integers(0, 3, (100, 4)) + 20.0, rng.normal(0, 1e-3, (50, 4)) - 9])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squares, np.inf)
    found = nearest_neighbours(rows, "id", "x", block=block).collect()
    assert sorted(r.id for r in found) == list(range(300))
    for r in found:
        assert r.distance == pytest.approx(np.sqrt(squares[r.id].min()), rel=1e-9, abs=1e-12)
        # integer coordinates have equal distances, of which the lowest id counts
        assert squares[r.id, r.neighbour] == pytest.approx(squares[r.id].min(), rel=1e-9, abs=1e-12)
        assert not 150 <= r.id < 250 or r.neighbour == squares[r.id].argmin()


def test_blocks_travel_as_bytes_and_share_tasks():
    """850 pairs of blocks were 850 tasks, and every vector was sent element by element."""
    vectors = pd.Series([[0.1, -2.5, 1e300], [float(np.float32(0.1)), 0.0, 3.0]])
    assert np.array_equal(neighbours._unpacked(neighbours._packed(vectors, "<f8"), "<f8", 3), np.array(vectors.to_list()))
    single = neighbours._unpacked(neighbours._packed(vectors[1:], "<f4"), "<f4", 3)
    assert np.array_equal(single, np.array(vectors[1:].to_list())) and single.dtype == "float64"
    assert neighbours._unpacked(pd.Series([], dtype=object), "<f8", 3).shape == (0, 3)
    assert [neighbours._meeting_tasks(n) for n in (0, 1, 40, 850, 10**6)] == [1, 1, 40, 212, neighbours.MOST_TASKS]
