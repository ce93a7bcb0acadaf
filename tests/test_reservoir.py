from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.operators.reservoir import Reservoir, reservoir_sample


def _batches(sizes):
    ends = np.cumsum(sizes)
    return [pa.record_batch({"v": pa.array(np.arange(e - n, e))}) for e, n in zip(ends, sizes)]


def _chi_square(counts, expected):
    return float(((np.asarray(counts) - expected) ** 2 / expected).sum())


def test_every_slot_is_uniform_whatever_the_batches():
    sizes, slots = [3, 1, 0, 20, 2, 14], 5
    seen = np.zeros((slots, 40))
    for seed in range(6000):
        reservoir = Reservoir(slots, np.random.default_rng(seed))
        for batch in _batches(sizes):
            reservoir.add(batch)
        rows = reservoir.rows()["v"].to_numpy()
        assert len(rows) == slots and reservoir.seen == 40
        seen[np.arange(slots), rows] += 1
    # 39 degrees of freedom: above 80 with a probability below 0.0002
    assert all(_chi_square(row, 150) < 80 for row in seen)
    assert _chi_square(seen.sum(axis=0), 750) < 80


def test_slots_are_independent():
    pairs = Counter()
    for seed in range(8000):
        reservoir = Reservoir(2, np.random.default_rng(seed))
        for batch in _batches([2, 1, 1]):
            reservoir.add(batch)
        pairs[tuple(reservoir.rows()["v"].to_pylist())] += 1
    assert _chi_square([pairs[a, b] for a in range(4) for b in range(4)], 500) < 45


def test_few_rows_are_held_as_they_are():
    reservoir = Reservoir(10, np.random.default_rng(1))
    assert reservoir.rows() is None
    for batch in _batches([4, 6]):
        reservoir.add(batch)
    assert reservoir.rows()["v"].to_pylist() == list(range(10))


def test_memory_does_not_grow_with_the_rows():
    reservoir = Reservoir(100, np.random.default_rng(1))
    for batch in _batches([500] * 200):
        reservoir.add(batch)
        assert reservoir._rows.num_rows <= 700


@pytest.fixture(scope="module")
def uneven(spark):
    """100 000 rows, a third of them in one partition, the smallest partitions below any sample."""
    part = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.sqrt(F.col("id") % 121)).cast("int") + 1)
    rows = spark.range(100_000).select("id", F.concat(F.lit("r"), F.col("id")).alias("name"), part.alias("p"))
    return rows.repartition(16, "p").cache()


@pytest.mark.parametrize("number", [1, 7, 2000, 20_000])
def test_exact_size_and_seed(uneven, number):
    first = Counter(map(tuple, reservoir_sample(uneven, number).collect()))
    assert sum(first.values()) == number
    assert all(name == f"r{i}" for i, name, _ in first)
    assert first == Counter(map(tuple, reservoir_sample(uneven, number).collect()))
    if number > 1:
        assert first != Counter(map(tuple, reservoir_sample(uneven, number, seed=7).collect()))


def test_rows_are_drawn_alike_from_all_partitions(uneven):
    drawn = Counter(r.id for r in reservoir_sample(uneven, 20_000).collect())
    counts = np.bincount([i // 1000 for i in drawn.elements()], minlength=100)
    assert _chi_square(counts, 200) < 170  # 99 degrees of freedom
    parts = uneven.groupBy("p").count().collect()
    own = Counter(r.p for r in reservoir_sample(uneven, 20_000, seed=3).collect())
    assert sum((own[r["p"]] - r["count"] / 5) ** 2 / (r["count"] / 5) for r in parts) < 35  # 11 degrees of freedom
    # with replacement: 20 000 of 100 000 leave about 18 127 different ones
    assert 17_950 < len(drawn) < 18_300


def test_no_more_rows_than_wanted(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, [1.5])], "a int, b array<double>").repartition(3)
    for number in (3, 4):
        assert sorted(map(str, reservoir_sample(rows, number).collect())) == sorted(map(str, rows.collect()))
    assert reservoir_sample(rows, 2).count() == 2 and reservoir_sample(rows, 0).count() == 0
    assert reservoir_sample(rows.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        reservoir_sample(rows.withColumnRenamed("a", "_sample_at"), 2)
