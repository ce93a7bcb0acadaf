"""Partial updates with several changes of a key."""

import pytest

from quayside.operators.records import updated

STORED = [(1, "a", 1.0), (2, "b", 2.0), (3, None, None), (None, "n", 0.0)]
CHANGE = "id long, name string, at long"


@pytest.fixture(scope="module")
def stored(spark):
    return spark.createDataFrame(STORED, "id long, name string, balance double")


def names(df):
    return {r["id"]: r["name"] for r in df.collect()}


def test_last_value_of_each_field_counts(spark, stored):
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 7), (1, None, 9), (2, None, 1), (None, "z", 1), (8, "new", 1)], CHANGE)
    got = updated(stored, changes, "id", order=["at"])
    assert names(got) == {1: "y", 2: "b", 3: None, None: "n"} and got.count() == len(STORED)
    assert got.columns == stored.columns


def test_several_changes_without_an_order_are_an_error(spark, stored):
    changes = spark.createDataFrame([(1, "x", 5), (1, "y", 7)], CHANGE)
    with pytest.raises(Exception, match="several changes of one id: 1"):
        updated(stored, changes, "id").collect()


def test_single_empty_and_unknown_changes(spark, stored):
    assert names(updated(stored, spark.createDataFrame([(3, "c", 1), (None, "p", 1), (None, "q", 1)], CHANGE), "id"))[3] == "c"
    assert names(updated(stored, spark.createDataFrame([], CHANGE), "id")) == {1: "a", 2: "b", 3: None, None: "n"}
    only = spark.createDataFrame([(1, 4), (1, 5)], "id long, at long")
    assert updated(stored, only, "id", order=["at"]).count() == len(STORED)
