"""Every registered query against its SQL."""

import pytest
from oracle import compare, connect

from quayside.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    import os

    return connect(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        _, problems = compare(df, con, ORACLE[name])
        assert not problems
    else:
        assert df.columns
        df.collect()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
