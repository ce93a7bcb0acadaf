"""The queries that SQL can express, against it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402

from quayside.llm.queries import ORACLE, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, sf_dir, name):
    rows, problems = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name])
    assert rows and not problems
