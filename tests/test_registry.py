"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

from checks.compare import connect, rows_of
from checks.registry import CHECKS

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_oracle(spark, oracle, name):
    check = CHECKS[name]
    frame = check.query(spark, SF_DIR)
    actual = rows_of(frame.columns, frame.collect())
    if check.sql is None:
        return
    result = oracle.execute(check.sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert actual == rows_of(columns, result.fetchall())
