"""Every query that SQL can express gives the rows of its SQL."""

import pytest

from tests.compare import assert_same, duck
from tidewater.plans.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    assert_same(df, con, ORACLE[name])


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)
