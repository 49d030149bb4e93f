"""Every registered query of the library proper against its SQL in DuckDB."""

import pytest
from oracle_compare import connect, same

from foliant.plans.registry import registered

FOLDER = "/root/testdata/sf0.001"
QUERIES = registered()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows(spark, duck, name):
    run, sql = QUERIES[name]
    assert same(run(spark, FOLDER), duck, sql) is None
