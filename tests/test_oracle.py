"""Every registered query against its DuckDB oracle, on the smallest data."""

import pytest

from contract import CASES
from tests.check_oracle import connection, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_matches_oracle(spark, duck, name):
    case = CASES[name]
    if case.sql is None:
        assert case.run(spark, SF_DIR).count() > 0
    else:
        assert difference(spark, duck, case.run, case.sql, SF_DIR) is None


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).columns[:2] == ["repository", "run_id"]
    assert set(oracle_sql()) <= set(queries())
