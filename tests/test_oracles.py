"""Every SQL-checkable query against DuckDB (the driver's gate runs sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck

SCALES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def cons():
    return {sf: duck(sf) for sf in SCALES}


@pytest.mark.parametrize("sf_dir", SCALES)
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, cons, name, sf_dir):
    r = compare(spark, name, entry.queries()[name], SQL[name], sf_dir, cons[sf_dir])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r
