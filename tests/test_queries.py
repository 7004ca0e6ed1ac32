"""Every registered query with an oracle, against it, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

# The oracle of this one assumes at least a thousand values per column; test_models checks it on fewer.
NEEDS_MORE_ROWS = {"gaussianize"}


@pytest.fixture(scope="module")
def oracle(tiny):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - NEEDS_MORE_ROWS))
def test_query_equals_oracle(spark, oracle, tiny, name):
    got = rows_of(contract.queries()[name](spark, tiny).toArrow())
    want = rows_of(oracle.execute(contract.oracle_sql()[name]).to_arrow_table())
    assert got == want


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 206
