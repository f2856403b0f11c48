"""Every registered query against its SQL."""

import compare
import pytest

import __spark_entry__ as contract
from cardmill.plans import oracle as sql, registry
from conftest import SF

QUERIES = registry.QUERIES
ORACLE = sql.ORACLE


@pytest.fixture(scope="module")
def oracle():
    return compare.duck(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLE.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_agree(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns, expected = compare.duck_rows(oracle, ORACLE[name])
    assert sorted(df.columns) == sorted(columns)
    assert compare.spark_rows(df) == expected


def test_flagship_gives_a_page(spark):
    df = contract.entry(spark)
    assert df.count() == 30
    assert "title" in df.columns
