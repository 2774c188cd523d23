"""Every registered query against its DuckDB check."""

import pytest

from packloom.catalog import ORACLES, QUERIES

from .compare import ROOT, differences, duck


@pytest.fixture(scope="module")
def con():
    return duck(f"{ROOT}/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(tables, con, name):
    assert differences(QUERIES[name](tables), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(tables, name):
    assert QUERIES[name](tables).limit(1).collect()


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 4
    assert set(contract.oracle_sql()) <= set(contract.queries())
