"""Every catalogue query that has SQL gives DuckDB's rows; the others run."""

import pytest
from oracle import TESTDATA, connect, difference

from tauplane.plans import catalog, catalog_audits, catalog_policies, catalog_support  # noqa: F401

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    assert difference(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
