"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import differences
from conftest import SF

import __spark_entry__ as contract
from tidegrid import catalog, oracles

SQL = oracles.build()
ROWS_ONLY = {
    "hac_regression_expanded",
    "gbt_grid_search", "gbt_holdout", "holdout_evaluation", "holdout_deciles", "holdout_economics",
}


def test_registry():
    assert set(catalog.QUERIES) - set(SQL) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    found = differences(contract.queries()[name](spark, SF), SQL[name], SF)
    assert [d for d in found if d.startswith("DIFF") or not d.startswith("close")] == []


def test_entry(spark):
    frame = contract.entry(spark)
    assert len(frame.columns) == 4 + 157 + 6 and frame.count() > 0
