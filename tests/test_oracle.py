"""Every registered query against its SQL on DuckDB."""

import importlib
from pathlib import Path

import pytest
from oracle_check import connect, difference

from tillroll.driver.oracle import ORACLE
from tillroll.driver.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= entry.queries().keys()
    assert set(ORACLE) <= entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["Country", "total_invoice", "porcentage"]
    assert entry.entry(spark).count() > 0


def test_other_attributes_do_not_change_the_result(spark):
    """The adapter skips tables a query does not read; the lines must stay the same."""
    from tillroll.driver.adapter import retail
    from tillroll.plans.analyses import sales_by_country

    few = sales_by_country(retail(spark, SF_DIR, "Country")).collect()
    assert few == sales_by_country(retail(spark, SF_DIR)).collect()
