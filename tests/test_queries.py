"""Every registered query against its checking SQL."""

import compare
import pytest

import __spark_entry__ as entry_module
from tableprofile import plans

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(plans.builders()))
def test_query_equals_checking_sql(spark, folder, con, name):
    assert name in ORACLES
    assert compare.differences(QUERIES[name](spark, folder), con, ORACLES[name]) is None


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
