"""Every registered query against its SQL, or at least run."""

import pytest

from compare import diff
from lexmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, name):
    assert diff(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
