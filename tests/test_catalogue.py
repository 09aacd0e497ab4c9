import pytest

import __spark_entry__ as contract
import check_queries
from labelflow.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sum(r["rows"] for r in rows) == 300


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query_agrees_with_sql(spark, name):
    assert check_queries.compare(spark, SF_DIR, name).startswith(("ok", "rows-only"))


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(catalogue.queries()) <= set(contract.queries())
