"""Every query with SQL returns the rows of its SQL at the smallest size."""

import pytest

import __spark_entry__ as entry
import verify
from tidemark.plans import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return verify.connect(SMALL)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, duck, name):
    assert verify.compare(spark, duck, name, SMALL).startswith("same")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
