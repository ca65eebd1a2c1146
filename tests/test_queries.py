"""Every registered query beside its checking SQL."""

import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF_DIR = os.environ.get("TESSALY_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    assert difference(spark, duck, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
