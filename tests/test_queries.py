"""Every query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, _, note = oracle.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() == 6
