"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, FOLDER, name)
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
