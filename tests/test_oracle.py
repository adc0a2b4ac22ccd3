"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
import registry
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {name: q.run for name, q in registry.load().items()}, entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    assert "perm_FDR" in entry.entry(spark).columns
