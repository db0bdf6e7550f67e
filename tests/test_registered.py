"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from checks import queries as registered

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    ours = normal([tuple(r) for r in found.collect()], found.columns)
    result = duck.execute(ORACLES[name])
    rows = result.fetchall()
    assert ours == normal(rows, [c[0] for c in result.description])


def test_entry(spark):
    found = entry_module.entry(spark)
    assert found.count() == 776
    assert "Secret" not in found.columns
