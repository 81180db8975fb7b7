"""The driver contract."""

import importlib.util
import os

import duckdb
import pytest

from conftest import ROOT, TESTDATA

pytestmark = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")

QUICK = ["canonicalise_sources", "newest_n", "combine_genres", "knn_exact", "similar_items"]


@pytest.fixture(scope="module")
def entry_module():
    spec = importlib.util.spec_from_file_location(
        "__spark_entry__", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_runs(spark, entry_module):
    assert entry_module.entry(spark).count() > 0


def test_registered_names(entry_module):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_its_sql(spark, entry_module, name):
    con = duckdb.connect()
    for file in os.listdir(TESTDATA):
        table = file.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from '{TESTDATA}/{file}'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = entry_module.queries()[name](spark, TESTDATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*[f"`{c}`" for c in columns]).collect())) == sorted(
        cursor.fetchall())
