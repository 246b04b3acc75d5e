"""Registered queries against DuckDB on the smallest tables."""

import decimal
import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from citaforge import catalog

DIR = "/root/testdata/sf0.001"


def rows(found):
    plain = lambda v: round(float(v), 7) if isinstance(v, float | decimal.Decimal) else v
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    for t in "orders part lineitem documents pages conversations benchmark".split():
        link.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return link


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    want = duck.execute(f"select {', '.join(names)} from ({catalog.ORACLES[name]}) z").fetchall()
    assert rows(df.select(*names).collect()) == rows(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("citaforge.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert set(bare.queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
