import importlib

import duckdb
import pytest

import __spark_entry__
from stratadiff.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_catalogue(spark, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    r = db.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(x[names.index(c)] for c in columns) for x in r.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_training(monkeypatch):
    import builtins
    import sys

    real = builtins.__import__

    def deny(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("stratadiff.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, globals, locals, fromlist, level)

    for gone in [m for m in sys.modules if m.startswith("stratadiff.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, gone)
    monkeypatch.setattr(builtins, "__import__", deny)
    try:
        reduced = importlib.reload(__spark_entry__)
        assert set(reduced.queries()) == set(catalogue.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
