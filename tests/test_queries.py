"""Every registered query against its SQL in DuckDB, over the small tables; those without SQL run and keep their schema."""

import math
import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

import cubeframe
from cubeframe import session
from cubeframe.queries import core, reference

QUERIES = core.QUERIES | reference.QUERIES
SQL = core.SQL | reference.SQL


@pytest.fixture(scope="session")
def db(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, data, db, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(cols).collect())
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_lists_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_a_missing_dependency_of_llm_is_not_swallowed():
    code = """
import sys
class Finder:
    def find_spec(self, name, path=None, target=None):
        if name == "cubeframe.llm.queries":
            raise ModuleNotFoundError("No module named 'elsewhere'", name="elsewhere")
sys.meta_path.insert(0, Finder())
import __spark_entry__
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode != 0 or not os.path.isdir(os.path.join(os.path.dirname(cubeframe.__file__), "llm")), done.stderr


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Scala:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Scala()})()})()

    session_like = type("Spark", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, key, default: default})()})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(session_like)
