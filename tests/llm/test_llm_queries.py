import math
import os
from collections import Counter

import duckdb
import pytest

from cubeframe.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = q.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rel = con.sql(q.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert Counter(map(tuple, df.select(cols).collect())) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_runs(spark, data, name):
    df = q.QUERIES[name](spark, data)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_containers_hold_every_document(spark, data):
    usage = q.p7_usage(spark, data).first()
    assert usage.largest <= 8192 and usage.containers <= math.ceil(1.02 * usage.fewest) + 1


def test_leaks_against_every_twelve_words(spark, data):
    from cubeframe.llm.leaks import words

    grams = lambda t: {tuple(w[i : i + 12]) for w in [words(t)] for i in range(len(w) - 11)}
    items = {r.item_id: grams(r.item_text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()}
    by_gram = {}
    for i, g in items.items():
        for x in g:
            by_gram.setdefault(x, set()).add(i)
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{data}/documents.parquet").collect() for x in grams(r.text) if x in by_gram for i in by_gram[x]}
    assert {tuple(r) for r in q.p8_found(spark, data).select("doc_id", "item_id").collect()} == want


def test_splits_keep_groups_and_shares(spark, data):
    rows = q.p3_splits(spark, data).collect()
    of = {}
    for r in rows:
        of.setdefault(r.group_scene, set()).add(r.split)
    assert all(len(s) == 1 for s in of.values())
    assert len({r.scene for r in rows}) == len(rows) == spark.read.parquet(f"{data}/scenes.parquet").select("scene").distinct().count()
