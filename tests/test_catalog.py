"""Every query with SQL gives the SQL's rows on the smallest tables."""

import datetime
import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v)[:10] if isinstance(v, datetime.date) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(([plain(r[k]) for k in order] for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.oracle_sql()[name])
    assert mine == rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
