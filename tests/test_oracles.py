"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from gridwright import queries as base

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        p = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def rows_of(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(base.QUERIES))
def test_query(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in base.ORACLES:
        assert got
        return
    cur = duck.execute(base.ORACLES[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
