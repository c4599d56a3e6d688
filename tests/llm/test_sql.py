"""Every query that SQL can express gives the rows of its SQL."""

import glob
import os

import duckdb
import pytest
from parlora.llm.registry import oracle_sql, queries


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, data, name):
    df = queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall()) and got
