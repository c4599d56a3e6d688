"""Every registered query gives the rows of its SQL."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest
from parlora.plans.registry import oracle_sql, queries


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return float(v)
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
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0


ODD = ("", "   ", "\t\n", "\u00a0", "\u00a0a\u00a0\u00a0b \u00a0", "\x0ba\x0bb\x1c", "a\u2028", " a\u2003\u2028", "the" + "\u00a0 the" * 60, "\x85 dans \x85", "x" * 201, "\U0001f600 " * 120, None)


def odd_tables(spark, folder):
    """Documents and conversations of odd texts, and DuckDB with views of them."""
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k // 4, k % 4, "user", t) for k, t in enumerate(ODD)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return con


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want and got


@pytest.mark.parametrize("name", ["evidence_excerpts", "narrative_phases"])
def test_odd_white_space_equals_sql(spark, tmp_path, name):
    con = odd_tables(spark, str(tmp_path))
    same_rows(queries()[name](spark, str(tmp_path)), con, oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("left", ["nothing", "the pipeline", "empty folder"])
def test_the_rest_works_without_llm(tmp_path, left):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/parlora", tmp_path / "parlora", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if left == "the pipeline" and os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "parlora" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_llm():
    import re

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = [f for f in glob.glob(f"{root}/parlora/**/*.py", recursive=True) + glob.glob(f"{root}/tests/*.py") + [f"{root}/bench.py"] if "/parlora/llm/" not in f]
    assert len(files) > 20
    assert not [f for f in files if re.search(r"^\s*(from|import) (parlora|\.+)\.?llm\b", open(f).read(), re.M)]
