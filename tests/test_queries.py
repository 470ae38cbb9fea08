"""Every query that has SQL, against DuckDB over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from skein.plans import catalog
from tools.compare import rows

catalog.load()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    got = rows(catalog.QUERIES[name](spark, sf).toPandas())
    if name in catalog.ORACLES:
        want = rows(con.sql(catalog.ORACLES[name]).df())
        assert list(got.columns) == list(want.columns)
        assert len(got) == len(want)
        assert not len(got) or got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(8).to_string()


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_entry_without_corpus_operators(tmp_path, also):
    """A copy of the repository without the corpus operators and their tests, and without the pipeline too, still has all other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *also)
    shutil.copytree(root, tmp_path / "copy", ignore=gone)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'v2_cosine_topk' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print(len(q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0 and int(ran.stdout) == len(catalog.QUERIES), ran.stderr[-2000:]


def test_entry():
    import __spark_entry__ as e

    assert "v2_cosine_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
