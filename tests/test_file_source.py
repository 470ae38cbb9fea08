"""The file source: filters and skipped folders are settled before a file is opened."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from skein.sources.file_source import FileReader, listed_files
from skein.sources.files import IGNORED_FOLDERS, code_files, project_files


@pytest.fixture
def tree(tmp_path):
    put = {"a.py": "x = 1", "b.PY": "y", "c.v": "module m;", "blank.py": "  \n", "sub/d.py": "z" * 900, "sub/e.txt": "text", "node_modules/f.py": "no", "sub/.git/g.py": "no", "h": "none", "é x.tcl": "puts é"}
    for name, text in put.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def test_options(spark, tree):
    names = lambda d: sorted(r.name for r in d.select("name").collect())
    df = listed_files(spark, str(tree), skip=IGNORED_FOLDERS)
    every = sorted(["a.py", "b.PY", "c.v", "blank.py", "d.py", "e.txt", "h", "é x.tcl"])
    assert names(df) == every
    assert names(listed_files(spark, str(tree), ("py", "v"), 100, IGNORED_FOLDERS)) == ["a.py", "b.PY", "blank.py", "c.v"]
    assert names(listed_files(spark, str(tree), ("py",), recursive=False)) == ["a.py", "b.PY", "blank.py"]
    assert names(listed_files(spark, f"file://{tree}", ("txt",))) == ["e.txt"]
    assert {r.name: bytes(r.content).decode() for r in listed_files(spark, str(tree), ("TCL",)).collect()} == {"é x.tcl": "puts é"}
    assert listed_files(spark, str(tree), ("none",)).count() == 0


def test_one_relation_with_several_filters(spark, tree):
    """What one query asks of a relation does not stay with it."""
    df = listed_files(spark, str(tree), skip=IGNORED_FOLDERS)
    names = lambda d: sorted(r.name for r in d.select("name").collect())
    assert names(df.where(F.col("folder").endswith("sub"))) == ["d.py", "e.txt"]
    assert names(df.where("extension = 'py' or length > 800")) == ["a.py", "b.PY", "blank.py", "d.py"]
    assert df.count() == 8


@pytest.mark.skipif(os.geteuid() == 0, reason="root reads every file")
def test_excluded_files_stay_closed(spark, tree):
    for name in ("sub/e.txt", "node_modules/f.py"):
        os.chmod(tree / name, 0)
    assert listed_files(spark, str(tree), ("py",), skip=IGNORED_FOLDERS).count() == 4


def test_partitions_hold_only_wanted_files(tree):
    reader = FileReader({"path": str(tree), "skip": "node_modules,.git", "partBytes": "6", "extensions": "py", "mostBytes": "100"})
    parts = reader.partitions()
    assert sorted(os.path.basename(p) for part in parts for p, _ in part.files) == ["a.py", "b.PY", "blank.py"]
    assert len(parts) == 2 and all(sum(n for _, n in p.files) <= 6 for p in parts)
    assert [r.num_rows for part in parts for r in reader.read(part)] == [len(p.files) for p in parts]


def test_scans_of_code_use_it(spark, tree):
    got = {r.path.rsplit("/", 1)[-1]: r.language for r in code_files(spark, str(tree)).collect()}
    assert got == {"a.py": "python", "b.PY": "python", "c.v": "verilog", "d.py": "python", "é x.tcl": "tcl"}
    got = {r.path.rsplit("/", 1)[-1] for r in project_files(spark, str(tree)).collect()}
    assert {"a.py", "c.v", "d.py", "é x.tcl"} <= got and "blank.py" not in got
