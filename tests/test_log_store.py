"""The log-structured store: merges, crashes, races, replays, and what a write costs."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from skein.sources import tables
from skein.sources.log_store import Files, Store


@pytest.fixture
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "id long, v string, seq long")


def store(spark, path, **kw):
    return Store(spark, str(path), "id long, v string, seq long", ["id"], **kw)


def held(s, version=None):
    return sorted(((r.id, r.v) for r in s.read(version).collect()), key=str)


def test_merge_on_read(spark, tmp_path, frame):
    s = store(spark, tmp_path / "s", buckets=4)
    assert s.version() == 0 and held(s) == []
    s.upsert(frame((1, "a", 1), (2, "b", 1), (None, "n", 1)))
    s.upsert(frame((1, "c", 2), (1, "d", 3), (3, None, 1), (None, "m", 1)), "seq")
    assert held(s) == sorted([(1, "d"), (2, "b"), (3, None), (None, "m")], key=str)
    s.append(frame((1, "no", 9), (4, "f", 1), (None, "no", 1)))
    s.delete_keys(frame((2, "", 0), (77, "", 0)))
    s.delete(F.col("v") == "f")
    s.upsert(frame((2, "back", 1)))
    assert held(s) == sorted([(1, "d"), (2, "back"), (3, None), (None, "m")], key=str)
    assert held(s, 1) == sorted([(1, "a"), (2, "b"), (None, "n")], key=str)
    s.upsert(frame().limit(0))
    s.delete(F.lit(None).cast("boolean"))
    assert s.compact() and not s.compact() and held(s) == sorted([(1, "d"), (2, "back"), (3, None), (None, "m")], key=str)
    s.vacuum()
    assert len(glob.glob(f"{tmp_path}/s/log/*")) == 1 and len(glob.glob(f"{tmp_path}/s/data/*")) == 1 and len(held(s)) == 4
    s.clear()
    assert held(s) == []
    s.write(frame((5, "e", 1)))
    assert held(s) == [(5, "e")]


def test_many_writes_are_folded(spark, tmp_path, frame):
    s = store(spark, tmp_path / "s", buckets=2, deltas=2)
    for k in range(6):
        s.upsert(frame((k % 3, f"v{k}", k), (10 + k, "x", k)))
    state = s._state(s.version())
    assert max(len(x["after"]) for x in state["buckets"].values()) <= 2 and len(state["order"]) <= 4
    assert held(s) == sorted([(0, "v3"), (1, "v4"), (2, "v5"), *((10 + k, "x") for k in range(6))], key=str)


@pytest.mark.parametrize("at", ["before the data", "within the data", "before the version", "within the version"])
def test_a_kill_leaves_a_whole_version(spark, tmp_path, frame, monkeypatch, at):
    s = store(spark, tmp_path / "s")
    s.upsert(frame((1, "old", 1), (2, "old", 1)))

    class Killed(Exception):
        pass

    def die(*a, **k):
        raise Killed

    real = Files.write

    def half(self, text, *parts):
        real(self, text[: len(text) // 2], *parts)
        raise Killed

    with monkeypatch.context() as m:
        if at == "before the data":
            m.setattr(Store, "_segment", die)
        elif at == "within the data":
            (tmp_path / "s/data" / ("f" * 32) / "_bucket=0").mkdir(parents=True)
            (tmp_path / "s/data" / ("f" * 32) / "_bucket=0/part-0.parquet").write_bytes(b"PAR1 not a whole file")
            m.setattr(Store, "_segment", die)
        elif at == "before the version":
            m.setattr(Files, "take", die)
        else:
            m.setattr(Files, "write", half)
        with pytest.raises(Killed):
            s.upsert(frame((1, "new", 2), (3, "new", 2)))
    again = store(spark, tmp_path / "s")
    assert held(again) == [(1, "old"), (2, "old")]
    again.upsert(frame((1, "new", 2), (3, "new", 2)))
    again.vacuum()
    assert held(again) == [(1, "new"), (2, "old"), (3, "new")] and not os.path.exists(tmp_path / "s/data" / ("f" * 32))


def test_two_writers(spark, tmp_path, frame, monkeypatch):
    """Another writer commits between the data and the version of this one: both writes hold, and what was worked out from an older version is worked out anew."""
    a, b = store(spark, tmp_path / "s"), store(spark, tmp_path / "s")
    a.upsert(frame((1, "a", 1)))
    real, others = Store._segment, [lambda: b.upsert(frame((2, "b", 1))), lambda: b.upsert(frame((3, "b", 1), (4, "gone", 1))), lambda: b.upsert(frame((5, "gone", 1)))]

    def meanwhile(self, rows):
        out = real(self, rows)
        if self is a and others:
            others.pop(0)()
        return out

    monkeypatch.setattr(Store, "_segment", meanwhile)
    a.upsert(frame((1, "c", 2)))
    a.append(frame((3, "late", 1), (6, "late", 1)))
    a.delete(F.col("v") == "gone")
    assert not others and held(store(spark, tmp_path / "s")) == [(1, "c"), (2, "b"), (3, "b"), (6, "late")]


def test_a_taken_version_is_not_taken_again(spark, tmp_path):
    f = Files(spark, str(tmp_path / "f"))
    assert f.take("one", "log", "1") and not f.take("two", "log", "1") and f.read("log", "1", "manifest") == "one"


def test_replayed_batches_change_nothing(spark, tmp_path, frame):
    s = store(spark, tmp_path / "s")
    assert s.upsert(frame((1, "a", 1)), stream=("in", 0)) and s.upsert(frame((1, "b", 1)), stream=("in", 1))
    v = s.version()
    assert not s.upsert(frame((1, "a", 1)), stream=("in", 0)) and not s.upsert(frame((1, "x", 1)), stream=("in", 1)) and s.version() == v
    assert s.upsert(frame((2, "z", 1)), stream=("other", 0)) and held(s) == [(1, "b"), (2, "z")]


def test_a_small_batch_writes_little(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    rows = spark.range(200_000).select("id", F.md5(F.col("id").cast("string")).alias("v"), F.lit(1).cast("long").alias("seq"))
    s.write(rows)
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/s/data/*/*/*.parquet"))
    before = size()
    s.upsert(rows.where("id % 100 = 7").withColumn("v", F.lit("new")))
    s.delete_keys(rows.where("id % 1000 = 9"))
    assert size() - before <= 0.02 * before
    got = s.read().agg(F.count("*").alias("n"), F.sum((F.col("v") == "new").cast("int")).alias("new")).first()
    assert (got.n, got.new) == (199_800, 2000)
    # Bases are scanned, not shuffled: only the later segments are grouped, and the bases miss their keys by a join.
    plan = s.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.count("Aggregate") <= 4


def test_one_changed_row_remakes_one_bucket(spark, tmp_path, frame):
    a, b = store(spark, tmp_path / "a", buckets=8), store(spark, tmp_path / "b", buckets=8)
    rows = [(k, f"v{k}", k) for k in range(100)]
    a.write(frame(*rows))
    b.write(frame(*[(k, "other" if k == 42 else v, s) for k, v, s in rows]))
    assert tables.in_step(a.read(), b.read())  # by their numbers of rows
    before = b._state(b.version())["buckets"]
    stale = tables.backfill(a, b, lambda df: df)
    after = b._state(b.version())["buckets"]
    assert len(stale) == 1 and held(a) == held(b) and sum(before[k] != after[k] for k in before) == 1
    assert tables.backfill(a, b, lambda df: df) == []
    a.delete(F.col("id") >= 50)
    tables.backfill(a, b, lambda df: df)
    assert held(a) == held(b) and b.read().count() == 50


def test_rows_with_other_keys_and_types(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), "a string, b int, x array<string>, y double", ["b", "a"])
    df = lambda *rows: spark.createDataFrame(list(rows), "a string, b int, x array<string>, y double")
    s.upsert(df(("k", 1, ["p", None], 0.5), ("k", 2, None, None), ("", 1, [], 1.0)))
    s.upsert(df(("k", 1, ["q"], float("nan"))))
    s.delete_keys(df(("k", 2, None, None)).select("b", "a"))
    assert sorted((r.a, r.b, r.x) for r in s.read().collect()) == [("", 1, []), ("k", 1, ["q"])] and s.read().columns == ["a", "b", "x", "y"]
