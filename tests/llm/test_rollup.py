"""Delta-maintained totals: signs, revisions, replays, crashes and compaction."""

from __future__ import annotations

import pytest

SCHEMA = "source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches(spark, tmp_path):
    from skein.llm.rollup import Rollup, deletes, inserts, revisions

    r = Rollup(spark, str(tmp_path / "r"))
    assert rows(r.totals()) == []
    first = spark.createDataFrame([("a", "en", "t1", 5, 0), ("a", "en", "t1", 5, 0), (None, None, "t1", 7, 0), ("b", "de", "t1", None, 0)], SCHEMA)
    assert r.commit("load", inserts(first)) and not r.commit("load", inserts(first))
    assert rows(r.totals()) == sorted([("a", "en", "t1", 2, 10), (None, None, "t1", 1, 7), ("b", "de", "t1", 1, 0)], key=str)
    assert r.commit("fix", revisions(spark.createDataFrame([("a", "en", "t1", 9, 5)], SCHEMA)))
    assert r.commit("gone", deletes(spark.createDataFrame([(None, None, "t1", 7, 0), ("b", "de", "t1", None, 0)], SCHEMA)))
    assert r.commit("none", inserts(spark.createDataFrame([], SCHEMA)))
    want = [("a", "en", "t1", 2, 14)]
    assert rows(r.totals()) == want
    r.compact()
    assert rows(r.totals()) == want and not r.commit("fix", inserts(first)) and rows(r.totals()) == want
    assert r.commit("later", inserts(first)) and ("a", "en", "t1", 4, 24) in rows(r.totals())
    r.compact()
    r.compact()
    assert len(rows(Rollup(spark, str(tmp_path / "r")).totals())) == 3
    with pytest.raises(ValueError):
        r.commit("a/b", inserts(first))


def test_a_crash_before_the_marker_leaves_nothing(spark, tmp_path):
    from skein.llm.rollup import Rollup, inserts

    r = Rollup(spark, str(tmp_path / "r"))
    df = inserts(spark.createDataFrame([("a", "en", "t1", 5, 0)], SCHEMA))
    df.write.parquet(str(tmp_path / "r/data/load-dead"))
    assert rows(r.totals()) == [] and r.commit("load", df) and rows(r.totals()) == [("a", "en", "t1", 1, 5)]


def test_a_crash_while_the_marker_is_written_leaves_nothing(spark, tmp_path, monkeypatch):
    from skein.llm.rollup import Rollup, inserts
    from skein.sources.log_store import Files

    r = Rollup(spark, str(tmp_path / "r"))
    df = inserts(spark.createDataFrame([("a", "en", "t1", 5, 0)], SCHEMA))
    real = Files.write

    def half(self, text, *parts):
        real(self, text[:5], *parts)
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(Files, "write", half)
        with pytest.raises(RuntimeError):
            r.commit("load", df)
        with pytest.raises(RuntimeError):
            r._mark("snapshots", "000000001", {"data": "x", "batches": []})
    assert rows(r.totals()) == [] and r.commit("load", df) and rows(r.totals()) == [("a", "en", "t1", 1, 5)]


def test_a_snapshot_that_comes_second_is_left_out(spark, tmp_path, monkeypatch):
    from skein.llm.rollup import Rollup, inserts

    r = Rollup(spark, str(tmp_path / "r"))
    df = inserts(spark.createDataFrame([("a", "en", "t1", 5, 0)], SCHEMA))
    r.commit("one", df)
    r.commit("two", df)
    other, real = Rollup(spark, str(tmp_path / "r")), Rollup._mark

    def late(self, kind, name, data):
        if self is r and kind == "snapshots":
            other.compact()
        return real(self, kind, name, data)

    monkeypatch.setattr(Rollup, "_mark", late)
    r.compact()
    assert rows(r.totals()) == [("a", "en", "t1", 2, 10)] and len(r._marks("snapshots")) == 1


def test_null_and_long_texts_empty_tables_and_other_columns(spark):
    from skein.llm.rollup import count_words, inserts

    schema = "doc_id long, text string, lang string, source string, n_docs string, n_tokens string, tokenizer int"
    docs = spark.createDataFrame([(1, None, "en", "s", "x", "y", 1), (2, "", "en", "s", "x", "y", 1), (3, "w " * 300_000, None, None, "x", "y", 1)], schema)
    got = sorted(((r.doc_id, r.n_tokens, r.tokenizer) for r in count_words(docs).collect()))
    assert got == [(1, 0, "words-1"), (2, 0, "words-1"), (3, 300_000, "words-1")]
    assert inserts(count_words(docs.limit(0))).count() == 0
