"""Each stage of the pipeline against its own input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm.test_basic import brute_targets, check_pieces, words
from tests.llm.test_near import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        result = stage(spark, docs, sf)
        if name != "packing":
            assert result.columns == docs.columns
        result.write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return {name: (a.collect(), b.collect()) for name, a, b in out}


def test_quality(spark, stages):
    docs, kept = stages["quality"]
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    ids = {r.doc_id for r in kept}
    good = [r.doc_id for r in docs if label.get(r.doc_id) == 1]
    bad = [r.doc_id for r in docs if label.get(r.doc_id) == 0]
    assert len(ids & set(good)) >= 0.97 * len(good) and len(ids & set(bad)) <= 0.3 * len(bad)
    assert set(kept) <= set(docs)


def test_exact(stages):
    docs, kept = stages["exact"]
    best = {}
    for r in docs:
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept) == sorted(best.values()) and set(kept) <= set(docs)


def test_near(stages):
    docs, kept = stages["near"]
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in docs], 5).items() if i == c}
    assert sorted(r.doc_id for r in kept) == sorted(want) and set(kept) <= set(docs)


def test_mixing(stages):
    """Whole documents only, each source within half of its longest document of its target."""
    docs, mixed = stages["mixing"]
    sizes, longest, got, whole = {}, {}, {}, {r.doc_id: r for r in docs}
    for r in docs:
        n = len(words(r.text))
        sizes[r.source], longest[r.source] = sizes.get(r.source, 0) + n, max(longest.get(r.source, 0), n)
    for r in mixed:
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert r == whole[r.doc_id]
    target = brute_targets(sizes)
    assert {s: (got.get(s, 0), target[s]) for s in sizes if abs(got.get(s, 0) - target[s]) > longest[s] / 2 + 0.5} == {}


def test_packing(stages):
    docs, pieces = stages["packing"]
    once = {r.doc_id for r in docs}
    assert once == {r.doc_id for r in pieces}
    total = sum(r.length for r in pieces)
    lengths = {}
    for r in pieces:
        lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values()) and total == sum(lengths.values())


def test_without_copies_edges(spark):
    from skein.llm.chosen_path import without_near_copies
    from skein.llm.exact_dedup import without_copies

    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "n"), (None, "n"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(map(tuple, without_copies(docs, "largest").collect()), key=str)
    assert got == [(2, "a"), (4, ""), (None, "n")]
    assert sorted(map(tuple, without_copies(docs, "smallest").collect()), key=str) == [(1, "a"), (3, None), (None, "n")]
    assert without_near_copies(docs).where("doc_id is null").count() == 3


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, size long, text_sha256 string, target double, h string, taken long, repeats long, extra long, source_size long, `a b` string"


def clashing(rows):
    return [(i, t, "en", s, len(t or ""), 0.5, 1, 7, "x", 1.0, "y", 3, 4, 5, 6, "z") for i, t, s in rows]


def test_stages_with_clashing_columns_and_edges(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, and columns that are called like those of the operators."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(good)]
    rows += [(20, good[0], "s1"), (20, good[0], "s1"), (21, "", "s1"), (22, None, None), (23, "word " * 200_000, "s2"), (None, good[1], "s0"), (None, "alone here", None), (24, good[2] + " one more word", "s2")]
    docs = spark.createDataFrame(clashing(rows), CLASH).repartition(4)
    labelled = docs.unionByName(spark.createDataFrame([(r.doc_id, r.text, "en", "s", 1, 0.0, 0, 0, "", 0.0, "", 0, 0, 0, 0, "") for r in spark.read.parquet(f"{sf}/documents.parquet").select((1000 + F.col("doc_id")).alias("doc_id"), "text").where("doc_id < 1001").collect()], CLASH))
    assert labelled.count() > docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect()), name
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0, name
    got = corpus_pipeline.exact(spark, docs, sf).collect()
    assert len(got) == len({r.text or "" for r in got}) and {r.doc_id for r in got} >= {20, 22, 23, 24, None}


def test_classifiers_edges(spark):
    """Scores of nulls, empty and very long texts, repeated rows and ids without a label; without labels every text has one score; an empty table has no rows."""
    from skein.llm import quality, toxicity

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "word " * 100_000), (None, "x"), (10**6 + 4, "same"), (10**6 + 4, "same")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd).withColumn("score", F.lit("s")).withColumn("predicted", F.lit(None).cast("int"))
    for op, least in ((quality, 0.5), (toxicity, 0.7)):
        got = op.classify(both, labels).collect()
        assert len(got) == docs.count() + odd.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= least) for r in got)
        same = [r.score for r in got if r.doc_id == 10**6 + 4]
        assert len(same) == 2 and same[0] == same[1]
        assert op.classify(both.limit(0), labels).count() == 0
        flat = op.classify(odd, labels.limit(0)).collect()
        assert len({r.score for r in flat}) == 1 and len(flat) == odd.count()


def test_classifiers_on_held_out_rows(spark):
    """Ranking of held-out labelled rows of the largest test table."""
    from skein.llm import quality, toxicity

    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    for op, label, least in ((quality, "quality", 0.99), (toxicity, "toxic", 0.9)):
        y = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None}
        rows = [(r.score, y[r.doc_id]) for r in op.classify(docs, labels).where("held_out").collect() if r.doc_id in y]
        ones, zeros = [s for s, v in rows if v == 1], [s for s, v in rows if v == 0]
        better = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))
        print(label, len(ones), len(zeros), "AUC", better)
        assert better >= least
