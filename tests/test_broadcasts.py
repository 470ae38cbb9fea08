"""Tables whose size Spark guesses from compressed files are not broadcast."""

from __future__ import annotations

from skein.operators import routes as Ro
from skein.sources import files as S


def hints(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_catalog_goes_to_the_listing(spark, monkeypatch):
    files = spark.createDataFrame([(f"/d/{p}/src/f{n}.v",) for p in "ab" for n in range(5)] + [("/e/x.v",)], "path string")
    catalog = spark.createDataFrame([("a", ["/d/a/"], ["v"], ["f3"], []), ("b", ["/d/b"], ["c"], [], ["f1.v"])], "project string, roots array<string>, include_exts array<string>, exclude_patterns array<string>, specific_files array<string>")
    want = [("a", f"/d/a/src/f{n}.v") for n in (0, 1, 2, 4)] + [("b", "/d/b/src/f1.v")]
    for most, hint in ((10_000, "rightHint=(strategy=broadcast)"), (1, "rightHint=(strategy=merge)")):
        monkeypatch.setattr(S, "MOST_ROOTS", most)
        found = S.in_catalog(files, catalog)
        assert hint in hints(found)
        assert sorted(tuple(r) for r in found.collect()) == want


def test_chunks_and_hits_are_not_broadcast(spark):
    chunks = spark.createDataFrame([(f"K{n}", "p", "c", f"src/widget{n % 3}.c", "", "") for n in range(9)], "chunk_id string, project string, file_type string, file_path string, chunk_label string, content string")
    stems = spark.createDataFrame([(1, "Widget1")], "question_id int, stem string")
    hits = spark.createDataFrame([(1, f"K{n}", n / 10) for n in range(9)], "question_id int, chunk_id string, similarity double")
    found = Ro.in_file(chunks, stems, hits)
    assert hints(found).count("strategy=merge") >= 2
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == ["K7", "K4", "K1"]


def test_a_query_goes_to_a_part_once(spark, tmp_path, monkeypatch):
    """Lists are put together into parts; a query has one row a part that it reads, whatever the lists, and answers are exact."""
    import numpy as np

    from skein.operators import vector_index as Vi

    monkeypatch.setattr(Vi, "PART", 64)
    monkeypatch.setattr(Vi, "CELLS", 100)
    x = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(n, v.tolist(), n % 3) for n, v in enumerate(x)], "vec_id long, embedding array<double>, label long")
    index = Vi.VectorIndex(spark, str(tmp_path / "i"))
    index.build(df, keep=("label",), lists=20)
    q = df.selectExpr("vec_id as query_id", "embedding as query_vector", "label")
    found, pairs, lists = index._search(q, 5, None, None, None, "label")
    # First lists and others are asked apart.
    read = pairs.selectExpr("count(*) as n", "sum(size(lists)) as lists").first()
    assert lists == 20 and read.n <= 2 * 300 * 7 < read.lists
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.where(np.arange(300)[:, None] % 3 == np.arange(300)[None] % 3, u @ u.T, -9)
    got = {(r.query_id, r["rank"]): r.id for r in found.collect()}
    assert got == {(a, k + 1): b for a in range(300) for k, b in enumerate(np.argsort(-s[a], kind="stable")[:5].tolist())}
    assert "strategy=merge" in hints(found)
