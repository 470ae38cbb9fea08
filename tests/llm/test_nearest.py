"""Posting-list search against brute force."""

from __future__ import annotations

import numpy as np


def brute(rows, k=20, every=20):
    """rows: distinct (id, vector). {(id, number of the row): [(vec_id, score), ...]}"""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None for x in v)]
    good = [(i, v) for i, v in good if len(v) and np.isfinite(v).all() and v.any()]
    good = list({(i, v.tobytes()): (i, v) for i, v in good}.values())
    out = {}
    for n, (i, v) in enumerate(good):
        if i % every == 0:
            found = []
            for m, (j, u) in enumerate(good):
                if m != n and len(u) == len(v):
                    score = 0.0
                    for a, b in zip(v.tolist(), u.tolist(), strict=True):
                        score += a * b
                    found.append((-score, j))
            out[i, n] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def recall(got, rows):
    want = {(i, j) for (i, _), found in brute(rows).items() for j, _ in found}
    return len(want & {(r.query_id, r.vec_id) for r in got}) / len(want)


def test_recall_on_the_table(spark):
    from skein.llm.posting_lists import nearest

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    got = nearest(df).collect()
    assert len(got) == 100 * 20 and recall(got, [(r.vec_id, r.embedding) for r in df.collect()]) >= 0.93
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    for q, found in by.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and [f[1:] for f in found] == sorted(f[1:] for f in found) and q not in [f[2] for f in found]


def test_clusters_lengths_and_copies(spark, monkeypatch):
    """Many small lists, clusters, norms of all sizes, and one vector that a third of the rows share."""
    from skein.llm import posting_lists

    monkeypatch.setattr(posting_lists, "LIST_ROWS", 50)
    monkeypatch.setattr(posting_lists, "BLOCK", 64)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    x[::7] *= rng.uniform(0.1, 3.0, size=(len(x[::7]), 1))
    x[1000:2000] = 6 * x[1000]  # larger than the others, so its copies are its neighbours
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    got = posting_lists.nearest(df).collect()
    assert len(got) == 150 * 20
    want = brute(rows)
    scores = {}
    for r in got:
        scores.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for (i, _), found in want.items():
        mine = {j: s for _, j, s in scores[i]}
        assert i not in mine
        hit += sum(mine.get(j) == s for j, s in found)  # scores agree to the last bit
        total += len(found)
    assert hit >= 0.95 * total
    copies = sorted(scores[1500])
    assert [j for _, j, _ in copies] == list(range(1000, 1020)) and [j for _, j, _ in sorted(scores[1000])] == list(range(1001, 1021))


def test_edges(spark):
    from skein.llm.posting_lists import nearest

    schema = "vec_id long, embedding array<double>, uid string, score int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [1.0, 1.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (5, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, None]), (100, []), (120, [inf, 1.0]), (None, [1.0, 0.0]), (140, [1.0, 2.0, 3.0]), (-20, [-1.0, 0.0]), (160, [1.0])]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {}
    for (i, _), found in brute(rows).items():
        want.setdefault(i, []).extend((n + 1, j, s) for n, (j, s) in enumerate(found))
    # A vector whose length no other has finds nothing.
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v} and 140 not in got and set(got) == {0, 20, -20}
    assert nearest(spark.createDataFrame([], schema)).count() == 0
    assert sorted(c for c in nearest(spark.createDataFrame([], schema)).columns) == ["query_id", "rank", "score", "vec_id"]


def test_graph_finds_the_nearest():
    from skein.llm.posting_lists import Graph, balanced

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(balanced(x, 300))
    exact = (x[:500] @ g.points.T).argmax(1)
    r, c, far = g.within(x[:500], 1.0, 1)
    assert (r == np.arange(500)).all() and (c == exact).mean() >= 0.97
    r, c, far = g.within(x[:500], 1.2)
    d = np.sqrt(2 - 2 * (x[:500] @ g.points.T))
    assert len(r) >= 0.95 * (d <= 1.2 * d.min(1, keepdims=True)).sum() and (far <= 1.2 * far[np.searchsorted(r, r)] + 1e-6).all()
    n = np.bincount((x @ g.points.T).argmax(1), minlength=300)
    assert n.max() <= 6 * n.mean()
