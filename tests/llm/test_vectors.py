"""Vector near-dedup against all pairs by brute force."""

from __future__ import annotations

import numpy as np


def brute(vectors, cosine=0.9):
    """vectors: (id, array or None). Links, components."""
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(x is not None for x in v)]
    good = [(i, v) for i, v in good if len(v) and np.isfinite(v).all() and np.abs(v).max() > 0]
    good = [(i, (w := v / np.abs(v).max()) / np.linalg.norm(w)) for i, v in good]
    u = np.stack([v for _, v in good])
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    ids = np.array([i for i, _ in good])
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
        if (new == label).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids.tolist(), linked.sum(1), label, strict=True)}
        label = new


def test_planted_groups(spark):
    from skein.llm.product_quant import near_vectors

    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    centre = rng.normal(size=32)
    x[:400] = centre + rng.normal(size=(400, 32)) * 0.12  # a group larger than others, not all within the threshold
    for k in range(60):  # pairs near the threshold
        t = rng.normal(size=32)
        x[400 + 2 * k] = t
        o = rng.normal(size=32)
        o -= o @ t / (t @ t) * t
        c = rng.uniform(0.88, 0.99)
        x[401 + 2 * k] = (c * t / np.linalg.norm(t) + np.sqrt(1 - c * c) * o / np.linalg.norm(o)) * 7
    x[600:650] = x[599]  # copies
    x[650:700] = x[599] * 3.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: r for r in near_vectors(df, block=128).collect()}
    want = brute(rows)
    links, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert len(got) == 1500 and found <= links and found >= 0.999 * links
    wrong = [i for i in want if (got[i].component_id) != want[i][1]]
    assert len(wrong) <= 2 and all(r.kept == (i == r.component_id) for i, r in got.items())


def test_recall_on_the_table(spark):
    """Against brute force over all vectors of the largest test table, to which noisy copies are added: cosines from 0.8 to 1."""
    from skein.llm.product_quant import near_vectors

    rng, rows = np.random.default_rng(3), spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    more = []
    for r in rows[::2]:
        v = np.array(r.embedding, float)
        for k in range(3):
            noise = rng.normal(size=len(v)) * np.linalg.norm(v) / len(v) ** 0.5
            more.append((1_000_000 + 4 * r.vec_id + k, (v + rng.uniform(0.1, 0.6) * noise).tolist()))
    df = spark.createDataFrame([(r.vec_id, [float(x) for x in r.embedding]) for r in rows] + more, "vec_id long, embedding array<double>").repartition(8)
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    links, found = sum(n for n, _ in want.values()), sum(min(got[i].n_links, want[i][0]) for i in want)
    same = sum(got[i].component_id == want[i][1] for i in want)
    print("recall", found / links, "same component", same / len(want))
    assert found >= 0.995 * links and all(got[i].n_links <= want[i][0] for i in want) and same >= 0.999 * len(want)


def test_edges(spark):
    from skein.llm.product_quant import near_vectors

    schema = "vec_id long, embedding array<double>, label string"
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (9, [1e300, 1e299]), (10, [1e-300, 0.0]), (11, [1.0, 2.0, 3.0]), (12, [2.0, 4.0, 6.1]), (13, [3.0, 2.0, 1.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])]
    got = sorted((tuple(r) for r in near_vectors(spark.createDataFrame([(i, v, "x") for i, v in rows], schema)).collect()), key=str)
    linked = {1: 4, 2: 4, 9: 4, 10: 4}
    # Vectors of another length link with each other.
    want = sorted([(i, 1, 11, i == 11) if i in (11, 12) else (i, linked.get(i, 0), 1 if i in linked else i, i == 1 or i not in linked) for i, _ in rows], key=str)
    assert got == want
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
