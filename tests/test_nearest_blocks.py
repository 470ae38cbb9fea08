"""Nearest vectors in blocks: of the own group only, from a least similarity on; a row is sent to no more blocks when the tables grow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skein.operators import retrieval as R


def test_same_group_and_least(spark, monkeypatch):
    monkeypatch.setattr(R, "COLUMNS", 32)
    monkeypatch.setattr(R, "CELLS", 256)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x[50:120] = x[50]  # copies: ties go to the smaller id
    x[7] = 0
    rows = [(i, None if i == 9 else v[:5].tolist() if i == 11 else v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    q = d.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    y = x.astype(float)
    with np.errstate(invalid="ignore"):
        u = y / np.linalg.norm(y, axis=1, keepdims=True)

    def sim(a, b):
        if a == b == 11:
            return 1.0
        return -np.inf if {a, b} & {7, 9, 11} else float((u[a] * u[b]).sum())

    for least in (None, 0.4):
        got: dict = {}
        for r in R.nearest(d, q, 5, "label", same=True, at_least=least).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.similarity)
        for a, _, g in rows:
            best = [] if g is None else sorted(((-sim(a, b), b) for b, _, h in rows if h == g))
            best = [(b, -s) for s, b in best if least is None or -s >= least][:5]
            mine = [got.get(a, {})[k + 1] for k in range(len(got.get(a, {})))]
            assert [b for b, _ in best] == [b for b, _ in mine]
            assert all((s is None) == np.isneginf(t) and (s is None or abs(s - t) < 1e-9) for (_, t), (_, s) in zip(best, mine, strict=True))


def test_rows_are_sent_as_often_for_larger_tables(spark):
    """As many vectors again are not sent to more blocks, as they were when blocks had fixed numbers of rows."""

    def sent(n: int) -> int:
        d = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
        part = R.nearest(d, d.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 2)
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        blocks = [line for line in plan.splitlines() if "explode" in line]
        return sum(int(line.split("sequence(0, ")[1].split(",")[0].split(")")[0]) + 1 if "sequence" in line else len(line.split("explode([")[1].split("]")[0].split(",")) for line in blocks)

    assert sent(100_000) == sent(200_000)


def test_index_has_as_many_parts_for_larger_tables(spark, tmp_path, monkeypatch):
    """Queries of a neighbour join go to a fixed number of parts, until parts are full."""
    from skein.operators import vector_index as I

    monkeypatch.setattr(I, "PART", 100)
    rng = np.random.default_rng(5)
    for n in (2000, 4000):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 4)))], "vec_id long, embedding array<double>")
        index = I.VectorIndex(spark, str(tmp_path / str(n)))
        index.build(rows, lists=40)
        q = rows.limit(50).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
        pairs = index._search(q, 3, None, None, None, None)[1]
        assert pairs.select("part").distinct().count() <= 2 * I.PARTS
