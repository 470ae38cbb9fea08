"""Prefix scans that split a key, against a plain loop; and what is built on them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skein.operators import linkage as K
from skein.operators import scan
from skein.operators.context import within_budget
from skein.operators.graph import last_before, patched_edges

SCHEMA = "k string, at int, id int, n long, v string, key string, _part int"


def brute(rows, key=0):
    out, state = {}, {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        k = r[key] if key is not None else None
        total, last = state.get(k, (0, None))
        last = r[4] if r[4] is not None else last
        out[r[2]] = (total, last)
        state[k] = (total + (r[3] or 0), last)
    return out


def data(hot=1500):
    rng = random.Random(5)
    pick = lambda i: "hot" if i < hot else rng.choice(["a", "b", "c", None, ""])
    return [(pick(i), rng.choice([None, *range(60)]), i, rng.choice([None, 0, 1, 7]), rng.choice([None, None, None, f"v{i}"]), "x", i) for i in range(2000)]


def test_against_loop(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for key in (["k"], []):
        want = brute(rows, 0 if key else None)
        got = scan.prefix_scan(df, key, ["at", "id"], {"before": F.col("n")}, {"last": F.col("v")}, parts=9)
        assert got.columns == [*df.columns, "before", "last"]
        assert {r.id: (r.before, r["last"]) for r in got.collect()} == want
    assert {r.id: r.place for r in scan.numbered(df, ["id"]).collect()} == {i: i + 1 for i in range(2000)}
    assert scan.prefix_scan(df.limit(0), ["k"], ["at", "id"], {"before": F.col("n")}).count() == 0
    twice = scan.prefix_scan(spark.createDataFrame(rows[:1] * 3, SCHEMA), ["k"], ["at", "id"], {"place": F.lit(1)})
    assert sorted(r.place for r in twice.collect()) == [0, 1, 2]


def test_a_hot_key_lies_in_many_parts(spark, monkeypatch):
    held = []
    real = scan.kept
    monkeypatch.setattr(scan, "kept", lambda df: held.append(real(df)) or held[-1])
    df = spark.createDataFrame([("one", i, i, 1, None, "", 0) for i in range(4000)], SCHEMA)
    assert scan.prefix_scan(df, ["k"], ["at", "id"], {"before": F.col("n")}, parts=10).agg(F.max("before")).first()[0] == 3999
    sizes = [r["count"] for r in held[0].groupBy("_scan_part").count().collect()]
    assert len(sizes) >= 9 and max(sizes) < 1000


def test_budget_and_as_of_of_one_group(spark):
    df = spark.createDataFrame([("g", i, 10) for i in range(300)], "g string, id int, size long").repartition(4)
    got = sorted((r.id, r.taken) for r in within_budget(df, "g", ["id"], "size", 1005, F.lit(2), least=3).collect())
    assert got == [(i, 10) for i in range(83)] + [(83, 7)]
    marks = spark.createDataFrame([("u", t, f"m{t}") for t in range(0, 1000, 100)], "u string, t int, m string")
    events = spark.createDataFrame([("u", t, t) for t in range(-5, 1000)], "u string, at int, id int").repartition(3)
    got = {r.id: r.last_m for r in last_before(events, marks, "u", "at", "t", "m").collect()}
    assert got == {t: f"m{t // 100 * 100}" if t >= 0 else None for t in range(-5, 1000)}


def test_categories_join_on_the_project(spark):
    r = spark.createDataFrame([("r1", "p", "timing and power"), ("r2", "q", "timing"), ("r3", None, "timing")], "node_id string, project string, text string")
    c = spark.createDataFrame([("c1", "p", "power and timing"), ("c2", None, "timing"), ("c3", "", "nothing"), ("c4", "q", "power")], "node_id string, project string, text string")
    found = K.by_category(r, c)
    assert {(x.req_id, x.target_id) for x in found.collect()} == {("r1", "c1"), ("r1", "c2"), ("r2", "c2"), ("r3", "c2")}
    assert found.count() == 4


def test_edge_patches(spark):
    schema = "from_id string, to_id string, edge_type string, note string"
    nodes = spark.createDataFrame([(x,) for x in "abcc"], "node_id string")
    old = spark.createDataFrame([("a", "b", "IMPLEMENTS", "old"), ("b", "c", "DEPENDS_ON", "old"), ("c", "x", "DEPENDS_ON", "old")], schema)
    patch = spark.createDataFrame([("a", "b", "IMPLEMENTS", 1), ("b", "c", "IMPLEMENTS", 3), ("b", "c", "DEPENDS_ON", 2), ("c", "x", "IMPLEMENTS", 4), ("a", "c", "IMPLEMENTS", 5), ("a", None, "IMPLEMENTS", 6)], "from_id string, to_id string, edge_type string, seq int")
    got = {tuple(r) for r in patched_edges(old, patch, nodes).collect()}
    assert got == {("a", "b", "IMPLEMENTS", "old"), ("b", "c", "IMPLEMENTS", None), ("c", "x", "DEPENDS_ON", "old"), ("a", "c", "IMPLEMENTS", None)}
    assert patched_edges(old.limit(0), patch, nodes).count() == 3 and patched_edges(old, patch.limit(0), nodes).count() == 3
