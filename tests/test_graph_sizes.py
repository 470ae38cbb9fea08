"""What graph steps hold: hubs are counted, not listed; a pair is not joined with all that its start reaches."""

from __future__ import annotations

import random

import pytest

from skein.operators import graph


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_counts_of_reach(spark, depth):
    """As many as reach() lists, with cycles, loops, several parents, ends that are null and roots without edges."""
    rng = random.Random(depth)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)] + [("n1", f"x{k}") for k in range(30)] + [("n2", f"x{k}") for k in range(20, 40)]
    rows += [("n3", None), ("n4", None), ("n5", "n3"), ("n5", "n4"), ("n6", "n6"), (None, "n7")]
    e = spark.createDataFrame(rows, "from_id string, to_id string")
    r = spark.createDataFrame([(f"n{k}",) for k in range(30)] + [("gone",), ("n1",)], "node_id string")
    want: dict = {}
    for x in graph.reach(e, r, None, depth).collect():
        want[x.root, x.depth] = want.get((x.root, x.depth), 0) + 1
    assert {(x.root, x.depth): x.n for x in graph.reach_counts(e, r, depth).collect()} == want


def test_what_a_hub_leads_to_is_counted(spark, monkeypatch):
    rows = [(f"s{k}", "hub") for k in range(50)] + [("hub", f"c{k}") for k in range(200)] + [("s1", "c1"), ("c7", "c8"), ("s2", "c7"), ("s3", "x"), ("x", "c9"), ("x", "y")]
    sizes, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: (d := real(df), sizes.append(d.count()))[0])
    e = spark.createDataFrame(rows, "from_id string, to_id string")
    got = {(x.root, x.depth): x.n for x in graph.reach_counts(e, spark.createDataFrame([(f"s{k}",) for k in range(50)], "node_id string"), 2).collect()}
    assert got[("s0", 2)] == 200 and got[("s1", 2)] == 199 and got[("s2", 2)] == 199 and got[("s3", 2)] == 201
    assert max(sizes) <= len(rows)


def test_pairs_go_by_their_smaller_end(spark, monkeypatch):
    """Goals that their start reaches with many others: a pair meets the one row of its goal, not all rows of its start."""
    rows = [("r", f"n{k}") for k in range(4)] + [(f"n{k % 4}", f"c{k}") for k in range(100)]
    plans, real = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: (plans.append(df._jdf.queryExecution().analyzed().toString()) if df.columns == ["start", "goal", "path"] else None, real(df))[1])
    e = spark.createDataFrame(rows, "from_id string, to_id string")
    got = graph.shortest_paths(e, spark.createDataFrame([("r", f"c{k}") for k in range(100)], "start string, goal string")).collect()
    assert {r.goal: r.path for r in got} == {f"c{k}": ["r", f"n{k % 4}", f"c{k}"] for k in range(100)}
    inner = [x for x in plans[-1].splitlines() if "Join Inner" in x][-1]
    assert "goal" in inner and "start" not in inner
