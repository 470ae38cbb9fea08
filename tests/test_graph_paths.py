"""Paths and hierarchies against plain searches: cycles, ties, long chains, no path."""

from __future__ import annotations

import random
from collections import deque

from skein.operators import graph


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "DECOMPOSES_TO") for a, b in rows], "from_id string, to_id string, edge_type string")


def levels(rows, root):
    next_of, depth, todo = {}, {root: 0}, deque([root])
    for a, b in rows:
        next_of.setdefault(a, []).append(b)
    while todo:
        a = todo.popleft()
        for b in next_of.get(a, []):
            if b not in depth:
                depth[b] = depth[a] + 1
                todo.append(b)
    return depth


def least_path(rows, start, goal):
    """The least by ids of all shortest paths."""
    depth = levels([(b, a) for a, b in rows], goal)
    if start not in depth:
        return None
    path = [start]
    while path[-1] != goal:
        path.append(min(b for a, b in rows if a == path[-1] and depth.get(b, 1 << 30) == depth[path[-1]] - 1))
    return path


def test_random_graphs(spark):
    rng = random.Random(5)
    rows = sorted({(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(130)})
    nodes = sorted({x for r in rows for x in r})
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(80)] + [("n00", "n00"), ("absent", "n01"), ("n01", "absent"), ("gone", "gone")]
    got = {(r.start, r.goal): r.path for r in graph.shortest_paths(edges(spark, rows), spark.createDataFrame([*pairs, (None, "n01")], "start string, goal string")).collect()}
    want = {p: w for p in pairs if (w := least_path(rows, *p)) is not None}
    assert got == want
    roots = spark.createDataFrame([("n00",), ("n05",), ("absent",)], "node_id string")
    below = {(r.root, r.node_id): r.depth for r in graph.descend(edges(spark, rows), roots).collect()}
    assert below == {(r, n): d for r in ("n00", "n05", "absent") for n, d in levels(rows, r).items()}
    assert sorted(map(tuple, graph.reach(edges(spark, rows), roots, ("DECOMPOSES_TO",)).collect())) == sorted((*k, d) for k, d in below.items())


def test_no_pairs(spark):
    assert graph.shortest_paths(edges(spark, [("a", "b")]), spark.createDataFrame([], "start string, goal string")).count() == 0


def test_a_path_longer_than_any_depth_given_before(spark):
    rows = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(36)]
    got = graph.shortest_paths(edges(spark, rows), spark.createDataFrame([("c000", "c036"), ("c036", "c000")], "start string, goal string")).collect()
    assert [r.path for r in got] == [[f"c{k:03d}" for k in range(37)]]


def test_a_deep_hierarchy_takes_few_rounds(spark, monkeypatch):
    rows = [(f"c{k:04d}", f"c{k + 1:04d}") for k in range(1000)]
    written, real = [], graph.kept

    def counted(df):
        written.append(1)
        return real(df)

    monkeypatch.setattr(graph, "kept", counted)
    got = graph.descend(edges(spark, rows), spark.createDataFrame([("c0000",)], "node_id string")).collect()
    assert sorted((r.depth, r.node_id) for r in got) == [(k, f"c{k:04d}") for k in range(1001)] and len(written) <= 12


def test_shortest_paths_follow_the_side_with_fewer_edges(spark, monkeypatch):
    """A start that fans out is not followed where its goal has few edges into it, whether or not there is a path."""
    from skein.operators import graph as G

    e = [("s", f"a{n}") for n in range(50)] + [(f"a{n}", f"b{n}_{k}") for n in range(50) for k in range(50)] + [("a7", "x"), ("x", "y"), ("y", "g"), ("u", "v"), ("v", "w")]
    edges = spark.createDataFrame(e, "from_id string, to_id string")
    sizes, put = [], G._Frontier._put
    monkeypatch.setattr(G._Frontier, "_put", lambda self, rows: (put(self, rows), sizes.append(self.last().count()))[0])
    got = {(r.start, r.goal): r.path for r in G.shortest_paths(edges, spark.createDataFrame([("s", "g"), ("s", "w")], "start string, goal string")).collect()}
    assert got == {("s", "g"): ["s", "a7", "x", "y", "g"]}
    assert max(sizes) <= 50
