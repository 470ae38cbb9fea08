"""Routes and gates write what they find once; links are made of edges both ways without being deduplicated."""

from __future__ import annotations

import random

from skein.operators import gates as Gt
from skein.operators import routes as Ro


def test_links_and_pairs_once(spark):
    r = random.Random(3)
    ids = [f"n{i}" for i in range(30)]
    edges = [(r.choice(ids), r.choice(ids), r.choice(["IMPLEMENTS", "DEPENDS_ON", "SUPERSEDES"])) for _ in range(150)] + [("n1", "n1", "IMPLEMENTS"), ("n2", "n3", "IMPLEMENTS"), ("n3", "n2", "IMPLEMENTS"), ("n2", "n3", "IMPLEMENTS")]
    hits = [(q, r.choice(ids), 0.5, r.randint(1, 4)) for q in (1, 2) for _ in range(12)]
    n = spark.createDataFrame([(i, "PATTERN", i, "p", "HIGH") for i in ids], "node_id string, node_type string, name string, project string, confidence string")
    e = spark.createDataFrame(edges, "from_id string, to_id string, edge_type string")
    h = spark.createDataFrame(hits, "question_id int, node_id string, similarity double, rank int")
    none, asked = spark.createDataFrame([], "node_id string"), spark.createDataFrame([(1, "p"), (2, None)], "question_id int, project string")
    best: dict = {}
    for q, x, _, k in hits:
        best[q, x] = min(k, best.get((q, x), k))
    links = {(q, x, b if a == x else a, t, k) for (q, x), k in best.items() for a, b, t in edges if t != "SUPERSEDES" and x in (a, b)}
    followed = Ro.followed(Ro.found(h, n), e, ("IMPLEMENTS", "DEPENDS_ON"))
    assert sorted(map(tuple, followed.collect())) == sorted(links)
    assert "Aggregate" not in followed._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    first: dict = {}
    for q, x, y, t, k in links:
        at = (q, min(x, y), max(x, y), t)
        first[at] = min(first.get(at, (k, x, y)), (k, x, y))
    nodes, once = Ro.what(h, n, e, asked, none)
    assert sorted(map(tuple, once.select("question_id", "from_id", "to_id", "edge_type").collect())) == sorted((q, x, y, t) for (q, _, _, t), (_, x, y) in first.items())
    assert sorted((x.question_id, x.node_id) for x in nodes.collect()) == sorted(set(best) | {(q, y) for (q, _, _, _), (_, _, y) in first.items()})


def test_gate_writes_live_nodes_once(spark):
    n = spark.createDataFrame([("r", "REQUIREMENT", "HIGH"), ("s", "REQUIREMENT", "HIGH"), ("v", "EVIDENCE", "MEDIUM"), ("x", "EVIDENCE", "HIGH")], "node_id string, node_type string, confidence string")
    e = spark.createDataFrame([("r", "v", "MOTIVATED_BY", "HIGH"), ("s", "x", "VERIFIED_BY", None), ("r", "x", "MOTIVATED_BY", "PARSE_UNCERTAIN")], "from_id string, to_id string, edge_type string, confidence string")
    m = spark.createDataFrame([("a", "r"), ("a", "v"), ("b", "r"), ("b", "s"), ("c", "v")], "answer string, node_id string")
    got = Gt.gate(m, n, e)
    assert sorted((x.answer, x.gaps, x.evidence, x.confidence, x.passed) for x in got.collect()) == [("a", 1, 1, "MEDIUM", True), ("b", 2, 1, "HIGH", True), ("c", 0, 0, "MEDIUM", False)]
    assert "parquet" in got._jdf.queryExecution().optimizedPlan().toString()
