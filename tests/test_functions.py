"""Chunkers, extraction, routing, gates and stores on small fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.functions import chunking as C
from skein.functions import extract as X
from skein.functions import text as T
from skein.operators import context, evaluation, gates, graph, linkage, retrieval, routing
from skein.sources import files, tables


def test_boundary_chunks():
    text = "A sentence here. " * 200
    chunks = C.boundary_chunks(text)
    assert len(chunks) > 3 and all(len(c) <= 1000 for c in chunks) and all(c.endswith(".") for c in chunks[:-1])
    assert C.boundary_chunks("short") == ["short"] and C.boundary_chunks("") == [""] and C.boundary_chunks(None) == []
    para = "x" * 700 + "\n\n" + "y" * 700
    assert C.boundary_chunks(para)[0] == "x" * 700
    assert all(len(c) > 50 for c in C.boundary_chunks("word " * 500, 500, 50, (". ",), 3, 50, True))
    for size in (1, 7, 1000, 1001, 2500):
        assert "".join(C.boundary_chunks("z" * size, 1000, 0)) == "z" * size


def test_greedy_paragraphs():
    text = "\n\n".join(["A" * 25, "B" * 25, "C" * 25])
    got = C.greedy_paragraphs(text, 30, 10)
    assert len(got) >= 2 and got[0] == "A" * 25 and got[1].endswith("B" * 25)
    assert C.greedy_paragraphs("", 30, 10) == [] and C.greedy_paragraphs("D" * 100, 30, 10) == ["D" * 100]


def test_sections(spark):
    rows = [(1, "intro\n# One\nbody\n## Two ##\nmore\n#no heading\n"), (2, "# " + "x" * 5000), (3, ""), (4, None), (5, "   \n\t# not at a line's start"), (6, "###### six\n# \n")]
    got = {r.i: [(x.heading, x.content) for x in r.s or []] for r in spark.createDataFrame(rows, "i int, t string").select("i", C.sections(F.col("t")).alias("s")).collect()}
    assert got[1] == [("", "intro\n"), ("One", "# One\nbody\n"), ("Two ##", "## Two ##\nmore\n#no heading\n")]
    assert [len(c) for _, c in got[2]] == [3000, 2302] and {h for h, _ in got[2]} == {"x" * 5000}
    assert got[3] == got[4] == [] and got[5] == [("", "   \n\t# not at a line's start")] and got[6] == [("six", "###### six\n"), ("", "# \n")]


def test_extraction(spark):
    tcl = "set ip_0 [ create_bd_cell -type ip -vlnv x:ip:dma:7.1 ip_0 ]\nset_property -dict [ list CONFIG.W {32} CONFIG.CLKOUT1_JITTER {9} ] $ip_0\ncreate_bd_cell -type ip -vlnv y:ip:own:1 other\nset_property -dict [list CONFIG.K { a b } CONFIG.W {1}] [get_bd_cells other]\nset_property -dict [list CONFIG.W {64}] [get_bd_cells ip_0]\ncreate_bd_cell -type ip -vlnv z:ip:bare:1 bare"
    got = X.tcl_parameters(spark.createDataFrame([("a.tcl", tcl), ("b.tcl", "nothing")], "path string, content string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a.tcl", "ip_0", "x:ip:dma:7.1", "W", "64"), ("a.tcl", "other", "y:ip:own:1", "K", "a b"), ("a.tcl", "other", "y:ip:own:1", "W", "1")]
    df = spark.createDataFrame([("#define A 0x10\n#define B (x)\nparameter P = 4; // parameter Q = 5\ntypedef struct S_s { int a; } S;\ntypedef enum { ON, OFF = 2 } E;\nName\tValue\nkey  two words",)], "t string")
    t = F.col("t")
    r = df.select(X.formatted(X.c_defines(t)).alias("c"), X.formatted(X.verilog_parameters(t)).alias("v"), X.typedefs(t, "struct").alias("s"), X.typedefs(t, "enum").alias("e"), X.table_rows(t).alias("rows")).first()
    assert (r.c, r.v, [tuple(x) for x in r.s], [tuple(x) for x in r.e]) == ("A = 0x10", "P = 4", [("S", "int a")], [("E", "ON; OFF = 2")]) and r.rows == [["Name", "Value"], ["key", "two words"]]
    c = spark.createDataFrame([("p", "v", "src/uart_core.v", "uart_tx_0", ""), ("p", "v", "x/a.v", "header", ""), ("q", "c", "x/spi_master.c", "has blank", ""), ("q", "md", "x/y.md", "long_label", ""), ("q", "tcl", "x/z.tcl", "top", "create_bd_cell -type ip -vlnv x:ip:axi_iic:1 a"), ("", "v", "x/never.v", "never_so", "")], "project string, file_type string, path string, label string, content string")
    assert {(s.keyword, s.project) for s in X.signals(c).collect()} == {("uart_tx_0", "p"), ("uart_tx", "p"), ("uart_core", "p"), ("spi_master", "q"), ("axi_iic", "q")}
    v = spark.createDataFrame([("ip", "k", "late", 2), ("ip", "k", "early", 1)], "ip string, key string, value string, seq int")
    assert X.first_wins(v, ["ip"], "seq").first().value == "early"


def test_tokens_and_text(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(T.tokens, "SPI_MOSI clk clk _x_") == ["spi_mosi", "spi", "mosi", "clk", "_x_", "x"]
    assert one(T.json_in_text, 'so: ```json\n{"a": 1}\n``` end') == '{"a": 1}' and one(T.json_in_text, "no {json") is None and one(T.json_in_text, 'x {"b": 2} y') == '{"b": 2}'
    assert one(T.strip_comments, '{"a": "http://x", // c\n /* d\n */ "b": 1}').replace(" ", "").replace("\n", "") == '{"a":"http://x","b":1}'
    assert one(T.is_turkish, "FPGA nedir acaba") and one(T.is_turkish, "Işık") and not one(T.is_turkish, "what is it")
    assert one(lambda c: C.char_windows(c, 10, 3), "abcdefghijklm") == ["abcdefghij", "hijklm"] and one(C.char_windows, "") == []


@pytest.fixture(scope="module")
def tiny(spark):
    n = [("TEST-PROJ-A", "PROJECT", "HIGH", None), ("TEST-REQ-001", "REQUIREMENT", "HIGH", "TEST-PROJ-A"), ("TEST-REQ-002", "REQUIREMENT", "MEDIUM", "TEST-PROJ-A"), ("TEST-COMP-001", "COMPONENT", "HIGH", "TEST-PROJ-A"), ("TEST-EVID-001", "EVIDENCE", "HIGH", "TEST-PROJ-A"), ("TEST-DEC-001", "DECISION", "HIGH", "TEST-PROJ-A"), ("TEST-PAT-001", "PATTERN", "HIGH", None), ("TEST-CONST-001", "CONSTRAINT", "HIGH", None), ("TEST-ISSUE-001", "ISSUE", "HIGH", None)]
    e = [("TEST-REQ-001", "TEST-REQ-002", "DECOMPOSES_TO"), ("TEST-COMP-001", "TEST-REQ-001", "IMPLEMENTS"), ("TEST-REQ-001", "TEST-EVID-001", "VERIFIED_BY"), ("TEST-DEC-001", "TEST-REQ-001", "MOTIVATED_BY"), ("TEST-COMP-001", "TEST-CONST-001", "CONSTRAINED_BY")]
    return spark.createDataFrame(n, "node_id string, node_type string, confidence string, project string"), spark.createDataFrame([(*x, "HIGH") for x in e], "from_id string, to_id string, edge_type string, confidence string")


def test_graph(spark, tiny):
    n, e = tiny
    ids = lambda df, c="node_id": sorted(r[c] for r in df.collect())
    seed = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id string")
    assert {(r.kind, r.type): r.n for r in graph.counts(n, e).collect()}[("node", "REQUIREMENT")] == 2
    assert ids(graph.reach(e, seed("TEST-REQ-001"), ("DECOMPOSES_TO",))) == ["TEST-REQ-001", "TEST-REQ-002"]
    pairs = spark.createDataFrame([("TEST-COMP-001", "TEST-REQ-002"), ("TEST-COMP-001", "TEST-PROJ-A")], "start string, goal string")
    paths = graph.shortest_paths(e, pairs)
    assert [r.path for r in paths.collect()] == [["TEST-COMP-001", "TEST-REQ-001", "TEST-REQ-002"]]
    assert graph.path_confidence(paths, n).first().confidence == "MEDIUM"
    assert ids(graph.unlinked(n, e, "REQUIREMENT", "IMPLEMENTS", "to_id")) == ["TEST-REQ-002"] and ids(graph.unlinked(n, e, "COMPONENT", "IMPLEMENTS", "from_id")) == []
    assert ids(gates.evidenced(n.where("node_type = 'REQUIREMENT'"), e, n)) == ["TEST-REQ-001"]
    assert gates.overall_confidence(n.limit(0), e.limit(0)).first().confidence == "PARSE_UNCERTAIN"
    member = lambda df: df.select(F.lit("a").alias("answer"), "node_id")
    ok = gates.gate(member(n), n, e).first()
    assert ok.passed and ok.gaps == 1 and ok.superseded == 0 and ok.contradictions == 0 and ok.evidence == 1 and ok.confidence == "MEDIUM"
    assert not gates.gate(member(n.where("node_type = 'DECISION'")), n, e.limit(0)).first().passed
    good, bad = graph.checked_edges(spark.createDataFrame([("a", "b", "IMPLEMENTS"), ("a", "b", "NOPE")], "from_id string, to_id string, edge_type string"))
    assert (good.count(), bad.count()) == (1, 1)
    comp = spark.createDataFrame([("TEST-COMP-001", "TEST-CONST-001", "CONTRADICTS", "HIGH"), ("TEST-DEC-001", "TEST-REQ-001", "CONTRADICTS", "HIGH")], e.schema)
    assert [r.from_id for r in gates.contradictions(n, comp, n).collect()] == ["TEST-DEC-001"]


def test_reach_against_plain_search(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)}
    e = spark.createDataFrame([(str(a), str(b), "DEPENDS_ON") for a, b in pairs], "from_id string, to_id string, edge_type string")
    want = {}
    for root in ("0", "1", "2"):
        depth, front = {root: 0}, [root]
        while front:
            front = sorted({str(b) for a, b in pairs if str(a) in front} - set(depth))
            depth |= {x: max(depth.values()) + 1 for x in front}
        want |= {(root, k): v for k, v in depth.items()}
    got = graph.reach(e, spark.createDataFrame([("0",), ("1",), ("2",)], "node_id string"))
    assert {(r.root, r.node_id): r.depth for r in got.collect()} == want


def test_routing(spark):
    cases = {
        "FPGA nedir?": "What", "axis2fifo nasıl çalışır?": "How", "neden interrupt yerine polling seçildi?": "Why", "hangi bileşen bu gereksinimi karşılıyor?": "Trace", "A ile B'yi karşılaştır": "CrossRef",
        "list all IP blocks": "Enumerate", "which steps should I take": "How", "trace REQ-1": "Trace", "what is the offset": "What", "X versus Y": "CrossRef",
    }
    df = spark.createDataFrame([(k,) for k in cases], "q string")
    assert {r.q: r.t for r in df.select("q", routing.question_type(F.col("q")).alias("t")).collect()} == cases
    q = spark.createDataFrame([(1, "tell me about my audio-core design"), (2, "nothing here")], "question_id int, question string")
    p = spark.createDataFrame([("audio_core",), ("audio",), ("my",)], "project string")
    assert [(r.question_id, r.project) for r in routing.exact_projects(q, p).collect()] == [(1, "audio_core")]
    assert routing.retrieval_sizes(2) == (6, 6) and routing.retrieval_sizes(90) == (20, 24)
    a = spark.createDataFrame([(1, "x", 1)], "q int, id string, rank int")
    b = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "q int, id string, rank int")
    assert sorted((r.q, r.id) for r in routing.with_top_up(a, b, 6, "q", "id").collect()) == [(1, "x"), (1, "y"), (2, "z")]


def test_vectors_and_evaluation(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.5, 0.5, 0.0]), (3, [-1.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0])], "vec_id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    assert [r.vec_id for r in retrieval.topk(d, q, 2).orderBy("rank").collect()] == [0, 2]
    assert retrieval.topk(d, q, 5).orderBy("rank").collect()[-1].vec_id == 4
    assert [r.vec_id for r in retrieval.nearest(d, q, 2, measure="euclidean").orderBy("rank").collect()] == [0, 2]
    from skein.functions import vectors as V

    unit = d.unionByName(spark.createDataFrame([(9, [3.0, 4.0])], d.schema)).select("vec_id", V.normalized(F.col("embedding")).alias("u")).collect()
    assert {r.vec_id: r.u for r in unit}[9] == [0.6, 0.8] and {r.vec_id: r.u for r in unit}[4] == [0.0, 0.0, 0.0]
    s = spark.createDataFrame([("the value is unknown; it is not 42 MHz",), ("unknown, " + "x" * 300 + " 42 MHz",), ("it is 42 MHz",), ("well",), ("142 mhz",)], "a string")
    lit = lambda *x: F.array(*map(F.lit, x))
    assert [r.x for r in s.select(evaluation.trap_score(F.col("a"), lit("42 mhz"), lit("not"), lit("unknown")).alias("x")).collect()] == [1.0, 0.5, 0.0, 0.3, 0.3]
    rng = random.Random(2)
    rows = [(g, None if rng.random() < 0.1 else round(rng.gauss(0, 9), 1)) for g in ("a", "b", None) for _ in range(rng.randrange(1, 400))] + [("one", 5.0)]
    got = {r.g: r for r in evaluation.summary(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in ("a", "b", None, "one"):
        v = sorted(x for k, x in rows if k == g and x is not None)
        if g is not None:
            assert got[g].p95 == v[int(len(v) * 0.95)] and abs(got[g].median - (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2) < 1e-9
    text = context.pack([{"chunk_id": "c", "content": "x" * 50_000, "similarity": 1.0}], [{"node_id": "n", "node_type": "PROJECT", "name": "P"}], [{"doc_id": "d", "content": "y" * 9000}], [{"from_id": "a", "edge_type": "E", "to_id": "b"}], max_chars=10_000)
    assert len(text) <= 10_000 + len(context.CUT) and "[PROJECT] n" in text and text.index("(c)") < text.index("[d]") < text.index("[PROJECT] n") < text.index("a --[E]--> b")
    r = context.response("q", "What", ["a", "b", "a"], {"confidence": "HIGH", "warnings": ["w"], "filtered": ["b"]}, "yes")
    assert r["sources"] == ["a"] and r["stale_filtered"] == 1 and "yes" in r["answer"]
    assert context.system_prompt(["p1"]).endswith("counts.") and "p1" in context.system_prompt(["p1"], context="c", question="q")


def test_linkage(spark):
    r = spark.createDataFrame([("R1", "p", "The axis2fifo must meet 100 MHz timing"), ("R2", "q", "axis2fifo elsewhere")], "node_id string, project string, text string")
    c = spark.createDataFrame([("C1", "p", "axis2fifo_0 — stream"), ("C2", "q", "uart")], "node_id string, project string, name string")
    assert [(m.req_id, m.target_id) for m in linkage.by_name(r, c).collect()] == [("R1", "C1")]
    inside = spark.createDataFrame([("R3", "q", "the uartlite core")], r.schema)
    assert [(m.req_id, m.target_id) for m in linkage.by_name(inside, c).collect()] == [("R3", "C2")]
    hits = lambda *x: spark.createDataFrame(list(x), "query_id string, node_id string, similarity double, rank int")
    d = spark.createDataFrame([("D1", "p", "SG mode selected"), ("D2", "q", "simple DMA"), ("D3", "p", "rejected"), ("D4", "q", "rejected")], "node_id string, project string, text string")
    near = hits(("D1", "D2", 0.7, 2), ("D2", "D1", 0.7, 2), ("D1", "D3", 0.76, 3), ("D1", "D4", 0.8, 4), ("D4", "D1", 0.9, 2), ("D1", "D1", 1.0, 1))
    assert sorted(tuple(x) for x in linkage.contradictions(near, d).collect()) == [("D1", "D2", "C"), ("D1", "D3", "B"), ("D1", "D4", "A")]
    assert [(x.a, x.b) for x in linkage.similar_issues(hits(("D1", "D2", 0.9, 2), ("D2", "D1", 0.9, 1), ("D1", "D3", 0.99, 3), ("D1", "D4", 0.9, 9)), d).collect()] == [("D1", "D2")]
    ev = spark.createDataFrame([("E1", "p", "timing report: wns 0.2"), ("E2", "q", "lut")], r.schema)
    none = spark.createDataFrame([], "from_id string, to_id string, edge_type string, confidence string, source string")
    best, gaps, orphans = linkage.run_matching(r, c, ev, r.limit(0), hits(("R2", "C2", 0.8, 1), ("R2", "C1", 0.5, 2)), none)
    assert sorted((m.req_id, m.target_id, m.strategy) for m in best.collect()) == [("R1", "C1", "name_match"), ("R1", "E1", "evidence_bind"), ("R2", "C2", "semantic")] and gaps.count() == orphans.count() == 0
    assert sorted((x.from_id, x.to_id) for x in linkage.apply_matches(none, best).collect()) == [("R1", "C1"), ("R1", "E1"), ("R2", "C2")]
    comps = spark.createDataFrame([("X1", "p", "dma_0", "reads stream data fast"), ("X2", "q", "dma_1", "other")], "node_id string, project string, name string, text string")
    pat = spark.createDataFrame([("T1", "p", "fast stream data reader")], r.schema)
    links = linkage.cross_references(comps, pat, d, hits(("D1", "D2", 0.1, 1)), d, near, none).collect()
    assert sorted((x.from_id, x.to_id, x.edge_type) for x in links) == [("D1", "D2", "CONTRADICTS"), ("D1", "D3", "CONTRADICTS"), ("D1", "D4", "CONTRADICTS"), ("X1", "T1", "REUSES_PATTERN")]
    k = spark.createDataFrame([("K1", None, "clock period"), ("K2", "q", "setup time"), ("K3", "p", "voltage")], "node_id string, project string, text string")
    assert sorted((m.req_id, m.target_id) for m in linkage.by_category(r, k).collect()) == [("R1", "K1")]


def test_stores_and_stream(spark, tmp_path):
    from skein.streaming.ingest import ingest

    s = tables.Store(spark, str(tmp_path / "store"), "id long, v string, seq long", ["id"])
    df = lambda *rows: spark.createDataFrame(list(rows), "id long, v string, seq long")
    s.upsert(df((1, "a", 1), (2, "b", 1)))
    s.upsert(df((1, "c", 2), (1, "d", 3), (3, "e", 1)), "seq")
    s.append(df((1, "no", 9), (4, "f", 1)))
    s.delete(F.col("id") == 2)
    assert sorted((r.id, r.v) for r in s.read().collect()) == [(1, "d"), (3, "e"), (4, "f")]
    src = str(tmp_path / "in")
    df((1, "x", 5), (9, "y", 1)).write.parquet(src)
    t = tables.Store(spark, str(tmp_path / "t"), "id long, v string, seq long", ["id"])
    assert ingest(spark, src, "id long, v string, seq long", t, str(tmp_path / "cp"), "seq") >= 1
    assert ingest(spark, src, "id long, v string, seq long", t, str(tmp_path / "cp"), "seq") == 0
    df((1, "z", 6)).write.mode("append").parquet(src)
    ingest(spark, src, "id long, v string, seq long", t, str(tmp_path / "cp"), "seq")
    assert sorted((r.id, r.v) for r in t.read().collect()) == [(1, "z"), (9, "y")]
    s.clear()
    assert s.read().count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "src/build").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.v").write_text("module b; endmodule\n")
    (tmp_path / "src/blank.py").write_text("  \n")
    (tmp_path / "src/build/c.py").write_text("y = 2\n")
    code = files.code_files(spark, str(tmp_path / "src"))
    assert {r.language: r.n for r in files.language_counts(code).collect()} == {"python": 1, "verilog": 1}
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf/a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "pdf/bad.pdf").write_bytes(b"")
    (tmp_path / "pdf/t.txt").write_text("text")

    def reader(raw):
        if not raw:
            raise ValueError("no pages")
        return raw.decode().split("\x0c")

    both = {r.path.rsplit("/", 1)[1]: (r.type, r.content) for r in files.all_documents(spark, str(tmp_path / "pdf"), reader).collect()}
    assert both == {"a.pdf": ("pdf", "[PAGE 1]\none\n[PAGE 2]\ntwo"), "t.txt": ("text", "text")}
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert sorted(r.a for r in files.json_files(spark, str(tmp_path / "j.json"), "a int").collect()) == [1, 2]
    assert {r.language for r in files.project_files(spark, str(tmp_path / "src")).collect()} == {"python", "verilog"}
    o = tables.Objects(spark, str(tmp_path / "objects"))
    o.write("a/x.txt", "çok")
    o.upload(str(tmp_path / "j.json"), "b.json")
    o.download("b.json", str(tmp_path / "k.json"))
    assert o.names() == ["a/x.txt", "b.json"] and o.read("a/x.txt") == "çok" and (tmp_path / "k.json").exists() and o.delete("b.json") and o.names("a") == ["a/x.txt"]
    text = "projects:\n  p:\n    roots: [x]  # kept\n"
    more = tables.append_to_catalog(text, [{"project": "q", "roots": ["y"]}, {"project": "p", "roots": []}])
    import yaml

    assert more.startswith(text) and yaml.safe_load(more) == {"projects": {"p": {"roots": ["x"]}, "q": {"roots": ["y"]}}} and tables.append_to_catalog(more, [{"project": "q"}]) == more
    gs = tables
    gs.save_graph(spark.createDataFrame([("a", "T")], "node_id string, node_type string"), spark.createDataFrame([("a", "a", "E")], "from_id string, to_id string, edge_type string"), str(tmp_path / "graph"))
    n, e = gs.load_graph(spark, str(tmp_path / "graph"), "node_id string, node_type string", "from_id string, to_id string, edge_type string")
    assert (n.count(), e.count()) == (1, 1)
    (tmp_path / "g.json").write_text('{ // graph\n "nodes": [{"node_id": "a", "node_type": "PROJECT"}], "edges": [{"from": "a", "to": "b", "edge_type": "IMPLEMENTS"}] }')
    n, e = files.graph_json(spark, str(tmp_path / "g.json"))
    assert n.first().node_id == "a" and e.first().to_id == "b" and sorted(r.node_type for r in graph.with_stubs(n, e).collect()) == ["PROJECT", "UNKNOWN"]
    cat = files.catalog_from_yaml(spark, "variables: {root: /d}\ndefaults: {include_exts: [.v], exclude_patterns: [/sim/]}\nprojects:\n  p: {roots: ['{root}/p'], specific_files: [mig.prj]}\n")
    listing = spark.createDataFrame([("/d/p/a.v",), ("/d/p/sim/b.v",), ("/d/p/x/mig.prj",), ("/d/q/a.v",)], "path string")
    assert sorted(r.path for r in files.in_catalog(listing, cat).collect()) == ["/d/p/a.v", "/d/p/x/mig.prj"]


def test_per_group_takes_any_number_of_queries(spark, monkeypatch):
    """More queries than are broadcast, in several blocks, beside brute force; zero vectors and null groups included."""
    import numpy as np

    from skein.operators import retrieval as R

    monkeypatch.setattr(R, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(R, "BLOCK_VECTORS", 30)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5)).round(2)
    v[7], v[50:55] = 0, v[49]
    rows = [(i, x.tolist(), None if i % 4 == 3 else i % 4) for i, x in enumerate(v)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = data.where("vec_id < 60").selectExpr("vec_id as query_id", "embedding as query_vector")
    got = {(r.query_id, r.label, r["rank"]): (r.vec_id, r.similarity) for r in R.nearest(data, queries, 2, "label").collect()}
    norm = np.linalg.norm(v, axis=1)
    for q in range(60):
        for label in (0, 1, 2, None):
            hits = [(-round((v[q] * v[i]).sum() / norm[q] / norm[i], 12) if norm[q] and norm[i] else 9, i) for i, _, x in rows if x == label]
            for k, (s, i) in enumerate(sorted(hits)[:2], 1):
                found = got.pop((q, label, k))
                assert found[0] == i and (found[1] is None if s == 9 else abs(found[1] + s) < 1e-4)
    assert not got


def test_containment_beside_plain_search(spark):
    """Terms of one, two and more words, inside words, over line ends, hot and absent ones, against plain search."""
    from skein.operators.containment import holding

    rng = random.Random(6)
    words = ["ab", "abc", "bcd", "é", "ring", "spring", "x", "a.b", "(c)", "long_word_here"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))).replace("x", rng.choice(["x", "\n", "  "]))) for i in range(120)] + [(200, None), (201, ""), (202, "ab"), (203, "ab")]
    terms = ["ab", "b", "ring", "pring x", "ring ab", "ab abc bcd", "c) ab r", "abc  bcd", "\u00e9 \u00e9 \u00e9", "none", "", None, "ab none ring", "a.b", "d (", "x x x x"]
    got = holding(spark.createDataFrame(texts, "key int, text string").repartition(4), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(i, t) for i, x in texts if x is not None for t in terms if t and t.strip() and t in x}
    assert {(r.key, r.term) for r in got.collect()} == want and len(want) > 200 and got.count() == len(want)


def test_models(spark):
    from skein.functions import models as M

    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "alpha beta"), (4, "bad")], "id int, t string").repartition(2)

    def load():
        model, calls = M.hashing_model(8), []

        def run(texts):
            calls.append(1)
            if "bad" in texts and (len(texts) > 1 or len(calls) > 0):
                raise ValueError("no")
            return model(texts)

        return run

    got = {r.id: r.v for r in df.select("id", M.embedder(load, 2, 1, 0.0)(F.col("t")).alias("v")).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[4] is None and set(got[2]) == {0.0}
    assert "blue" in M.language_model("quoting").generate("what is blue", ["The sky is blue. Grass is green."])
    with pytest.raises(ValueError):
        M.language_model("none")
    q = spark.createDataFrame([(1, "nedir bu"), (2, "what")], "question_id int, question string")
    assert {r.question_id: r.question for r in T.translated(q, lambda x: [f"en {t}" for t in x]).collect()} == {1: "en nedir bu", 2: "what"}
    assert T.translated(q, lambda x: 1 / 0).count() == 2


def test_containment_in_blocks_of_terms(spark, monkeypatch):
    """More terms than one automaton has: blocks of texts meet blocks of terms, with the same result."""
    from skein.operators import containment

    rng = random.Random(7)
    texts = [(f"k{i % 90}", " ".join(rng.choices(["alpha", "beta", "gam ma", "x"], k=rng.randrange(0, 12)))) for i in range(100)] + [("n", None)]
    terms = [f"{a}{b}" for a in ("alpha", "beta", "ma ", "") for b in (" beta", " x", "", "zz")] + [None, " "]
    run = lambda: sorted(tuple(r) for r in containment.holding(spark.createDataFrame(texts, "key string, text string").repartition(3), spark.createDataFrame([(t,) for t in terms], "term string")).collect())
    one = run()
    monkeypatch.setattr(containment, "BLOCK_BYTES", 16)
    monkeypatch.setattr(containment, "TEXT_BYTES", 500)
    assert run() == one == sorted({(k, t) for k, x in texts if x for t in terms if t and t.strip() and t in x}) and one
