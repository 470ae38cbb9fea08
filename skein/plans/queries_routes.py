"""Queries of routing and of what routes bring together, each beside its SQL. Nations ask; suppliers, nations, regions, parts and events are their hits in the graph of queries_graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import routes as Ro
from ..operators import routing as Q
from .catalog import query, table
from .queries_graph import WITH, graph, rows

HITS = """SELECT s_nationkey AS question_id, concat('S', s_suppkey) AS node_id, 1.0D / (2 + s_suppkey) AS similarity, CAST(s_suppkey AS INT) AS rank FROM supplier
UNION ALL SELECT n_nationkey, concat('N', n_nationkey), 0.0D, 1000000 FROM nation UNION ALL SELECT n_nationkey, concat('R', n_regionkey), 0.0D, 1000001 FROM nation
UNION ALL SELECT CAST(p_partkey % 25 AS INT), concat('P', p_partkey), 0.0D, CAST(2000000 + p_partkey AS INT) FROM part UNION ALL SELECT CAST(user_id % 25 AS INT), concat('E', event_id), 0.0D, CAST(100000000 + event_id AS INT) FROM events"""
ASKED = "SELECT n_nationkey AS question_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('R', n_regionkey) END AS project FROM nation"
# What nations ask, by their key: a phrase of every type, some with a project's name.
ASKS = "SELECT n_nationkey AS question_id, concat(CASE n_nationkey % 10 WHEN 0 THEN 'adım adım kurulum' WHEN 1 THEN 'hangi bileşen bunu karşılıyor' WHEN 2 THEN 'neden seçildi' WHEN 3 THEN 'A ile B karşılaştır, benzer mi' WHEN 4 THEN 'tüm IP listesi' WHEN 5 THEN 'how does ring_7 work' WHEN 6 THEN 'tüm projelerimiz nelerdir' WHEN 7 THEN 'what is DMA_Engine' WHEN 8 THEN 'main.c ve top-level.v çalışır' ELSE 'nedir' END, CASE WHEN n_nationkey % 3 = 0 THEN concat(' ', r_name, ' east board?') WHEN n_nationkey % 7 = 0 THEN ' nexys video?' ELSE '?' END) AS question FROM nation JOIN region ON n_regionkey = r_regionkey"
PROJECTS = "SELECT concat(r_name, '_east') AS project, CASE r_regionkey % 5 WHEN 0 THEN 'Digilent Nexys Video' WHEN 1 THEN 'Nexys Video' WHEN 2 THEN ' Arty S7 ' WHEN 3 THEN 'Xilinx KC705' ELSE '' END AS board, concat('xc7a', 100 + r_regionkey, 'tcsg324-1') AS fpga_part FROM region"
SIGNALS = "SELECT DISTINCT replace(lower(p_name), ' ', '_') AS keyword, concat(r_name, '_east') AS project FROM part JOIN region ON length(p_brand) % 5 = r_regionkey"


def sql(text: str) -> str:
    """The same in DuckDB's dialect."""
    return text.replace("0D ", "0::DOUBLE ").replace("0D,", "0::DOUBLE,")


def asked(spark, sf) -> DataFrame:
    return rows(spark, sf, ASKED, "nation")


def hits(spark, sf) -> DataFrame:
    return rows(spark, sf, HITS, "supplier", "nation", "part", "events")


def questions(spark, sf) -> DataFrame:
    return spark.sql(ASKS.replace("FROM nation JOIN region", "FROM {nation} JOIN {region}"), nation=table(spark, sf, "nation"), region=table(spark, sf, "region"))


# ------------------------------------------------------------------ routes

OF = "CASE WHEN n.node_type = 'PROJECT' THEN a.project IS NULL OR n.node_id = a.project WHEN n.node_type IN ('DECISION', 'EVIDENCE', 'REQUIREMENT', 'ISSUE', 'COMPONENT') THEN a.project IS NOT NULL AND (n.project IS NULL OR n.project = a.project) ELSE true END"
BASE = WITH + sql(f""", hits AS ({HITS}), asked AS ({ASKED}), stale AS MATERIALIZED (SELECT DISTINCT to_id AS node_id FROM edges WHERE edge_type = 'SUPERSEDES'),
r AS MATERIALIZED (SELECT question_id, node_id, min(rank) AS rank FROM hits ANTI JOIN stale USING (node_id) SEMI JOIN nodes USING (node_id) GROUP BY 1, 2)""")
MINE = f"SELECT v.question_id, 'node' AS kind, v.node_id AS x, n.node_type AS y, '' AS edge_type FROM v JOIN nodes n USING (node_id) JOIN asked a USING (question_id) WHERE {OF}"


def links(name: str, types: tuple[str, ...], both: bool, source: str = "r") -> str:
    of = ", ".join(f"'{t}'" for t in types)
    out = f"SELECT question_id, node_id AS x, to_id AS y, edge_type, rank FROM {source} JOIN edges ON from_id = node_id WHERE edge_type IN ({of})"
    back = f" UNION SELECT question_id, node_id, from_id, edge_type, rank FROM {source} JOIN edges ON to_id = node_id WHERE edge_type IN ({of})"
    return f"{name} AS MATERIALIZED ({out}{back if both else ''})"


def together(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Nodes and edges of a route as one table."""
    n = found[0].select("question_id", F.lit("node").alias("kind"), F.col("node_id").alias("x"), F.col("node_type").alias("y"), F.lit("").alias("edge_type"))
    return n.unionByName(found[1].select("question_id", F.lit("edge").alias("kind"), F.col("from_id").alias("x"), F.col("to_id").alias("y"), "edge_type"))


def inputs(spark, sf) -> tuple:
    n, e = graph(spark, sf)
    return hits(spark, sf), n, e, asked(spark, sf), G.stale(e)


@query(BASE + f""", {links("l", Ro.WHAT_EDGES, True)}, f AS MATERIALIZED (SELECT question_id, edge_type, unnest(min(struct_pack(rank := rank, x := x, y := y))) FROM l GROUP BY question_id, edge_type, least(x, y), greatest(x, y)),
v AS (SELECT question_id, node_id FROM r UNION SELECT question_id, y FROM f WHERE y NOT IN (SELECT node_id FROM stale))
{MINE} UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM f""")
def g8_what(spark, sf):
    return together(Ro.what(*inputs(spark, sf)))


@query(BASE + f""", {links("l", Ro.HOW_EDGES, False)}, v AS (SELECT question_id, node_id FROM r) {MINE} UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM l""")
def g9_how(spark, sf):
    return together(Ro.how(*inputs(spark, sf)))


@query(BASE + f""", d AS (SELECT r.* FROM r JOIN nodes USING (node_id) WHERE node_type = 'DECISION'), {links("l", Ro.WHY_EDGES, False, "d")}, v AS (SELECT question_id, node_id FROM r), k AS ({MINE}),
e AS (SELECT DISTINCT question_id, 'node' AS kind, y AS x, node_type AS y2, '' AS edge_type FROM l JOIN nodes ON node_id = y WHERE node_type IN ('EVIDENCE', 'REQUIREMENT'))
SELECT * FROM k UNION SELECT * FROM e UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM l""")
def g10_why(spark, sf):
    return together(Ro.why(*inputs(spark, sf)))


@query(BASE + f""", {links("l", Ro.TRACE_EDGES, True)}, {links("c", ("CONSTRAINED_BY",), False)}, v AS (SELECT question_id, node_id FROM r UNION SELECT question_id, y FROM l)
{MINE} UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM l UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM c""")
def g11_trace(spark, sf):
    return together(Ro.trace(*inputs(spark, sf)))


CROSS = sql(f""", ask AS MATERIALIZED ({ASKS}), few AS (SELECT question_id, node_id, rank FROM hits ANTI JOIN stale USING (node_id)),
t AS MATERIALIZED (SELECT node_id, unnest(list_concat([lower(string_split(node_id, '-')[-1])], list_filter(list_filter(string_split(lower(name), ' '), lambda w: w <> '')[1:2], lambda w: length(w) > 3))) AS term FROM nodes),
u AS MATERIALIZED (SELECT DISTINCT term FROM t), s AS MATERIALIZED (SELECT question_id, term FROM ask JOIN u ON contains(lower(question), term)),
w AS MATERIALIZED (SELECT question_id, node_id, min(rank) AS rank FROM (SELECT * FROM few UNION ALL SELECT DISTINCT question_id, node_id, 1073741824 FROM s JOIN t USING (term)) SEMI JOIN nodes USING (node_id) GROUP BY 1, 2)""")


@query(BASE + CROSS + f""", {links("l", Ro.CROSS_EDGES, True, "w")}, z AS (SELECT question_id FROM ask WHERE len(list_filter({list(Ro.ASKS_RELATIONS)}, lambda m: contains(lower(question), m))) > 0 AND question_id NOT IN (SELECT question_id FROM l)),
b AS MATERIALIZED (SELECT question_id, x, y, edge_type FROM l UNION ALL SELECT question_id, from_id, to_id, edge_type FROM z, edges WHERE edge_type IN ('ANALOGOUS_TO', 'CONTRADICTS', 'ALTERNATIVE_TO')),
v AS (SELECT question_id, node_id FROM w UNION SELECT question_id, x FROM b UNION SELECT question_id, y FROM b)
SELECT question_id, 'node' AS kind, node_id AS x, node_type AS y, '' AS edge_type FROM v JOIN nodes USING (node_id) UNION ALL SELECT question_id, 'edge', x, y, edge_type FROM b""")
def g12_crossref(spark, sf):
    """All suppliers, nations and parts as hits, and what nations name."""
    h, n, e, _, stale = inputs(spark, sf)
    return together(Ro.crossref(questions(spark, sf), h, n, e, stale))


@query(BASE + f", v AS (SELECT question_id, node_id FROM r) SELECT question_id, x AS node_id, y AS node_type FROM ({MINE})")
def f8_nodes_of_project(spark, sf):
    h, n, _, a, stale = inputs(spark, sf)
    return Ro.of_project(Ro.found(h, n, stale), a).select("question_id", "node_id", "node_type")


@query(BASE + " SELECT question_id, node_id, name, r.rank FROM r JOIN nodes USING (node_id)")
def j2_hits_with_nodes(spark, sf):
    h, n, _, _, stale = inputs(spark, sf)
    return Ro.found(h, n, stale).select("question_id", "node_id", "name", "rank")


@query(BASE + """, q AS (SELECT DISTINCT question_id, node_id FROM r JOIN nodes USING (node_id) WHERE node_type = 'REQUIREMENT'), t(root, node_id, depth) AS (SELECT DISTINCT node_id, node_id, 0 FROM q UNION SELECT root, to_id, depth + 1 FROM t JOIN edges ON from_id = t.node_id AND edge_type = 'DECOMPOSES_TO')
SELECT question_id, t.node_id, min(depth)::INT AS depth FROM q JOIN t ON q.node_id = root WHERE (question_id, t.node_id) NOT IN (SELECT (question_id, node_id) FROM q) GROUP BY 1, 2""")
def g4_trees_of_hits(spark, sf):
    h, n, e, _, stale = inputs(spark, sf)
    return Ro.trees_of(Ro.found(h, n, stale), e)


# ------------------------------------------------------------------ classification and projects


def portable(pattern: str) -> str:
    """A pattern with Unicode words for a dialect whose \\w and \\b know ASCII only."""
    return pattern.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}_])").replace(r"[\w][\w\-]*", r"[\p{L}\p{N}_][\p{L}\p{N}_\-]*").replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")


def typed(question: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({question}), '{portable(p)}') THEN '{t}'" for t, p in Q.RULES) + " ELSE 'What' END"


def fits_sql(question: str, pattern: str) -> str:
    return f"regexp_matches(lower({question}), '{portable(pattern.lower())}')"


@query(f"WITH ask AS ({ASKS}) SELECT question_id, {typed('question')} AS type FROM ask UNION ALL SELECT 1000000 + conv_id * 1000 + turn, {typed('text')} FROM conversations")
def q1_classify(spark, sf):
    """What nations ask, and all turns of conversations."""
    c = table(spark, sf, "conversations").select((1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    return questions(spark, sf).unionByName(c).select("question_id", Q.question_type(F.col("question")).alias("type"))


def projects(spark, sf) -> DataFrame:
    return rows(spark, sf, PROJECTS, "region")


def signals(spark, sf) -> DataFrame:
    s = spark.sql(SIGNALS.replace("FROM part JOIN region", "FROM {part} JOIN {region}"), part=table(spark, sf, "part"), region=table(spark, sf, "region"))
    static = spark.createDataFrame([("dma_engine", "ASIA_east", 0), ("kurulum", "AFRICA_east", 1), ("nexys video", "EUROPE_east", 2)], "keyword string, project string, place int")
    return Q.signal_table(projects(spark, sf), Q.unique_signals(s), static)


PROJECT_SQL = f"""pr AS MATERIALIZED ({PROJECTS}), bo AS (SELECT lower(trim(board)) AS b FROM pr WHERE trim(board) <> ''), bs AS (SELECT b FROM bo UNION ALL SELECT regexp_replace(b, '^(digilent|xilinx|avnet|trenz) ', '') FROM bo WHERE regexp_matches(b, '^(digilent|xilinx|avnet|trenz) ')),
shared AS MATERIALIZED (SELECT b AS board FROM bs GROUP BY b HAVING count(*) > 1), fo AS MATERIALIZED (SELECT project, unnest(list_distinct([lower(project), replace(lower(project), '_', ' '), replace(lower(project), '_', '-')])) AS form FROM pr)"""
SIGNAL_SQL = f"""{PROJECT_SQL}, un AS (SELECT keyword, min(project) AS project FROM ({SIGNALS}) GROUP BY 1 HAVING count(DISTINCT project) = 1),
al AS (SELECT 1 AS s, project AS f, list_position([lower(project), replace(lower(project), '_', ' '), replace(lower(project), '_', '-')], form) - 1 AS n, form AS keyword, project FROM fo
UNION ALL SELECT 1, project, 3, lower(trim(board)), project FROM pr WHERE lower(trim(board)) NOT IN (SELECT board FROM shared) AND trim(board) <> ''
UNION ALL SELECT 1, project, 4, string_split(lower(fpga_part), '-')[1], project FROM pr WHERE length(string_split(lower(fpga_part), '-')[1]) >= 6
UNION ALL SELECT 2, keyword, 0, keyword, project FROM un UNION ALL SELECT 2, keyword, 1, CASE WHEN contains(keyword, '_') THEN replace(keyword, '_', ' ') ELSE replace(keyword, ' ', '_') END, project FROM un WHERE contains(keyword, '_') AND replace(keyword, '_', ' ') NOT IN (SELECT board FROM shared)
UNION ALL SELECT * FROM (VALUES (3, '', 0, 'dma_engine', 'ASIA_east'), (3, '', 1, 'kurulum', 'AFRICA_east'), (3, '', 2, 'nexys video', 'EUROPE_east'))),
sg AS MATERIALIZED (SELECT keyword, unnest(min(struct_pack(s := s, f := f, n := n, project := project))) FROM al GROUP BY keyword), ask AS MATERIALIZED ({ASKS}),
heard AS MATERIALIZED (SELECT question_id, sg.* FROM ask JOIN sg ON contains(lower(question), keyword)), ex AS MATERIALIZED (SELECT question_id, project, form FROM ask JOIN fo ON contains(lower(question), form)),
exact AS (SELECT question_id, arg_min(project, (-length(form), project)) AS project FROM ex WHERE length(form) >= 4 GROUP BY 1)"""


@query(f"WITH {PROJECT_SQL} SELECT board FROM shared")
def a3_shared_boards(spark, sf):
    return Q.shared_boards(projects(spark, sf))


@query(f"WITH {SIGNAL_SQL} SELECT keyword, project FROM sg")
def q4_signals(spark, sf):
    return signals(spark, sf).select("keyword", "project")


@query(f"WITH {SIGNAL_SQL} SELECT question_id, project FROM exact")
def q3_exact_projects(spark, sf):
    return Q.exact_projects(questions(spark, sf), projects(spark, sf))


CLASSIFIED_SQL = f"""w AS (SELECT question_id, project, sum(length(keyword)) AS weight FROM heard GROUP BY 1, 2), x AS (SELECT question_id, count(*) AS n, max(weight) / sum(weight) AS top FROM w GROUP BY 1), y AS (SELECT question_id, count(DISTINCT project) AS n FROM ex GROUP BY 1),
ty AS MATERIALIZED (SELECT question_id, CASE WHEN y.n = 1 AND t = 'CrossRef' THEN 'What' WHEN y.n IS NULL AND coalesce(x.n, 0) >= 2 AND top < 0.7 THEN 'CrossRef' ELSE t END AS type FROM (SELECT question_id, {typed('question')} AS t FROM ask) LEFT JOIN x USING (question_id) LEFT JOIN y USING (question_id))"""


@query(f"WITH {SIGNAL_SQL}, {CLASSIFIED_SQL} SELECT question_id, type FROM ty")
def q2_classified(spark, sf):
    return Q.classified(questions(spark, sf), projects(spark, sf), signals(spark, sf))


@query(f"WITH {SIGNAL_SQL}, w AS (SELECT question_id, project, sum(length(keyword))::BIGINT AS weight FROM heard GROUP BY 1, 2) SELECT question_id, project, weight, round(weight / sum(weight) OVER (PARTITION BY question_id), 6) AS share FROM w")
def a4_signal_weights(spark, sf):
    w = Q.signal_weights(Q.heard(questions(spark, sf), signals(spark, sf)))
    return w.select("question_id", "project", "weight", F.round("share", 6).alias("share"))


# The nearest project node of a question, and hits that vote: by key.
NEAR_PROJECT = "SELECT n_nationkey AS question_id, concat(r_name, '_east') AS node_id, n_nationkey / 40.0D AS similarity, 1 AS rank FROM nation JOIN region ON n_regionkey = r_regionkey"
VOTERS = "SELECT s_nationkey AS question_id, CASE s_suppkey % 6 WHEN 0 THEN 'ASIA_east' WHEN 1 THEN concat('COMP-ASIA_east-', s_suppkey) WHEN 2 THEN concat('EVID-', s_suppkey) WHEN 3 THEN 'COMP-EUROPE_east-x' WHEN 4 THEN 'REQ-A-1' ELSE 'COMP-none-2' END AS node_id, CAST(s_suppkey AS INT) AS rank FROM supplier"
LEGACY = {"A": "AFRICA_east", "B": "EUROPE_east"}
RESOLVED_SQL = sql(f"""np AS ({NEAR_PROJECT}), vo AS MATERIALIZED ({VOTERS}), vt AS (SELECT question_id, CASE WHEN node_id IN (SELECT project FROM pr) THEN node_id WHEN node_id LIKE 'COMP-%' THEN (SELECT max(project) FROM pr WHERE project = string_split(node_id, '-')[2]) WHEN node_id LIKE '%-A-%' THEN 'AFRICA_east' END AS project, CASE WHEN node_id IN (SELECT project FROM pr) THEN 2 ELSE 1 END AS weight, rank FROM vo WHERE node_id NOT LIKE 'EVID-%'),
vs AS (SELECT question_id, project, sum(weight) AS w, min(rank) AS o FROM vt WHERE project IS NOT NULL GROUP BY 1, 2), vw AS (SELECT question_id, arg_min(project, (-w, o, project)) AS t4, max(w) / sum(w) AS share FROM vs GROUP BY 1 HAVING max(w) / sum(w) >= 0.7),
t2 AS (SELECT question_id, arg_min(project, (s, f, n, project)) AS t2 FROM heard GROUP BY 1),
re AS MATERIALIZED (SELECT question_id, question, {fits_sql('question', Q.ALL_PROJECTS)} AS every, exact.project AS t0, t2, np.node_id AS t3, t4 FROM ask LEFT JOIN exact USING (question_id) LEFT JOIN t2 USING (question_id) LEFT JOIN (SELECT * FROM np WHERE similarity >= 0.45) np USING (question_id) LEFT JOIN vw USING (question_id)),
rs AS MATERIALIZED (SELECT question_id, question, CASE WHEN t0 IS NOT NULL THEN t0 WHEN every THEN NULL ELSE coalesce(t2, t3, t4) END AS project, CASE WHEN t0 IS NOT NULL THEN 0 WHEN every THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN t3 IS NOT NULL THEN 3 WHEN t4 IS NOT NULL THEN 4 END AS tier, t0 IS NOT NULL OR t2 IS NOT NULL AS signal FROM re)""")


def resolved(spark, sf) -> DataFrame:
    near = spark.sql(NEAR_PROJECT.replace("FROM nation JOIN region", "FROM {nation} JOIN {region}"), nation=table(spark, sf, "nation"), region=table(spark, sf, "region"))
    none = spark.createDataFrame([], "node_id string")
    return Q.resolved(questions(spark, sf), projects(spark, sf), signals(spark, sf), near, rows(spark, sf, VOTERS, "supplier"), none, LEGACY)


@query(f"WITH {SIGNAL_SQL}, {RESOLVED_SQL} SELECT question_id, project, tier, signal FROM rs")
def q5_resolved(spark, sf):
    return resolved(spark, sf)


@query(f"""WITH {SIGNAL_SQL}, {CLASSIFIED_SQL}, {RESOLVED_SQL}, g AS (SELECT *, NOT signal AND type IN ('Trace', 'CrossRef') AND NOT {fits_sql('question', Q.ALL_PROJECTS)} AS general FROM rs JOIN ty USING (question_id)), h AS (SELECT *, CASE WHEN general THEN 'What' ELSE type END AS route FROM g),
k AS (SELECT *, route IN ('What', 'Why') AND NOT signal AS concept, route = 'What' AND {fits_sql('question', Q.PROJECT_LIST)} AS listing FROM h)
SELECT question_id, route, general, CASE WHEN general OR (route = 'How' AND NOT signal) THEN 12 WHEN concept THEN 8 ELSE 4 END AS n_docs, CASE WHEN general THEN 2 WHEN concept AND NOT listing THEN 4 END AS n_sources FROM k""")
def q6_dispatched(spark, sf):
    types = Q.classified(questions(spark, sf), projects(spark, sf), signals(spark, sf))
    return Q.dispatched(questions(spark, sf), types, resolved(spark, sf))


@query("""WITH p AS (SELECT concat(r_name, '_east') AS project FROM region), o AS (SELECT * FROM (VALUES ('A', 'AFRICA_east'), ('B', 'EUROPE_east'), ('ASIA_east', 'none')) v(tag, project))
SELECT project AS tag, project FROM p UNION ALL SELECT tag, project FROM o WHERE tag NOT IN (SELECT project FROM p)""")
def ex18_project_tags(spark, sf):
    return Q.project_tags(projects(spark, sf), LEGACY | {"ASIA_east": "none"})


# ------------------------------------------------------------------ chunks of sources

BLOCKS = "['clk_wiz', 'axi_gpio', 'microblaze', 'mig_7series', 'own_block', 'axi_dma', 'xadc_wiz', 'processing_system7']"
#: Parts as chunks of scripts and sources of five projects; their sizes stand for hits.
CHUNKS = """SELECT concat('K', p_partkey) AS chunk_id, concat('R', p_partkey % 5) AS project, CASE p_partkey % 3 WHEN 0 THEN 'tcl' WHEN 1 THEN 'c' ELSE 'v' END AS file_type, concat('src/', p_brand, '/', replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN '.tcl' WHEN 1 THEN '.c' ELSE '.v' END) AS file_path,
CASE p_size % 8 WHEN 0 THEN 'includes_defines' WHEN 1 THEN 'preamble' WHEN 2 THEN 'lines 1-37' WHEN 3 THEN concat(p_name, ' (part 1)') WHEN 4 THEN '' ELSE concat(replace(p_name, ' ', '_'), '_', p_size % 4) END AS chunk_label, CASE WHEN p_size % 9 = 0 THEN 1 ELSE 0 END AS is_meta,
concat('create_bd_cell -type ip  -vlnv xilinx.com:ip:', element_at({blocks}, CAST(p_partkey % 8 + 1 AS INT)), ':6.0 x', chr(10), 'CREATE_BD_CELL -type ip -vlnv a.b:user:', 'Own_', p_size % 3, ':1 y') AS content FROM part"""


def chunks(spark, sf) -> DataFrame:
    return rows(spark, sf, CHUNKS.replace("{blocks}", "array(" + BLOCKS[1:-1] + ")"), "part")


CHUNK_SQL = CHUNKS.replace("element_at({blocks}, CAST(p_partkey % 8 + 1 AS INT))", f"{BLOCKS}[(p_partkey % 8 + 1)::INT]")
NAMES_BLOCK = "chunk_label <> '' AND chunk_label NOT IN ('preamble', 'address_map', 'net_connections', 'get_script_folder', 'write_mig_file_system_mig_7series_0_0', 'ip_manifest')" + "".join(f" AND NOT starts_with(chunk_label, '{p}')" for p in Ro.SKIP_PREFIXES) + "".join(f" AND NOT ends_with(chunk_label, '{x}')" for x in Ro.SKIP_SUFFIXES)


@query(f"WITH c AS ({CHUNK_SQL}), l AS (SELECT DISTINCT project, chunk_label FROM c WHERE file_type = 'tcl' AND {NAMES_BLOCK}) SELECT project, count(*)::INT AS n, string_agg(chunk_label, ', ' ORDER BY chunk_label) AS labels FROM l GROUP BY 1")
def q8_manifest(spark, sf):
    return Ro.manifest(chunks(spark, sf))


@query(f"WITH c AS ({CHUNK_SQL}) SELECT chunk_id, chunk_label FROM c WHERE {NAMES_BLOCK}")
def f9_block_labels(spark, sf):
    c = chunks(spark, sf)
    return c.where(Ro.names_block(F.col("chunk_label"))).select("chunk_id", "chunk_label")


@query(f"WITH c AS ({CHUNK_SQL}) SELECT chunk_id, project FROM c WHERE is_meta = 1")
def f10_meta_chunks(spark, sf):
    return Ro.meta_chunks(chunks(spark, sf)).select("chunk_id", "project")


@query(f"WITH c AS ({CHUNK_SQL}) SELECT * EXCLUDE (content) FROM c WHERE project = 'R2' AND file_type IN ('tcl', 'v')")
def v9_chunk_listing(spark, sf):
    return Ro.chunk_listing(chunks(spark, sf), "R2", ("tcl", "v"))


@query(f"WITH c AS ({CHUNK_SQL}) SELECT chunk_id, 1.0::DOUBLE AS similarity FROM c WHERE contains(regexp_extract(lower(file_path), '([^/]+)\\.[a-z]+$', 1), 'widget')")
def v8_chunks_of_file(spark, sf):
    return Ro.of_file(chunks(spark, sf), "Widget").select("chunk_id", "similarity")


#: A question names the files of two words; sizes and prices stand for similarities.
STEMS = "SELECT n_nationkey AS question_id, CASE n_nationkey % 4 WHEN 0 THEN 'Widget' WHEN 1 THEN 'red_' WHEN 2 THEN 'bolt' ELSE 'none' END AS stem FROM nation"


@query(f"""WITH c AS MATERIALIZED ({CHUNK_SQL}), s AS ({STEMS}), m AS MATERIALIZED (SELECT question_id, stem, c.*, (hash_of * 7919 % 1000) / 1000.0 AS similarity FROM s JOIN (SELECT *, substring(chunk_id, 2)::BIGINT AS hash_of FROM c) c ON contains(regexp_extract(lower(file_path), '([^/]+)\\.[a-z]+$', 1), lower(stem))),
f AS (SELECT question_id, stem, arg_min(file_type, chunk_id) AS first FROM m GROUP BY 1, 2), p AS (SELECT m.*, first IN ('c', 'cpp', 'h', 'hpp') AND (chunk_label IN ('includes_defines', 'global_vars') OR starts_with(chunk_label, 'typedef_struct_')) AS pinned FROM m JOIN f USING (question_id, stem)),
h AS (SELECT *, count(*) FILTER (pinned) OVER (PARTITION BY question_id, stem) AS have, row_number() OVER (PARTITION BY question_id, stem ORDER BY pinned DESC, CASE WHEN pinned THEN 0 ELSE -similarity END, chunk_id) AS rank FROM p)
SELECT question_id, stem, chunk_id, CASE WHEN pinned THEN 0.97 ELSE round(greatest(similarity, 0.95), 4) END::DOUBLE AS similarity, rank::INT AS rank FROM h WHERE pinned OR rank - have <= greatest(1, 8 - have)""")
def v7_search_in_files(spark, sf):
    c, s = chunks(spark, sf), rows(spark, sf, STEMS, "nation")
    scores = c.select("chunk_id", ((F.substring("chunk_id", 2, 20).cast("long") * 7919 % 1000) / 1000.0).alias("similarity"))
    return Ro.in_file(c, s, scores.withColumn("question_id", F.explode(F.sequence(F.lit(0), F.lit(24)))))


@query(f"""WITH c AS ({CHUNK_SQL}) SELECT chunk_id FROM c WHERE contains(regexp_extract(lower(file_path), '([^/]+)\\.[a-z]+$', 1), 'red_')""")
def f6_file_stem(spark, sf):
    return Ro.of_file(chunks(spark, sf), "red_").select("chunk_id")


BLOCK_SQL = f"c AS ({CHUNK_SQL}), b AS (SELECT DISTINCT project, lower(unnest(regexp_extract_all(content, '(?i)create_bd_cell\\s+-type\\s+ip\\s+.*?-vlnv\\s+\\S+:(\\w+):\\S+', 1))) AS block FROM c WHERE file_type = 'tcl')"
DOCS_SQL = "t(block, n, doc_id) AS (VALUES " + ", ".join(f"('{k}', {n}, '{d}')" for k, docs in Ro.BLOCK_DOCS.items() for n, d in enumerate(docs)) + "), x AS (SELECT project, doc_id, min((block, n)) AS f FROM b JOIN t USING (block) GROUP BY 1, 2)"


@query(f"WITH {BLOCK_SQL} SELECT project, block FROM b")
def q9_blocks(spark, sf):
    return Ro.blocks(chunks(spark, sf))


@query(f"WITH {BLOCK_SQL}, {DOCS_SQL} SELECT project, doc_id, concat(f[1], ':', f[2]) AS place FROM x")
def j12_block_docs(spark, sf):
    return Ro.block_docs(Ro.blocks(chunks(spark, sf)))


#: Every document's best passages for every question, as ranked hits: by key.
DOC_HITS = "SELECT n_nationkey AS question_id, CASE o_orderkey % 6 WHEN 0 THEN 'pg065' WHEN 1 THEN 'ug984' WHEN 2 THEN 'pg144' WHEN 3 THEN 'ug585' WHEN 4 THEN 'pg021' ELSE 'zz1' END AS doc_id, o_orderkey AS passage, CAST((o_orderkey - o_orderkey % 6) / 6 % 5 + 1 AS INT) AS rank FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(f"WITH {BLOCK_SQL}, {DOCS_SQL}, a AS ({ASKED}), h AS ({DOC_HITS}) SELECT question_id, h.doc_id, passage, rank FROM h JOIN a USING (question_id) JOIN x ON x.project = a.project AND x.doc_id = h.doc_id WHERE rank <= 2")
def q9_docs_of_questions(spark, sf):
    h = spark.sql(DOC_HITS.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("JOIN nation", "JOIN {nation}"), **{t: table(spark, sf, t) for t in ("orders", "customer", "nation")})
    return Ro.docs_of_questions(questions(spark, sf), asked(spark, sf), chunks(spark, sf), h).select("question_id", "doc_id", "passage", "rank")


@query(f"""WITH ask AS ({ASKS}), f AS (SELECT question_id, regexp_extract_all(lower(question), '{portable(Q.SOURCE_FILE[2:])[len(portable("")):]}', 1) AS s FROM ask) SELECT question_id, unnest(s) AS stem, (generate_subscripts(s, 1) - 1)::INT AS place FROM f""")
def q7_file_stems(spark, sf):
    return Q.file_stems(questions(spark, sf))


#: Hits in files, in a question's project and everywhere, by key.
IN_FILES = "SELECT n_nationkey AS question_id, concat('K', n_nationkey) AS chunk_id, 0.95D AS similarity, 1 AS rank FROM nation"
EVERYWHERE = "SELECT s_nationkey AS question_id, concat('K', s_suppkey % 40) AS chunk_id, min(1.0D / (1 + s_suppkey)) AS similarity, CAST(min(s_suppkey) AS INT) AS first FROM supplier GROUP BY s_nationkey, s_suppkey % 40"


@query(f"""WITH a AS ({ASKED}), i AS ({IN_FILES.replace('0.95D', '0.95::DOUBLE')}), e0 AS ({EVERYWHERE.replace('1.0D', '1.0::DOUBLE')}), e AS MATERIALIZED (SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY first) AS rank FROM e0), m AS (SELECT * FROM e WHERE rank % 3 = 0),
f AS (SELECT *, 0 AS p FROM i UNION ALL SELECT m.*, 1 FROM m JOIN a USING (question_id) WHERE project IS NOT NULL AND rank <= 6 UNION ALL SELECT e.*, 1 FROM e JOIN a USING (question_id) WHERE project IS NULL AND rank <= 6),
o AS MATERIALIZED (SELECT question_id, chunk_id, unnest(min(struct_pack(p := p, rank := rank, similarity := similarity))) FROM f GROUP BY 1, 2), h AS (SELECT question_id, count(*) AS have FROM o GROUP BY 1),
x AS (SELECT e.*, coalesce(have, 0) AS have FROM e JOIN a USING (question_id) LEFT JOIN h USING (question_id) WHERE project IS NOT NULL AND coalesce(have, 0) < 3 AND rank <= 6 - coalesce(have, 0) + 4), y AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM x WHERE (question_id, chunk_id) NOT IN (SELECT (question_id, chunk_id) FROM o)),
z AS (SELECT question_id, chunk_id, p, rank, similarity FROM o UNION ALL SELECT question_id, chunk_id, 2, rank, similarity FROM y WHERE k <= 6 - have) SELECT question_id, chunk_id, similarity, row_number() OVER (PARTITION BY question_id ORDER BY p, rank, chunk_id)::INT AS place FROM z""")
def q7_source_chunks(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("question_id").orderBy("first")
    every = rows(spark, sf, EVERYWHERE, "supplier").withColumn("rank", F.row_number().over(w)).drop("first")
    return Q.source_chunks(rows(spark, sf, IN_FILES, "nation"), every.where("rank % 3 = 0"), every, asked(spark, sf), 6)


KEYWORDS = [("econ", ["N1", "N2"]), ("SMALL", ["N3"]), ("om", [])]


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'econ') THEN 'N1,N2' WHEN contains(lower(p_type), 'small') THEN 'N3' ELSE '' END AS node_ids FROM part")
def j20_first_keyword(spark, sf):
    return Ro.first_keyword(table(spark, sf, "part"), KEYWORDS, "p_type").select("p_partkey", F.array_join("node_ids", ",").alias("node_ids"))


@query(f"""WITH c AS ({CHUNK_SQL}), r AS (SELECT regexp_extract(file_path, '([^/]+)$', 1) AS name, list_sort(list(DISTINCT project)) AS ids FROM c WHERE is_meta = 1 GROUP BY 1) SELECT chunk_id, array_to_string(coalesce(ids, []), ',') AS node_ids FROM c LEFT JOIN r ON regexp_extract(file_path, '([^/]+)$', 1) = name""")
def j21_file_nodes(spark, sf):
    c = chunks(spark, sf)
    related = c.where("is_meta = 1").groupBy(F.regexp_extract("file_path", r"([^/]+)$", 1).alias("name")).agg(F.array_sort(F.collect_set("project")).alias("node_ids"))
    return Ro.file_nodes(c, related, "file_path").select("chunk_id", F.array_join("node_ids", ",").alias("node_ids"))


@query(WITH + " SELECT from_id, to_id, edge_type FROM edges WHERE from_id = 'R0' AND to_id = 'N0'")
def j22_edge(spark, sf):
    return G.edge(graph(spark, sf)[1], "R0", "N0").select("from_id", "to_id", "edge_type")
