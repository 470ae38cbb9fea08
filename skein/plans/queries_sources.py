"""Queries of scans, extraction, sinks, evaluation and context over files made of the tables' rows, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import extract as X
from ..functions import text as T
from ..operators import context as Cx
from ..operators import evaluation as E
from ..operators.graph import shared_folder
from ..sources import files as S
from ..sources import tables as Tb
from .catalog import query, table
from .queries_graph import WITH, graph, rows
from .queries_routes import CHUNK_SQL, chunks

# ------------------------------------------------------------------ listings

#: Parts as files of about fifty designs, some of which are no design: by key.
LISTING = """SELECT concat('/d/', CASE p_size % 6 WHEN 0 THEN 'Arty-A7 v' WHEN 1 THEN 'own_design' WHEN 2 THEN 'Finn-lib' WHEN 3 THEN 'Umbrella' WHEN 4 THEN 'Zybo board' ELSE 'no_constraints' END, p_size, '/',
CASE WHEN p_size % 6 = 3 THEN 'Projects/p/' WHEN p_partkey % 11 = 0 THEN 'src/.gen/' ELSE 'src/' END, replace(p_name, ' ', '_'), p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.tcl' WHEN 1 THEN CASE WHEN p_size % 6 = 5 THEN '.txt' ELSE '.xdc' END WHEN 2 THEN '.V' WHEN 3 THEN '.mmi' WHEN 4 THEN '.cfg' ELSE '' END) AS path, p_partkey AS id, p_size AS size FROM part"""
SCRIPTS = f"""SELECT path, concat('# ', CASE id % 4 WHEN 0 THEN 'create_project p' WHEN 1 THEN 'nothing' WHEN 2 THEN 'create_bd_cell -type ip -vlnv a:b:c:1 d create_bd_cell' ELSE 'puts x' END, chr(10), 'set part ', CASE WHEN id % 3 = 0 THEN concat('XC7A', size, 'tcsg324-', 1, 'i') ELSE 'none' END, chr(10), CASE WHEN id % 7 = 0 THEN 'for Basys 3 board' ELSE '' END) AS content FROM ({LISTING}) l WHERE path LIKE '%.tcl' OR path LIKE '%.xdc'"""


def listing(spark, sf):
    return rows(spark, sf, LISTING, "part")


def scripts(spark, sf):
    return rows(spark, sf, SCRIPTS, "part")


EXT = r"lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1))"
LANG = "CASE e " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LANGUAGES.items()) + " END"


@query(f"WITH l AS (SELECT {EXT} AS e FROM ({LISTING})), x AS (SELECT {LANG} AS language FROM l) SELECT language, count(*) AS n FROM x WHERE language IS NOT NULL GROUP BY 1")
def sc7_language_counts(spark, sf):
    return S.language_counts(S.with_language(listing(spark, sf)).where("language is not null"))


CATALOG = [("a", ["/d/Arty-A7 v6/", "/d/own_design1"], ["tcl", "v"], ["/.gen/"], ["none.txt"]), ("b", ["/d"], ["xdc"], ["Finn", "board"], [])]
CATALOG_SQL = "c AS (SELECT * FROM (VALUES ('a', '/d/Arty-A7 v6'), ('a', '/d/own_design1'), ('b', '/d')) v(project, root)), u AS (SELECT c.project, path FROM l JOIN c ON starts_with(path, root || '/')), found AS (SELECT DISTINCT project, path FROM u WHERE (project = 'a' AND {ext} IN ('tcl', 'v') AND NOT contains(path, '/.gen/')) OR (project = 'b' AND {ext} = 'xdc' AND NOT contains(path, 'Finn') AND NOT contains(path, 'board')))"


def catalog(spark):
    return spark.createDataFrame(CATALOG, "project string, roots array<string>, include_exts array<string>, exclude_patterns array<string>, specific_files array<string>")


@query(f"WITH l AS ({LISTING}), {CATALOG_SQL.format(ext=EXT)} SELECT project, path FROM found")
def sc8_in_catalog(spark, sf):
    return S.in_catalog(listing(spark, sf).select("path"), catalog(spark))


@query(f"WITH l AS ({LISTING}), {CATALOG_SQL.format(ext=EXT)} SELECT DISTINCT project, path FROM u WHERE regexp_matches(path, '\\.mmi$|/mig\\.prj$') AND (project, path) NOT IN (SELECT (project, path) FROM found)")
def sc9_critical_files(spark, sf):
    one = listing(spark, sf).select("path")
    return S.critical_files(one, catalog(spark), S.in_catalog(one, catalog(spark)))


DOCS = "SELECT concat('/pdfs/x/', CASE p_partkey % 8 WHEN 0 THEN 'ug' WHEN 1 THEN 'PG' WHEN 2 THEN 'xapp' WHEN 3 THEN 'wp' WHEN 4 THEN 'ds' WHEN 5 THEN 'book' WHEN 6 THEN 'dsx ' ELSE 'ug' END, CASE WHEN p_partkey % 8 = 6 THEN '' ELSE cast(p_partkey AS STRING) END, '-', replace(p_name, ' ', '_'), CASE WHEN p_partkey % 8 = 7 THEN '.txt' ELSE '.pdf' END) AS path FROM part"


@query(rf"""WITH l AS ({DOCS}), n AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS name FROM l WHERE path LIKE '%.pdf'), s AS (SELECT path, regexp_extract(lower(name), '^(ug|pg|xapp|wp|ds)', 1) AS prefix, regexp_replace(name, '\.pdf$', '') AS stem FROM n)
SELECT path, prefix, CASE WHEN regexp_matches(lower(stem), '(ug|xapp|wp|xcn|pg|oslib)[0-9]+') THEN regexp_extract(lower(stem), '(ug|xapp|wp|xcn|pg|oslib)[0-9]+', 0) ELSE regexp_replace(substring(regexp_replace(lower(stem), '[^A-Za-z0-9_]', '_', 'g'), 1, 20), '^_+|_+$', '', 'g') END AS doc_id FROM s WHERE prefix <> ''""")
def sc18_reference_documents(spark, sf):
    return S.reference_documents(rows(spark, sf, DOCS, "part")).select("path", "prefix", "doc_id")


@query(rf"""WITH l AS (SELECT path, string_split(substring(path, 4), '/')[1] AS folder, {EXT} AS e, string_split(substring(path, 4), '/')[2] = 'Projects' AS umb FROM ({LISTING})), g AS (SELECT folder, count(*) AS files, count(*) FILTER (e = 'tcl') AS tcl, count(*) FILTER (e = 'xdc') AS xdc, bool_or(umb) AS umb FROM l GROUP BY 1),
z AS (SELECT *, regexp_replace(regexp_replace(lower(folder), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS project FROM g WHERE files BETWEEN 5 AND 3000 AND tcl > 0 AND xdc > 0 AND NOT umb AND NOT contains(lower(folder), 'finn')),
s AS (SELECT string_split(substring(path, 4), '/')[1] AS folder, path, content, path LIKE '%.xdc' AS late FROM ({SCRIPTS})), m AS (SELECT DISTINCT folder FROM s WHERE NOT late AND regexp_matches(content, 'create_bd_cell|create_project|create_bd_design|set_property -dict|create_clock')),
p AS (SELECT folder, arg_min(lower(regexp_extract(content, '(?i)xc[0-9][a-z][0-9a-z]+[a-z]+-[0-9][a-z]+', 0)), (late, path)) AS part FROM s WHERE regexp_matches(content, '(?i)xc[0-9][a-z][0-9a-z]+[a-z]+-[0-9][a-z]+') GROUP BY 1),
b AS (SELECT folder, arg_min(trim(regexp_extract(content, 'Basys[ _-]?[A-Z0-9-]*', 0)), path) AS board FROM s WHERE NOT late AND contains(content, 'Basys') GROUP BY 1)
SELECT project, z.folder, files, tcl, xdc, coalesce(part, '') AS part, coalesce(nullif(trim(regexp_extract(z.folder, '(?i)(Arty|Zybo)[ _-]?[A-Z0-9-]*', 0)), ''), board, z.folder) AS board FROM z JOIN m USING (folder) LEFT JOIN p USING (folder) LEFT JOIN b USING (folder) WHERE project <> 'own_design7'""")
def sc19_discovered_projects(spark, sf):
    known = spark.createDataFrame([("own_design7",)], "project string")
    return S.discovered_projects(listing(spark, sf).select("path"), scripts(spark, sf), "/d", known, ("finn",))


CORPUS = "SELECT concat('/c/', CASE p_partkey % 4 WHEN 0 THEN 'pdfs/' WHEN 1 THEN 'code/' WHEN 2 THEN 'code/.git/' ELSE 'docs/a/' END, p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.v' WHEN 2 THEN '.md' WHEN 3 THEN '.py' ELSE '.rst' END) AS path, p_size FROM part"


@query(f"WITH l AS ({CORPUS}) SELECT CASE WHEN path LIKE '/c/pdfs/%' THEN 'pdf' WHEN path LIKE '/c/code/%' THEN 'code' ELSE 'text' END AS type, path FROM l WHERE ((path LIKE '/c/pdfs/%' AND path LIKE '%.pdf') OR (path LIKE '/c/code/%' AND NOT contains(path, '.git') AND (path LIKE '%.v' OR path LIKE '%.py')) OR (path LIKE '/c/docs/%' AND (path LIKE '%.md' OR path LIKE '%.rst'))) AND path NOT IN (SELECT path FROM l WHERE p_size < 10)")
def sc20_corpus_listing(spark, sf):
    c = rows(spark, sf, CORPUS, "part")
    return S.corpus_listing(c.select("path"), c.where("p_size < 10"))


@query(f"WITH s AS (SELECT string_split(substring(path, 4), '/')[1] AS project, path, content FROM ({SCRIPTS})), n AS (SELECT *, (length(content) - length(replace(content, 'create_bd_cell', ''))) / 14 AS n FROM s WHERE path LIKE '%.tcl') SELECT project, arg_min(path, (-n, path)) AS script, (SELECT min(path) FROM s x WHERE x.project = n.project AND path LIKE '%.xdc') AS constraints FROM n WHERE n > 0 GROUP BY project")
def sc22_first_files(spark, sf):
    s = scripts(spark, sf).withColumn("project", F.split(F.substring("path", 4, 1000), "/")[0])
    main = S.main_script(s.where("path like '%.tcl'")).withColumnRenamed("path", "script")
    return main.join(S.first_file(s, "*.xdc").withColumnRenamed("path", "constraints"), "project", "left").select("project", "script", "constraints")


@query(f"WITH l AS ({LISTING}) SELECT path, CASE WHEN path LIKE '%.tcl' THEN 1 ELSE 0 END AS blocks, CASE WHEN path LIKE '%.V' THEN 1 ELSE 0 END AS verilog FROM l")
def f13_file_kinds(spark, sf):
    one = listing(spark, sf)
    text = F.when(F.col("path").endswith(".tcl"), "create_bd_cell -type ip").otherwise("create_bd_cell")
    return one.select("path", X.holds_blocks(text).cast("int").alias("blocks"), X.verilog_file(F.col("path")).cast("int").alias("verilog"))


# ------------------------------------------------------------------ extraction

CODE = """SELECT p_partkey AS id, concat('set b', p_size, '_0 [ create_bd_cell -type ip -vlnv xilinx.com:ip:', replace(p_name, ' ', '_'), ':1.0 b', p_size, '_0 ]', chr(10), 'set_property -dict [ list CONFIG.W {', p_size, '} CONFIG.CLKOUT1_JITTER {1} CONFIG.N {', p_brand, '} ] $b', p_size, '_0', chr(10),
'create_bd_cell -type ip -vlnv a.b:user:own:2 own_', p_partkey % 3, chr(10), 'set_property -dict [list CONFIG.K { ', p_type, ' }] [get_bd_cells own_', p_partkey % 3, ']', chr(10), 'create_bd_cell -type ip -vlnv a.b:user:bare:2 bare_1', chr(10),
'#define SIZE_', p_size, ' 0x', p_partkey, chr(10), '#define PAIR (a', CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '' END, ')', chr(10), 'typedef enum { A', p_size, ', B = 2 } kind_t;', chr(10), 'typedef struct s {', chr(10), '  int x', p_size, ';', chr(10), '  // no', chr(10), '  char c;', chr(10), '} data_t;', chr(10),
'module m #(parameter W = ', p_size, ', parameter integer D = 4); // parameter Q = 5', chr(10), 'localparam L = W;', chr(10), 'Clock  ', p_size, ' MHz', chr(10), 'Name', chr(9), p_name) AS content FROM part"""


def code(spark, sf):
    return rows(spark, sf, CODE, "part")


@query(f"""WITH c AS ({CODE}), x AS (SELECT id, concat('b', regexp_extract(content, 'set b([0-9]+)_0', 1), '_0') AS b, regexp_extract(content, 'xilinx.com:ip:[a-z_]+:1.0', 0) AS v, regexp_extract(content, 'CONFIG.W .([0-9]+)', 1) AS w, regexp_extract(content, 'CONFIG.N .([^}}]+)', 1) AS n, regexp_extract(content, 'get_bd_cells (own_[0-9])', 1) AS o, trim(regexp_extract(content, 'CONFIG.K .([^}}]+)', 1)) AS k FROM c)
SELECT id::VARCHAR AS path, b AS ip, v AS vlnv, 'W' AS key, w AS value FROM x UNION ALL SELECT id::VARCHAR, b, v, 'N', n FROM x UNION ALL SELECT id::VARCHAR, o, 'a.b:user:own:2', 'K', k FROM x""")
def ex1_tcl_parameters(spark, sf):
    return X.tcl_parameters(code(spark, sf).select(F.col("id").cast("string").alias("path"), "content"))


@query(f"""WITH c AS ({CODE}), d AS (SELECT id, regexp_extract(content, '#define (SIZE_[0-9]+)', 1) AS a, regexp_extract(content, '#define SIZE_[0-9]+ (0x[0-9]+)', 1) AS av, contains(content, '(a2)') AS two, regexp_extract(content, 'enum . (A[0-9]+)', 1) AS e, regexp_extract(content, 'int (x[0-9]+);', 1) AS x FROM c)
SELECT id, 'define' AS kind, a AS key, av AS value FROM d UNION ALL SELECT id, 'define', 'PAIR', '(a2)' FROM d WHERE two UNION ALL SELECT id, 'enum', 'kind_t', concat(e, '; B = 2') FROM d UNION ALL SELECT id, 'struct', 'data_t', concat('int ', x, '; char c') FROM d""")
def ex3_c_definitions(spark, sf):
    c = code(spark, sf)
    one = lambda kind, a: c.select("id", F.lit(kind).alias("kind"), F.explode(a).alias("p")).select("id", "kind", F.trim("p.key").alias("key"), F.trim("p.value").alias("value"))
    t = F.col("content")
    return one("define", X.c_defines(t)).unionByName(one("enum", X.typedefs(t, "enum"))).unionByName(one("struct", X.typedefs(t, "struct")))


@query(f"WITH c AS ({CODE}), w AS (SELECT id, regexp_extract(content, 'parameter W = ([0-9]+)', 1) AS w FROM c) SELECT id, concat('D = 4', chr(10), 'L = W', chr(10), 'W = ', w) AS text FROM w")
def ex4_verilog_parameters(spark, sf):
    return code(spark, sf).select("id", X.formatted(X.verilog_parameters(F.col("content"))).alias("text"))


@query("WITH t AS (SELECT p_partkey AS id, concat('Clock  ', p_size, ' MHz', chr(10), 'Name', chr(9), p_name, chr(10), 'one word', chr(10), '  Brand   ', p_brand, '  ') AS t FROM part) SELECT id, concat('Brand = ', regexp_extract(t, 'Brand   ([^ ]+)', 1), chr(10), 'Clock = ', regexp_extract(t, 'Clock  ([0-9]+ MHz)', 1), chr(10), 'Name = ', regexp_extract(t, chr(9) || '([^' || chr(10) || ']+)', 1)) AS text FROM t")
def ex5_table_rows(spark, sf):
    t = F.concat(F.lit("Clock  "), F.col("p_size").cast("string"), F.lit(" MHz\nName\t"), "p_name", F.lit("\none word\n  Brand   "), "p_brand", F.lit("  "))
    pairs = F.transform(X.table_rows(t), lambda r: F.struct(F.trim(r[0]).alias("key"), r[1].alias("value")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.formatted(pairs).alias("text"))


@query("SELECT p_brand AS ip, p_type AS key, arg_min(p_name, p_partkey) AS value FROM part GROUP BY 1, 2")
def ex2_first_value(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("ip"), F.col("p_type").alias("key"), F.col("p_name").alias("value"), "p_partkey")
    return X.first_wins(p, ["ip"], "p_partkey")


COMPS = "SELECT concat('COMP-', CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, '-', replace(p_name, ' ', '_'), '-', p_size) AS node_id, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'B' END AS project, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_brand, p_type) END AS name, p_partkey FROM part"


@query(f"""WITH c AS ({COMPS}), m AS (SELECT *, string_split(node_id, '-') AS s FROM c WHERE CASE WHEN coalesce(project, '') <> '' THEN project = 'A' ELSE string_split(node_id, '-')[2] = 'A' END), u AS (SELECT node_id, concat(s[3], '-', s[4]) AS instance FROM m UNION ALL SELECT node_id, name FROM m WHERE name <> '')
SELECT instance, max(node_id) AS node_id FROM u GROUP BY 1""")
def ex7_instances(spark, sf):
    return X.instances(rows(spark, sf, COMPS, "part"), "A")


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(p_name, chr(10), 'extracted_params: old=1') WHEN 1 THEN concat(p_name, '  ') ELSE NULL END AS d, p_partkey % 4 < 3 AS has, concat('size=', p_size, ', type=', p_type) AS p FROM part)
SELECT p_partkey::VARCHAR AS node_id, CASE WHEN NOT has THEN d WHEN contains(d, 'extracted_params:') THEN regexp_replace(d, 'extracted_params:.*', 'extracted_params: ' || p) ELSE concat(rtrim(coalesce(d, '')), chr(10), 'extracted_params: ', p) END AS description FROM n""")
def ex8_described(spark, sf):
    p = table(spark, sf, "part")
    d = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("\nextracted_params: old=1"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("  ")))
    nodes = p.select(F.col("p_partkey").cast("string").alias("node_id"), d.alias("description"))
    params = p.where("p_partkey % 4 < 3").select(F.col("p_partkey").cast("string").alias("node_id"), F.explode(F.array(F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")), F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value")))).alias("x")).select("node_id", "x.*")
    return X.described(nodes, params).select("node_id", "description")


_NOT = lambda c, words: f"{c} NOT IN (" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""WITH c AS ({CHUNK_SQL}), l AS (SELECT *, lower(trim(chunk_label)) AS k, lower(regexp_extract(file_path, '([^/]+?)(\\.[^./]*)?$', 1)) AS stem FROM c),
ok AS (SELECT * FROM l WHERE length(k) >= 4 AND NOT contains(k, ' ') AND {_NOT('k', X.SKIP_LABELS)} AND {_NOT('k', X.FLOW_STEPS)} AND NOT starts_with(k, 'declarations_after_line')),
u AS (SELECT k AS keyword, project, concat('label_', file_type) AS source FROM ok UNION ALL SELECT regexp_replace(k, '_[0-9]+$', ''), project, 'label_stripped' FROM ok WHERE regexp_matches(k, '_[0-9]+$') AND length(regexp_replace(k, '_[0-9]+$', '')) >= 4
UNION ALL SELECT stem, project, 'file_stem' FROM l WHERE length(stem) >= 5 AND {_NOT('stem', X.SKIP_STEMS)} AND {_NOT('stem', X.FLOW_STEPS)}
UNION ALL SELECT lower(unnest(regexp_extract_all(content, '(?i)create_bd_cell\\s+-type\\s+ip[^"]+?-vlnv\\s+\\S+:(\\S+):\\S+\\s+\\S+', 1))), project, 'tcl_ip' FROM l WHERE file_type = 'tcl')
SELECT keyword, project, min(source) AS source FROM u WHERE length(keyword) >= 4 GROUP BY 1, 2""")
def ex9_signals(spark, sf):
    return X.signals(chunks(spark, sf).select("project", "file_type", F.col("chunk_label").alias("label"), F.col("file_path").alias("path"), "content"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('[\"', event_type, '\",\"x\"]') END AS tags FROM events")
def ex11_flattened(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.array("event_type", F.lit("x"))).alias("tags"))
    return T.flattened(e)


XDC = "SELECT p_partkey AS id, concat('set_property PACKAGE_PIN E', p_size, ' [get_ports a]', chr(10), CASE WHEN p_size % 2 = 0 THEN concat('#set_property x', chr(10), '# set_property y', chr(10)) ELSE '' END, 'create_clock z', chr(10), CASE WHEN p_size % 3 = 0 THEN 'set_property w' ELSE '## heading' END) AS t FROM part"


@query(f"WITH t AS ({XDC}) SELECT id, CASE WHEN contains(t, chr(10) || 'set_property w') THEN 3 ELSE 2 END AS active, CASE WHEN contains(t, '#set_property x') THEN 2 ELSE 0 END AS commented FROM t")
def a14_constraint_counts(spark, sf):
    t = F.col("t")
    return rows(spark, sf, XDC, "part").select("id", F.regexp_count(t, F.lit(C.ACTIVE)).alias("active"), F.regexp_count(t, F.lit(C.COMMENTED)).alias("commented"))


# ------------------------------------------------------------------ sinks


def _store(spark, name: str, schema: str, keys: list[str]) -> Tb.Store:
    return Tb.Store(spark, f"{shared_folder(spark)}/skein-stores/{name}-{uuid.uuid4().hex}", schema, keys)


@query("SELECT doc_id, CASE WHEN quality IS NOT NULL THEN concat('q', quality) ELSE lang END AS v FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT (lang = 'de' AND quality IS NULL)")
def sk4_store_delete(spark, sf):
    """A store that is filled, upserted and from which rows go by a condition."""
    s = _store(spark, "delete", "doc_id long, v string", ["doc_id"])
    s.upsert(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")))
    s.upsert(table(spark, sf, "labels").where("quality is not null").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("v")))
    s.delete(F.col("v") == "de")
    return s.read()


@query("SELECT doc_id, lang AS v FROM documents UNION ALL SELECT doc_id, 'new' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def sk2_store_append(spark, sf):
    s = _store(spark, "append", "doc_id long, v string", ["doc_id"])
    s.append(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")))
    s.append(table(spark, sf, "labels").select("doc_id", F.lit("new").alias("v")))
    return s.read()


@query("SELECT doc_id, lang AS v FROM documents WHERE lang = 'en'")
def sk5_store_cleared(spark, sf):
    """A store that is filled, cleared and filled with less."""
    s = _store(spark, "clear", "doc_id long, v string", ["doc_id"])
    s.append(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")))
    s.clear()
    s.append(table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.col("lang").alias("v")))
    return s.read()


@query("SELECT doc_id, lang FROM documents")
def sk6_backfill(spark, sf):
    """A derived table with as many rows as its source, of which some hold another language: only their buckets are written anew."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    source, derived = _store(spark, "source", "doc_id long, lang string", ["doc_id"]), _store(spark, "derived", "doc_id long, lang string", ["doc_id"])
    source.write(docs)
    derived.write(docs.withColumn("lang", F.when(F.col("doc_id") % 97 == 5, F.lit("xx")).otherwise(F.col("lang"))))
    Tb.backfill(source, derived, lambda df: df)
    return derived.read()


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def sk15_rebuilt(spark, sf):
    """A derived table that is written anew from its source, whatever it held."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    derived = _store(spark, "rebuilt", "doc_id long, lang string", ["doc_id"])
    derived.write(docs.where("lang = 'en'"))
    Tb.rebuild(docs, derived, lambda df: df)
    return derived.read().groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def sk4_stream_store(spark, sf):
    """A stream of event files into a store of each user's last event. The stream is then taken once more from its start, as after the loss of its checkpoint: its batches are known and change nothing."""
    from ..streaming.ingest import ingest

    base = f"{shared_folder(spark)}/skein-streams/{uuid.uuid4().hex}"
    table(spark, sf, "events").select("user_id", "event_type", "event_id").repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    s = _store(spark, "stream", "user_id long, event_type string, event_id long", ["user_id"])
    for k in range(2):
        ingest(spark, f"{base}/in", "user_id long, event_type string, event_id long", s, f"{base}/checkpoint-{k}", "event_id", name="events", files=4)
    return s.read()


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE lang END AS lang FROM documents WHERE doc_id % 4 <> 1")
def sk4_store_compacted(spark, sf):
    """A store after many small writes and deletes by key, folded into bases on the way, and cleaned of what no version needs."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    s = _store(spark, "compacted", "doc_id long, lang string", ["doc_id"])
    s.deltas = 2
    s.write(docs)
    for k in range(3):
        s.upsert(docs.where((F.col("doc_id") % 9) == 3 * k).withColumn("lang", F.lit("third")))
    s.delete_keys(docs.where("doc_id % 4 = 1"))
    s.vacuum()
    return s.read()


@query("SELECT DISTINCT lower(p_name) AS keyword, p_brand AS project FROM part WHERE p_brand <> 'Brand#3' AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size = 7)")
def sk9_signal_store(spark, sf):
    p = table(spark, sf, "part")
    s = Tb.signals_store(spark, _store(spark, "signals", "x int", ["x"]).path)
    s.upsert(p.select(F.lower("p_name").alias("keyword"), F.col("p_brand").alias("project"), F.lit("a").alias("source")))
    Tb.delete_project(s, "Brand#3")
    Tb.delete_words(s, p.where("p_size = 7").select(F.upper("p_name").alias("keyword")))
    return s.read().select("keyword", "project")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def sk12_json_report(spark, sf):
    path = f"{shared_folder(spark)}/skein-reports/{uuid.uuid4().hex}"
    Tb.json_report(table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("event_type string, n long").json(path)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'fixed' WHEN p_size % 4 = 1 THEN p_type ELSE p_type END AS p_type FROM part")
def sk11_patched(spark, sf):
    from ..operators import graph as G

    p = table(spark, sf, "part")
    nodes, patch = p.select(F.col("p_partkey").alias("node_id"), "p_type"), p.where("p_size % 4 in (0, 1)").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") % 4 == 0, F.lit("fixed")).alias("p_type"))
    return G.patched(nodes, patch, "p_type").withColumnRenamed("node_id", "p_partkey")


@query("SELECT doc_id, upper(lang) AS v FROM documents")
def sk16_in_batches(spark, sf):
    """A store that is filled in batches, from where an earlier run stopped."""
    docs = table(spark, sf, "documents").select("doc_id", F.upper("lang").alias("v"))
    s = _store(spark, "batches", "doc_id long, v string", ["doc_id"])
    s.append(docs.where("v = 'EN'"))
    Tb.in_batches(docs, s, "doc_id", 100 + docs.count() // 3)
    return s.read()


@query("SELECT lang AS category, min(n_chars) AS priority, row_number() OVER (ORDER BY min(n_chars), lang)::INT AS place FROM documents WHERE lang <> 'en' GROUP BY 1")
def u5_queue(spark, sf):
    c = table(spark, sf, "documents").groupBy(F.col("lang").alias("category")).agg(F.min("n_chars").alias("priority"))
    return Tb.queue(c, c.where("category = 'en'"))


@query("SELECT doc_id, arg_max(v, p) AS v FROM (SELECT doc_id, lang AS v, 0 AS p FROM documents UNION ALL SELECT doc_id, 'labelled', 1 FROM labels) GROUP BY 1")
def u4_later_overrides(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("v")), table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("v"))  # noqa: E741
    return Tb.first_wins([l, d], "doc_id").select("doc_id", "v")


# ------------------------------------------------------------------ evaluation and context

ANSWERS = "SELECT o_orderkey AS id, o_orderstatus AS category, concat(CASE o_orderkey % 5 WHEN 0 THEN 'This is not in the sources.' WHEN 1 THEN 'It runs at 42 MHz.' WHEN 2 THEN 'There is no 42 MHz clock here.' WHEN 3 THEN 'Not in the sources, but perhaps 42 MHz.' ELSE 'It depends.' END, ' ', o_orderpriority, ' axi_dma and mig 7series') AS answer, o_orderkey % 3 > 0 AS route_ok FROM orders"


def answers(spark, sf):
    return rows(spark, sf, ANSWERS, "orders")


def _array(*x: str):
    return F.array(*map(F.lit, x))


@query(f"WITH a AS ({ANSWERS}) SELECT id, round(0.6 * (contains(lower(answer), 'axi_dma')::INT + contains(lower(answer), 'urgent')::INT) / 2 + 0.4 * (contains(lower(answer), '42 mhz')::INT + contains(lower(answer), 'high')::INT) / 2, 3)::DOUBLE AS score FROM a")
def e4_blind_score(spark, sf):
    return answers(spark, sf).select("id", E.blind_score(F.col("answer"), _array("axi_dma", "URGENT"), _array("42 MHz", "high")).alias("score"))


@query(f"WITH a AS (SELECT id, lower(answer) AS a FROM ({ANSWERS})), f AS (SELECT id, contains(a, 'not in the sources') AS says, contains(a, '42 mhz') AND NOT contains(a, 'there is no') AND NOT contains(a, 'perhaps not') AS makes FROM a) SELECT id, CASE WHEN says AND NOT makes THEN 1.0 WHEN says THEN 0.5 WHEN makes THEN 0.0 ELSE 0.3 END::DOUBLE AS score FROM f")
def e4_trap_score(spark, sf):
    return answers(spark, sf).select("id", E.trap_score(F.col("answer"), _array("42 MHz"), _array("there is no", "perhaps not"), _array("not in the sources")).alias("score"))


@query(f"""WITH a AS (SELECT *, lower(answer) AS l FROM ({ANSWERS})) SELECT id, round(0.3 * (id % 7 >= 3)::INT + 0.3 * (id % 5 >= 2)::INT + 0.4 * ((contains(l, 'axi_dma') OR contains(replace(l, '_', ''), 'axidma'))::INT + (contains(l, 'mig_7series'))::INT) / 2, 6)::DOUBLE AS hops,
round(0.5 * (id % 4) / 4 + 0.3 * route_ok::INT + 0.2 * (id % 5 >= 2)::INT, 6)::DOUBLE AS crossed, round((CASE WHEN id % 2 = 0 THEN 0.5 ELSE 1.0 END + 0.5 * (id % 3 = 0)::INT + 0.3 * (id % 4 = 0)::INT + 0.2 * (id % 5 = 0)::INT) / 2, 6)::DOUBLE AS conflict, round(0.7 * (id % 3 = 0)::INT + 0.3 * contains(l, 'not in')::INT, 6)::DOUBLE AS held FROM a""")
def e7_scores(spark, sf):
    i, a = F.col("id"), F.col("answer")
    hops = E.multi_hop_score(i % 7, F.lit(3), i % 5, F.lit(2), a, _array("AXI_DMA", "mig_7series"))
    crossed = E.cross_project_score((i % 4) / 4, F.col("route_ok"), i % 5)
    conflict = E.contradiction_score(i % 2 == 0, i % 3 == 0, i % 4 == 0, i % 5 == 0)
    held = E.held_out_score(i % 3 == 0, F.contains(F.lower(a), F.lit("not in")))
    return answers(spark, sf).select("id", *(F.round(x, 6).alias(n) for x, n in ((hops, "hops"), (crossed, "crossed"), (conflict, "conflict"), (held, "held"))))


@query(f"WITH a AS ({ANSWERS}) SELECT category, count(*) AS n, round(avg((id % 11) / 10.0), 3)::DOUBLE AS score, count(*) FILTER (route_ok) AS route_ok, CASE WHEN round(avg((id % 11) / 10.0), 3) >= 0.80 THEN 'A' WHEN round(avg((id % 11) / 10.0), 3) >= 0.65 THEN 'B' WHEN round(avg((id % 11) / 10.0), 3) >= 0.50 THEN 'C' WHEN round(avg((id % 11) / 10.0), 3) >= 0.35 THEN 'D' ELSE 'F' END AS grade FROM a GROUP BY 1")
def a17_category_means(spark, sf):
    return E.category_means(answers(spark, sf).withColumn("score", (F.col("id") % 11) / 10.0))


@query("SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') OR contains(lower(p_name), 'econ') OR contains(lower(p_type), 'econ') AS matches FROM part")
def e2_category_matches(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.category_matches(F.col("p_name"), F.col("p_type"), _array("Ring", "ECON")).alias("matches"))


@query("SELECT o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1")
def a20_status_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT label, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT label, avg((vec_id % 3 = 0)::INT) AS p, avg((vec_id % 2 = 0)::INT) AS r FROM embeddings GROUP BY 1) WHERE p + r > 0")
def a13_f1(spark, sf):
    m = table(spark, sf, "embeddings").groupBy("label").agg(F.avg((F.col("vec_id") % 3 == 0).cast("int")).alias("p"), F.avg((F.col("vec_id") % 2 == 0).cast("int")).alias("r"))
    return m.where("p + r > 0").select("label", F.round(E.f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query(f"WITH c AS ({CHUNK_SQL}), s AS (SELECT project, min(chunk_label) AS keyword FROM c WHERE chunk_label <> '' GROUP BY project, lower(chunk_label)) SELECT project, keyword, row_number() OVER (ORDER BY project, keyword)::INT AS place FROM s")
def e9_signal_listing(spark, sf):
    s = chunks(spark, sf).where("chunk_label <> ''").groupBy("project", F.lower("chunk_label").alias("_l")).agg(F.min("chunk_label").alias("keyword")).drop("_l")
    return Tb.listed(s, ["project", "keyword"])


@query(WITH + f""", c AS ({CHUNK_SQL}), p AS (SELECT node_id AS project, concat(rpad(node_id, 25, ' '), ': ', name) AS line, 0 AS o FROM nodes WHERE node_type = 'PROJECT' AND node_id < 'R3' UNION ALL SELECT DISTINCT project, concat(rpad(project, 25, ' '), ': sources only'), 1 FROM c WHERE project NOT IN (SELECT node_id FROM nodes WHERE node_type = 'PROJECT' AND node_id < 'R3'))
SELECT project, line, row_number() OVER (ORDER BY o, project)::INT AS place FROM p""")
def p3_project_list(spark, sf):
    """Some projects of the graph, and those of chunks."""
    n, _ = graph(spark, sf)
    return Cx.project_list(n.where("node_id < 'R3'"), chunks(spark, sf))


@query(f"""WITH c AS ({CHUNK_SQL}), q AS (SELECT n_nationkey AS question_id, concat('R', n_regionkey) AS project FROM nation),
f AS (SELECT question_id, file_type, regexp_extract(file_path, '([^/]+)$', 1) AS file FROM q JOIN c USING (project)),
s AS (SELECT question_id, count(*) AS source_chunks, string_agg(DISTINCT file, ',' ORDER BY file) AS files, count(DISTINCT file_type) AS nodes FROM f GROUP BY 1),
d AS (SELECT doc_id % 25 AS question_id, count(*) AS doc_chunks, string_agg(DISTINCT concat(source, '/', lang), ',' ORDER BY concat(source, '/', lang)) AS docs FROM documents GROUP BY 1)
SELECT question_id, coalesce(source_chunks, 0) AS source_chunks, coalesce(files, '') AS files, coalesce(doc_chunks, 0) AS doc_chunks, coalesce(docs, '') AS docs, coalesce(nodes, 0) AS nodes, coalesce(source_chunks, 0) AS edges
FROM q LEFT JOIN s USING (question_id) LEFT JOIN d USING (question_id)""")
def e6_answered(spark, sf):
    """Nations ask; all chunks of their region and the documents of their number, named by source and language, are what was retrieved."""
    q = table(spark, sf, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("R"), "n_regionkey").alias("project"))
    c = chunks(spark, sf).join(q, "project")
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 25).alias("question_id"), F.concat("source", F.lit("/"), "lang").alias("doc_id"))
    return E.answered(q, c, docs, c.withColumn("node_id", F.col("file_type")), c)


@query("""WITH s AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY (n_chars % 1000) DESC, doc_id) AS place FROM documents) SELECT lang, doc_id AS chunk_id, place::INT AS place FROM s WHERE place <= 20""")
def t1_first_chunks(spark, sf):
    c = table(spark, sf, "documents").select("lang", F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 1000).alias("similarity"))
    return Cx.first_chunks(c, "lang").select("lang", "chunk_id", "place")


# ------------------------------------------------------------------ files that a catalog names, and what describes a project


@query(f"""WITH l AS ({LISTING}), f AS (SELECT path, string_split(substring(path, 4), '/')[1] AS project, regexp_extract(path, '([^/]+)$', 1) AS name FROM l), named AS (SELECT project, arg_min(name, path) AS name FROM f GROUP BY project)
SELECT DISTINCT f.project, path FROM f JOIN named USING (project) WHERE f.name = named.name OR ({EXT} = 'v' AND NOT contains(path, '/.gen/'))""")
def sc10_named_files(spark, sf):
    """Each design as a project whose catalog entry names its first file, whatever its extension and folder, besides its sources."""
    one = listing(spark, sf).select("path", F.split(F.substring("path", 4, 1000), "/")[0].alias("project"))
    first = one.groupBy("project").agg(F.array(F.regexp_extract(F.min("path"), "([^/]+)$", 1)).alias("specific_files"))
    entry = first.select("project", F.array(F.concat(F.lit("/d/"), "project")).alias("roots"), F.array(F.lit("v")).alias("include_exts"), F.array(F.lit("/.gen/")).alias("exclude_patterns"), "specific_files")
    return S.in_catalog(one.select("path"), entry)


#: Documents as the files of projects, ten a project, some of which lack some.
BUNDLED = """SELECT concat('b', CAST(floor(doc_id / 10) AS BIGINT)) AS project, concat('/p/', CAST(floor(doc_id / 10) AS BIGINT), CASE doc_id % 10 WHEN 0 THEN '/README.md' WHEN 1 THEN '/readme.md' WHEN 2 THEN '/a.tcl' WHEN 3 THEN '/b.tcl' WHEN 4 THEN '/x.xdc' WHEN 5 THEN '/y.xdc'
WHEN 6 THEN '/helloworld.c' WHEN 7 THEN '/src/main.c' WHEN 8 THEN '/main.cc' ELSE '/n.txt' END) AS path, concat(CASE WHEN doc_id % 10 = 2 THEN 'create_bd_cell ' WHEN doc_id % 20 = 3 THEN 'create_bd_cell create_bd_cell ' ELSE '' END, text) AS content FROM documents WHERE doc_id % 7 <> 0"""


@query(f"""WITH b AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS name, (length(content) - length(replace(content, 'create_bd_cell', ''))) / 14 AS n FROM ({BUNDLED})),
k AS (SELECT *, CASE WHEN name IN ('README.md', 'readme.md') THEN 0 WHEN name LIKE '%.tcl' AND n > 0 THEN 1 WHEN name LIKE '%.xdc' THEN 2 WHEN name IN ('helloworld.c', 'main.c', 'main.cc') THEN 3 END AS part,
CASE name WHEN 'readme.md' THEN 1 WHEN 'main.c' THEN 1 WHEN 'main.cc' THEN 2 ELSE CASE WHEN name LIKE '%.tcl' THEN -n ELSE 0 END END AS p FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY project, part ORDER BY p, path) AS rank FROM k WHERE part IS NOT NULL) SELECT project, path AS label, content[1:[2500, 3000, 2000, 1500][part + 1]] AS content FROM r WHERE rank = 1""")
def sc22_bundles(spark, sf):
    """What describes each project to a reader: its read-me, main script, first constraints and main program, each cut to its share."""
    return S.project_bundle(rows(spark, sf, BUNDLED, "documents"))
