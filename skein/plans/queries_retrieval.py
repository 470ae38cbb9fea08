"""Queries of scans, text, lexical and vector retrieval, each beside the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import linkage as K
from ..operators import retrieval as R
from ..operators.graph import kept, shared_folder
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from .catalog import query, table

# The stated query set of searches by words: the whole text of every benchmark item.
TOKENS_SQL = r"""
toks AS (
  SELECT doc_id, lang, source, list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'),
         lambda w: CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: p <> '')) ELSE [w] END))) AS t FROM documents
), q AS (
  SELECT DISTINCT 50 * item_id AS query_id, unnest(list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'),
         lambda w: CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: p <> '')) ELSE [w] END)))) AS term FROM benchmark
)"""
BM25_SQL = rf"""
WITH {TOKENS_SQL}, idx AS (SELECT doc_id, lang, t, len(t) AS dl FROM toks),
post AS (SELECT doc_id, lang, dl, unnest(t) AS term FROM idx),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM idx),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
w AS (SELECT term, avgdl, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM df, st),
s AS (SELECT query_id, doc_id, sum(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN w USING (term) JOIN q USING (term) {{where}} GROUP BY query_id, doc_id),
lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""
def bm25_sql(where: str = "") -> str:
    return BM25_SQL.format(where=where)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts, under the ids of the vectors that ask beside them in hybrid searches."""
    return table(spark, sf, "benchmark").select((50 * F.col("item_id")).alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))


def search_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set of searches: every vector whose id is divisible by 50."""
    e = table(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def lexical_hits(spark: SparkSession, sf: str, k: int, where=None) -> DataFrame:
    index = kept(L.indexed(table(spark, sf, "documents").select("doc_id", "text", "lang")).drop("text"))
    return L.best(index, questions(spark, sf), k, where=where)


# ------------------------------------------------------------------ vectors

SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


NEAR_SQL = "WITH h AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {sim} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0{where}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM h)"


@query(NEAR_SQL.format(sim=SIM, where="") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def v2_cosine_topk(spark, sf):
    return R.topk(table(spark, sf, "embeddings"), search_queries(spark, sf), 10).select("query_id", "vec_id", "similarity", "rank")


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2,
round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine,
round(a.embedding[3]::DOUBLE / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS unit3 FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def v1_vector_arithmetic(spark, sf):
    """Every vector beside the next."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    d = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return d.select("vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.euclidean(a, b), 6).alias("l2"), F.round(V.norm(a), 6).alias("norm"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.normalized(a)[2], 6).alias("unit3"))


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id, {SIM} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM h)
SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 20 AND round(s, 4) >= 0.35""")
def v3_topk_then_threshold(spark, sf):
    return R.topk(table(spark, sf, "embeddings"), search_queries(spark, sf), 20, threshold=0.35).select("query_id", "vec_id", "similarity", "rank")


@query(NEAR_SQL.format(sim=SIM, where=" AND e.label IN (1, 3, 5)") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def f1_filtered_topk(spark, sf):
    return R.topk(table(spark, sf, "embeddings"), search_queries(spark, sf), 10, where=F.col("label").isin(1, 3, 5)).select("query_id", "vec_id", "similarity", "rank")


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {SIM} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY s DESC, vec_id) AS rank FROM h)
SELECT query_id, label, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 2""")
def v6_topn_per_group(spark, sf):
    return R.nearest(table(spark, sf, "embeddings"), search_queries(spark, sf), 2, "label").select("query_id", "label", "vec_id", F.round("similarity", 4).alias("similarity"), "rank")


@query(NEAR_SQL.format(sim="0.0 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", where="") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def v5_distance_topk(spark, sf):
    return R.topk(table(spark, sf, "embeddings"), search_queries(spark, sf), 10, "euclidean").select("query_id", "vec_id", "similarity", "rank")


@query(NEAR_SQL.format(sim="list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", where="") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def v4_dot_topk(spark, sf):
    return R.topk(table(spark, sf, "embeddings"), search_queries(spark, sf), 10, "dot").select("query_id", "vec_id", "similarity", "rank")


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, {SIM} AS s FROM embeddings e JOIN embeddings q ON e.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM h)
SELECT query_id AS req_id, vec_id AS target_id, round(s, 4) AS similarity FROM r WHERE rank <= 5 AND s >= 0.75""")
def j5_similarity_join(spark, sf):
    """Every vector against those of its label (project): the five nearest from 0.75 on."""
    e = table(spark, sf, "embeddings")
    own = kept(R.nearest(e, e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label"), 5, "label", same=True, at_least=K.SEMANTIC_AT_LEAST))
    m = K.by_similarity(own.withColumnRenamed("vec_id", "node_id"))
    return m.join(own.select(F.col("query_id").alias("req_id"), F.col("vec_id").alias("target_id"), F.round("similarity", 4).alias("similarity")), ["req_id", "target_id"]).select("req_id", "target_id", "similarity")


_VECTORS: dict[tuple, VectorIndex] = {}


def stored_vectors(spark, sf) -> VectorIndex:
    """The index of the vectors, made once a session for a table of these files."""
    e = table(spark, sf, "embeddings")
    key = (spark.sparkContext.applicationId, *sorted(e.inputFiles()))
    if key not in _VECTORS:
        index = VectorIndex(spark, f"{shared_folder(spark)}/skein-index/{uuid.uuid4().hex}")
        index.build(e, keep=("label",))
        _VECTORS[key] = index
    return _VECTORS[key]


@query(NEAR_SQL.format(sim=SIM, where="") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 20 AND round(s, 4) >= 0.35")
def v3_stored_index(spark, sf):
    """Limit, then threshold, from stored lists; lists are left out where none of their members can be among the twenty."""
    hits = stored_vectors(spark, sf).search(search_queries(spark, sf), 20)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"), "rank").where("similarity >= 0.35")


@query(NEAR_SQL.format(sim=SIM, where=" AND e.label IN (1, 3, 5)") + " SELECT query_id, vec_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10")
def f1_stored_filtered(spark, sf):
    """The same stored lists again, with a condition on a kept column before the limit."""
    hits = stored_vectors(spark, sf).search(search_queries(spark, sf), 10, where=F.col("label").isin(1, 3, 5))
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"), "rank")


# ------------------------------------------------------------------ words


@query(f"WITH {TOKENS_SQL}, p AS (SELECT unnest(t) AS term FROM toks) SELECT term, count(*) AS df FROM p GROUP BY term")
def ex15_postings(spark, sf):
    return L.postings(L.indexed(table(spark, sf, "documents").select("doc_id", "text"))).groupBy("term").agg(F.count("*").alias("df"))


@query(bm25_sql() + " SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def b1_bm25(spark, sf):
    return lexical_hits(spark, sf, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(bm25_sql("WHERE lang = 'en'") + " SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def f3_bm25_filtered(spark, sf):
    """Statistics are of the whole table, the filter comes after them."""
    return lexical_hits(spark, sf, 10, F.col("lang") == "en").select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


_INDEXES: dict[tuple, TextIndex] = {}


def stored_index(spark, sf) -> TextIndex:
    """The index of the documents, made once a session for a table of these files: half of them, folded into blocks, then the others and once more some of the first as fresh postings."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()))
    if key not in _INDEXES:
        index = TextIndex(spark, f"{shared_folder(spark)}/skein-index/{uuid.uuid4().hex}", buckets=4)
        index.upsert(docs.where("doc_id % 2 = 0 or doc_id % 5 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text"))))
        index.compact()
        index.upsert(docs.where("doc_id % 2 = 1 or doc_id % 5 = 0"))
        _INDEXES[key] = index
    return _INDEXES[key]


@query(bm25_sql() + " SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def b1_stored_index(spark, sf):
    return stored_index(spark, sf).search(questions(spark, sf), 10).select("query_id", F.col("key").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


@query(bm25_sql("WHERE lang = 'en'") + " SELECT query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def f3_stored_filtered(spark, sf):
    """The stored index again; what may be ranked is looked up before candidates are scored."""
    english = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return stored_index(spark, sf).search(questions(spark, sf), 10, english).select("query_id", F.col("key").alias("doc_id"), F.round("score", 4).alias("score"), "rank")


# ------------------------------------------------------------------ fusion

SEM_SQL = f"""sh AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, {SIM} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
sem AS (SELECT query_id, doc_id, round(s, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM sh)"""


def semantic_hits(spark, sf, k):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return R.topk(e, search_queries(spark, sf), k, key="doc_id")


@query(bm25_sql() + f""", {SEM_SQL},
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p, similarity FROM sem WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), NULL FROM lex WHERE rank <= 20)
SELECT query_id, doc_id, round(sum(p), 6) AS rrf, coalesce(max(similarity), 0.0) AS similarity FROM u GROUP BY query_id, doc_id""")
def h1_rrf(spark, sf):
    return R.rrf(semantic_hits(spark, sf, 20), lexical_hits(spark, sf, 20), "doc_id").select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "similarity")


@query(bm25_sql() + f""", {SEM_SQL}, a AS (SELECT query_id, doc_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM sem WHERE rank <= 15 AND similarity >= 0.25),
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p, similarity FROM a UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), NULL FROM lex WHERE rank <= 15),
f AS (SELECT query_id, doc_id, sum(p) AS rrf, coalesce(max(similarity), 0.0) AS similarity FROM u GROUP BY query_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS place FROM f)
SELECT o.query_id, o.doc_id, round(rrf, 6) AS rrf, o.similarity, place::INT AS place FROM o LEFT JOIN (SELECT query_id, doc_id AS d FROM lex WHERE rank = 1) x USING (query_id) WHERE place <= 5 OR o.doc_id = x.d""")
def h2_hybrid_sources(spark, sf):
    return R.hybrid_sources(semantic_hits(spark, sf, 15), lexical_hits(spark, sf, 15), 5, "doc_id").select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "similarity", "place")


@query(bm25_sql() + f""", {SEM_SQL},
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p, similarity FROM sem WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank), NULL FROM lex WHERE rank <= 20),
f AS (SELECT query_id, doc_id, sum(p) AS rrf, coalesce(max(similarity), 0.0) AS similarity FROM u GROUP BY query_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS place FROM f)
SELECT query_id, doc_id, round(rrf, 6) AS rrf, similarity, place::INT AS place FROM o WHERE place <= 5 AND similarity >= 0.35""")
def h3_hybrid_docs(spark, sf):
    return R.hybrid_docs(semantic_hits(spark, sf, 20), lexical_hits(spark, sf, 20), 5, "doc_id").select("query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "similarity", "place")


# ------------------------------------------------------------------ chunks


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, length(text), 2700)) AS s FROM documents WHERE length(text) > 0)
SELECT doc_id AS parent_id, (s // 2700)::INT AS chunk_index, length(substring(text, s + 1, 3000))::INT AS n, md5(substring(text, s + 1, 3000)) AS digest FROM w""")
def ch6_char_windows(spark, sf):
    c = C.exploded(table(spark, sf, "documents"), C.char_windows(F.col("text")))
    return c.select("parent_id", "chunk_index", F.length("content").alias("n"), F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT page_id, string_split(html, chr(10)) AS x FROM pages), w AS (SELECT page_id, x, unnest(range(0, len(x), 34)) AS s FROM l),
c AS (SELECT page_id, 'lines ' || (s + 1) || '-' || least(s + 37, len(x)) AS label, substring(array_to_string(x[s + 1 : s + 37], chr(10)), 1, 3000) AS content FROM w)
SELECT page_id, label, md5(content) AS digest FROM c WHERE trim(content) <> ''""")
def ch7_line_windows(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.explode(C.line_windows(F.col("html"))).alias("w"))
    return p.select("page_id", F.col("w.label").alias("label"), F.md5(F.col("w.content").cast("binary")).alias("digest"))


@query("SELECT doc_id, substring(text, 1, 3000) AS content FROM documents")
def ch8_whole(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.whole(F.col("text"))[0].alias("content"))


@query()
def ch1_chunk_1000(spark, sf):
    return C.exploded(table(spark, sf, "documents"), C.chunk_1000("text"))


@query()
def ch2_paragraphs(spark, sf):
    return C.exploded(table(spark, sf, "documents"), C.split_paragraphs("text"))


@query()
def ch4_chunk_500(spark, sf):
    return C.exploded(table(spark, sf, "documents"), C.chunk_500("text"))


@query()
def ch5_chunk_500_lines(spark, sf):
    return C.exploded(table(spark, sf, "documents"), C.chunk_500_lines("text"))


@query(r"""WITH d AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || '## ') AS t FROM documents),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '(?m)^(#{1,6} )', chr(57344) || '\1', 'g'), chr(57344)), lambda x: trim(translate(x, chr(10) || chr(13) || chr(9), '   ')) <> '') AS parts FROM d),
x AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM p),
w AS (SELECT doc_id, n, part, unnest(range(0, len(part), 2700)) AS s FROM x)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, s) - 1)::INT AS place, CASE WHEN regexp_matches(part, '^#{1,6} ') THEN trim(regexp_extract(part, '^#{1,6} ([^\n]*)', 1)) ELSE '' END AS heading, md5(substring(part, s + 1, 3000)) AS digest FROM w""")
def ch20_sections(spark, sf):
    """Documents whose lines after a sentence's end are headings, by sections."""
    t = F.replace("text", F.lit(".\n"), F.lit(".\n## "))
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(C.sections(t)).alias("place", "s"))
    return s.select("doc_id", "place", "s.heading", F.md5(F.col("s.content").cast("binary")).alias("digest"))


# ------------------------------------------------------------------ text functions


@query("""SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[ğüşıöçĞÜŞİÖÇ]') OR len(list_intersect(regexp_split_to_array(lower(text), '[ \\t\\n\\f\\r\\v]+'),
['nedir','nasıl','için','ile','bir','olan','hangi','yapılır','oluştur','kullan','ayarla','konfigüre'])) > 0) AS turkish FROM documents GROUP BY lang""")
def ex13_language(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.is_turkish(F.col("text"))).alias("turkish"))


@query(r"""SELECT url, substring(c, 1, 40) AS slug, c AS project, substring(CASE WHEN regexp_matches(c, '^[0-9]') THEN 'proj_' || c ELSE c END, 1, 63) AS collection FROM (SELECT url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS c FROM pages)""")
def ex12_identifiers(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("url", T.slug(u).alias("slug"), T.project_id(u).alias("project"), T.collection_name(u).alias("collection"))


@query("SELECT p_partkey, concat_ws(' ', 'COMPONENT', concat('P', p_partkey), nullif(p_name, ''), nullif(p_type, ''), concat('k ', p_brand)) AS text FROM part")
def ex10_node_text(spark, sf):
    n = table(spark, sf, "part").select("p_partkey", F.lit("COMPONENT").alias("node_type"), F.concat(F.lit("P"), "p_partkey").alias("node_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.lit("k"), "p_brand").alias("key_logic"), F.lit("").alias("summary"))
    return n.select("p_partkey", T.node_text_of(n).alias("text"))


@query("""SELECT CASE WHEN contains(lower(source), 'src1') THEN 'one' WHEN contains(lower(source), 'src2') THEN 'two' ELSE 'other' END AS category, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1""")
def f11_category(spark, sf):
    c = T.category(F.col("source"), [("SRC1", "one"), ("src2", "two")], "other")
    return table(spark, sf, "documents").groupBy(c.alias("category")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)")
def ex16_json(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.json_in_text(F.col("props")), "$.k").alias("k")).where("k is not null")


@query("""SELECT doc_id, text || CASE WHEN contains(lower(text), 'the') AND contains(lower(text), 'der') THEN ' | article Artikel' WHEN contains(lower(text), 'the') THEN ' | article' WHEN contains(lower(text), 'der') THEN ' | Artikel' ELSE '' END AS text FROM documents""")
def ex14_augment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.augment(F.col("text"), {"the": "article", "der": "Artikel"}).alias("text"))


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) >= 1000 GROUP BY lang")
def f12_length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.length("text") >= 1000).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'License') AND lang = 'en'")
def f4_contains(spark, sf):
    return table(spark, sf, "documents").where(F.contains("text", F.lit("License")) & (F.col("lang") == "en")).select("doc_id")


@query(f"""WITH h AS (SELECT q.vec_id AS query_id, e.vec_id, {SIM} AS s FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id % 2 = 1 AND q.vec_id % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM h WHERE s >= 0.2) SELECT query_id AS req_id, vec_id AS target_id, round(s, 4) AS similarity, rank::INT AS rank FROM r WHERE rank <= 5""")
def j5_across(spark, sf):
    """Vectors of even ids as requirements, of odd ones as components: the five nearest of a label (project) from 0.2 on, as the vectors are far apart. A neighbour join over the stored lists."""
    q = table(spark, sf, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    hits = stored_vectors(spark, sf).search(q, 5, where=F.col("id") % 2 == 1, at_least=0.2, same="label")
    return hits.select(F.col("query_id").alias("req_id"), F.col("id").alias("target_id"), F.round("similarity", 4).alias("similarity"), "rank")
