"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(documents(spark, sf_dir).select("doc_id", "text"), keep="largest")


@query("""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio,
         1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM w
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (
  SELECT *, max(level) OVER () AS fill FROM l
), t AS (
  SELECT source, source_size, least(cap, weight * fill) AS target FROM f
), q AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t
), c AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT doc_id, size, q.source_size, target,
       CAST(repeats * size + greatest(0, least(size, words - repeats * q.source_size - before)) AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
""")
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(documents(spark, sf_dir), labels(spark, sf_dir))


@query("""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, low), doc_id) AS component_id, doc_id = coalesce(least(doc_id, low), doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON doc_id = a
""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_groups

    return near_groups(documents(spark, sf_dir), width=4, percent=80)


@query("""
WITH g AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9
), r AS (
  WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a) SELECT a, min(b) AS low FROM reach GROUP BY a
), c AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, low), vec_id) AS component_id, vec_id = coalesce(least(vec_id, low), vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.a LEFT JOIN r ON vec_id = r.a
""")
def op2_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .product_quant import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("""
WITH d AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM d WHERE n > 0 GROUP BY source, lang
""")
def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with a count guessed from their length, then revised to their exact count; those without
    a word are deleted. Every batch is committed twice, as after a retry."""
    from pyspark.sql import functions as F

    from .common import Workspace
    from .rollup import Rollup, count_words, deletes, inserts, revisions

    work = Workspace(spark, "rollup")
    docs = documents(spark, sf_dir)
    guess = F.expr("n_chars div 6")
    counts = work.keep(count_words(docs, extra={"old_tokens": guess}), "counts")
    rollup = Rollup(spark, f"{work.path}/store")
    for _ in range(2):
        rollup.commit("load", inserts(counts.withColumn("n_tokens", F.col("old_tokens"))))
        rollup.commit("recount", revisions(counts))
        rollup.commit("blank", deletes(counts.where("n_tokens = 0")))
    rollup.compact()
    return rollup.totals()


@query("""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS MATERIALIZED (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)
), m AS MATERIALIZED (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)
), x AS (SELECT doc_id, p FROM s JOIN m USING (g) WHERE first < doc_id
), y AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true) AS new FROM x
), z AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM y
), i AS MATERIALIZED (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM z GROUP BY doc_id, island
), k AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER w, 0) AS before, lead(lo) OVER w IS NULL AS last FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
), t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * before + 1, 2 * (lo - before)) || CASE WHEN last THEN substring(h, 2 * hi + 1) ELSE '' END, '' ORDER BY lo) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
""")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


@query()
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_mixing import score_documents

    return score_documents(documents(spark, sf_dir))


_CRC = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda r, b: CASE WHEN xor(r, b) & 1 = 1 THEN xor(xor(r, b) >> 1, 3988292384) ELSE xor(r, b) >> 1 END)"""


@query(f"""
WITH t AS (
  SELECT conv_id, turn, md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS s FROM t GROUP BY conv_id
), c AS (SELECT conv_id, s, conv_id - conv_id % 100 AS base, xor({_CRC}, 4294967295) % 6 AS h FROM own
), r AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.s[1:h], []), c.s[h + 1:]) AS s FROM c LEFT JOIN own b ON b.conv_id = c.base
), p AS MATERIALIZED (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.k), '') AS p, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS n, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)
), v AS MATERIALIZED (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM p GROUP BY d, p
), up AS MATERIALIZED (SELECT v.d, v.p, o.conv_id AS parent, o.d AS pd, o.p AS pp FROM v JOIN p q ON q.conv_id = v.conv_id AND q.d = v.d - 1 JOIN v o ON o.d = q.d AND o.p = q.p
), k AS MATERIALIZED (SELECT pd AS d, pp AS p, count(*) AS n_children FROM up GROUP BY 1, 2
), s AS (SELECT q.d, q.p, CAST(sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * v.n) AS BIGINT) AS saved FROM v LEFT JOIN k USING (d, p) JOIN p q ON q.conv_id = v.conv_id AND q.d <= v.d GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, up.parent AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(ids) AS ends_sha256
FROM v JOIN s USING (d, p) LEFT JOIN k USING (d, p) LEFT JOIN up USING (d, p)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query()
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_alignment import alignment_counts

    return alignment_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .posting_lists import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
