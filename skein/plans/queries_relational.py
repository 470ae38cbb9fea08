"""Queries of joins, aggregations, set operations, evaluation and sinks over the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import context as X
from ..operators import evaluation as E
from ..operators import gates as G
from ..operators import graph as Gr
from ..operators import routing as Q
from ..operators.containment import holding
from ..operators.linkage import key_pairs
from ..sources import tables as Tb
from .catalog import query, table

# ------------------------------------------------------------------ aggregations


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang, source")
def a10_category_totals(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH t AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS keyword FROM documents)
SELECT keyword, min(lang) AS project FROM t GROUP BY keyword HAVING count(DISTINCT lang) = 1""")
def a2_unique_signals(spark, sf):
    t = table(spark, sf, "documents").select(F.col("lang").alias("project"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1))).alias("keyword"))
    return Q.unique_signals(t)


@query("""WITH s AS (SELECT concat(user_id, ':', event_id // 1000) AS voter, event_type, count(*) AS w, min(event_id) AS o FROM events GROUP BY 1, 2), m AS (SELECT voter, arg_min(event_type, (-w, o, event_type)) AS event_type, max(w) AS weight, sum(w)::BIGINT AS total FROM s GROUP BY 1)
SELECT voter, event_type, weight, total FROM m WHERE weight / total >= 0.70""")
def a5_dominant_vote(spark, sf):
    """Users vote anew with every thousand events; of equals the type that came first."""
    e = table(spark, sf, "events").select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.floor(F.col("event_id") / 1000).cast("string")).alias("voter"), "event_type", F.lit(1).alias("one"), "event_id")
    return Q.winners(e, "voter", "event_type", "one", order="event_id")


@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, max(CASE WHEN k = floor(n * 0.95) THEN value END) AS p95 FROM p GROUP BY event_type""")
def a11_summary(spark, sf):
    s = E.summary(table(spark, sf, "events"), ["event_type"], "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "least", "most", "p95")


@query("""WITH s AS (SELECT doc_id, 0.7 * quality + 0.3 * (1 - toxic) AS score FROM labels), g AS (SELECT CASE WHEN score >= 0.80 THEN 'A' WHEN score >= 0.65 THEN 'B' WHEN score >= 0.50 THEN 'C' WHEN score >= 0.35 THEN 'D' ELSE 'F' END AS grade FROM s)
SELECT x.grade, count(g.grade) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('F')) x(grade) LEFT JOIN g USING (grade) GROUP BY x.grade""")
def a16_grade_histogram(spark, sf):
    return E.histogram(table(spark, sf, "labels").withColumn("score", 0.7 * F.col("quality") + 0.3 * (1 - F.col("toxic"))))


@query("""SELECT source, count(*) AS n, round(avg(quality), 6) AS quality, sum(toxic)::BIGINT AS toxic, min(n_chars) AS least, max(n_chars) AS most FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def a15_grouped_means(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").alias("toxic"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""WITH h AS (SELECT lang, contains(lower(text), 'tion') OR contains(lower(text), 'ung') AS hit FROM documents) SELECT lang, round(avg(hit::INT), 6) AS hit_rate, round(1 - avg(hit::INT), 6) AS miss_rate FROM h GROUP BY lang""")
def a18_hit_rate(spark, sf):
    h = table(spark, sf, "documents").select("lang", E.has_keywords(F.col("text"), F.array(F.lit("tion"), F.lit("ung")), 1).cast("int").alias("hit"))
    return h.groupBy("lang").agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(1 - F.avg("hit"), 6).alias("miss_rate"))


@query("SELECT source, max_by(doc_id, (n_chars * 1000000000 + doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def a8_max_per_key(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query("SELECT DISTINCT lang FROM documents")
def a19_distinct(spark, sf):
    return table(spark, sf, "documents").select("lang").distinct()


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey")
def a7_distinct_per_key(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"))


@query("""WITH c AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY event_type), w AS (SELECT *, CASE WHEN event_type < 'm' THEN 0.6 ELSE 0.4 END AS w FROM c)
SELECT round(sum(m * w), 6) AS total, count(*) FILTER (m >= 50) AS passed, count(*) FILTER (m < 20) AS failed FROM w""")
def a12_weighted_total(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m")).withColumn("w", F.when(F.col("event_type") < "m", 0.6).otherwise(0.4))
    return c.agg(F.round(F.sum(F.col("m") * F.col("w")), 6).alias("total"), F.count_if(F.col("m") >= 50).alias("passed"), F.count_if(F.col("m") < 20).alias("failed"))


# ------------------------------------------------------------------ joins


@query("""SELECT e.event_id, e.user_id, m.event_id AS last_mark FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts) m
ON e.user_id = m.user_id AND m.ts <= e.ts""")
def j19_as_of(spark, sf):
    e = table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("t"))
    marks = e.join(first, F.col("event_type") == F.col("t")).groupBy("user_id", F.col("ts").alias("mark_ts")).agg(F.max("event_id").alias("mark"))
    return Gr.last_before(e.select("event_id", "user_id", "ts"), marks, "user_id", "ts", "mark_ts", "mark").select("event_id", "user_id", F.col("last_mark"))


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j1_left_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")


@query("""SELECT s_suppkey, s_name, n_name, coalesce(n, 0) AS n_parts, n IS NOT NULL AS used FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def j13_coverage(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "s_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_parts"), F.col("n").isNotNull().alias("used"))


@query("""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)""")
def f6_passages_held(spark, sf):
    """Benchmark passages that stand in documents, by the rarest of their inner words."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("term"))
    return holding(table(spark, sf, "documents"), b, "doc_id", "text", "term").join(b, "term").select("doc_id", "item_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j15_anti(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j16_semi(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS key FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand""")
def j8_self_join(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("key"), F.col("p_brand").alias("brand"))
    return key_pairs(p, ["key"], ["brand"], lambda p, q: p["brand"] != q["brand"]).select("a", "b", "key")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def a1_pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# ------------------------------------------------------------------ sets and upserts


@query("""SELECT doc_id, 'both' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'labels' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def u3_catalog_difference(spark, sf):
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("documents"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("labels")))


@query("""WITH x AS (SELECT item_id AS id, text, 0 AS p FROM benchmark UNION ALL SELECT doc_id, text, 1 FROM documents) SELECT id, arg_min(text, p) AS text FROM x GROUP BY id""")
def u1_first_wins(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return Tb.first_wins([b, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")], "id").select("id", "text")


@query("""SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""")
def sk1_upsert(spark, sf):
    """Through a store: the labels are a segment of their own behind the documents."""
    import uuid

    s = Tb.Store(spark, f"{Tb.shared_folder(spark)}/skein-stores/upsert-{uuid.uuid4().hex}", "doc_id long, quality int", ["doc_id"])
    s.write(table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality")))
    s.upsert(table(spark, sf, "labels").select("doc_id", "quality"))
    return s.read()


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def sk3_latest_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    last = Gr.latest(e.select("user_id", "event_type", "event_id"), ["user_id"], "event_id")
    return last.join(e.groupBy("user_id").agg(F.max("ts").alias("ts")), "user_id").select("user_id", "event_type", "event_id", "ts")


# ------------------------------------------------------------------ evaluation, routing, context


@query("""WITH h AS (SELECT e.label AS case_id, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS rank, e.vec_id % 3 = 0 AS relevant FROM embeddings e), r AS (SELECT * FROM h WHERE rank <= 5)
SELECT case_id, coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0.0) AS rr, sum(relevant::INT)::DOUBLE / count(*) AS precision, least(1.0::DOUBLE, sum(relevant::INT)::DOUBLE / 2) AS recall, sum(relevant::INT) > 0 AS hit FROM r GROUP BY case_id""")
def e1_retrieval_metrics(spark, sf):
    w = Window.partitionBy("label").orderBy("vec_id")
    r = table(spark, sf, "embeddings").select(F.col("label").alias("case_id"), F.row_number().over(w).alias("rank"), (F.col("vec_id") % 3 == 0).alias("relevant")).where("rank <= 5")
    return E.retrieval(r, total=F.lit(2))


@query("""WITH s AS (SELECT conv_id, turn, text, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'and') THEN 1 ELSE 0 END) / 2 AS t, CASE WHEN contains(lower(text), 'ing') THEN 1 ELSE 0 END AS v FROM conversations),
x AS (SELECT conv_id, turn, (0.5 * t + 0.35 * v + 0.15) * CASE WHEN length(text) < 80 THEN 0.5 ELSE 1 END AS score FROM s)
SELECT conv_id, turn, round(score, 4) AS score, CASE WHEN score >= 0.80 THEN 'A' WHEN score >= 0.65 THEN 'B' WHEN score >= 0.50 THEN 'C' WHEN score >= 0.35 THEN 'D' ELSE 'F' END AS grade FROM x""")
def e3_answer_score(spark, sf):
    none = F.array().cast("array<string>")
    s = table(spark, sf, "conversations").withColumn("score", E.answer_score(F.col("text"), F.array(F.lit("the"), F.lit("and")), F.array(F.lit("ing")), none, F.lit("")))
    return s.select("conv_id", "turn", F.round("score", 4).alias("score"), E.grade(F.col("score")).alias("grade"))


#: Lines of an order as an answer, the order's first lines as its corpus: values, addresses and protocols by key.
SAID = "concat('It has ', CAST(l_quantity AS INT), CASE l_linenumber % 3 WHEN 0 THEN ' KB' WHEN 1 THEN 'bits' ELSE ' stages' END, ' at 0x', {hex}, ' over ', CASE l_partkey % 8 WHEN 0 THEN 'UART' WHEN 1 THEN 'SPI NOR' WHEN 2 THEN 'SPI' WHEN 3 THEN 'CAN  bus' WHEN 4 THEN 'usb 3' WHEN 5 THEN 'Ethernet MAC' WHEN 6 THEN 'i2c' ELSE 'none' END, '.')"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, {SAID.format(hex="lower(hex(l_partkey + 4096))")} AS text FROM lineitem), c AS (SELECT l_orderkey, string_agg(lower(text), ' ' ORDER BY l_linenumber) AS corpus FROM s WHERE l_linenumber <= 2 GROUP BY 1),
a AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS key, lower(text) AS t, coalesce(corpus, '') AS c FROM s LEFT JOIN c USING (l_orderkey) WHERE l_linenumber > 2),
v AS (SELECT key, c, regexp_extract(t, '([0-9]+) ?(bits|kb|stages)', 0) AS value, regexp_extract(t, '([0-9]+) ?(bits|kb|stages)', 1) AS n FROM a),
f AS (SELECT key, 'value' AS kind, value FROM v WHERE NOT contains(c, value) AND NOT contains(c, replace(value, ' ', '')) AND NOT (length(n) >= 2 AND regexp_matches(c, '(^|[^a-z0-9_])' || n || '([^a-z0-9_]|$)')) AND value NOT IN ('32 bit','64 bit','16 bit','8 bit','1 bit','2 bit','1 kb','2 kb','4 kb','50 mhz','100 mhz','200 mhz','1 cycle','2 cycle')
UNION ALL SELECT key, 'address', regexp_extract(t, '0x[0-9a-f]+', 0) FROM a WHERE NOT contains(c, regexp_extract(t, '0x[0-9a-f]+', 0))
UNION ALL SELECT key, 'protocol', p FROM (SELECT key, c, regexp_extract(replace(t, 'spi nor', ''), '\\b(i2s|spi|uart|pcie|can\\s*bus|i2c|mipi|hdmi|displayport|thunderbolt|usb\\s*3|ethernet\\s*mac)\\b', 1) AS p FROM a) WHERE p <> '' AND NOT contains(c, p)) SELECT DISTINCT key, kind, value FROM f""")
def gt8_grounding(spark, sf):
    """The later lines of each order against its first two. Lines are dealt by order as short columns, in parts of a fixed number of lines; texts are made where they meet."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    parts = G.parts_of(lines)
    s = spark.sql(f"SELECT l_orderkey, l_linenumber, {SAID.format(hex='lower(hex(l_partkey + 4096))')} AS text FROM {{lines}}", lines=lines.repartition(parts, "l_orderkey"))
    # As in a join, lines without an order have no first lines.
    first = F.when((F.col("l_linenumber") <= 2) & F.col("l_orderkey").isNotNull(), F.lower("text"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = s.withColumn("first", F.collect_list(first).over(order)).where("l_linenumber > 2")
    return G.ungrounded(a.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), F.col("text").alias("answer"), F.concat_ws(" ", "first").alias("corpus")), parts)


@query("""WITH t AS (SELECT doc_id, source, n_chars, coalesce(sum(n_chars + 50) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents)
SELECT source, doc_id, n_chars, least(n_chars, greatest(0, 20000 - b - 50))::BIGINT AS taken, (b + n_chars + 50)::BIGINT AS running FROM t WHERE k = 1 OR 20000 - b > 200""")
def t3_budget(spark, sf):
    """Documents of a source from the shortest on, each with a heading of 50 characters; the one that crosses the budget is cut."""
    return X.within_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", ["n_chars", "doc_id"], "n_chars", 20_000, F.lit(50))


@query("""SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources FROM documents GROUP BY lang""")
def q10_manifest(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


@query("""SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3""")
def a16_best_three(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").withColumn("n", F.row_number().over(w)).where("n <= 3").select("source", "doc_id", "n_chars")


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, max(CASE WHEN doc_id = 7 THEN 1 ELSE 0 END) = 1 AS has FROM documents")
def sc14_point_lookups(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.bool_or(F.col("doc_id") == 7).alias("has"))


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def sc15_bound_parameter(spark, sf):
    return spark.sql("SELECT doc_id, lang, source FROM {docs} WHERE doc_id = :id", args={"id": 17}, docs=table(spark, sf, "documents"))
