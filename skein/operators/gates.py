"""Trust gates over the nodes of an answer, and the grounding of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import kept, name_of, rank_of

# What counts as a technical value, an address and a protocol, and values that need no source.
VALUE = (
    r"\b(\d+(?:\.\d+)?)\s*"
    r"(?:bit|bits|kb|mb|gb|stage|stages|"
    r"word|words|byte|bytes|cycle|cycles|channel|channels|way|ways|"
    r"line|lines|entry|entries|tap|taps)\b"
)
ADDRESS = r"\b0x[0-9a-fA-F]{4,}\b"
PROTOCOL = (
    r"\b(i2s|spi(?!\s*nor)|uart|pcie|can\s*bus|i2c|mipi|hdmi|displayport|"
    r"thunderbolt|usb\s*3|ethernet\s*mac)\b"
)
BENIGN = ("32 bit", "64 bit", "16 bit", "8 bit", "1 bit", "2 bit", "1 kb", "2 kb", "4 kb", "50 mhz", "100 mhz", "200 mhz", "1 cycle", "2 cycle")

#: Rows of a part, on average: what one task sorts and holds does not grow with the table.
PART = 250_000


def evidenced(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Nodes that a VERIFIED_BY edge joins to evidence, or that point to evidence among the answer's own nodes."""
    proof = all_nodes.where("node_type = 'EVIDENCE'").select(F.col("node_id").alias("to_id"))
    direct = edges.where("edge_type = 'VERIFIED_BY'").join(proof, "to_id", "left_semi").select(F.col("from_id").alias("node_id"))
    own = nodes.where("node_type = 'EVIDENCE'").select(F.col("node_id").alias("to_id"))
    around = edges.join(own, "to_id", "left_semi").select(F.col("from_id").alias("node_id"))
    return nodes.join(direct.unionByName(around).distinct(), "node_id", "left_semi")


def overall_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the weakest of the answer's nodes and edges; an edge that says nothing is MEDIUM, nothing at all is uncertain."""
    e = edges.select(F.coalesce(F.col("confidence"), F.lit("MEDIUM")).alias("confidence"))
    rank = F.coalesce(F.min(rank_of(F.col("confidence"))), F.lit(0))
    return nodes.select("confidence").unionByName(e).agg(name_of(rank).alias("confidence"))


def endpoint_confidence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the weaker of their own and their ends' confidence."""
    ends = edges.select("from_id", "to_id", F.explode(F.array("from_id", "to_id")).alias("node_id"))
    low = ends.join(nodes.select("node_id", "confidence"), "node_id", "left").groupBy("from_id", "to_id").agg(F.min(rank_of(F.col("confidence"))).alias("r"))
    own = edges.select("from_id", "to_id", "edge_type", rank_of(F.coalesce(F.col("confidence"), F.lit("MEDIUM"))).alias("e"))
    return own.join(low, ["from_id", "to_id"]).select("from_id", "to_id", "edge_type", name_of(F.least("e", "r")).alias("confidence"))


def uncertain(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.contains("confidence", F.lit("PARSE_UNCERTAIN")))


def contradictions(nodes: DataFrame, edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """CONTRADICTS edges that touch the answer, but for those of which an end is a component."""
    c = edges.where("edge_type = 'CONTRADICTS'").select("from_id", "to_id")
    mine = nodes.select("node_id")
    touched = c.join(mine, F.col("from_id") == F.col("node_id"), "left_semi").unionByName(c.join(mine, F.col("to_id") == F.col("node_id"), "left_semi")).distinct()
    comps = all_nodes.where("node_type = 'COMPONENT'").select("node_id")
    return touched.join(comps, F.col("from_id") == F.col("node_id"), "left_anti").join(comps, F.col("to_id") == F.col("node_id"), "left_anti")


def superseded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that others supersede, with the list of those in order."""
    by = edges.where("edge_type = 'SUPERSEDES'").groupBy(F.col("to_id").alias("node_id")).agg(F.array_sort(F.collect_set("from_id")).alias("superseded_by"))
    return nodes.join(by, "node_id")


def gate(members: DataFrame, nodes: DataFrame, edges: DataFrame, require_evidence: bool = True) -> DataFrame:
    """One row per answer of members (answer, node_id): superseded, uncertain, gaps and contradictions counted, evidence, overall confidence, and passed, which only fails where evidence is asked for, something is wrong and there is none.

    Superseded nodes are taken out first. Confidence is the weakest of the live nodes and the edges between them; an edge that says nothing is MEDIUM.
    """
    members = members.select("answer", "node_id").distinct()
    old = edges.where("edge_type = 'SUPERSEDES'").select(F.col("to_id").alias("node_id")).distinct()
    # All counts are made of the live nodes, so these are written once.
    live = kept(members.join(old, "node_id", "left_anti").join(nodes.select("node_id", "node_type", "confidence"), "node_id"))
    ids = live.select("answer", "node_id", "node_type")
    implemented = edges.where("edge_type = 'IMPLEMENTS'").select(F.col("to_id").alias("node_id"))
    comps = nodes.where("node_type = 'COMPONENT'").select("node_id")
    c = edges.where("edge_type = 'CONTRADICTS'").select("from_id", "to_id").distinct()
    c = c.join(comps, F.col("from_id") == F.col("node_id"), "left_anti").join(comps, F.col("to_id") == F.col("node_id"), "left_anti")
    touching = c.withColumn("node_id", F.explode(F.array("from_id", "to_id"))).join(ids, "node_id").select("answer", "from_id", "to_id").distinct()
    proof = nodes.where("node_type = 'EVIDENCE'").select(F.col("node_id").alias("to_id"))
    direct = edges.where("edge_type = 'VERIFIED_BY'").join(proof, "to_id", "left_semi").select(F.col("from_id").alias("node_id")).distinct()
    proved = ids.join(direct, "node_id", "left_semi").select("answer", "node_id")
    # One pass over the edges between live nodes: their confidence, and which nodes point to evidence of the answer.
    e = edges.select("from_id", "to_id", rank_of(F.coalesce("confidence", F.lit("MEDIUM"))).alias("r"))
    inner = e.join(ids.select("answer", F.col("node_id").alias("from_id")), "from_id").join(ids.select("answer", F.col("node_id").alias("to_id"), "node_type"), ["answer", "to_id"])
    inner = kept(inner.groupBy("answer", F.when(F.col("node_type") == "EVIDENCE", F.col("from_id")).alias("node_id")).agg(F.min("r").alias("r")))
    proved = proved.unionByName(inner.where("node_id is not null").select("answer", "node_id")).distinct()
    level = live.select("answer", rank_of(F.col("confidence")).alias("r")).unionByName(inner.select("answer", "r")).groupBy("answer").agg(F.min("r").alias("r"))
    out = members.select("answer").distinct()
    for df, name in (
        (members.join(old, "node_id", "left_semi"), "superseded"),
        (live.where(F.contains("confidence", F.lit("PARSE_UNCERTAIN"))), "uncertain"),
        (ids.where("node_type = 'REQUIREMENT'").join(implemented, "node_id", "left_anti"), "gaps"),
        (touching, "contradictions"),
        (proved, "evidence"),
    ):
        out = out.join(df.groupBy("answer").agg(F.count("*").alias(name)), "answer", "left").fillna({name: 0})
    out = out.join(level, "answer", "left").withColumn("confidence", name_of(F.coalesce("r", F.lit(0)))).drop("r")
    wrong = (F.col("uncertain") + F.col("gaps") + F.col("contradictions") > 0) | (F.col("evidence") == 0)
    return out.withColumn("passed", ~(F.lit(require_evidence) & wrong & (F.col("evidence") == 0)))


def parts_of(rows: DataFrame) -> int:
    """So many parts that they have at most PART rows on average, spark.sql.shuffle.partitions at least. The rows are counted; a file's count is in its footer."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))


def ungrounded(answers: DataFrame, parts: int | None = None) -> DataFrame:
    """Of answers (key, answer, corpus) what the corpus does not hold: (key, kind, value), each once. parts: in how many parts these are compared.

    A value is grounded by itself, without its blanks, or by its number alone where that has two characters or more and stands as a word; addresses and protocols by themselves.
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    whole = lambda p, g: F.transform(F.regexp_extract_all(low, F.lit(p), g), lambda v: F.trim(v))
    values = F.zip_with(whole(VALUE, 0), whole(VALUE, 1), lambda v, n: F.struct(F.lit("value").alias("kind"), v.alias("value"), n.alias("number")))
    named = lambda kind, a: F.transform(a, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("").alias("number")))
    every = F.concat(values, named("address", whole(ADDRESS, 0)), named("protocol", whole(PROTOCOL, 1)))
    rows = answers.select("key", F.lower(F.coalesce("corpus", F.lit(""))).alias("c"), F.explode(F.array_distinct(every)).alias("f")).select("key", "c", "f.*")
    word = (F.length("number") >= 2) & F.regexp_like(F.col("c"), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), F.regexp_replace("number", r"\.", r"\\."), F.lit(r"(?![\p{L}\p{N}_])")))
    ok = F.contains("c", F.col("value")) | ((F.col("kind") == "value") & (F.col("value").isin(*BENIGN) | word | F.contains("c", F.replace("value", F.lit(" "), F.lit("")))))
    found = rows.where(~ok).select("key", "kind", "value")
    return (found.repartition(parts, "key", "kind", "value") if parts else found).distinct()
