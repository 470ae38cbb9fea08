"""Typed property graphs as two tables: nodes (node_id, node_type, ...) and edges (from_id, to_id, edge_type, ...).

Traversals are frontier loops: each step is a join of the frontier with the edges and an anti join with what was seen, written to the shared folder, so neither lineage nor the
set of seen nodes grows in one place. Nothing is collected.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The closed enumerations of the data model.
NODE_TYPES = ("PROJECT", "REQUIREMENT", "DECISION", "COMPONENT", "CONSTRAINT", "EVIDENCE", "PATTERN", "SOURCE_DOC", "ISSUE")
EDGE_TYPES = ("DECOMPOSES_TO", "MOTIVATED_BY", "ALTERNATIVE_TO", "IMPLEMENTS", "VERIFIED_BY", "CONSTRAINED_BY", "DEPENDS_ON", "ANALOGOUS_TO", "CONTRADICTS", "INFORMED_BY", "REUSES_PATTERN", "SUPERSEDES")
CONFIDENCE = ("PARSE_UNCERTAIN", "MEDIUM", "HIGH")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where none is set, a temporary one of this machine, which is right for a session on one machine only: others must set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = getattr(spark.sparkContext, "_skein_dir", None) or tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext._skein_dir = base
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared folder and read again: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/skein-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ------------------------------------------------------------------ confidence


def rank_of(confidence):
    """0, 1, 2; what is not known counts as uncertain."""
    return F.when(confidence == "HIGH", 2).when(confidence == "MEDIUM", 1).otherwise(0)


def name_of(rank):
    return F.element_at(F.array(*map(F.lit, CONFIDENCE)), rank + 1)


def weakest(rows: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    """The weakest confidence of each group."""
    return rows.groupBy(*by).agg(name_of(F.min(rank_of(F.col(confidence)))).alias("confidence"))


# ------------------------------------------------------------------ writing


def checked_nodes(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known type, and the others."""
    ok = F.col("node_type").isin(*NODE_TYPES)
    return nodes.where(ok), nodes.where(~F.coalesce(ok, F.lit(False)))


def checked_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("edge_type").isin(*EDGE_TYPES)
    return edges.where(ok), edges.where(~F.coalesce(ok, F.lit(False)))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key; the columns of rows."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest)).select(rows.columns)


def upsert_edges(edges: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """One edge a pair of nodes; a later write replaces its type and all else."""
    return latest(edges.unionByName(checked_edges(new)[0]), ["from_id", "to_id"], order)


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and, for ends of edges that are not among them, rows of type UNKNOWN."""
    ends = edges.select(F.col("from_id").alias("node_id")).unionByName(edges.select(F.col("to_id").alias("node_id"))).distinct()
    missing = ends.join(nodes.select("node_id"), "node_id", "left_anti")
    return nodes.unionByName(missing.withColumn("node_type", F.lit("UNKNOWN")), allowMissingColumns=True)


def insert_checked(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges whose ends both exist and that are not there yet, by pair and type."""
    ids = nodes.select("node_id")
    ok = new.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi")
    return ok.join(edges.select("from_id", "to_id", "edge_type"), ["from_id", "to_id", "edge_type"], "left_anti").select(new.columns)


def protected_merge(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges after found ones were written, but for pairs whose edge was made by hand (source other than auto)."""
    manual = edges.where(F.coalesce(F.col("source"), F.lit("")) != "auto").select("from_id", "to_id")
    fresh = found.join(manual, ["from_id", "to_id"], "left_anti")
    old = edges.join(fresh.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return old.unionByName(fresh.dropDuplicates(["from_id", "to_id"]), allowMissingColumns=True)


def patched(nodes: DataFrame, patch: DataFrame, field: str) -> DataFrame:
    """nodes with a field set where the patch (node_id, field) has another value."""
    p = patch.select("node_id", F.col(field).alias("_new"))
    return nodes.join(p, "node_id", "left").withColumn(field, F.coalesce("_new", field)).drop("_new").select(nodes.columns)


def patched_edges(edges: DataFrame, patch: DataFrame, nodes: DataFrame, order: str = "seq") -> DataFrame:
    """edges, one a pair (from_id, to_id), after a patch of wanted ones: a pair that has no edge, or one of another type, gets the patch's; an edge of the wanted type stays as it is.

    Patch rows with an end that is no node are left out, and of several for a pair the last in order counts. Columns that the patch lacks are null in its rows.
    """
    ids = nodes.select("node_id").distinct()
    for end in ("from_id", "to_id"):
        patch = patch.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    new = latest(patch, ["from_id", "to_id"], order).drop(order).join(edges.select("from_id", "to_id", "edge_type"), ["from_id", "to_id", "edge_type"], "left_anti")
    old = edges.join(new.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return old.unionByName(new, allowMissingColumns=True).select(edges.columns)


# ------------------------------------------------------------------ reading


def neighbours(edges: DataFrame, seeds: DataFrame, types: tuple[str, ...] | None = None, direction: str = "out") -> DataFrame:
    """(seed, node_id, edge_type) one step from seeds (node_id); direction out, in or both."""
    e = edges.where(F.col("edge_type").isin(*types)) if types else edges
    s = seeds.select(F.col("node_id").alias("seed")).distinct()
    parts = []
    if direction in ("out", "both"):
        parts.append(e.join(s, F.col("from_id") == F.col("seed")).select("seed", F.col("to_id").alias("node_id"), "edge_type"))
    if direction in ("in", "both"):
        parts.append(e.join(s, F.col("to_id") == F.col("seed")).select("seed", F.col("from_id").alias("node_id"), "edge_type"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def edge(edges: DataFrame, start: str, end: str) -> DataFrame:
    """The edges from one node to another."""
    return edges.where((F.col("from_id") == start) & (F.col("to_id") == end))


def undirected_pairs(hits: DataFrame) -> DataFrame:
    """One row a pair of nodes and type, whichever end the seed was."""
    a, b = F.least("seed", "node_id"), F.greatest("seed", "node_id")
    return hits.groupBy(a.alias("a"), b.alias("b"), "edge_type").agg(F.count("*").alias("times")).drop("times")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _levels(e: DataFrame, roots: DataFrame, depth: int | None) -> list[DataFrame]:
    """(root, node_id, depth) a step after another along distinct edges (from_id, to_id), until one finds nothing."""
    front = kept(roots.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth")).distinct())
    found, level = [front], 0
    while depth is None or level < depth:
        level += 1
        step = front.join(e, F.col("node_id") == F.col("from_id")).select("root", F.col("to_id").alias("node_id"))
        if level == 1:
            # Each root has its own edges only, which are distinct.
            step = step.where("not (root <=> node_id)")
        else:
            step = step.distinct().join(_union(found).select("root", "node_id"), ["root", "node_id"], "left_anti")
        front = kept(step.withColumn("depth", F.lit(level)))
        if not front.take(1):
            break
        found.append(front)
    return found


def _distinct_edges(edges: DataFrame, types: tuple[str, ...] | None) -> DataFrame:
    return kept((edges.where(F.col("edge_type").isin(*types)) if types else edges).select("from_id", "to_id").distinct())


def reach(edges: DataFrame, roots: DataFrame, types: tuple[str, ...] | None = None, depth: int | None = None) -> DataFrame:
    """(root, node_id, depth) of all nodes within so many steps, the root at 0; safe with cycles. Order by depth and id for a walk by levels."""
    return _union(_levels(_distinct_edges(edges, types), roots, depth))


def reach_counts(edges: DataFrame, roots: DataFrame, depth: int, types: tuple[str, ...] | None = None) -> DataFrame:
    """(root, depth, n): how many nodes reach() finds at each depth, without a list of those at the last one: it would be as long as roots times what the hubs that they share lead to.

    Every child of the last nodes but one has an owner among its parents, the one that most roots found. A root that found an owner finds all that it owns, which are only counted. Listed are children that a
    root finds by other parents alone; taken off are those that it found at a lesser depth.
    """
    e = _distinct_edges(edges, types)
    found = _levels(e, roots, depth - 1)
    counts = _union(found).groupBy("root", "depth").agg(F.count("*").alias("n"))
    if len(found) < depth:
        return counts
    seen = _union(found).select("root", "node_id")
    via = kept(found[-1].select("root", F.col("node_id").alias("via")).join(e.select(F.col("from_id").alias("via")).distinct(), "via", "left_semi"))
    by = kept(via.groupBy("via").agg(F.count("*").alias("w")))
    kids = kept(e.join(by, F.col("from_id") == F.col("via")).select("via", F.col("to_id").alias("child"), "w"))
    owners = kept(kids.groupBy("child").agg(F.max(F.struct("w", "via")).alias("o"), F.count("*").alias("n")).select("child", F.col("o.via").alias("owner"), "n"))
    known = via.withColumnRenamed("via", "owner")
    owned = known.join(owners.groupBy("owner").agg(F.count("*").alias("k")), "owner").groupBy("root").agg(F.sum("k").alias("n"))
    light = kids.join(owners.where("n > 1").withColumnRenamed("child", "c"), F.col("child").eqNullSafe(F.col("c"))).where("via <> owner").select("via", "child", "owner")
    listed = kept(via.join(light, "via").select("root", "child", "owner").distinct().join(known, ["root", "owner"], "left_anti"))
    before = seen.withColumnRenamed("node_id", "child")
    again = before.join(owners, "child").join(known, ["root", "owner"], "left_semi").select("root").unionByName(before.join(listed.select("root", "child"), ["root", "child"]).select("root"))
    last = owned.unionByName(listed.groupBy("root").agg(F.count("*").alias("n"))).unionByName(again.groupBy("root").agg((-F.count("*")).alias("n")))
    return counts.unionByName(last.groupBy("root").agg(F.sum("n").alias("n")).where("n > 0").select("root", F.lit(depth).alias("depth"), "n"))


def descend(edges: DataFrame, roots: DataFrame, types: tuple[str, ...] | None = ("DECOMPOSES_TO",)) -> DataFrame:
    """(root, node_id, depth) of all nodes below roots, the root at 0, by path doubling; safe with cycles. The same rows as reach() without a depth.

    The relation of nodes at most 2^k steps apart grows by those exactly 2^k apart joined with itself, as the way to any node between 2^k and 2^(k+1) steps away leads over one of these: rounds grow
    with the logarithm of the depth. It holds every pair of a node and one below it, so it is meant for hierarchies, in which these are few; reach() keeps to what the roots reach.
    """
    e = (edges.where(F.col("edge_type").isin(*types)) if types else edges).where("from_id <> to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.lit(1).alias("d"))
    pairs, far = kept(e.distinct()), 1
    while True:
        long = pairs.where(F.col("d") == far)
        if not long.take(1):
            break
        step = long.select("a", F.col("b").alias("via"), F.col("d").alias("d1")).join(pairs.select(F.col("a").alias("via"), "b", F.col("d").alias("d2")), "via")
        step = step.where("a <> b").select("a", "b", (F.col("d1") + F.col("d2")).alias("d"))
        pairs, far = kept(pairs.unionByName(step).groupBy("a", "b").agg(F.min("d").alias("d"))), 2 * far
    r = roots.select(F.col("node_id").alias("root")).distinct()
    below = r.join(pairs, F.col("root") == F.col("a")).select("root", F.col("b").alias("node_id"), F.col("d").alias("depth"))
    return r.select("root", F.col("root").alias("node_id"), F.lit(0).alias("depth")).unionByName(below)


class _Frontier:
    """What is reached from some nodes, a level at a time: (root, at, path) with the least path by ids. All levels lie in one folder, which is one scan however many they are."""

    def __init__(self, edges: DataFrame, roots: DataFrame, backward: bool):
        self.edges, self.backward, self.level, self.degree = edges, backward, 0, None
        self.path = f"{shared_folder(edges.sparkSession)}/skein-graph/{uuid.uuid4().hex}"
        self._put(roots.select(F.col("root"), F.col("root").alias("at"), F.array("root").alias("path")).distinct())

    def _put(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/level={self.level}")
        self.schema = rows.schema

    def _read(self, path: str) -> DataFrame:
        return self.edges.sparkSession.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(path)

    def last(self) -> DataFrame:
        return self._read(f"{self.path}/level={self.level}")

    def ahead(self, live: DataFrame) -> int:
        """How many edges the next level follows."""
        here = "to_id" if self.backward else "from_id"
        if self.degree is None:
            self.degree = kept(self.edges.groupBy(F.col(here).alias("at")).agg(F.count("*").alias("n")))
        return self.last().select("root", "at").join(live, "root", "left_semi").join(self.degree, "at").agg(F.sum("n")).first()[0] or 0

    def rows_for(self, pairs: DataFrame, end: str) -> int:
        """How many rows pairs get that are joined with the last level by an end."""
        sizes = self.last().groupBy(F.col("root").alias(end)).agg(F.count("*").alias("n"))
        return pairs.groupBy(end).agg(F.count("*").alias("of")).join(sizes, end).agg(F.sum(F.col("n") * F.col("of"))).first()[0] or 0

    def step(self, live: DataFrame) -> None:
        """One level further from the roots (root) that still have to look."""
        here, there = ("to_id", "from_id") if self.backward else ("from_id", "to_id")
        path = F.concat(F.array(there), "path") if self.backward else F.concat("path", F.array(there))
        front = self.last().join(live, "root", "left_semi")
        step = front.join(self.edges, F.col("at") == F.col(here)).select("root", F.col(there).alias("at"), path.alias("path")).groupBy("root", "at").agg(F.min("path").alias("path"))
        step = step.join(self._read(self.path).select("root", "at"), ["root", "at"], "left_anti")
        self.level += 1
        self._put(step)


def shortest_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(start, goal, path): a shortest directed path for each pair (start, goal), however long; the least one by ids. Pairs without a path have no row.

    Two frontiers, one from the starts and one against the edges from the goals, go a level at a time, each time the one that has fewer edges to follow. After i and j levels a pair whose path has i + j steps meets at nodes that are i
    steps from its start and j from its goal; of these the least path is taken, and the pair asks no further. A start or goal none of whose pairs is open stops, and a pair is given up where a side
    finds nothing new.
    """
    e = kept(edges.select("from_id", "to_id").distinct())
    open_pairs = kept(pairs.select("start", "goal").where("start is not null and goal is not null").distinct())
    ahead, back = (_Frontier(e, open_pairs.select(F.col(c).alias("root")), c == "goal") for c in ("start", "goal"))
    out = []
    while open_pairs.take(1):
        left = ahead.last().select(F.col("root").alias("start"), "at", F.col("path").alias("p"))
        right = back.last().select(F.col("root").alias("goal"), "at", F.col("path").alias("q"))
        # A pair goes to all rows of one of its ends, the one that has fewer, and from there to the other end's row of the same node.
        if ahead.rows_for(open_pairs, "start") <= back.rows_for(open_pairs, "goal"):
            both = open_pairs.join(left, "start").join(right, ["goal", "at"])
        else:
            both = open_pairs.join(right, "goal").join(left, ["start", "at"])
        met = both.groupBy("start", "goal").agg(F.min(F.concat("p", F.slice("q", F.lit(2), F.size("q")))).alias("path"))
        out.append(kept(met))
        open_pairs = kept(open_pairs.join(out[-1], ["start", "goal"], "left_anti"))
        side, c = min(((ahead, "start"), (back, "goal")), key=lambda x: x[0].ahead(open_pairs.select(F.col(x[1]).alias("root")).distinct()))
        side.step(open_pairs.select(F.col(c).alias("root")).distinct())
        open_pairs = open_pairs.join(side.last().select(F.col("root").alias(c)).distinct(), c, "left_semi")
    return _union(out) if out else open_pairs.select("start", "goal", F.array("start").alias("path"))


def path_confidence(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The weakest node of each path."""
    on = paths.select("start", "goal", F.explode("path").alias("node_id")).join(nodes.select("node_id", "confidence"), "node_id", "left")
    return weakest(on, ["start", "goal"])


def unlinked(nodes: DataFrame, edges: DataFrame, node_type: str, edge_type: str, end: str) -> DataFrame:
    """Nodes of a type that are no end (from_id or to_id) of an edge of a type: gaps are requirements no IMPLEMENTS points to, orphans components none comes from."""
    used = edges.where(F.col("edge_type") == edge_type).select(F.col(end).alias("node_id"))
    return nodes.where(F.col("node_type") == node_type).join(used, "node_id", "left_anti")


def stale(edges: DataFrame) -> DataFrame:
    """Nodes that another supersedes."""
    return edges.where("edge_type = 'SUPERSEDES'").select(F.col("to_id").alias("node_id")).distinct()


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, type, n) of nodes and edges."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("type")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("type")).agg(F.count("*").alias("n")))


def trees_without_roots(edges: DataFrame, roots: DataFrame, types: tuple[str, ...] = ("DECOMPOSES_TO",)) -> DataFrame:
    """What lies below several roots, once, without the roots themselves."""
    below = descend(edges, roots, types).groupBy("node_id").agg(F.min("depth").alias("depth"))
    return below.join(roots.select("node_id"), "node_id", "left_anti")


def last_before(events: DataFrame, marks: DataFrame, key: str, at: str, mark_at: str, value: str) -> DataFrame:
    """As-of lookup: events with the value of their key's last mark at or before them, null if there is none. One union and a scan that splits hot keys, no inequality join."""
    from .scan import prefix_scan

    e = events.withColumn("_m", F.lit(1)).withColumn("_v", F.lit(None).cast(marks.schema[value].dataType))
    m = marks.select(F.col(key), F.col(mark_at).alias(at), F.col(value).alias("_v"), F.lit(0).alias("_m"))
    both = prefix_scan(e.unionByName(m, allowMissingColumns=True), [key], [at, "_m"], lasts={f"last_{value}": F.col("_v")})
    return both.where("_m = 1").drop("_m", "_v")
