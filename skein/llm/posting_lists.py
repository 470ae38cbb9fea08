"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Vectors become points of a sphere: scaled by the largest norm, with one more coordinate that makes up what a shorter one lacks; a query has the same direction and no such part. The nearest point
of a query is then its largest inner product. Coarse cells (a number that grows with the square root of the table) are fitted on a bounded sample, and each cell gets as many lists as its rows
need, fitted on a bounded sample of it, so lists stay of about LIST_ROWS rows whatever the table's size. Both fits weigh down centroids that draw too many rows.

A vector near a border is kept in several lists: all within BORDER times its smallest distance to a centroid, COPIES at most. A query reads all lists whose distance is within REACH times its
smallest; there is no cap on how many, and where these hold fewer than k other ids it looks wider, in the end in all lists. Centroids are searched through an in-memory neighbour graph whose beam widens until it holds all that the ratio allows. Cells are broadcast (SAMPLE_ROWS
bounds them); the lists' centroids are not: rows go to their cells, in blocks, and meet the cell's graph there. Lists are read in blocks of BLOCK rows on either side, scored by exact products in
double precision. A query reads its nearest list first; from the others only what comes up to the last of the k + 1 best of that list is passed on, and no more than k + 1 vectors a block. Equal vectors are one, with the k + 1 smallest of their ids: no others can be among k neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Rows of a list, rows that cells and that a cell's lists are fitted on at most, rows a block.
LIST_ROWS, SAMPLE_ROWS, BLOCK = 1_000, 20_000, 2_048
#: Ratios of distances within which a vector is stored and a query looks; lists that a vector is in at most.
BORDER, REACH, COPIES = 1.12, 1.18, 4
#: Links of a centroid in the graph, width of the first beam, rounds of a fit.
LINKS, BEAM, ROUNDS = 16, 16, 8


# ---------------------------------------------------------------- centroids


def balanced(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centroids of unit length. A centroid that draws more than its share of rows is weighed down in the next round."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    weight = np.zeros(k)
    for _ in range(ROUNDS if k > 1 else 1):
        near = np.concatenate([(x[i : i + 4096] @ c.T - weight).argmax(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-12, total / np.maximum(size, 1e-12)[:, None], c)
        weight += 0.02 * (n * k / len(x) - 1)
    return c


class Graph:
    """Centroids, each linked with its LINKS nearest ones."""

    def __init__(self, points: np.ndarray):
        self.points = points
        m = len(points)
        self.links = np.zeros((m, min(LINKS, max(0, m - 1))), np.int64)
        for i in range(0, m, 1024):
            dots = points[i : i + 1024] @ points.T
            dots[np.arange(len(dots)), np.arange(i, i + len(dots))] = -np.inf
            self.links[i : i + 1024] = np.argpartition(-dots, self.links.shape[1] - 1, axis=1)[:, : self.links.shape[1]] if m > 1 else 0

    def _beam(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points that a beam finds, and their dots, best first."""
        n, m = len(x), len(self.points)
        rows = np.arange(n)[:, None]
        if 2 * width >= m:
            dots = x @ self.points.T
            order = np.argsort(-dots, axis=1)[:, :width]
            return order, dots[rows, order]
        start = np.linspace(0, m - 1, width).astype(np.int64)
        ids, dots = np.tile(start, (n, 1)), x @ self.points[start].T
        done, seen = np.zeros((n, width), bool), np.zeros((n, m), bool)
        seen[:, start] = True
        while not done.all():
            at = np.where(done, -np.inf, dots).argmax(1)
            live = ~done[rows[:, 0], at]
            done[rows[:, 0], at] = True
            near = self.links[ids[rows[:, 0], at]]
            fresh = ~seen[rows, near] & live[:, None]
            seen[rows, near] |= live[:, None]
            more = np.where(fresh, np.einsum("nd,nkd->nk", x, self.points[near]), -np.inf)
            both, every = np.concatenate([dots, more], 1), np.concatenate([ids, near], 1)
            flags = np.concatenate([done, ~fresh], 1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :width]
            ids, dots, done = every[rows, best], both[rows, best], flags[rows, best]
        return ids, dots

    def within(self, x: np.ndarray, ratio: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, points and distances: all points within `ratio` times the smallest distance (the `most` nearest of them; all points for an infinite ratio)."""
        width = min(len(self.points), max(BEAM, most or 0))
        while True:
            ids, dots = self._beam(x, width)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots))
            limit = np.full((len(x), 1), np.inf) if math.isinf(ratio) else far[:, :1] * ratio + 1e-9
            if width == len(self.points) or (most and width >= most) or (far[:, -1:] > limit).all():
                break
            width = min(len(self.points), 4 * width)
        ok = far <= limit
        if most:
            ok[:, most:] = False
        r, c = np.nonzero(ok)
        return r, ids[r, c], far[r, c]


# ---------------------------------------------------------------- vectors


class Sphere:
    """Vectors of one length as points of the unit sphere. scale: the largest size of a component; norm: the largest norm of a vector divided by it."""

    def __init__(self, dim: int, scale: float, norm: float, kind):
        self.dim, self.scale, self.norm, self.kind = dim, scale, norm, kind

    def raw(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.kind).astype(np.float64).reshape(-1, self.dim)

    def stored(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale / self.norm
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1, keepdims=True)))], 1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        x = x / np.abs(x).max(1, keepdims=True)
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], 1)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components, as a plain loop does."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def best_of(x: np.ndarray, z: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of z and products of at least each row's bound: the k largest of each row of x, and all that equal the last of these."""
    fast, low = x @ z.T, bound
    if k < len(z):
        low = np.maximum(low, np.partition(fast, len(z) - k, axis=1)[:, len(z) - k])
    size = np.linalg.norm(x, axis=1) * np.linalg.norm(z, axis=1).max()
    r, c = np.nonzero(~(fast < (low - 1e-12 * size)[:, None]))
    score = products(x[r], z[c])
    ok = ~(score < bound[r])
    return r[ok], c[ok], score[ok]


# ---------------------------------------------------------------- index


def _routed(sphere: Sphere, cells: Graph, reach: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = sphere.raw(part.column("vec"))
                r, cell, _ = cells.within(sphere.asked(x), reach * 1.05) if reach else cells.within(sphere.stored(x), BORDER, COPIES)
                first = np.concatenate([[True], r[1:] != r[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *(part.column(c).take(pa.array(r)) for c in ("uid", "vec", "ids")), pa.array(first)], names=["cell", "uid", "vec", "ids", "first"])

    return run


def _fitted(sphere: Sphere):
    def run(key, rows: pa.Table) -> pa.Table:
        x = sphere.stored(sphere.raw(rows.column("vec")))
        c = balanced(x, max(1, min(len(x), -(-rows.column("n")[0].as_py() // LIST_ROWS))))
        return pa.table({"cell": pa.array([key[0].as_py()] * len(c), pa.int32()), "place": pa.array(range(len(c)), pa.int32()), "centroid": [v.tobytes() for v in c]})

    return run


def _listed(sphere: Sphere, reach: float | None):
    """Rows of a cell's block with the lists of that cell in which they may lie."""

    def run(key, rows: pa.Table, centroids: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and centroids.num_rows:
            centroids = centroids.sort_by("place")
            graph = Graph(np.frombuffer(b"".join(centroids.column("centroid").to_pylist())).reshape(-1, sphere.dim + 1))
            for at in range(0, rows.num_rows, 512):
                part = rows.slice(at, 512)
                x = sphere.raw(part.column("vec"))
                r, place, far = graph.within(sphere.asked(x), reach) if reach else graph.within(sphere.stored(x), BORDER, COPIES)
                part = part.take(pa.array(r))
                out.append(pa.table({"list": pa.array((key[0].as_py() << 32) + place, pa.int64()), "far": far, "uid": part.column("uid"), "vec": part.column("vec"), "ids": part.column("ids")}))
        return pa.concat_tables(out) if out else pa.table({"list": pa.array([], pa.int64()), "far": pa.array([], pa.float64()), "uid": pa.array([], pa.int64()), "vec": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int64()))})

    return run


_LISTED = "list long, far double, uid long, vec binary, ids array<long>"


def _scored(sphere: Sphere, k: int):
    def run(key, queries: pa.Table, stored: pa.Table) -> pa.Table:
        found = ([], [], [])
        if queries.num_rows and stored.num_rows:
            x, z = sphere.raw(queries.column("vec")), sphere.raw(stored.column("vec"))
            low, bound = np.array([v[0] for v in stored.column("ids").to_pylist()]), queries.column("bound").to_numpy()
            for at in range(0, len(x), 256):
                r, c, score = best_of(x[at : at + 256], z, k + 1, bound[at : at + 256])
                order = np.lexsort((low[c], -score, r))
                r, c, score = r[order], c[order], score[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                for to, v in zip(found, (r[place <= k] + at, c[place <= k], score[place <= k]), strict=True):
                    to.append(v)
        r, c, score = (np.concatenate(f) if f else np.empty(0, kind) for f, kind in zip(found, (np.int64, np.int64, float), strict=True))
        return pa.table({"query": queries.column("uid").take(pa.array(r, pa.int64())), "uid": stored.column("uid").take(pa.array(c, pa.int64())), "score": pa.array(score, pa.float64()), "ids": stored.column("ids").take(pa.array(c, pa.int64()))})

    return run


class Index:
    """Posting lists of the vectors of one length, written to the work folder. items: distinct vectors (uid, vec, ids)."""

    def __init__(self, items: DataFrame, sphere: Sphere, work: Workspace):
        self.items, self.sphere, self.work = items, sphere, work
        self.n = items.count()
        sample = items.select("vec").orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE_ROWS).toArrow().column("vec").combine_chunks()
        points = sphere.stored(sphere.raw(sample))
        k = max(1, min(math.ceil(math.sqrt(self.n / LIST_ROWS)), SAMPLE_ROWS // 8, len(points)))
        self.cells = Graph(balanced(points, k))
        routed = work.keep(items.mapInArrow(self._route(None), "cell int, uid long, vec binary, ids array<long>, first boolean"), "routed")
        own = routed.where("first")
        sizes = own.groupBy("cell").agg(F.count("*").alias("n"))
        w = Window.partitionBy("cell").orderBy(F.xxhash64("uid"), "uid")
        some = own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= SAMPLE_ROWS).join(sizes, "cell").select("cell", "vec", "n")
        self.centroids = work.keep(some.groupBy("cell").applyInArrow(lambda k, t: _fitted(sphere)(k, t), "cell int, place int, centroid binary"), "centroids")
        near = self._near(routed, None)
        w = Window.partitionBy("uid")
        best = near.withColumn("least", F.min("far").over(w)).where(F.col("far") <= F.col("least") * BORDER + 1e-9)
        best = best.withColumn("place", F.row_number().over(w.orderBy("far", "list"))).where(F.col("place") <= COPIES)
        self.lists = work.keep(best.select("list", "uid", "vec", "ids"), "lists")
        self.sizes = work.keep(self.lists.groupBy("list").agg(F.count("*").alias("n_stored")), "sizes")

    def _route(self, reach: float | None):
        sphere, shared = self.sphere, self.items.sparkSession.sparkContext.broadcast(self.cells)
        return lambda batches: _routed(sphere, shared.value, reach)(batches)

    def _near(self, routed: DataFrame, reach: float | None) -> DataFrame:
        """Rows at the lists of their cells; a cell's rows come in blocks, each with all centroids of the cell."""
        sphere = self.sphere
        blocks = routed.groupBy("cell").agg(F.ceil(F.count("*") / (8 * BLOCK)).cast("int").alias("blocks"))
        rows = routed.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int")).select("cell", "block", "uid", "vec", "ids")
        known = self.centroids.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "place", "centroid")
        return rows.groupBy("cell", "block").cogroup(known.groupBy("cell", "block")).applyInArrow(lambda k, a, b: _listed(sphere, reach)(k, a, b), _LISTED)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, uid, score, ids): the best k + 1 distinct vectors found for each of the distinct queries (uid, vec, ids). Queries whose lists hold fewer ids than there are ask again, more widely."""
        there = self.items.agg(F.sum(F.size("ids"))).first()[0] or 0
        out = None
        for reach in (REACH, 2 * REACH - 1, 4 * REACH - 3, math.inf):
            found = self.work.keep(self._within(queries, k, reach), "found")
            full = found.groupBy("query").agg(F.sum(F.size("ids")).alias("n")).where(F.col("n") >= min(k + 1, int(there))).select("query") if reach < math.inf else found.select("query").distinct()
            done = found.join(full, "query", "left_semi")
            out = done if out is None else out.unionByName(done)
            queries = self.work.keep(queries.join(full, F.col("uid") == F.col("query"), "left_anti"), "short")
            if not queries.take(1):
                break
        return out

    def _within(self, queries: DataFrame, k: int, reach: float) -> DataFrame:
        sphere, work = self.sphere, self.work
        routed = work.keep(queries.mapInArrow(self._route(reach), "cell int, uid long, vec binary, ids array<long>, first boolean"), "asked")
        w = Window.partitionBy("uid")
        near = self._near(routed, reach).withColumn("least", F.min("far").over(w)).withColumn("place", F.row_number().over(w.orderBy("far", "list")))
        asked = work.keep((near.where(F.col("far") <= F.col("least") * reach + 1e-9) if reach < math.inf else near).select("list", "place", "uid", "vec"), "probes")
        first = work.keep(self._top(self._read(asked.where("place = 1").withColumn("bound", F.lit(-math.inf)), k), k), "first")
        bound = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("bound")).where(F.col("n") > k).select(F.col("query").alias("uid"), "bound")
        rest = asked.where("place > 1").join(bound, "uid", "left").withColumn("bound", F.coalesce("bound", F.lit(-math.inf)))
        return self._top(first.unionByName(self._read(rest, k)), k)

    def _read(self, asked: DataFrame, k: int) -> DataFrame:
        """What queries (list, uid, vec, bound) find in their lists, block by block."""
        sphere = self.sphere
        cut = lambda c, name: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int").alias(name)
        sizes = self.sizes.join(asked.groupBy("list").agg(F.count("*").alias("n_asked")), "list").select("list", cut("n_stored", "stored_blocks"), cut("n_asked", "asked_blocks"))
        left = asked.join(sizes, "list").withColumn("qb", F.pmod(F.xxhash64("uid", F.lit(1)), "asked_blocks").cast("int")).select("list", "qb", F.explode(F.sequence(F.lit(0), F.col("stored_blocks") - 1)).alias("sb"), "uid", "vec", "bound")
        right = self.lists.join(sizes, "list").withColumn("sb", F.pmod(F.xxhash64("uid", F.lit(2)), "stored_blocks").cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("asked_blocks") - 1)).alias("qb"), "sb", "uid", "vec", "ids")
        return left.groupBy("list", "qb", "sb").cogroup(right.groupBy("list", "qb", "sb")).applyInArrow(lambda key, a, b: _scored(sphere, k)(key, a, b), "query long, uid long, score double, ids array<long>")

    def _top(self, found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1), "uid")
        return found.dropDuplicates(["query", "uid"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1).drop("place")


def nearest(vectors: DataFrame, asked: Column | str = "vec_id % 20 = 0", k: int = 20, key: str = "vec_id", column: str = "embedding", work: Workspace | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asked` names (a condition on vec_id) its k nearest found by inner product, all others if there are fewer; ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors meet those of their length only. Rows that agree in id and vector are
    one; rows of one id and different vectors are candidates of their own (and of each other), each with its own k neighbours. Scores are sums in double precision, in the order of components,
    of the original values; one that overflows is infinite. Other columns may have any names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "nearest")
    asked = F.expr(asked) if isinstance(asked, str) else asked
    single = vectors.schema[column].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<float>" if single else "array<double>").alias("v"))
    fit = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    good = rows.where(fit).dropDuplicates(["vec_id", "v"])
    w = Window.partitionBy("v").orderBy("vec_id")
    few = good.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    packed = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).mapInArrow(_packing(kind), "dim int, most double, vec binary, ids array<long>")
    items = work.keep(packed.withColumn("uid", F.monotonically_increasing_id()), "items")
    out = None
    for dim, most in sorted((r.dim, r.most) for r in items.groupBy("dim").agg(F.max("most").alias("most")).collect()):
        part = items.where(F.col("dim") == dim)
        norm = part.mapInArrow(_norms(dim, most, kind), "norm double").agg(F.max("norm")).first()[0]
        index = Index(part.select("uid", "vec", "ids"), Sphere(dim, most, norm, kind), work)
        # All queries with an equal vector are one search. A query that is not among the first ids of its vector finds it by that vector.
        owners = good.where(asked & (F.size("v") == dim)).mapInArrow(_owners(kind), "query_id long, vec binary")
        owners = work.keep(owners.join(part.select("uid", "vec"), "vec").select("query_id", "uid"), "owners")
        found = index.search(part.join(owners.select("uid").distinct(), "uid", "left_semi").select("uid", "vec", "ids"), k)
        flat = found.select("query", "uid", "score", F.explode("ids").alias("vec_id"))
        ranked = flat.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid"))).where(F.col("place") <= k + 1)
        lists = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", (F.col("uid") == F.col("query")).alias("same")))).alias("found"))
        each = owners.join(lists, F.col("uid") == F.col("query")).select("query_id", F.expr("slice(filter(found, x -> not (x.same and x.vec_id = query_id)), 1, %d)" % k).alias("found"))
        each = each.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
        out = each if out is None else out.unionByName(each)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _packing(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.array(v, kind) for v in b.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in rows], pa.int32()), pa.array([float(np.abs(v).max()) for v in rows], pa.float64()), pa.array([(v + kind(0)).tobytes() for v in rows], pa.binary()), b.column("ids")], names=["dim", "most", "vec", "ids"])

    return run


def _owners(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([(np.array(v, kind) + kind(0)).tobytes() for v in b.column("v").to_pylist()], pa.binary())], names=["query_id", "vec"])

    return run


def _norms(dim: int, most: float, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("vec").to_pylist()), kind).astype(np.float64).reshape(-1, dim) / most
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(x, axis=1))], names=["norm"])

    return run
