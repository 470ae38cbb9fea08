"""Embedding near-dedup by product quantisation.

Vectors are made unit length; equal ones are one from the start. Coarse centroids, fitted on a bounded sample, give inverted lists. A vector's residual
to its centroid is coded by its nearest codeword in each of SUBSPACES subspaces, and the exact length of what the code leaves over (slack) is kept with it.
A query probes the lists in which a partner may be, reads distances to their codes from its asymmetric lookup tables, and keeps those
that its threshold plus the slack cannot rule out: by the triangle inequality that loses no partner in a probed list. These are reranked by exact cosine in double precision.

Which lists are probed: let y be a partner of x in list c, and b the best list of x. As c was the best list of y, x.c >= x.b - (y - x).(c - b). For a
direction of x - y that has nothing to do with the lists this is normal with deviation |x - y| * |c - b| / sqrt(dim); x probes c if x.c >= x.b - MARGIN
deviations. The recall that this gives is measured in the tests.

Every vector is a query and every vector is in a list, so this is a self-join. Lists are cut into blocks of about BLOCK vectors on each side, so a list
with a third of all vectors is many tasks; a block counts links per vector and gives spanning links (at most one a vector), never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, spanning
from .components import components

#: Rows that the index is fitted on at most; all rows are indexed.
SAMPLE_ROWS = 20_000
SUBSPACES, CODES, BLOCK, MARGIN = 8, 256, 2048, 3.5
#: Lists at most; the centroids are broadcast.
LISTS = 1024
ROUNDS = 8


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: np.ndarray  # SUBSPACES x codes x dims of a subspace

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and slack of unit vectors."""
        dots = x @ self.centroids.T
        best = dots.argmax(1)
        residual = x - self.centroids[best]
        parts = residual.reshape(len(x), len(self.codebooks), -1)
        codes, left = np.empty((len(x), len(self.codebooks)), np.uint8), np.zeros(len(x))
        for m, book in enumerate(self.codebooks):
            d = (book**2).sum(1)[None, :] - 2 * parts[:, m] @ book.T
            codes[:, m] = d.argmin(1)
            left += ((parts[:, m] - book[codes[:, m]]) ** 2).sum(1)
        return best, codes, np.sqrt(left)

    def probes(self, x: np.ndarray, radius: float, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists of all probes."""
        dots = x @ self.centroids.T
        best = dots.argmax(1)
        between = np.sqrt(np.maximum(0, 2 - 2 * self.centroids @ self.centroids.T))[best]  # centroids are of unit length
        return np.nonzero(dots >= dots.max(1, keepdims=True) - margin * radius * between / math.sqrt(x.shape[1]))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, dot: bool = False) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        score = x @ c.T if dot else 2 * x @ c.T - (c**2).sum(1)[None, :]
        near = score.argmax(1)
        total = np.stack([np.bincount(near, x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if dot:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(x: np.ndarray, rows: int, seed: int = 11) -> Index:
    """rows: how many vectors will be indexed; the number of lists grows with its square root."""
    rng = np.random.default_rng(seed)
    k = max(1, min(int(math.sqrt(rows) / 8), LISTS, len(x)))
    centroids = _kmeans(x, k, rng, dot=True)
    residual = x - centroids[(x @ centroids.T).argmax(1)]
    m = math.gcd(SUBSPACES, x.shape[1])
    parts = residual.reshape(len(x), m, -1)
    return Index(centroids, np.stack([_kmeans(np.ascontiguousarray(parts[:, i]), min(CODES, len(x)), rng) for i in range(m)]))


def _rows(batch: pa.RecordBatch, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)


def _units(batch: pa.RecordBatch, kind, dim: int) -> np.ndarray:
    x = _rows(batch, "vec", kind).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block(index: Index, cosine: float, kind):
    """Compares a block's queries with a block of one list."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))

    def run(key, queries: pa.Table, stored: pa.Table) -> pa.Table:
        out = {"id": [], "links": [], "to": []}
        if queries.num_rows and stored.num_rows:
            d = index.centroids.shape[1]
            centroid, books = index.centroids[key[0].as_py()], index.codebooks
            x, z = _units(queries, kind, d), _units(stored, kind, d)
            codes, slack = _rows(stored, "codes", np.uint8).reshape(-1, len(books)), stored.column("slack").to_numpy()
            ids, others = queries.column("id").to_numpy(), stored.column("id").to_numpy()
            times = stored.column("times").to_numpy()
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                r = (part - centroid).reshape(len(part), len(books), -1)
                far = np.zeros((len(part), len(z)), np.float32)
                for m, book in enumerate(books):
                    table = (r[:, m] ** 2).sum(1)[:, None] - 2 * r[:, m] @ book.T + (book**2).sum(1)[None, :]
                    far += np.take(table.astype(np.float32), codes[:, m], axis=1)
                near = np.sqrt(np.maximum(far, 0)) <= radius + slack[None, :] + 1e-4
                near &= ids[at : at + 256, None] != others[None, :]
                a, b = np.nonzero(near)
                # Exact cosine of what is left, in bounded blocks.
                sure = np.zeros(near.shape, bool)
                for k in range(0, len(a), 100_000):
                    i, j = a[k : k + 100_000], b[k : k + 100_000]
                    sure[i, j] = np.einsum("ij,ij->i", part[i], z[j]) >= cosine
                count = sure @ times
                some = np.flatnonzero(count)
                out["id"].append(ids[at : at + 256][some])
                out["links"].append(count[some])
                out["to"].append(np.full(len(some), -1))
                u, v = spanning(sure, ids[at : at + 256], others)
                out["id"].append(u)
                out["links"].append(np.zeros(len(u), np.int64))
                out["to"].append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for c, v in out.items()})

    return run


def _hash(seed: int) -> F.Column:
    return F.xxhash64("id", F.lit(seed))


def near_vectors(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", column: str = "embedding", margin: float = MARGIN, block: int = BLOCK, work: Workspace | None = None) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link if their cosine, in double precision, is at least the threshold. n_links counts the other vectors linked directly, copies included;
    component_id is the smallest vec_id reachable. Null or zero vectors, those with null, non-finite or no components, and rows without an id link with nothing.
    Rows that share a vec_id and a vector are copies of each other. Vectors link with those of their length only. An empty table gives no rows.
    """
    work = work or Workspace(vectors.sparkSession, "vectors")
    single = vectors.schema[column].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    good = good.withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x)))).where("most > 0")
    # Doubles are scaled by the largest component, so that no square overflows or vanishes; squares of floats never do.
    good = good.withColumn("unit", F.col("v") if single else F.transform("v", lambda x: x / F.col("most")))
    lengths = [r.d for r in good.groupBy(F.size("unit").alias("d")).count().orderBy(F.desc("count"), "d").collect()]
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Vectors of different lengths have no cosine: each length is a join of its own (tables have one, or a few).
    of = None
    for dim in lengths:
        part = _links_of_length(good.where(F.size("unit") == dim), dim, cosine, kind, margin, block, work)
        of = part if of is None else of.unionByName(part)
    able = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    out = rows.join(of, able & (F.col("v") == F.col("vv")), "left")
    own = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))


def _links_of_length(good: DataFrame, dim: int, cosine: float, kind, margin: float, block: int, work: Workspace) -> DataFrame:
    """(vv, links, c): the links and the component of each distinct vector of one length."""
    spark = good.sparkSession
    copies = work.keep(good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("unit").alias("unit")), "copies")
    n = copies.count()
    first = copies.select("unit").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow().column("unit").combine_chunks()
    sample = first.flatten().to_numpy().reshape(-1, dim)
    index = fit(sample / np.linalg.norm(sample, axis=1, keepdims=True), n)
    shared = spark.sparkContext.broadcast(index)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("unit").flatten().to_numpy().reshape(-1, dim)
            best, codes, slack = shared.value.encode(x / np.linalg.norm(x, axis=1, keepdims=True))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("times"), pa.array(best, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(slack), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names=["id", "times", "list", "codes", "slack", "vec"])

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                row, lists = shared.value.probes(_units(part, kind, dim), radius, margin)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part.column("id").take(pa.array(row)), part.column("vec").take(pa.array(row))], names=["list", "id", "vec"])

    stored = work.keep(copies.select("id", "times", "unit").mapInArrow(to_lists, "id long, times long, list int, codes binary, slack double, vec binary"), "lists")
    asked = stored.select("id", "vec").mapInArrow(to_probes, "list int, id long, vec binary")
    # How many blocks a list has on either side: a table of at most LISTS rows.
    cut = lambda c, name: F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int").alias(name)
    sizes = stored.groupBy("list").agg(F.count("*").alias("n_stored")).join(asked.groupBy("list").agg(F.count("*").alias("n_asked")), "list")
    sizes = F.broadcast(work.keep(sizes.select("list", cut("n_stored", "stored_blocks"), cut("n_asked", "asked_blocks")), "sizes"))
    left = asked.join(sizes, "list").withColumn("qb", F.pmod(_hash(1), "asked_blocks").cast("int")).select("list", "qb", F.explode(F.sequence(F.lit(0), F.col("stored_blocks") - 1)).alias("sb"), "id", "vec")
    right = stored.join(sizes, "list").withColumn("sb", F.pmod(_hash(2), "stored_blocks").cast("int")).select("list", F.explode(F.sequence(F.lit(0), F.col("asked_blocks") - 1)).alias("qb"), "sb", "id", "vec", "times", "codes", "slack")
    compare = lambda k, a, b: _block(shared.value, cosine, kind)(k, a, b)
    found = work.keep(left.groupBy("list", "qb", "sb").cogroup(right.groupBy("list", "qb", "sb")).applyInArrow(compare, "id long, links long, to long"), "found")
    counts = found.where("links > 0").groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("to >= 0").select(F.col("id").alias("a"), F.col("to").alias("b")), work)
    of = copies.select("v", "id", "times").join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    return of.select(F.col("v").alias("vv"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "id").alias("c"))
