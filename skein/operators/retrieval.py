"""Vector top-k, and fusion of ranked lists.

Queries are a table of any size, so many questions are one plan: blocks of queries meet blocks of vectors in matrix products, and n a query, group and block are kept before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Queries and vectors of a block, blocks of either that a join is cut into on that account, and components of a block, from which on there are more blocks: so a row is sent a fixed number of times, until blocks are full.
BLOCK_QUERIES, BLOCK_VECTORS, FEW, BLOCK_VALUES = 1000, 10_000, 8, 1 << 22
#: Vectors that queries are compared with at once, similarities and components that are held at once.
COLUMNS, CELLS = 8_192, 1 << 22
RRF_K = 60


def ranked(hits: DataFrame, k: int, group: str = "query_id", by: str = "similarity", key: str = "vec_id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(by), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _sizes(c: pa.ListArray) -> np.ndarray:
    """Lengths of vectors, 0 where there is none."""
    return np.where(c.is_valid().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy()), 0) if len(c) else np.empty(0, int)


def _vectors(c: pa.ListArray, width: int) -> np.ndarray:
    """The vectors in double precision; rows of NaN where there is none or its length differs."""
    out = np.full((len(c), width), np.nan)
    at = np.flatnonzero(_sizes(c) == width)
    if len(at):
        flat, start = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()[:-1]
        out[at] = flat[start[at][:, None] + np.arange(width)[None, :]]
    return out


def _similarities(measure: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if measure == "euclidean":
        return -np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
    return x @ y.T


def _exact(measure: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of rows that belong together, by sums in one order, so that equal vectors are equally similar."""
    return -np.sqrt(((x - y) ** 2).sum(1)) if measure == "euclidean" else (x * y).sum(1)


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first(a: np.ndarray, b: np.ndarray, exact: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each a the n best, ties to the smaller b."""
    order = np.lexsort((b, -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    first = np.arange(len(a)) - np.searchsorted(a, a) < n
    return a[first], b[first], exact[first]


def _best(measure: str, x: np.ndarray, y: np.ndarray, n: int, at_least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of the n nearest rows of y of each row of x, ties to the first rows; those without a similarity come last, with -inf, if no least one is asked for.

    Once n are known, only what comes up to the last of these is looked at.
    """
    found, none = [], (np.empty(0, int), np.empty(0, int), np.empty(0))
    step, some = max(1, CELLS // max(1, min(len(y), COLUMNS))), max(1, CELLS // max(1, x.shape[1]))
    for i in range(0, len(x), step):
        part, have = x[i : i + step], none
        bound = np.full(len(part), -np.inf if at_least is None else at_least)
        for j in range(0, len(y), COLUMNS):
            with np.errstate(invalid="ignore"):
                s = _similarities(measure, part, y[j : j + COLUMNS])
            np.copyto(s, -np.inf, where=np.isnan(s))
            if not j and s.shape[1] > n:
                bound = np.maximum(bound, np.partition(s, s.shape[1] - n, axis=1)[:, -n])
            margin = 1e-9 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0)))
            least = bound - (margin if measure != "euclidean" else 1e-6 * (1 + margin))
            a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            for k in range(0, len(a), some):
                u, v = a[k : k + some], b[k : k + some] + j
                exact = _exact(measure, part[u], y[v])
                ok = exact > -np.inf if at_least is None else exact >= at_least
                have = _first(*(np.concatenate(c) for c in zip(have, (u[ok], v[ok], exact[ok]), strict=True)), n)
            full = np.flatnonzero(np.bincount(have[0], minlength=len(part)) >= n)
            bound[full] = np.maximum(bound[full], have[2][np.searchsorted(have[0], full, "right") - 1])
        if at_least is None:
            number, short = np.bincount(have[0], minlength=len(part)), []
            for r in np.flatnonzero(number < min(n, len(y))):
                if np.isnan(part[r]).all():
                    b = np.arange(min(n, len(y)))
                else:
                    mine = have[1][have[0] == r]
                    b = np.setdiff1d(np.arange(len(y)), mine)[: n - len(mine)]
                short.append((np.full(len(b), r), b, np.full(len(b), -np.inf)))
            have = tuple(np.concatenate(c) for c in zip(have, *short, strict=True))
        found.append((have[0] + i, *have[1:]))
    return tuple(np.concatenate(c) for c in zip(none, *found, strict=True))


def _by_code(code: np.ndarray) -> dict[int, np.ndarray]:
    """Rows of each code from 0 on, in order."""
    order = np.argsort(code, kind="stable")
    codes, start = np.unique(code[order], return_index=True)
    return {int(c): rows for c, rows in zip(codes, np.split(order, start[1:]), strict=True) if c >= 0}


def nearest(
    data: DataFrame, queries: DataFrame, n: int, group: str | None = None, measure: str = "cosine", key: str = "vec_id", vector: str = "embedding", same: bool = False, at_least: float | None = None
) -> DataFrame:
    """The n nearest of each query (query_id, query_vector), within each group if one is named, for any number of queries: (query_id, [group], key, similarity, rank).

    measure: cosine, dot or euclidean (the negated distance). Ties go by key. What has no similarity (a zero vector by cosine, a null one or one of another length) has null and comes last.
    same: the group is a column of the queries too, and only vectors with the query's value count (a null one equals none). at_least: of the n only those of that similarity on.
    """
    size = lambda t, v: t.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(v)), F.lit(1)).alias("w")).first()
    of_q, of_d = size(queries, "query_vector"), size(data, vector)
    blocks = lambda x, rows: max(1, min(FEW, -(-x.n // rows)), -(-x.n * max(x.w, 1) // BLOCK_VALUES))
    q_blocks, d_blocks = blocks(of_q, BLOCK_QUERIES), blocks(of_d, BLOCK_VECTORS)
    number = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    # Vectors travel in single precision if that is what they are in.
    flat = lambda t, v: (F.col(v) if t.schema[v].dataType.simpleString() == "array<float>" else V.double(F.col(v))).alias("v")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), (F.col(group) if same else F.lit(0)).alias("grp"), flat(queries, "query_vector"), number("query_id", q_blocks).alias("qb"), every(d_blocks).alias("db"))
    d = data.select(F.col(key).cast("long").alias("id"), (F.col(group) if group else F.lit(0)).alias("grp"), flat(data, vector), every(q_blocks).alias("qb"), number(key, d_blocks).alias("db"))
    if same:
        q, d = q.where("grp is not null"), d.where("grp is not null")
    kind = d.schema["grp"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            code = right.column("grp").combine_chunks().dictionary_encode(null_encoding="encode")
            lengths, asks = _sizes(left.column("v").combine_chunks()), left.column("v").combine_chunks()
            own = pc.fill_null(pc.index_in(left.column("grp").combine_chunks(), value_set=code.dictionary), -1).to_numpy(zero_copy_only=False) if same else None
            held, vectors = _by_code(code.indices.to_numpy()), right.column("v").combine_chunks()
            for width in np.unique(lengths):
                mine = np.flatnonzero(lengths == width)
                # A query without a vector is like one of which nothing is known.
                x = _vectors(asks.take(pa.array(mine)), int(width)) if width else np.full((len(mine), 1), np.nan)
                y = _vectors(vectors, x.shape[1])
                if measure == "cosine":
                    x, y = _units(x), _units(y)
                asked = _by_code(own[mine]) if same else dict.fromkeys(held, np.arange(len(mine)))
                for g, at in asked.items():
                    a, b, exact = _best(measure, x[at], y[held[g]], n, at_least)
                    found.append((mine[at[a]], held[g][b], exact))
        a, b, exact = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": left.column("query_id").take(pa.array(a)), "grp": right.column("grp").take(pa.array(b)), "id": right.column("id").take(pa.array(b)), "similarity": pa.array(exact, pa.float64(), mask=np.isneginf(exact))})

    part = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInArrow(run, f"query_id long, grp {kind}, id long, similarity double")
    w = Window.partitionBy("query_id", "grp").orderBy(F.desc_nulls_last("similarity"), "id")
    hits = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return hits.withColumnsRenamed({"grp": group, "id": key}) if group else hits.drop("grp").withColumnRenamed("id", key)


def topk(data: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", threshold: float | None = None, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query, rounded to 4 digits. A filter on the data comes first, the threshold on similarity last: after the limit."""
    data = data.where(where) if where is not None else data
    hits = nearest(data, queries, k, None, measure, key, vector).withColumn("similarity", F.round("similarity", 4))
    return hits.where(F.col("similarity") >= threshold) if threshold is not None else hits


def rrf(semantic: DataFrame, lexical: DataFrame, key: str, group: str = "query_id") -> DataFrame:
    """(group, key, rrf, similarity) by reciprocal ranks of two lists with ranks from 1; the similarity is the semantic one, 0 where only the words matched."""
    a = semantic.select(group, key, (1 / (RRF_K + F.col("rank"))).alias("part"), "similarity", F.lit(None).cast("double").alias("bm25"))
    b = lexical.select(group, key, (1 / (RRF_K + F.col("rank"))).alias("part"), F.lit(None).cast("double").alias("similarity"), F.col("score").alias("bm25"))
    return a.unionByName(b).groupBy(group, key).agg(F.sum("part").alias("rrf"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"), F.max("bm25").alias("bm25"))


def hybrid_sources(semantic: DataFrame, lexical: DataFrame, n: int, key: str, group: str = "query_id", threshold: float = 0.25) -> DataFrame:
    """3n candidates each, semantic ones from the threshold on; the n best by fusion, and the first by words also where it is not among them (n + 1 rows)."""
    a = ranked(semantic.where(F.col("rank") <= 3 * n).where(F.col("similarity") >= threshold), 3 * n, group=group, key=key)
    b = lexical.where(F.col("rank") <= 3 * n)
    w = Window.partitionBy(group).orderBy(F.desc("rrf"), key)
    fused = rrf(a, b, key, group).withColumn("place", F.row_number().over(w))
    first = b.where("rank = 1").select(group, F.col(key).alias("first_key"))
    return fused.join(first, group, "left").where((F.col("place") <= n) | (F.col(key) == F.col("first_key"))).drop("first_key")


def hybrid_docs(semantic: DataFrame, lexical: DataFrame, n: int, key: str, group: str = "query_id", threshold: float = 0.35) -> DataFrame:
    """4n candidates each, the n best by fusion, and only then those under the threshold dropped: rows found by words alone never stay."""
    w = Window.partitionBy(group).orderBy(F.desc("rrf"), key)
    fused = rrf(semantic.where(F.col("rank") <= 4 * n), lexical.where(F.col("rank") <= 4 * n), key, group)
    return fused.withColumn("place", F.row_number().over(w)).where((F.col("place") <= n) & (F.col("similarity") >= threshold))
