"""MinHash near-dedup by a chosen-path set similarity join.

A document is the set of its word shingles. Each tree sends a document down the branches of those minwise tokens (i, i-th minhash) that a seeded
hash of the branch and the token chooses, 1 / (similarity * tokens) of them: documents as similar as the threshold then share
one branch at each level on average, less similar ones soon part. Nodes of at most SMALL documents are compared exhaustively, larger ones branch
again. One tree finds a pair at the threshold with probability 0.63 at depth 1 and 0.47 at depth 2. The TREES deep trees alone miss a pair that they
resolve at depth 2 with probability 8e-7, over the agreement of its signatures. The FIRST_TREES trees of depth 1 get no credit: on large tables their nodes are beside unlike documents.

A node that stays large is one of documents that share something very common, such as a passage. Tokens of that do not part its members, and paths through them would go from one large node to the
next. Its members therefore branch by the tokens only that they share with none of HUBS members of the node (as long as they have APART of them): such a token is chosen so often that a pair at the
threshold still shares OFTEN branches on average where all tokens in which it differs are among those, and more otherwise. A member that differs from one of these in fewer than NEAR tokens is a guest of that
one's cluster: guests are compared with it, and each other, exhaustively. Members that are near none, but have fewer than NEAR tokens of their own, branch by all tokens too.

What keeps the work in proportion to the input, also where a third of all documents are copies:
- documents with the same set are one from the start (their smallest id);
- FIRST_TREES first trees of depth 1 link members of large nodes to one member each (a star, not all pairs) where their signatures agree in half of the tokens or more. The components
  of these weak links are clusters, inside which all full sets are compared, exactly and once, in blocks of BLOCK by BLOCK that give spanning links only;
- after that, documents of one cluster are not compared again, and nodes whose documents are all of one cluster are dropped; where a large node is one cluster for the most part, its
  other documents become guests of that cluster: they are compared with it, and each other, in its blocks, and the node is done;
- a node that is still large at the deepest level is compared exhaustively, all members against those outside the cluster of its first member, so nothing is capped;
- nodes meet by joins that adaptive execution may split. No group is collected into a task.

Candidates pass an estimate on the signature (five standard deviations below the threshold) and then the exact test on the full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix64, shingle_sets, slices, spanning, text_arrays
from .components import components

TOKENS, TREES, FIRST_TREES, SMALL, MAX_DEPTH, BLOCK, WEAK = 64, 24, 8, 20, 5, 512, 0.5
#: From APART tokens on that no hub of its node has a document branches by those; below NEAR it is near a hub. How often it branches, but once at depth 2, and by all tokens.
HUBS, APART, NEAR, OFTEN, REPEATS, ALL_REPEATS = 3, 6, 24, 1.25, 2, 2
_SEEDS = np.random.default_rng(0xC4A1).integers(1, 1 << 31, (TOKENS, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACE = np.random.default_rng(0xC4A2).integers(1, 1 << 63, TOKENS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minhashes of a set, 32 bits each: unlike documents hardly ever meet by chance, however many there are."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.empty(TOKENS, np.uint32)
    for k in range(0, len(_SEEDS), 8):
        h = x[None, :] * _SEEDS[k : k + 8, :1]
        h ^= h >> np.uint32(15)
        h *= _SEEDS[k : k + 8, 1:]
        out[k : k + 8] = h.min(1)
    return out


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_arrays(part.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "sig"],
                )

    return run, "doc_id long, n_shingles long, set_key binary, sig binary"


def _chosen(sig: np.ndarray, node: np.ndarray, free: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, child node and token of each branch that the rows take from their nodes: one in `per` of the free tokens."""
    h = mix64(sig.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _PLACE[None, :] + node[:, None])
    row, token = np.nonzero(((h >> np.uint64(32)) < ((1 << 32) / per).astype(np.uint64)[:, None]) & free)
    return row, mix64(h[row, token] + np.uint64(1)), np.uint64(1) << token.astype(np.uint64)


def _unused(used: np.ndarray) -> np.ndarray:
    return (used[:, None] >> np.arange(TOKENS, dtype=np.uint64)[None, :]) & np.uint64(1) == 0


_BRANCHES = "node long, doc long, comp long, used long"


def _branch_rows(node: np.ndarray, part: pa.RecordBatch, rows: np.ndarray, used: np.ndarray) -> pa.RecordBatch:
    doc, comp = (part.column(c).to_numpy()[rows] for c in ("doc", "comp"))
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(doc), pa.array(comp), pa.array(used.view(np.int64))], names=["node", "doc", "comp", "used"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _branches(similarity: float, trees: range, depth: int):
    """Rows of (doc, comp, sig) at a depth of some trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = _signatures(part.column("sig"))
                for t in trees:
                    rows, used = np.arange(len(sig)), np.zeros(len(sig), np.uint64)
                    node = mix64(np.full(len(sig), t + 1, np.uint64))
                    for _ in range(depth):
                        r, node, token = _chosen(sig[rows], node, _unused(used), np.full(len(rows), similarity * TOKENS))
                        rows, used = rows[r], used[r] | token
                    yield _branch_rows(node, part, rows, used)

    return run


def _deeper(similarity: float, repeats: int):
    """Rows of (node, doc, comp, used, sig, hub_comps, hub_sigs) one level further down, in independent repeats; guests have the cluster that they are compared with instead of a node. hub_*: of some members of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lost = (1 - similarity) * TOKENS
        none = pa.scalar(None, pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sig, hubs = _signatures(part.column("sig")), _signatures(part.column("hub_sigs")).reshape(-1, HUBS, TOKENS)
                comps = np.frombuffer(b"".join(part.column("hub_comps").to_pylist()), np.int64).reshape(-1, HUBS)
                node, used = (part.column(c).to_numpy().view(np.uint64) for c in ("node", "used"))
                free, like = _unused(used), hubs == sig[:, None, :]
                apart = (~like & free[:, None, :]).sum(2)
                first, own = apart.argmin(1), free & ~like.any(1)
                n, close = own.sum(1), apart.min(1) < NEAR
                near = np.flatnonzero(close)
                guests = _branch_rows(np.zeros(len(near), np.uint64), part, near, used[near])
                yield guests.append_column("guest_of", pa.array(comps[near, first[near]]))
                # By what no hub has: what may be left of that in a partner, but three tenths at least.
                ways = [(np.flatnonzero(n >= APART), own, np.maximum(n - lost, 0.3 * n) / OFTEN, r) for r in range(repeats)]
                ways += [(np.flatnonzero(~close & (n < NEAR)), free, np.full(len(n), similarity * TOKENS), repeats + r) for r in range(ALL_REPEATS)]
                for x, allowed, per, salt in ways:
                    row, child, token = _chosen(sig[x], mix64(node[x] + np.uint64(salt)), allowed[x], per[x])
                    rows = _branch_rows(child, part, x[row], used[x[row]] | token)
                    yield rows.append_column("guest_of", pa.nulls(rows.num_rows, none.type))

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(*text_arrays(part.column("text")), width)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "shingles"])

    return run


def _agreeing(least: float):
    """Keeps pairs whose signatures agree in at least that share of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_signatures(batch.column(c)) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).mean(1) >= least))

    return run


def _similar(percent: int):
    """Keeps pairs that are similar enough by their full sets sa and sb."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compared(percent: int):
    """Spanning links inside each cluster of a group of rows: w, blk, cross, doc, shingles. If cross, only rows of different blk are compared."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("w", "ascending"), ("blk", "ascending"), ("doc", "ascending")])
        w, blk, doc = (table.column(c).to_numpy() for c in ("w", "blk", "doc"))
        cross = table.column("cross")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        a, b = [], []
        for lo, hi in zip(*_runs(w), strict=True):
            mid = lo + int(np.searchsorted(blk[lo:hi], blk[lo], "right")) if cross else hi
            if hi - lo > 1 and (mid < hi or not cross):
                n = np.array([len(sets[k]) for k in range(lo, hi)])
                common = _overlaps([sets[k] for k in range(lo, hi)])
                i, j = slice(0, mid - lo), slice(mid - lo if cross else 0, hi - lo)
                both = common(i, j)
                linked = 100 * both >= percent * (n[i, None] + n[None, j] - both)
                linked &= doc[lo:mid][:, None] != doc[lo:hi][j][None, :]
                u, v = spanning(linked, doc[lo:mid], doc[lo:hi][j])
                a.append(u)
                b.append(v)
        return pa.table({c: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for c, x in (("a", a), ("b", b))})

    return run


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    at = np.flatnonzero(np.diff(x)) + 1
    return [0, *at.tolist()], [*at.tolist(), len(x)]


def _overlaps(sets: list[np.ndarray]):
    """A function of two ranges of the sets that gives their sizes of intersection, by products of dense blocks of shared shingles."""
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    number = np.cumsum(count > 1) - 1
    row, token = row[shared], number[token[shared]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]

    def of(i: slice, j: slice) -> np.ndarray:
        out = np.zeros((i.stop - i.start, j.stop - j.start), np.float32)
        for k in range(0, int(token[-1]) + 1 if len(token) else 0, 4096):
            x, y = np.searchsorted(token, [k, k + 4096])
            m = np.zeros((len(sets), 4096), np.float32)
            m[row[x:y], token[x:y] - k] = 1
            out += m[i] @ m[j].T
        return out

    return of


class Join:
    """The join over one table of distinct sets: doc (smallest id), n_shingles, sig."""

    def __init__(self, docs: DataFrame, sets: DataFrame, work: Workspace, width: int, percent: int):
        self.docs, self.sets, self.work, self.width, self.percent = docs, sets, work, width, percent
        self.similarity = percent / 100

    def _nodes(self, rows: DataFrame, hubs: int = 1) -> DataFrame:
        """Nodes of at least two documents of different clusters, with their size and first members in hashed orders (hub0, hub0_comp, ...)."""
        first = [F.min(F.struct(F.xxhash64("doc", "node", F.lit(k)).alias("h"), "doc", "comp")).alias(f"_{k}") for k in range(hubs)]
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *first)
        return nodes.where("n > 1 and lo < hi").select("node", "n", *(x for k in range(hubs) for x in (F.col(f"_{k}.doc").alias(f"hub{k}"), F.col(f"_{k}.comp").alias(f"hub{k}_comp"))))

    def _open_nodes(self, large: DataFrame) -> DataFrame:
        """Of large nodes those that are not one cluster for the most part, with their hubs as two binaries: (node, hub_comps, hub_sigs)."""
        names = [f"hub{k}" for k in range(HUBS)]
        of_hub = F.sum(F.when(F.col("comp") == F.col("hub0_comp"), 1).otherwise(0))
        firsts = [F.first(c).alias(c) for h in names for c in (h, f"{h}_comp")]
        nodes = large.groupBy("node").agg(of_hub.alias("same"), F.max("n").alias("n"), *firsts).where("2 * same < n")
        hubs = nodes.select("node", F.posexplode(F.array(*(F.struct(F.col(h).alias("doc"), F.col(f"{h}_comp").alias("comp")) for h in names))).alias("k", "h"))
        signed = hubs.select("node", "k", "h.doc", "h.comp").join(self.sets.select("doc", "sig"), "doc")
        as_bytes = lambda c: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8))))
        of = lambda c: F.concat(*(F.max(F.when(F.col("k") == k, c)) for k in range(HUBS)))
        return signed.groupBy("node").agg(of(as_bytes(F.col("comp"))).alias("hub_comps"), of(F.col("sig")).alias("hub_sigs"))

    def _likely(self, pairs: DataFrame, least: float) -> DataFrame:
        """Pairs whose sizes and signatures do not rule out that similarity."""
        side = lambda x: self.sets.select(F.col("doc").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        if least > WEAK:
            sized = sized.where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)")
        return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(least), "a long, b long")

    def clusters(self) -> DataFrame:
        """(node, component) of documents in clusters by weak links."""
        rows = self.sets.select("doc", F.col("doc").alias("comp"), "sig").mapInArrow(_branches(self.similarity, range(FIRST_TREES), 1), _BRANCHES)
        nodes = self._nodes(rows).select("node", "hub0")
        stars = rows.select("node", "doc").join(nodes, "node").where("doc <> hub0").select(F.col("doc").alias("a"), F.col("hub0").alias("b")).distinct()
        return self.work.keep(components(self._likely(stars, WEAK), self.work), "clusters")

    def candidates(self, trees: range, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of different clusters that meet in a tree and may be similar enough, and guests (node, component) to compare with whole clusters."""
        start = self.sets.select("doc", "sig").join(clusters, F.col("doc") == F.col("node"), "left").select("doc", F.coalesce("component", "doc").alias("comp"), "sig")
        start = self.work.keep(start, "start")
        rows = start.mapInArrow(_branches(self.similarity, trees, 2), _BRANCHES)
        pairs, guests = [], []
        for depth in range(2, MAX_DEPTH + 1):
            live = self.work.keep(rows.join(self._nodes(rows, HUBS), "node"), "live")
            small = live.where(F.col("n") <= SMALL).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("doc", "comp"))).alias("m"))
            two = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.lit(SMALL)), lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b"), (x["comp"] != y["comp"]).alias("new")))))
            pairs.append(small.select(F.explode(F.filter(two, lambda p: p["new"])).alias("p")).select("p.a", "p.b"))
            large = live.where(F.col("n") > SMALL)
            nodes = self.work.keep(self._open_nodes(large), "nodes")
            guests.append(large.join(nodes.select("node"), "node", "left_anti").where("comp <> hub0_comp").select(F.col("doc").alias("node"), F.col("hub0_comp").alias("component")))
            if not nodes.take(1):
                break
            large = large.join(nodes, "node")
            if depth < MAX_DEPTH:
                signed = large.select("node", "doc", "comp", "used", "hub_comps", "hub_sigs").join(self.sets.select("doc", "sig"), "doc")
                signed = signed.select("node", "doc", "comp", "used", "sig", "hub_comps", "hub_sigs")
                rows = self.work.keep(signed.mapInArrow(_deeper(self.similarity, 1 if depth == 2 else REPEATS), _BRANCHES + ", guest_of long"), "rows")
                near = rows.where("guest_of is not null and comp <> guest_of").select(F.col("doc").alias("node"), F.col("guest_of").alias("component")).distinct()
                guests.append(near)
                # A first member without a cluster is one of its own, with its guests.
                guests.append(near.select(F.col("component").alias("node"), "component").distinct())
                rows = rows.where("guest_of is null").drop("guest_of")
            else:
                # Members outside the first member's cluster, against all others.
                q = large.where("comp <> hub0_comp").select("node", F.col("doc").alias("q"), F.col("comp").alias("q_comp"))
                cross = large.join(q, "node").where("comp <> q_comp and (comp = hub0_comp or doc < q)")
                pairs.append(cross.select(F.least("doc", "q").alias("a"), F.greatest("doc", "q").alias("b")))
        found = pairs[0]
        for p in pairs[1:]:
            found = found.unionByName(p)
        of_clusters = clusters.limit(0)
        for g in guests:
            of_clusters = of_clusters.unionByName(g)
        of_clusters = of_clusters.join(clusters, ["node", "component"], "left_anti")
        return self.work.keep(self._likely(found.distinct(), self.similarity - 0.25), "likely"), self.work.keep(of_clusters.distinct(), "guests")

    def links(self, clusters: DataFrame, likely: DataFrame) -> DataFrame:
        """Links confirmed on full sets: spanning ones inside clusters, guests among them, and those of the likely pairs."""
        ids = clusters.select(F.col("node").alias("doc_id")).unionByName(likely.select(F.col("a").alias("doc_id"))).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
        full = self.docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(_full_sets(self.width), "doc long, shingles binary")
        full = self.work.keep(full.dropDuplicates(["doc", "shingles"]), "sets")
        # A cluster of several blocks is compared block by block; small clusters share groups of about BLOCK rows.
        # Only the few clusters of several blocks are joined back, so that a large one meets in no task.
        sizes = clusters.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        several = self.work.keep(sizes.where("blocks > 1"), "several")
        groups = max(1, -(-(clusters.count() - (several.agg(F.sum("m")).first()[0] or 0)) // BLOCK))
        blocks = F.coalesce("blocks", F.lit(1))
        member = clusters.join(several.select("component", "blocks"), "component", "left").select(F.col("component").alias("w"), F.col("node").alias("doc"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("blk"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        member = member.withColumn("o", other).withColumn("cross", F.col("o") != F.col("blk"))
        group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("w"), F.lit(groups))).otherwise(F.xxhash64("w", F.least("o", "blk"), F.greatest("o", "blk")))
        block_rows = member.withColumn("g", group).join(full, "doc").select("g", "w", "blk", "cross", "doc", "shingles")
        inside = block_rows.groupBy("g", "cross").applyInArrow(_compared(self.percent), "a long, b long")
        both = likely.join(full.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
        outside = both.mapInArrow(_similar(self.percent), "a long, b long")
        return self.work.keep(inside.unionByName(outside).distinct(), "links")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, trees: int = TREES, work: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of width-word shingles (A-Z lower-cased; a shorter text is one shingle).
    component_id is the smallest doc_id reachable over links. A null, empty or blank text has no shingles and links with nothing. Rows
    that share a doc_id link if any of them does. A row without an id takes the component of its set, and is not kept unless it has none. An empty table gives no rows.
    """
    work = work or Workspace(docs.sparkSession, "near")
    run, schema = _sketches(width)
    sketches = work.keep(docs.select("doc_id", "text").mapInArrow(run, schema), "sketches")
    by_set = sketches.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("n_shingles"), F.min("sig").alias("sig"))
    sets = work.keep(by_set, "by_set")
    join = Join(docs, sets.where("doc is not null").select("doc", "n_shingles", "sig"), work, width, percent)
    clusters = join.clusters()
    likely, guests = join.candidates(range(FIRST_TREES, FIRST_TREES + trees), clusters)
    comps = components(join.links(clusters.unionByName(guests), likely), work)
    of_set = sets.select("set_key", "doc").join(comps, F.col("doc") == F.col("node"), "left").select("set_key", F.coalesce("component", "doc").alias("c"))
    own = F.coalesce("c", "doc_id")
    return sketches.join(of_set, "set_key", "left").select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with the smallest id of each group of near copies. Rows without an id stay."""
    dropped = near_groups(docs, width, percent).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
