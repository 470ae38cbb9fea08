"""Prefix trie of conversations: every distinct run of first turns is a node with the conversations below it.

Turns become digests at once; no text is shuffled. Equal conversations become one, with how many they are and the hash of their ids, which is read as a sorted stream of id chunks. What is left
is partitioned by the digest of its first turn: each bucket builds dictionary tries inside applyInPandas and sums them up from the leaves, without recursion. A first turn under which more than
GROUP_TURNS turns lie is not built in one place: the turns that all of it shares become a chain of nodes at once, and it is partitioned anew by the turn after these, as often as needed. The
tops of the parts below such a chain are sums by chain, taken level by level from the deepest one. One conversation, as one text elsewhere, is held whole by a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Turns below one first turn that are built in one place, if they are of several conversations, and about how many a bucket has.
GROUP_TURNS, BUCKET_TURNS = 1_000, 100_000
#: Ids that share all but so many low bits are one chunk of a conversation's list of ids.
CHUNK_BITS = 12
#: Bytes of a turn's digest.
SIZE = 16
_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, gid string"


# ---------------------------------------------------------------- conversations


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's (digest, n) in order of turn, null first, ties by digest. Null role or text is empty; rows without a conv_id belong to none."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"))
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).alias("n")).where("conv_id is not null")
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))), lambda x: F.struct(x["digest"].alias("digest"), x["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations (conv_id, turns) whose first turns come from the conversation of a round id: with h = crc32(conv_id as text) mod most, the first h turns of conversation
    conv_id - conv_id % every (all if it has fewer, none if there is none), then the own turns after the first h."""
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.col("head"), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(F.slice(head, F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows with one key: the hash of all their ids, joined by commas, read as a stream."""
    key, row, sha, n = None, None, None, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([row.column("digests"), row.column("sizes"), row.column("id"), pa.array([n]), pa.array([sha.digest()], pa.binary())], names=["digests", "sizes", "id", "n", "ends"])

    for b in batches:
        for i, (k, ids, count) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "ids", "n")), strict=True)):
            if k != key:
                if row is not None:
                    yield done()
                key, row, sha, n = k, b.slice(i, 1), hashlib.sha256(), 0
            sha.update((("," if n else "") + ids).encode())
            n += count
    if row is not None:
        yield done()


def distinct(convs: DataFrame) -> DataFrame:
    """(digests, sizes, id, n, ends): distinct conversations, their smallest id, how many they are and the SHA-256 of their ids."""
    rows = convs.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("digests"), F.col("turns.n").alias("sizes")).withColumn("key", F.unhex(F.md5("digests")))
    ids = F.sort_array(F.collect_list("conv_id"))
    chunks = rows.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.any_value("digests").alias("digests"), F.any_value("sizes").alias("sizes"), ids.alias("ids"))
    chunks = chunks.select("key", "chunk", "digests", "sizes", F.element_at("ids", 1).alias("id"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_joined_ends, "digests binary, sizes array<int>, id long, n long, ends binary")


# ---------------------------------------------------------------- tries in one place


def _tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes below the chains (gid, depth at, smallest id top) that rows hang on, by pointer dictionaries."""
    children, parent, depth, size, low, count, ends, gids = [], [], [], [], [], [], [], []

    def node(above: int, at: int, n: int, gid: str | None) -> int:
        for column, value in ((children, {}), (parent, above), (depth, at), (size, n), (low, None), (count, 0), (ends, None), (gids, gid)):
            column.append(value)
        return len(children) - 1

    roots: dict[str, int] = {}
    for gid, at, top, digests, sizes, first, n, end in zip(*(rows[c].tolist() for c in ("gid", "at", "top", "digests", "sizes", "id", "n", "ends")), strict=True):
        if gid not in roots:
            roots[gid] = node(-1, at, 0, gid)
            low[roots[gid]] = top
        here = roots[gid]
        for k in range(at, len(sizes)):
            turn = digests[SIZE * k : SIZE * (k + 1)]
            below = children[here].get(turn)
            if below is None:
                below = children[here][turn] = node(here, k + 1, int(sizes[k]), gid)
            here = below
            count[here] += n
            low[here] = first if low[here] is None else min(low[here], first)
        ends[here] = end
    # A node is made after the one above it, so the other way round every node comes after all that is below it.
    leaves, saved, out = [0] * len(children), [0] * len(children), []
    for i in reversed(range(len(children))):
        if parent[i] < 0:
            continue
        leaves[i] += not children[i]
        saved[i] += (count[i] - 1) * size[i]
        above = parent[i]
        leaves[above] += leaves[i]
        saved[above] += saved[i]
        out.append((low[i], depth[i], low[above], count[i], len(children[i]), leaves[i], saved[i], ends[i], gids[i] if parent[above] < 0 else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _NODE.split(", ")])


# ---------------------------------------------------------------- the whole


def _common(lo: str, hi: str) -> F.Column:
    """How many turns two runs of digests share at their start."""
    same = f"substring({lo}, {SIZE} * i - {SIZE - 1}, {SIZE}) = substring({hi}, {SIZE} * i - {SIZE - 1}, {SIZE})"
    return F.expr(f"aggregate(sequence(1, greatest(1, least(length({lo}), length({hi})) div {SIZE})), 0L, (k, i) -> if(k = i - 1 and {same}, i, k))").cast("int")


def trie(convs: DataFrame, group_turns: int = GROUP_TURNS, work: Workspace | None = None) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turns as sequences() gives them): conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256. No conversation at all has no node; one without turns is a member of the root.
    """
    spark = convs.sparkSession
    work = work or Workspace(spark, "trie")
    all_of = work.keep(distinct(convs), "distinct")
    # The root: a chain without turns. Members of open chains: gid is the chain, top its smallest id, at its depth.
    total = all_of.agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.sum(F.size("sizes")).alias("turns")).first()
    if total.n is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    chain = "gid string, above string, parent_conv_id long, first int, last int, sizes array<int>, id long, n long"
    chains = [work.keep(spark.createDataFrame([("", None, None, 0, 0, [], total.id, total.n)], chain), "root")]
    members, parts, ended = all_of.select("*", F.lit("").alias("gid"), F.lit(total.id).alias("top"), F.lit(0).alias("at")), [], []
    while True:
        ends_here = F.size("sizes") == F.col("at")
        ended.append(members.where(ends_here).select("gid", "ends"))
        below = members.where(~ends_here).withColumn("above", F.col("gid")).withColumn("gid", F.md5(F.concat(F.unhex("gid"), F.substring("digests", F.col("at") * SIZE + 1, F.lit(SIZE)))))
        weight = below.groupBy("gid").agg(F.sum(F.size("sizes") - F.col("at")).alias("w"), F.count("*").alias("convs"), F.min("digests").alias("lo"), F.max("digests").alias("hi"), F.min("id").alias("id"), F.sum("n").alias("n"))
        large = work.keep(weight.where((F.col("w") > group_turns) & (F.col("convs") > 1)).select("gid", "id", "n", _common("lo", "hi").alias("last"), F.col("lo").alias("digests")), "large")
        if not large.take(1):
            parts.append(below.select(F.col("above").alias("gid"), "top", "at", "digests", "sizes", "id", "n", "ends"))
            break
        parts.append(below.join(large.select("gid"), "gid", "left_anti").select(F.col("above").alias("gid"), "top", "at", "digests", "sizes", "id", "n", "ends"))
        inside = below.join(large.select("gid", F.col("id").alias("low"), "last"), "gid")
        members = work.keep(inside.select("digests", "sizes", "id", "n", "ends", "gid", F.col("low").alias("top"), F.col("last").alias("at"), "above", F.col("top").alias("over"), F.col("at").alias("was")), "members")
        one = members.groupBy("gid").agg(F.any_value(F.struct("above", "over", "was", F.slice("sizes", F.col("was") + 1, F.col("at") - F.col("was")).alias("sizes"))).alias("m"))
        chains.append(work.keep(large.join(one, "gid").select("gid", "m.above", F.col("m.over").alias("parent_conv_id"), (F.col("m.was") + 1).alias("first"), "last", "m.sizes", "id", "n"), "chains"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total.turns) // BUCKET_TURNS))
    first_turn = F.xxhash64("gid", F.substring("digests", F.col("at") * SIZE + 1, F.lit(SIZE)))
    nodes = work.keep(rows.withColumn("bucket", F.pmod(first_turn, F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_tries, _NODE), "nodes")

    tops = nodes.where("gid is not null").select("gid", "n_leaves", "saved_tokens")
    out = nodes.drop("gid")
    sum_of = lambda df, n: df.groupBy("gid").agg(F.count("*").alias(f"c{n}"), F.sum("n_leaves").alias(f"l{n}"), F.sum("saved_tokens").alias(f"s{n}"))
    under = sum_of(tops, 1)
    deeper = None
    for level, ends in zip(reversed(chains), reversed(ended), strict=True):
        both = level.join(under, "gid", "left").join(ends, "gid", "left")
        both = both.join(sum_of(deeper, 2), "gid", "left") if deeper is not None else both.withColumns({c: F.lit(0) for c in ("c2", "l2", "s2")})
        plus = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
        own = lambda k: (F.col("n") - 1) * F.aggregate(F.slice("sizes", k, F.size("sizes")), F.lit(0).cast("long"), lambda x, y: x + y)
        both = work.keep(both.select("*", plus("c1", "c2").alias("n_children"), F.greatest(plus("l1", "l2"), F.lit(1)).alias("n_leaves"), plus("s1", "s2").alias("below")), "summed")
        deeper = both.select(F.col("above").alias("gid"), "n_leaves", (F.col("below") + own(F.lit(1))).alias("saved_tokens"))
        each = both.withColumn("depth", F.explode(F.sequence("first", "last")))
        last, top = F.col("depth") == F.col("last"), F.col("depth") == F.col("first")
        saved = F.col("below") + own(F.col("depth") - F.col("first") + 1)
        out = out.unionByName(
            each.select(
                F.col("id").alias("conv_id"), "depth", F.when(top, F.col("parent_conv_id")).otherwise(F.col("id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", saved.alias("saved_tokens"), F.when(last, F.col("ends")).alias("ends"),
            )
        )
    ends = F.lower(F.hex(F.coalesce("ends", F.unhex(F.sha2(F.lit(""), 256)))))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *(F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), ends.alias("ends_sha256"))


def conversation_trie(turns: DataFrame, group_turns: int = GROUP_TURNS, work: Workspace | None = None) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), with conversations rebuilt as rebuilt() says; columns as trie().

    Turns are in order of turn, null first; ties by a digest of role and text; repeated rows are turns of their own. Null role or text is empty. Rows without a conv_id take no part. Other columns
    may have any names. Long texts count by their digest and their number of code points. An empty table gives no rows.
    """
    work = work or Workspace(turns.sparkSession, "trie")
    return trie(work.keep(rebuilt(sequences(turns)), "rebuilt"), group_turns, work)
