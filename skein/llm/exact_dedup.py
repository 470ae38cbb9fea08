"""Exact dedup: a tree-merge of sorted digest runs.

Each scan partition makes one sorted run of its distinct digests. The runs then meet in binomial rounds: there are FAN_IN ** rounds
places, and in round k a place sends the rows whose k-th digest digit is d to the one place of its group whose own
k-th digit is d. Every place merges the FAN_IN sorted pieces it gets into one sorted run and keeps, at every level, one row a
digest: the id that stays and the number of copies. After the last round each place holds one range of all digests,
merged. A group of copies is one row of a run at every level, however many there are, so no task ever meets a hot group.

A digest is SHA-256 of the text's UTF-8 bytes, verified with its length in bytes and an independent 64-bit hash: rows merge only when all three agree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Runs that a place merges at once.
FAN_IN = 8
_RUN = "digest binary, n_bytes long, check_hash long, keep_id long, n long, src int"
_ARROW = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("check_hash", pa.int64()), ("keep_id", pa.int64()), ("n", pa.int64()), ("src", pa.int32())])
_BATCH = 50_000
#: The digest beside columns of any names.
_DIGEST = "_skein_digest"


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with digest columns in place of the text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(t, 256)).alias("digest"), F.octet_length(t).cast("long").alias("n_bytes"), F.xxhash64(t).alias("check_hash"))


def _merged(runs: list[list[tuple]], largest: bool) -> Iterator[tuple]:
    """Merges sorted runs of (digest, n_bytes, check, id, n) into one row a key."""
    pick = max if largest else min
    for key, same in groupby(heapq.merge(*runs, key=itemgetter(0, 1, 2)) if len(runs) > 1 else runs[0], key=itemgetter(0, 1, 2)):
        best, n = None, 0
        for row in same:
            n += row[4]
            if row[3] is not None:
                best = row[3] if best is None else pick(best, row[3])
        yield (*key, best, n)


def _batches(rows: Iterator[tuple], src: int) -> Iterator[pa.RecordBatch]:
    while True:
        part = [r for _, r in zip(range(_BATCH), rows, strict=False)]
        if not part:
            return
        cols = list(zip(*part, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=False)), pa.array([src] * len(part), pa.int32())], schema=_ARROW)


def _first_run(largest: bool):
    """A sorted run of a scan partition. Digests are 32 of a document's bytes, so that a run is a small part of its split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pick, found = max if largest else min, {}
        for b in batches:
            for i, *key in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "n_bytes", "check_hash")), strict=True):
                best, n = found.get(key := tuple(key), (None, 0))
                found[key] = (i if best is None else best if i is None else pick(best, i), n + 1)
        yield from _batches(((*k, *found[k]) for k in sorted(found)), TaskContext.get().partitionId())

    return run


def _merge_round(largest: bool):
    """Merges the sorted pieces that a place has got; src tells which run a row comes from."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[int, list[tuple]] = {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("digest", "n_bytes", "check_hash", "keep_id", "n")]
            for src, *row in zip(b.column("src").to_pylist(), *cols, strict=True):
                runs.setdefault(src, []).append(tuple(row))
        if runs:
            # A piece comes as several blocks where its sender was read in parts; sorting a sorted run costs one pass.
            pieces = [sorted(r, key=itemgetter(0, 1, 2)) for r in runs.values()]
            yield from _batches(_merged(pieces, largest), TaskContext.get().partitionId())

    return merge


def tree_merge(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """(digest, n_bytes, check_hash, keep_id, n): one row a distinct text, over the rows of digests()."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    rounds = max(1, math.ceil(math.log(max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), fan_in) - 1e-9))
    places = fan_in**rounds
    # The place of a digest: its first 6 bytes as a fraction of the digest space.
    home = F.floor(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("double") / F.lit(float(1 << 48)) * places).cast("int")
    runs = rows.mapInArrow(_first_run(largest), _RUN)
    for k in range(rounds):
        unit = fan_in ** (rounds - 1 - k)
        here = F.pmod(F.col("src"), F.lit(places))
        digit = lambda c, unit=unit: F.pmod(F.floor(c / unit), F.lit(fan_in))
        to = (here + (digit(home) - digit(here)) * unit).cast("int")
        runs = runs.repartitionById(places, to).mapInArrow(_merge_round(largest), _RUN)
    return runs.drop("src")


def exact_groups(docs: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty, and empty texts are copies of each other. keep tells which doc_id of a group stays.
    Rows that share a doc_id are one document given twice: each has its row, and all are kept if that id is. Null ids lose to any
    other; a group of null ids only keeps null. An empty table gives no rows; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "exact")
    rows = work.keep(digests(docs), "digests")
    groups = tree_merge(rows, keep, fan_in)
    key = ["digest", "n_bytes", "check_hash"]
    return rows.join(groups, key).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs, all columns, with one row of each group of equal texts.

    The row with the smallest or largest id stays; of rows that share that id, or have none, any one, as their texts are the same. Other columns may have any names.
    """
    work = Workspace(docs.sparkSession, "copies")
    groups = work.keep(exact_groups(docs, keep).withColumnRenamed("text_sha256", _DIGEST), "groups")
    # By id and text: an id may be given with several texts, of which only some are copies.
    key = ["doc_id", _DIGEST]
    t = F.sha2(F.coalesce("text", F.lit("")), 256)
    dropped = groups.where("not kept and doc_id is not null").select(key).distinct()
    repeated = groups.where("kept and doc_id is not null").groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    out = docs.where("doc_id is not null").withColumn(_DIGEST, t).join(dropped, key, "left_anti")
    if repeated.take(1):
        again = out.join(repeated, key, "left_semi")
        out = out.join(repeated, key, "left_anti").unionByName(again.dropDuplicates(key))
    out = out.drop(_DIGEST)
    # Rows without an id stay, one a text, where no row of that text has an id.
    lone = groups.where("keep_id is null").select(_DIGEST).distinct()
    nameless = docs.where("doc_id is null").withColumn(_DIGEST, t).join(lone, _DIGEST, "left_semi").dropDuplicates([_DIGEST]).drop(_DIGEST)
    return out.unionByName(nameless).select(docs.columns)
