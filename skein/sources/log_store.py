"""A keyed table as a log: each write adds a segment of what changed, readers merge segments, compaction folds them.

    data/<segment>/_bucket=<n>/...   rows of one write by bucket of their keys' hash; a row with _deleted is a tombstone
    log/<version>/manifest           the version's state: for each bucket its base segment and the segments after it, in order

A version is a folder that is written aside and renamed to its number. A number is taken once: the rename fails where the folder is there (on a file system whose rename moves into it
instead, the manifest read back is another's). So a writer that dies at any point leaves the old version or the new one, never a part, and of two writers one goes first and the other puts its
segment behind, or looks again at what it had read. What dead writers leave behind no manifest names; vacuum() removes it.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store, and segments after its base that a bucket has at most before it is folded.
BUCKETS, DELTAS = 16, 8
_EMPTY = {"buckets": {}, "streams": {}}


class LostRace(Exception):
    """Another writer took the version, and what this one had read may no longer hold."""


class Files:
    """The few file operations that a log needs, on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.conf, self.base = spark._jvm, spark._jsc.hadoopConfiguration(), base
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def names(self, *parts: str) -> list[str]:
        where = self.at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def read(self, *parts: str) -> str | None:
        if not self.fs.exists(self.at(*parts)):
            return None
        stream = self.fs.open(self.at(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        out = self.fs.create(self.at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def take(self, text: str, *parts: str) -> bool:
        """Makes a folder with a manifest of this text, whole or not at all; False if there is such a folder."""
        aside = ("aside", uuid.uuid4().hex)
        self.write(text, *aside, "manifest")
        self.fs.mkdirs(self.at(*parts[:-1]))
        try:
            if not self.fs.exists(self.at(*parts)):
                self.fs.rename(self.at(*aside), self.at(*parts))
        except Exception as e:
            if "exist" not in str(e).lower():
                raise
        mine = self.read(*parts, "manifest") == text
        if not mine:
            self.delete(*aside)
        return mine


class Store:
    """A keyed table in a folder. Rows of equal keys replace each other, null keys being equal to null. Schema: column names and types; keys: some of these."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS, deltas: int = DELTAS):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.columns = spark.createDataFrame([], schema).columns
        self.buckets, self.deltas = buckets, deltas
        self.files = Files(spark, self.path)

    # -------------------------------------------------------------- versions

    def version(self) -> int:
        """The newest version, 0 if nothing was written."""
        return max((int(n) for n in self.files.names("log") if n.isdigit()), default=0)

    def _state(self, version: int) -> dict:
        return json.loads(self.files.read("log", f"{version:012d}", "manifest")) if version else _EMPTY

    def _commit(self, change: Callable[[dict], dict | None], read: int | None = None) -> bool:
        """Makes the next version of what `change` makes of the newest; no version if it gives None. read: the version that the change was worked out from, if it holds for no other."""
        while True:
            now = self.version()
            if read is not None and now != read:
                raise LostRace(f"{self.path}: version {now} came after {read} was read")
            state = change(self._state(now))
            if state is None:
                return False
            if self.files.take(json.dumps(state | {"id": uuid.uuid4().hex}), "log", f"{now + 1:012d}"):
                return True

    def _again(self, work: Callable[[int], None]) -> None:
        """Works on a version, anew where another writer came first."""
        while True:
            try:
                return work(self.version())
            except LostRace:
                continue

    # -------------------------------------------------------------- segments

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _segment(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Writes rows (with _deleted) as a segment: its name and its buckets. Adaptive execution cuts large buckets and joins small ones."""
        name = uuid.uuid4().hex
        rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        return name, [n.removeprefix("_bucket=") for n in self.files.names("data", name) if n.startswith("_bucket=")]

    def _scan(self, where: list[tuple[str, str]]) -> DataFrame:
        """Rows of (segment, bucket) pairs with their segment's name; only these folders are listed."""
        read = self.spark.read.schema(f"{self.schema}, _deleted boolean").option("recursiveFileLookup", "true")
        if not where:
            return self.spark.createDataFrame([], f"{self.schema}, _deleted boolean, _segment string")
        rows = read.parquet(*(f"{self.path}/data/{s}/_bucket={b}" for s, b in where))
        return rows.withColumn("_segment", F.regexp_extract("_metadata.file_path", r"/([0-9a-f]{32})/_bucket=", 1))

    def _same(self, a: DataFrame, b: DataFrame) -> Column:
        return functools.reduce(operator.and_, (a[k].eqNullSafe(b[f"_k{i}"]) for i, k in enumerate(self.keys)))

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """rows whose keys are not in a table of keys."""
        named = keys.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)))
        return rows.join(named, self._same(rows, named), "left_anti")

    def _merged(self, state: dict, only: set[str] | None = None) -> DataFrame:
        """The rows of a state (of some buckets). Bases are scanned as they are, without those whose keys later segments have; only the later segments are grouped."""
        parts = {b: x for b, x in state["buckets"].items() if only is None or b in only}
        base = self._scan([(x["base"], b) for b, x in parts.items() if x["base"]]).select(self.columns)
        later = [(s, b) for b, x in parts.items() for s in x["after"]]
        if not later:
            return base
        place = {s: n for n, s in enumerate(state["order"]) if any(s == t for t, _ in later)}
        rest = [c for c in self.columns if c not in self.keys]
        order = F.element_at(F.create_map(*(F.lit(v) for pair in place.items() for v in pair)), F.col("_segment"))
        last = self._scan(later).groupBy(*self.keys).agg(F.max_by(F.struct(*rest, "_deleted"), order).alias("_r"))
        fresh = last.where("not _r._deleted").select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(self.columns)
        return self._without(base, last.select(*self.keys)).unionByName(fresh)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that vacuum() has not removed."""
        return self._merged(self._state(self.version() if version is None else version))

    # -------------------------------------------------------------- writes

    def _put(self, rows: DataFrame, read: int | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Adds rows (with _deleted, one a key) behind all segments."""
        name, buckets = self._segment(rows)

        def change(state: dict) -> dict | None:
            if self._seen(state, stream):
                return None
            now = {b: dict(x) for b, x in state["buckets"].items()}
            for b in buckets:
                x = now.setdefault(b, {"base": None, "after": []})
                now[b] = {"base": x["base"], "after": [*x["after"], name]}
            return {"buckets": now, "order": [*state.get("order", []), *([name] if buckets else [])], "streams": state["streams"] | ({stream[0]: stream[1]} if stream else {})}

        done = self._commit(change, read)
        if not done:
            self.files.delete("data", name)
        self.compact(self.deltas)
        return done

    @staticmethod
    def _seen(state: dict, stream: tuple[str, int] | None) -> bool:
        return stream is not None and state["streams"].get(stream[0], -1) >= stream[1]

    def _one_each(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """One row a key: the last in order, or any."""
        if not order:
            return rows.select(self.columns).dropDuplicates(self.keys)
        rest = [c for c in self.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(F.lit(1).alias("_1"), *rest), order).alias("_r"))
        return last.select(*self.keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(self.columns)

    def upsert(self, new: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Writes new rows only, in place of those of their keys; of new rows of one key the last in order holds. stream: a name and a number that grows; what came under it before is left out."""
        if stream and self._seen(self._state(self.version()), stream):
            return False
        return self._put(self._one_each(new, order).withColumn("_deleted", F.lit(False)), stream=stream)

    def append(self, new: DataFrame) -> None:
        """Only rows whose keys are not there yet."""

        def work(version: int) -> None:
            fresh = self._without(self._one_each(new), self._merged(self._state(version)).select(*self.keys))
            self._put(fresh.withColumn("_deleted", F.lit(False)), version)

        self._again(work)

    def delete_keys(self, keys: DataFrame) -> None:
        """Deletes the rows of a table of keys, without reading the store."""
        gone = keys.select(*self.keys).distinct()
        types = dict(self.spark.createDataFrame([], self.schema).dtypes)
        self._put(gone.select(*(F.col(c) if c in self.keys else F.lit(None).cast(types[c]).alias(c) for c in self.columns), F.lit(True).alias("_deleted")))

    def delete(self, where: Column) -> None:
        """Deletes the rows for which a condition holds; a tombstone is written for each."""

        def work(version: int) -> None:
            gone = self._merged(self._state(version)).where(F.coalesce(where, F.lit(False)))
            self._put(gone.withColumn("_deleted", F.lit(True)), version)

        self._again(work)

    def write(self, rows: DataFrame) -> None:
        """These rows in place of all."""
        name, buckets = self._segment(rows.select(self.columns).withColumn("_deleted", F.lit(False)))
        self._commit(lambda state: {"buckets": {b: {"base": name, "after": []} for b in buckets}, "order": [], "streams": state["streams"]})

    def replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """These rows, all of some buckets, in place of what these buckets hold."""

        def work(version: int) -> None:
            name, have = self._segment(rows.select(self.columns).withColumn("_deleted", F.lit(False)))

            def change(state: dict) -> dict:
                kept = {b: x for b, x in state["buckets"].items() if int(b) not in set(buckets)} | {b: {"base": name, "after": []} for b in have}
                return self._ordered(state, kept)

            self._commit(change, version)

        self._again(work)

    def clear(self) -> None:
        self._commit(lambda state: {"buckets": {}, "order": [], "streams": state["streams"]})

    def restore(self, version: int) -> None:
        """Makes an older version the newest again."""
        state = self._state(version)
        self._commit(lambda _: state)

    @staticmethod
    def _ordered(state: dict, buckets: dict) -> dict:
        live = {s for x in buckets.values() for s in x["after"]}
        return state | {"buckets": buckets, "order": [s for s in state.get("order", []) if s in live]}

    # -------------------------------------------------------------- upkeep

    def compact(self, most: int = 0) -> list[str]:
        """Folds the buckets that have more than `most` segments after their base into one base each. Segments that came meanwhile stay behind it. The buckets that were folded."""
        state = self._state(self.version())
        full = {b: x for b, x in state["buckets"].items() if len(x["after"]) > most}
        if not full:
            return []
        name, have = self._segment(self._merged(state, set(full)).withColumn("_deleted", F.lit(False)))

        def change(now: dict) -> dict | None:
            buckets = dict(now["buckets"])
            for b, x in full.items():
                y = buckets.get(b)
                if not y or y["base"] != x["base"] or y["after"][: len(x["after"])] != x["after"]:
                    return None  # cleared, written or folded by another
                buckets[b] = {"base": name if b in have else None, "after": y["after"][len(x["after"]) :]}
            return self._ordered(now, {b: x for b, x in buckets.items() if x["base"] or x["after"]})

        if not self._commit(change):
            self.files.delete("data", name)
            return []
        return sorted(full)

    def vacuum(self) -> None:
        """Removes older versions and what only these, or dead writers, need. Not while others write or read older versions."""
        newest = self.version()
        live = {s for x in self._state(newest)["buckets"].values() for s in [x["base"], *x["after"]]}
        for n in self.files.names("log"):
            if n.isdigit() and int(n) < newest:
                self.files.delete("log", n)
        for n in self.files.names("data"):
            if re.fullmatch("[0-9a-f]{32}", n) and n not in live:
                self.files.delete("data", n)
        self.files.delete("aside")

    def fingerprints(self, rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """(bucket, n, h): rows' number and an order-free hash by bucket; two tables agree in a bucket (but for a chance of 2^-64) if both do."""
        h = F.xxhash64(*(columns or self.columns))
        halves = F.sum(F.shiftrightunsigned(h, 32)).alias("hi"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")
        return rows.groupBy(self._bucket().alias("bucket")).agg(F.count("*").alias("n"), *halves).select("bucket", "n", F.xxhash64("hi", "lo").alias("h"))
