"""Token totals kept up to date by deltas.

Totals of documents and tokens by source, language and tokenizer version are additive, so a change is a signed row: an insert adds a document
and its tokens, a delete takes both away, a revised count adds the difference. A batch of changes is summed (combined before the shuffle) into a small
table and committed under its id: the data is written first, then a marker is renamed into its place, whole, where none may be yet. A batch that is
committed again changes nothing; one whose writer died at any point is not committed and can be again. Reading sums the committed batches; compact() folds
them into a snapshot, whose marker lists what it holds.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log_store import Files
from .common import WORD

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserts(counted: DataFrame) -> DataFrame:
    """Signed changes for counted documents: source, lang, tokenizer, n_tokens. A null count counts as 0."""
    return counted.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    """Takes away what inserts() of the same rows added."""
    return counted.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).cast("long").alias("n_tokens"))


def revisions(counted: DataFrame, old: str = "old_tokens", new: str = "n_tokens") -> DataFrame:
    """Replaces counts: the document stays, the difference is added."""
    change = (F.coalesce(F.col(new), F.lit(0)) - F.coalesce(F.col(old), F.lit(0))).cast("long")
    return counted.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share.

    Null sources, languages and tokenizers are groups of their own. Every row of a batch counts, also where rows repeat. A batch without rows
    can be committed. Groups whose documents and tokens are both 0 are not listed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._files = Files(spark, path)

    def _mark(self, kind: str, name: str, data: dict) -> bool:
        """Makes a marker, whole or not at all; False if there is one. A writer that dies before leaves none."""
        return self._files.take(json.dumps(data), kind, name)

    def _marks(self, kind: str) -> dict[str, dict]:
        return {name: json.loads(self._files.read(kind, name, "manifest")) for name in self._files.names(kind)}

    def committed(self, batch: str) -> bool:
        return batch in self._files.names("commits")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes once; False if it had been added before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
        if self.committed(batch):
            return False
        name = f"{batch}-{uuid.uuid4().hex[:12]}"
        self._sums(changes).write.parquet(f"{self.path}/data/{name}")
        if self._mark("commits", batch, {"data": name}):
            return True
        self._files.delete("data", name)
        return False

    @staticmethod
    def _sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def _parts(self) -> tuple[list[str], set[str]]:
        """The tables to add up, and the batches that they hold."""
        batches, snapshots = self._marks("commits"), self._marks("snapshots")
        newest = snapshots[max(snapshots)] if snapshots else {"data": None, "batches": []}
        rest = [m["data"] for b, m in sorted(batches.items()) if b not in set(newest["batches"])]
        return [*([newest["data"]] if newest["data"] else []), *rest], set(batches)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of all committed batches."""
        tables, _ = self._parts()
        if not tables:
            return self.spark.createDataFrame([], _SCHEMA)
        return self._sums(self.spark.read.schema(_SCHEMA).parquet(*(f"{self.path}/data/{t}" for t in tables)))

    def compact(self) -> None:
        """Folds all batches into one table; ids stay known, so a replay still changes nothing."""
        tables, batches = self._parts()
        if len(tables) > 1:
            name = f"snapshot-{uuid.uuid4().hex[:12]}"
            self.totals().coalesce(1).write.parquet(f"{self.path}/data/{name}")
            number = 1 + max((int(k) for k in self._marks("snapshots")), default=0)
            if not self._mark("snapshots", f"{number:09d}", {"data": name, "batches": sorted(batches)}):
                self._files.delete("data", name)  # another snapshot came first; it holds, and so do the batches after it


def count_words(docs: DataFrame, version: str = "words-1", extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens by the words of this package, and the extra columns; a null text has no words."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), n.alias("n_tokens"), *(c.alias(k) for k, c in (extra or {}).items()))
