"""Labelled rows for the classifiers: a bounded, seeded sample of documents with a label, never of the held-out part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Rows that a classifier is fitted on at most, and the longest text among them in characters. Scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 65_536
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id):
    return crc_mod(doc_id, FOLDS) == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, y): the labelled documents outside the held-out part that come first in a hashed order of ids.

    A null label or id is no label; of several labels of an id the largest holds. The sample is the same for any order of rows and any partitions.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    texts = docs.select("doc_id", "text", F.length("text").alias("n")).where((F.col("n") > 0) & (F.col("n") <= SAMPLE_CHARS)).drop("n")
    # At most `rows` ids are broadcast: some more than needed, as labels may name documents that are not here.
    first = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts.join(F.broadcast(first), "doc_id").dropDuplicates(["doc_id"])
