"""A corpus pipeline: quality, exact copies, near copies, mixing, packing. Each stage calls one operator of skein.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.chosen_path import without_near_copies
from skein.llm.common import Workspace
from skein.llm.exact_dedup import without_copies
from skein.llm.mixing import mixed
from skein.llm.packing import pack
from skein.llm.quality import accepted, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from labelled rows outside the held-out part."""
    return accepted(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return without_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id."""
    return without_near_copies(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the source mix takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: SQL cannot express the classifier or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again. An empty table has no pieces; other columns of documents may have any names and come along up to the last stage."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.keep(docs, name)
    return docs
