"""Retrieval and answer metrics over tables of cases and ranked rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

# Least scores of the grades.
GRADES = (("A", 0.80), ("B", 0.65), ("C", 0.50), ("D", 0.35))


def retrieval(ranked: DataFrame, case: str = "case_id", relevant: str = "relevant", total: Column | None = None) -> DataFrame:
    """Per case: reciprocal rank, precision (of the rows that came), recall (of `total`, one by default, at most 1) and hit."""
    hits = F.sum(F.when(F.col(relevant), 1).otherwise(0))
    of = F.max(total) if total is not None else F.lit(1)
    return ranked.groupBy(case).agg(
        F.coalesce(1 / F.min(F.when(F.col(relevant), F.col("rank"))), F.lit(0.0)).alias("rr"),
        (hits / F.count("*")).alias("precision"),
        F.least(F.lit(1.0), hits / of).alias("recall"),
        (hits > 0).alias("hit"),
    )


def has_keywords(text: Column, words: Column, least: int = 2) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))) >= least


def share_found(text: Column, words: Column) -> Column:
    """The share of words that a text holds; 1 if there are none."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))) / F.size(words)).otherwise(F.lit(1.0))


def answer_score(answer: Column, terms: Column, values: Column, files: Column, found_files: Column) -> Column:
    """Half for terms, 0.35 for values, 0.15 for files; an answer under 80 characters counts half."""
    s = 0.50 * share_found(answer, terms) + 0.35 * share_found(answer, values) + 0.15 * share_found(found_files, files)
    return F.when(F.length(answer) < 80, s * 0.5).otherwise(s)


def grade(score: Column) -> Column:
    g = F.lit("F")
    for name, least in reversed(GRADES):
        g = F.when(score >= least, F.lit(name)).otherwise(g)
    return g


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def blind_score(answer: Column, terms: Column, values: Column) -> Column:
    """0.6 for terms, 0.4 for values, to 3 digits."""
    return F.round(0.60 * share_found(answer, terms) + 0.40 * share_found(answer, values), 3)


def invented(before: int = 200, after: int = 200) -> Callable[..., Column]:
    """A function of (answer, words, denials): how often one of the words stands in the answer, as a word, with no denial within so many characters before and after it."""

    @pandas_udf(IntegerType())
    def run(answer: pd.Series, words: pd.Series, denials: pd.Series) -> pd.Series:
        def one(a, ws, no) -> int:
            low, n = (a or "").lower(), 0
            for w in ws if ws is not None else ():
                for m in re.finditer(rf"\b{re.escape(w.lower())}\b", low):
                    near = low[max(0, m.start() - before) : m.end() + after]
                    n += not any(d.lower() in near for d in (no if no is not None else ()))
            return n

        return pd.Series([one(*x) for x in zip(answer, words, denials, strict=True)], dtype="int32")

    return run


def trap_score(answer: Column, words: Column, denials: Column, refusals: Column, before: int = 200, after: int = 200) -> Column:
    """Of answers to questions about what does not exist: 1 if one says that it is not known and invents nothing, 0.5 if it invents nevertheless, 0 if it only invents, 0.3 if it does neither."""
    says = F.exists(refusals, lambda r: F.contains(F.lower(answer), F.lower(r)))
    makes = invented(before, after)(answer, words, denials) > 0
    return F.when(says & ~makes, 1.0).when(says, 0.5).when(makes, 0.0).otherwise(0.3)


def multi_hop_score(nodes: Column, least_nodes: Column, edges: Column, least_edges: Column, answer: Column, expected: Column) -> Column:
    """0.3 for enough nodes, 0.3 for enough edges, 0.4 for the share of expected nodes that the answer names, with or without underscores."""
    low = F.lower(answer)
    bare = F.replace(low, F.lit("_"), F.lit(""))
    named = F.size(F.filter(expected, lambda n: F.contains(low, F.lower(n)) | F.contains(bare, F.replace(F.lower(n), F.lit("_"), F.lit("")))))
    return 0.3 * (nodes >= least_nodes).cast("int") + 0.3 * (edges >= least_edges).cast("int") + 0.4 * F.when(F.size(expected) > 0, named / F.size(expected)).otherwise(F.lit(1.0))


def cross_project_score(coverage: Column, both: Column, edges: Column) -> Column:
    """0.5 for terms, 0.3 if both projects are named, 0.2 for two edges or more."""
    return 0.5 * coverage + 0.3 * both.cast("int") + 0.2 * (edges >= 2).cast("int")


def contradiction_score(warned_before: Column, warned: Column, conflict: Column, both: Column) -> Column:
    """The mean of the baseline (1, or 0.5 if it warned already) and of what follows a planted contradiction: 0.5 for a warning, 0.3 if the conflict is named, 0.2 if both sides are."""
    return (F.when(warned_before, 0.5).otherwise(1.0) + 0.5 * warned.cast("int") + 0.3 * conflict.cast("int") + 0.2 * both.cast("int")) / 2


def held_out_score(excluded: Column, unknown: Column) -> Column:
    """0.7 if what was taken out is not retrieved, 0.3 if the answer says that it is not known."""
    return 0.7 * excluded.cast("int") + 0.3 * unknown.cast("int")


def category_means(scored: DataFrame, by: str = "category", score: str = "score", route: str = "route_ok") -> DataFrame:
    """Per category the number of questions, mean score to 3 digits, its grade, and how many took the right route."""
    m = scored.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(score), 3).alias("score"), F.count_if(route).alias("route_ok"))
    return m.withColumn("grade", grade(F.col("score")))


def category_matches(source: Column, category: Column, expected: Column) -> Column:
    """Whether a hit's source or category holds one of the expected categories."""
    return F.exists(expected, lambda c: F.contains(F.lower(F.coalesce(source, F.lit(""))), F.lower(c)) | F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lower(c)))


def answered(questions: DataFrame, chunks: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What a run of questions retrieved: (question_id, source_chunks, files, doc_chunks, docs, nodes, edges), counts and distinct files and documents in order. All have question_id; chunks file_path, docs doc_id."""
    out = questions.select("question_id").distinct()
    name = F.regexp_extract("file_path", "([^/]+)$", 1)
    for part in (
        chunks.groupBy("question_id").agg(F.count("*").alias("source_chunks"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("files")),
        docs.groupBy("question_id").agg(F.count("*").alias("doc_chunks"), F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("docs")),
        nodes.groupBy("question_id").agg(F.count_distinct("node_id").alias("nodes")),
        edges.groupBy("question_id").agg(F.count("*").alias("edges")),
    ):
        out = out.join(part, "question_id", "left")
    return out.fillna(0).fillna("")


def histogram(scored: DataFrame, score: str = "score") -> DataFrame:
    """(grade, n) of all grades, with zeros."""
    spark = scored.sparkSession
    names = spark.createDataFrame([(g,) for g, _ in GRADES] + [("F",)], "grade string")
    return names.join(scored.groupBy(grade(F.col(score)).alias("grade")).agg(F.count("*").alias("n")), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


#: Ranges of values that are counted before any are put in order.
BINS = 4096


def at_places(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by..., names...): the values at places (from 0, columns of the group's size n) of each group's values in order. Nulls do not count.

    Values are counted by range; only the ranges in which a place falls are put in order, so no task sorts a group.
    """
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    spans = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    bin_of = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS))).otherwise(F.lit(0)).cast("int")
    binned = v.alias("v").join(spans.alias("s"), on).select(*(F.col(f"v.{c}").alias(c) for c in by), "_v", "n", bin_of.alias("_b"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(*by, "_b", "n").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    wanted = counts.withColumn("_p", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("at")) for k, p in places.items()))))
    wanted = wanted.where((F.col("_p.at") >= F.col("_before")) & (F.col("_p.at") < F.col("_before") + F.col("_c"))).select(*by, "_b", F.col("_p.name").alias("_name"), (F.col("_p.at") - F.col("_before") + 1).alias("_k"))
    keys = [*by, "_b"]
    inside = binned.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")))
    got = inside.join(wanted, [*keys, "_k"])
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, median, least, most and the 95th value of each group (not null): that at place floor(0.95 n), from 0, of the values in order."""
    n = F.col("n")
    placed = at_places(rows, by, value, {"_a": F.floor((n - 1) / 2), "_b2": F.floor(n / 2), "p95": F.floor(n * 0.95)})
    plain = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return plain.join(placed, by).select(*by, "n", "mean", ((F.col("_a") + F.col("_b2")) / 2).alias("median"), "least", "most", "p95")
