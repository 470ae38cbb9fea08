"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share a budget by weight; a source that would take more than its maximum of epochs is clamped there and its
excess goes to the others by weight, until none is above. That fixed point has a closed form, found with running sums over the sources in the order in which
they clamp. A source then takes whole repetitions of all its documents and, for the fraction left, the documents that come first in a
seeded order, up to the exact word.

The seeded order is md5 of seed and doc_id. Its first hex digits are bins: their sums (combined before the shuffle) give what stands before a
bin, and only rows of one bin of one source are ever ordered together, so a source with most of the rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace

#: Hex digits of the seeded order that make a bin: 4096 bins a source.
BIN_DIGITS = 3


def _weights(rank: Column, cycle: tuple[float, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int"))


def water_fill(sources: DataFrame, cycle: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Adds weight and target to a table with a row per source: source, source_size.

    Sources in order of their code points, null last, have the weights of the cycle. Targets add up to share * all sizes, or to all caps if those are less.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_clamp = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = sources.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", _weights(F.col("rank"), cycle))
    t = t.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    # The level if all sources before this one are clamped. It rises as long as clamping sets words free and falls from then on: the highest is the fixed point.
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(by_clamp), F.lit(0.0))) / F.sum("weight").over(rest))
    t = t.withColumn("fill", F.max("level").over(everything))
    return t.withColumn("target", F.least("cap", F.col("weight") * F.col("fill"))).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    seed: str = "mix-1",
    cycle: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    text: str = "text",
    keep: tuple[str, ...] = (),
    work: Workspace | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats (whole copies), extra (words of one more copy), taken.

    Size is the number of words; a null text has none. A null source is a source of its own, after all others. taken = repeats * size + extra, and a source's taken
    words add up to its target rounded to a whole number. Rows that repeat a doc_id are ordered by size, then arbitrarily but alike.
    An empty table gives no rows; further columns of docs come along only if named in keep.
    """
    work = work or Workspace(docs.sparkSession, "mix")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    sized = work.keep(
        docs.select("doc_id", "source", words.alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"), *keep)
        .withColumn("bin", F.substring("h", 1, BIN_DIGITS)),
        "sized",
    )
    bins = work.keep(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sources = work.keep(water_fill(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), cycle, share, max_epochs), "sources")
    quota = sources.select(F.col("source").alias("s"), "source_size", "target", F.round("target").cast("long").alias("words"))
    quota = quota.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(0).cast("long"))
    quota = quota.withColumn("rest", F.col("words") - F.col("repeats") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(quota, F.col("source").eqNullSafe(F.col("s")))
    starts = starts.select(F.col("source").alias("s"), F.col("bin").alias("b"), "bin_start", "source_size", "target", "repeats", "rest")
    inside = Window.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sized.withColumn("in_bin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = ordered.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("bin_start") - F.col("in_bin"))).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", "repeats", extra.alias("extra"), (F.col("repeats") * F.col("size") + extra).alias("taken"), *keep)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, all columns whatever their names, as often as they are taken.

    Repetitions are equal rows, and texts stay whole: the one document of a source at which its target is reached is taken once more if at least half of its words are wanted, so a
    source comes within half a document of its target.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_skein_row"))
    taken = mix(whole, keep=("_skein_row",), **options)
    times = F.col("repeats") + F.when((F.col("extra") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)
    rows = taken.select("_skein_row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("_skein_time"))
    return rows.select("_skein_row.*")
