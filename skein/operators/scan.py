"""Prefix scans that split a key: sums of what came before and last values so far, where one key may hold most rows.

A window keeps a key in one task. Here rows lie in ranges of (key, order), so a key of any size lies in several parts. Each part adds up what it holds, a window over these totals (as many a key as it has
parts) carries them forward, and the rows of a part go on from what is carried to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kept


def prefix_scan(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """rows with a column for each of sums, the sum over the earlier rows of the key (0 for the first; nulls count as nothing), and of lasts, the last value that is not null up to the row, itself included.

    order: columns, ascending, nulls first; together they should tell the rows of a key apart, as equal ones lie in one part and are in no set order. Without keys the whole table is one sequence; a null
    key is a key. parts: ranges to cut into, by default spark.sql.shuffle.partitions. Columns that begin with _scan_ are the scan's own. An empty table gives no rows.
    """
    sums, lasts = sums or {}, lasts or {}
    mine = {name: f"_scan_{k}" for k, name in enumerate([*sums, *lasts])}
    held = rows.select("*", *(c.alias(mine[name]) for name, c in {**sums, **lasts}.items()))
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that what is added up and what is scanned are cut alike.
    held = kept(held.repartitionByRange(parts, *keys, *order).withColumn("_scan_part", F.spark_partition_id()))
    at = F.struct(*order)
    total = [F.sum(mine[name]).alias(mine[name]) for name in sums] + [F.max_by(mine[name], F.when(F.col(mine[name]).isNotNull(), at)).alias(mine[name]) for name in lasts]
    earlier = Window.partitionBy(*keys).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(mine[name]).over(earlier) for name in sums] + [F.last(mine[name], ignorenulls=True).over(earlier) for name in lasts]
    own = [F.col(c).alias(f"_scan_key{k}") for k, c in enumerate(keys)]
    carry = held.groupBy(*keys, "_scan_part").agg(*total).select(*own, F.col("_scan_part").alias("_scan_to"), *(c.alias(f"{m}_before") for c, m in zip(carried, mine.values(), strict=True)))
    same = F.col("_scan_part") == F.col("_scan_to")
    for k, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_scan_key{k}"))
    inside = Window.partitionBy(*keys, "_scan_part").orderBy(*order)
    before, so_far = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {name: zero(F.sum(mine[name]).over(before)) + zero(F.col(f"{mine[name]}_before")) for name in sums}
    out |= {name: F.coalesce(F.last(mine[name], ignorenulls=True).over(so_far), F.col(f"{mine[name]}_before")) for name in lasts}
    return held.join(carry, same).select(*rows.columns, *(c.alias(name) for name, c in out.items()))


def numbered(rows: DataFrame, order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place, from 1, in the order of the whole table."""
    return prefix_scan(rows, [], order, {name: F.lit(1).cast("long")}, parts=parts).withColumn(name, F.col(name) + 1)
