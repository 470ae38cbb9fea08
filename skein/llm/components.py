"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join that adaptive execution may split, so
a hub with any number of links never meets in one task. Each round is written to the shared folder. The rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(links: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without a link are not returned.

    Null ends, loops and repeated links are allowed and change nothing.
    """
    edges = work.keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "links"
    )
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = work.keep(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large"
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = work.keep(
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(joined.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "small",
        )
        # A forest of stars: no end of a link is also the start of one, and each start has one end.
        if not small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").take(1) and small.count() == small.select("u").distinct().count():
            work.drop(edges, large)
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        work.drop(edges, large)
        edges = small
