"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolworks.sources.tables import Scratch


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Each round is two aggregations and two joins on the node, written to the shared folder in place of the round before.
    Rounds go on until nothing changes: the square of the logarithm of the number of nodes bounds them, whatever the
    shape. Links of a node to itself are left out; repeated ones count once. No links give no rows.
    """
    scratch = Scratch(links.sparkSession)
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = scratch.written(pairs, "links-0")
    before, turn = None, 0
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        turn += 1
        pairs = scratch.written(small.where("u <> v").distinct(), f"links-{turn}")
        scratch.remove(f"links-{turn - 1}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
