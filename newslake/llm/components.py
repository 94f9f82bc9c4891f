"""Connected components of an edge table by alternating large-star and
small-star steps, each a grouping and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """``edges(u, v)`` (longs, any direction, repeats allowed) to
    ``(node, component)``: each node that has an edge with the smallest node it
    reaches. Neither edges nor components pass through the driver; each step
    is written to the shared folder, in ``parts`` files at most. An empty table gives an empty one."""
    e = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), parts)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = scratch.save(small, parts)
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (r[0], r[1]) == mark:
            break
        mark = (r[0], r[1])
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
