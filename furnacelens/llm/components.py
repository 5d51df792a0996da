"""Connected components of a link table by alternating large and small stars (a distributed union by minimum)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.session import materialise


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (u, v): comp is the smallest node reachable.

    Each round is two grouped minima and joins, so no component meets in one task; rounds grow with the logarithm of
    the longest path. Tables are written to the shared folder, which cuts lineage.
    """
    e = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = materialise(small.select("x.u", "x.v").filter("u <> v").distinct(), "links")
        was, mark = mark, _mark(e)
        if was == mark:
            break
    both = e.unionByName(e.select(F.col("v").alias("u"), "v"))
    return both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
