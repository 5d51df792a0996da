"""Global offsets from task totals: the second pass of a two-pass prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.session import materialise

BLOCK = 1024


def prefix_sums(table: DataFrame, part: str, *values: str) -> DataFrame:
    """(part, <value>_before ...): sums of each value over all smaller parts.

    Parts are summed first (map side), then within blocks of 1024 parts and over the blocks, so that the one ordered
    window without a key has a row per 1024 tasks. The result is written, so a join sees its true size and broadcasts
    it only below the session's limit.
    """
    total = table.groupBy(F.col(part).alias("part")).agg(*[F.sum(v).alias(v) for v in values]).withColumn("block", F.floor(F.col("part") / BLOCK))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = total.groupBy("block").agg(*[F.sum(v).alias(v) for v in values]).select("block", *[F.coalesce(F.sum(v).over(over), F.lit(0)).alias(f"_{v}") for v in values])
    return materialise(
        total.select("block", "part", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in values])
        .join(blocks, "block")
        .select(F.col("part").alias(part), *[(F.col(v) + F.col(f"_{v}")).alias(f"{v}_before") for v in values]),
        "offsets",
    )
