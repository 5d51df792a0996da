"""Cumulative counts in value order, for rank statistics over whole columns.

Rows with equal values are merged first (map-side). Columns with many rows are then cut at sketched
quantiles, so a column is ranked by many tasks; a slice needs only the totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.operators.ordered import broadcast_if_small

RANK_SLICE_ROWS = 2_000_000
MAX_SLICES = 4096


def _slice_columns(df: DataFrame, names: Sequence[str], rows: int, slice_rows: int) -> tuple[DataFrame, bool]:
    slices = min(MAX_SLICES, -(-rows // slice_rows))
    if slices <= 1:
        return df, False
    grid = [i / slices for i in range(1, slices)]
    found = df.approxQuantile(list(names), grid, min(0.01, 0.25 / slices))
    inputs, outputs, splits = [], [], []
    for n, qs in zip(names, found):
        edges = sorted(set(qs))
        if edges:
            inputs.append(n)
            outputs.append(f"_slice_{n}")
            splits.append([-float("inf"), *edges, float("inf")])
    cut = Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=outputs, handleInvalid="keep").transform(df)
    return cut, True


def value_runs(
    df: DataFrame, columns: dict[str, str], measures: dict[str, dict[str, Column]], *, slice_rows: int = RANK_SLICE_ROWS,
    descending: bool = False,
) -> DataFrame:
    """One row per (name, distinct value): n, the sum of each measure, and the same over earlier values.

    ``columns`` maps a name to a numeric column; ``measures`` maps a measure to its expression per name.
    Nulls are left out. Result columns: name, value, n, <measure>, n_before, <measure>_before.
    """
    total = df.count()
    wide, sliced = _slice_columns(df, list(columns.values()), total, slice_rows)
    items = []
    for name, c in columns.items():
        fields = [F.lit(name).alias("name"), F.col(f"`{c}`").cast("double").alias("value")]
        has = sliced and f"_slice_{c}" in wide.columns
        fields.append((F.col(f"`_slice_{c}`") if has else F.lit(0.0)).cast("int").alias("slice"))
        fields += [e[name].cast("double").alias(m) for m, e in measures.items()]
        items.append(F.struct(*fields))
    long = wide.select(F.inline(F.array(*items))).filter(F.col("value").isNotNull())
    runs = long.groupBy("name", "slice", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    parts = ["n", *measures]
    direction = F.desc if descending else F.asc
    within = W.partitionBy("name", "slice").orderBy(direction("value")).rowsBetween(W.unboundedPreceding, -1)
    local = runs.withColumns({f"{p}_before": F.coalesce(F.sum(p).over(within), F.lit(0)) for p in parts})
    if not sliced:
        return local.drop("slice")
    earlier = W.partitionBy("name").orderBy(direction("slice")).rowsBetween(W.unboundedPreceding, -1)
    totals = runs.groupBy("name", "slice").agg(*[F.sum(p).alias(p) for p in parts]).select(
        "name", "slice", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(f"_off_{p}") for p in parts]
    )
    # names x slices rows
    joined = local.join(broadcast_if_small(totals), ["name", "slice"])
    return joined.select(
        "name", "value", *parts, *[(F.col(f"{p}_before") + F.col(f"_off_{p}")).alias(f"{p}_before") for p in parts]
    )
