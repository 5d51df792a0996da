"""Ordered operators that do not put a whole key into one task.

A window partitioned by asset alone runs each asset in one task, and one asset may hold a third of
all rows. Keys with more than ``slice_rows`` rows are therefore cut along their order axis into
slices of about that many rows:

* ``cells``: one narrow aggregate counts rows per (key, cell of the axis); it combines map-side and
  its result has one row per occupied cell, not per reading.
* a running count over the cells of a key places each cell in a slice.
* rows join their cell's slice. A row within ``lookback`` rows of a later slice is also copied into
  it as a halo row, so a frame of up to ``lookback`` preceding rows sees exactly what it would have
  seen in the uncut key. Halo rows are dropped after the window.

Keys below the threshold keep one window group and pay nothing but the count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.session import materialise

SLICE_ROWS = 2_000_000
PLAN_BROADCAST_ROWS = 200_000
HOUR_MICROS = 3_600_000_000
MAX_REFINEMENTS = 8


def time_axis(ts: str | Column) -> Column:
    """Microseconds since the epoch, as the order axis of a timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def broadcast_if_small(df: DataFrame, limit: int = PLAN_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting: beyond the limit the join stays a shuffle that AQE can split."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@dataclass
class Sliced:
    df: DataFrame
    keys: list[str]  # window partition keys
    hot: bool

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop halo rows and helper columns after the window."""
        if not self.hot:
            return df
        helpers = [c for c in df.columns if c.startswith("_sl_")]
        return df.filter(~F.col("_sl_halo")).drop(*helpers)


def _cells(df: DataFrame, keys: list[str], axis: Column, width: int, carry: dict[str, Column]) -> DataFrame:
    cell = F.floor(axis / F.lit(width)).cast("long")
    return df.groupBy(*keys, cell.alias("_sl_cell")).agg(
        F.count(F.lit(1)).alias("_sl_n"), *[c.alias(f"_sl_c_{n}") for n, c in carry.items()]
    )


def _plan(df, keys, axis, width, lookback, slice_rows, carry) -> DataFrame:
    """Per occupied cell of a hot key: its slice, the last slice that needs it, and what comes before."""
    whole = W.partitionBy(*keys)
    before = whole.orderBy("_sl_cell").rowsBetween(W.unboundedPreceding, -1)
    plan = (
        _cells(df, keys, axis, width, carry)
        .withColumn("_sl_total", F.sum("_sl_n").over(whole))
        .filter(F.col("_sl_total") > slice_rows)
        .withColumn("_sl_before", F.coalesce(F.sum("_sl_n").over(before), F.lit(0)))
        .withColumn("_sl_first", F.floor(F.col("_sl_before") / slice_rows).cast("long"))
    )
    reach = F.floor((F.col("_sl_before") + F.col("_sl_n") + F.lit(lookback - 1)) / slice_rows).cast("long")
    plan = plan.withColumns({
        "_sl_last": F.greatest("_sl_first", reach) if lookback else F.col("_sl_first"),
        "_sl_base": F.min("_sl_before").over(W.partitionBy(*keys, "_sl_first")),
        **{f"_sl_carry_{n}": F.max(f"_sl_c_{n}").over(before) for n in carry},
    })
    return plan.drop("_sl_total", "_sl_before", *[f"_sl_c_{n}" for n in carry])


def slice_keys(
    df: DataFrame,
    keys: list[str],
    axis: Column,
    *,
    width: int = HOUR_MICROS,
    lookback: int = 0,
    slice_rows: int = SLICE_ROWS,
    carry_max: dict[str, Column] | None = None,
) -> Sliced:
    """Cut hot keys along ``axis``. ``carry_max`` adds, per row, the maximum of an expression over all
    earlier cells of the key (``_sl_carry_<name>``) and the number of rows in earlier slices
    (``_sl_base``)."""
    if lookback > slice_rows:
        raise ValueError("slice_rows must be at least the lookback")
    for _ in range(MAX_REFINEMENTS):
        plan = _plan(df, keys, axis, width, lookback, slice_rows, {})  # counts only: reads key and axis
        local = plan.limit(PLAN_BROADCAST_ROWS + 1).toArrow()
        if local.num_rows == 0:
            return Sliced(df, list(keys), False)
        if local.num_rows <= PLAN_BROADCAST_ROWS:
            fullest = max(local.column("_sl_n").to_pylist())
        else:  # more cells than were read: the fullest of the whole plan decides
            fullest = plan.agg(F.max("_sl_n")).first()[0]
        if fullest <= 4 * slice_rows or width == 1:
            break
        width = max(1, width // 64)  # a burst: cut the axis finer until the fullest cell fits
    if carry_max:
        df = materialise(df, "ordered")  # the carried maxima and the rows both read it: what stands behind runs once
        plan = _plan(df, keys, axis, width, lookback, slice_rows, {n: F.max(c) for n, c in carry_max.items()})
        if local.num_rows <= PLAN_BROADCAST_ROWS:
            local = plan.toArrow()
    plan = plan.drop("_sl_n")
    if local.num_rows <= PLAN_BROADCAST_ROWS:
        small = df.sparkSession.createDataFrame(local.drop_columns(["_sl_n"]), schema=plan.schema)
        plan = F.broadcast(small)
    # Above that size the plan joins by shuffle on (key, cell), which spreads a hot key by cell.
    tagged = df.withColumn("_sl_cell", F.floor(axis / F.lit(width)).cast("long"))
    joined = tagged.join(plan, [*keys, "_sl_cell"], "left")
    out = joined.withColumn(
        "_sl_slice",
        F.explode(F.sequence(F.coalesce("_sl_first", F.lit(0)), F.coalesce("_sl_last", F.lit(0)))),
    ).withColumn("_sl_halo", F.col("_sl_slice") > F.coalesce("_sl_first", F.lit(0)))
    return Sliced(out, [*keys, "_sl_slice"], True)


def running_max_before(
    df: DataFrame,
    keys: list[str],
    axis: str,
    value: Column,
    out: str,
    *,
    width: int = 65_536,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Maximum of ``value`` over all earlier rows of the key in ``axis`` order (exclusive).

    A maximum is associative, so each slice needs only the maximum of everything before it.
    """
    sliced = slice_keys(
        df.withColumn("_rm_value", value), keys, F.col(axis), width=width, slice_rows=slice_rows,
        carry_max={"rm": F.col("_rm_value")},
    )
    frame = W.partitionBy(*sliced.keys).orderBy(axis).rowsBetween(W.unboundedPreceding, -1)
    local = F.max("_rm_value").over(frame)
    res = sliced.df.withColumn(out, F.greatest(F.col("_sl_carry_rm"), local) if sliced.hot else local)
    return sliced.finish(res).drop("_rm_value")


def row_positions(
    df: DataFrame,
    keys: list[str],
    axis: Column,
    order: list[str],
    out: str,
    *,
    width: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """1-based row number per key in ``order``, whose first part must agree with ``axis``."""
    sliced = slice_keys(df, keys, axis, width=width, slice_rows=slice_rows)
    rn = F.row_number().over(W.partitionBy(*sliced.keys).orderBy(*order)).cast("long")
    if sliced.hot:
        rn = rn + F.coalesce(F.col("_sl_base"), F.lit(0))
    return sliced.finish(sliced.df.withColumn(out, rn))


def _axis_width(df: DataFrame, column: str, slices: int, slice_rows: int) -> int:
    """Cell width that gives about ``slices`` cells, and more once cells would outgrow a slice."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    if lo is None:
        return 1
    return max(1, (hi - lo + 1) // max(slices, 4 * n // slice_rows))


def global_row_number(df: DataFrame, axis: str, out: str, *, slices: int = 512, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Row number over the whole table by a unique integer column, without a single-task window."""
    width = _axis_width(df, axis, slices, slice_rows)
    keyed = df.withColumn("_all", F.lit(0))
    return row_positions(keyed, ["_all"], F.col(axis), [axis], out, width=width, slice_rows=slice_rows).drop("_all")
