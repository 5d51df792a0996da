"""Row-count windows: buffers, rolling statistics, lagged safety values, score history."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.constants import (
    BUFFER_ROWS,
    CONTEXT_COLUMNS,
    DERIVED_MARKERS,
    PHYSICAL_SENSORS,
    ROLLING_WINDOWS,
    SAFETY_LAG_ROWS,
)
from furnacelens.operators.ordered import HOUR_MICROS, SLICE_ROWS, Sliced, slice_keys, time_axis

STATS = ["avg", "var", "std", "grad", "roc"]
GRADIENT_GUARD = 1e-6


def _slice(df, key, ts, lookback, slice_rows, width) -> Sliced:
    return slice_keys(df, [key], time_axis(ts), width=width, lookback=lookback, slice_rows=slice_rows)


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _moments(x: np.ndarray, inside: list[np.ndarray], w: int, cap: int, rows: int, variance: bool) -> tuple[np.ndarray, ...]:
    """(readings, mean, variance) over the last ``w`` rows; ``x`` starts ``cap`` rows early and is NaN where missing.

    The readings of a frame are taken in oldest first, in the order and by the updates of Spark's own aggregates.
    """
    n, total, mean, m2 = (np.zeros(rows) for _ in range(4))
    for back in range(w - 1, -1, -1):
        now = x[cap - back : cap - back + rows]
        ok = inside[back] & ~np.isnan(now)
        np.add(total, now, out=total, where=ok)
        np.add(n, 1.0, out=n, where=ok)
        if variance:
            delta = now - mean
            part = delta / np.maximum(n, 1.0)
            np.add(mean, part, out=mean, where=ok)
            np.add(m2, delta * (delta - part), out=m2, where=ok)
    some = np.maximum(n, 1.0)
    return n, total / some, m2 / some


def _frames(keys: Sequence[str], columns: int, windows: Sequence[int], mean: bool, variance: bool):
    """Appends the frame columns to batches in order of key and time; only the last rows are carried between batches."""
    cap = max(windows) - 1

    def of(batches):
        tail, last, carried = np.full((columns, cap), np.nan), None, 0
        for b in batches:
            rows = b.num_rows
            if not rows:
                continue
            names = b.schema.names
            key = [b.column(names.index(k)) for k in keys]
            joined = key if last is None else [pa.concat_arrays([x, y]) for x, y in zip(last, key)]
            codes = [x.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for x in joined]
            new = np.any([np.diff(c) != 0 for c in codes], axis=0)
            new = np.r_[True, new] if last is None else new
            at = np.arange(rows)
            place = at - np.maximum.accumulate(np.where(new, at, -carried))  # rows of the key before this one
            last, carried = [x.slice(rows - 1) for x in key], int(place[-1]) + 1
            inside = [place >= back for back in range(cap + 1)]
            x = np.stack([b.column(names.index(f"_rw_x{i}")).to_numpy(zero_copy_only=False) for i in range(columns)])
            x = np.concatenate([tail, x], axis=1)
            tail = x[:, x.shape[1] - cap :]
            made = {f"_rw_n{w}": pa.array(np.minimum(place + 1, w)) for w in windows}
            with np.errstate(all="ignore"):
                for i in range(columns):
                    for w in windows:
                        n, a, v = _moments(x[i], inside, w, cap, rows, variance)
                        if mean:
                            made[f"_rw_a{i}_{w}"] = pa.array(a, mask=n == 0)
                        if variance:
                            made[f"_rw_v{i}_{w}"] = pa.array(v, mask=n == 0)
                        first = x[i][cap + at - np.minimum(place, w - 1)]
                        made[f"_rw_f{i}_{w}"] = pa.array(first, mask=np.isnan(first))
            yield pa.RecordBatch.from_arrays([*b.columns, *made.values()], names=[*names, *made])

    fields = [T.StructField(f"_rw_n{w}", T.LongType()) for w in windows]
    for i in range(columns):
        for w in windows:
            fields += [T.StructField(f"_rw_{k}{i}_{w}", T.DoubleType()) for k, asked in (("a", mean), ("v", variance), ("f", True)) if asked]
    return of, fields


def rolling_stats(
    df: DataFrame,
    columns: Sequence[str] = PHYSICAL_SENSORS,
    windows: Sequence[int] = ROLLING_WINDOWS,
    stats: Sequence[str] = STATS,
    *,
    key: str = "asset_id",
    ts: str = "ts",
    tie: str = "arrival_seq",
    keep: Sequence[str] | None = None,
    extra: dict[str, tuple[str, int]] | None = None,
    slice_rows: int = SLICE_ROWS,
    width: int = HOUR_MICROS,
) -> DataFrame:
    """``{column}_roll_{stat}_{W}`` over the last W rows of the key, the current row included.

    One shuffle and one sort serve every column and window. Spark's sliding frames take in all rows of a frame
    anew for every row and aggregate, so mean and variance are computed on the arrays of a batch instead, by
    the same updates in the same order: they skip missing readings and stay exact under drift. First value
    and count alone stay a window. A NaN reading is missing, as null is: mean and variance are null where the frame holds no
    reading, gradient and rate where its first or last row holds none (a lone row gives 0). The divisor of
    the gradient is the number of rows of the frame. ``extra`` adds ``name: (aggregate, rows)`` on the
    same sort. The expressions are SQL text: hundreds of columns then cost one call instead of thousands.
    """
    lookback = max([*windows, SAFETY_LAG_ROWS]) - 1
    sliced = _slice(df, key, ts, lookback, slice_rows, width)
    base = [c for c in (list(keep) if keep is not None else df.columns)]
    order = f"PARTITION BY {', '.join(map(_tick, sliced.keys))} ORDER BY {_tick(ts)}, {_tick(tie)}"

    def last(rows: int) -> str:
        return f"OVER ({order} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"

    readings = sliced.df.selectExpr("*", *[f"nullif(CAST({_tick(c)} AS DOUBLE), double('NaN')) AS _rw_x{i}" for i, c in enumerate(columns)])
    more = [f"{agg} {last(rows)} AS {_tick(name)}" for name, (agg, rows) in (extra or {}).items()]
    mean, variance = "avg" in stats, bool({"var", "std"} & set(stats))
    if columns and windows and (mean or variance):
        dealt = readings.repartition(*map(_tick, sliced.keys))
        dealt = dealt.selectExpr("*", *more) if more else dealt
        halo = ["_sl_halo"] if sliced.hot else []
        needed = [*base, *(extra or {}), *sliced.keys, *halo, ts, tie, *[f"_rw_x{i}" for i in range(len(columns))]]
        ordered = dealt.sortWithinPartitions(*map(_tick, [*sliced.keys, ts, tie])).select(*map(_tick, dict.fromkeys(needed)))
        of, fields = _frames(sliced.keys, len(columns), list(windows), mean, variance)
        staged = ordered.mapInArrow(of, T.StructType([*ordered.schema.fields, *fields]))
    else:
        framed = [f"count(1) {last(w)} AS _rw_n{w}" for w in windows]
        framed += [f"first_value(_rw_x{i}) {last(w)} AS _rw_f{i}_{w}" for i in range(len(columns)) for w in windows]
        staged = readings.selectExpr("*", *framed, *more)

    made = {}
    for i, c in enumerate(columns):
        for w in windows:
            n, x, start = f"_rw_n{w}", f"_rw_x{i}", f"_rw_f{i}_{w}"
            text = {
                "avg": f"_rw_a{i}_{w}",
                "var": f"_rw_v{i}_{w}",
                "std": f"sqrt(_rw_v{i}_{w})",
                "grad": f"CASE WHEN {n} > 1 THEN ({x} - {start}) / {n} ELSE 0D END",
                "roc": f"CASE WHEN {n} > 1 THEN try_divide({x} - {start}, {start} + {GRADIENT_GUARD!r}D) ELSE 0D END",
            }
            for st in stats:
                made[f"{c}_roll_{st}_{w}"] = text[st]
    helper = ["_sl_halo", *sliced.keys] if sliced.hot else []
    kept = [*[b for b in base if b not in made], *(extra or {})]
    out = staged.selectExpr(
        *dict.fromkeys([*map(_tick, kept), *map(_tick, helper)]), *[f"{e} AS {_tick(n)}" for n, e in made.items()]
    )
    done = sliced.finish(out)
    return done if not sliced.hot or key in kept else done.drop(key)


def numeric_sensor_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither derived nor context; the standard list when none is left."""
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    chosen = [
        n for n, t in df.dtypes
        if t in numeric and n not in CONTEXT_COLUMNS and not any(m in n for m in DERIVED_MARKERS)
    ]
    return chosen or list(PHYSICAL_SENSORS)


def window_rows(
    df: DataFrame, columns: Sequence[str], size: int, out: str = "window", *, key: str = "asset_id", ts: str = "ts",
    tie: str = "arrival_seq", slice_rows: int = SLICE_ROWS, width: int = HOUR_MICROS,
) -> DataFrame:
    """Per row, the last ``size`` rows oldest to newest as an array."""
    sliced = _slice(df, key, ts, size - 1, slice_rows, width)
    frame = W.partitionBy(*sliced.keys).orderBy(ts, tie).rowsBetween(-(size - 1), 0)
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return sliced.finish(sliced.df.withColumn(out, F.collect_list(item).over(frame)))


def buffer_state(
    df: DataFrame, column: str, *, capacity: int = BUFFER_ROWS, ready: Sequence[int] = ROLLING_WINDOWS,
    key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq", slice_rows: int = SLICE_ROWS, width: int = HOUR_MICROS,
) -> DataFrame:
    """Per row: buffer size, readiness per window, newest and oldest value held."""
    sliced = _slice(df, key, ts, capacity - 1, slice_rows, width)
    frame = W.partitionBy(*sliced.keys).orderBy(ts, tie).rowsBetween(-(capacity - 1), 0)
    x = F.col(f"`{column}`")
    out = sliced.df.withColumns({
        "buffer_size": F.count(F.lit(1)).over(frame),
        "latest": F.last(x).over(frame),
        "oldest": F.first(x).over(frame),
    })
    out = out.withColumns({f"ready_{w}": F.col("buffer_size") >= w for w in ready})
    return sliced.finish(out)


def last_rows(df: DataFrame, n: int, *, key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq") -> DataFrame:
    """The final buffer: the last n rows per key, numbered from the oldest.

    The rank filter is small and constant, so Spark keeps only n rows per key and task before the
    shuffle.
    """
    newest = W.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    top = df.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= n)
    size = F.max("_back").over(W.partitionBy(key))
    return top.withColumn("slot", (size - F.col("_back") + 1).cast("int")).drop("_back")


def latest_row(df: DataFrame, columns: Sequence[str], *, key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq") -> DataFrame:
    """Newest value of every column per key: one aggregate that combines before the shuffle."""
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct(ts, tie)).alias("_row")
    return df.groupBy(key).agg(newest).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in columns])


def edge_rows(df: DataFrame, column: str, *, key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq") -> DataFrame:
    at = F.struct(ts, tie)
    return df.groupBy(key).agg(F.max_by(column, at).alias("latest"), F.min_by(column, at).alias("oldest"))


def lagged_safety(
    df: DataFrame, column: str = "Safety_Index", out: str = "safety_lag", *, rows: int = SAFETY_LAG_ROWS,
    key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq", slice_rows: int = SLICE_ROWS, width: int = HOUR_MICROS,
) -> DataFrame:
    """The oldest of the last five values, the current one included."""
    sliced = _slice(df, key, ts, rows - 1, slice_rows, width)
    frame = W.partitionBy(*sliced.keys).orderBy(ts, tie).rowsBetween(-(rows - 1), 0)
    return sliced.finish(sliced.df.withColumn(out, F.first(column).over(frame)))


def score_history(
    df: DataFrame, score: str, *, keep: int = 20, key: str = "asset_id", ts: str = "ts", tie: str = "arrival_seq",
    slice_rows: int = SLICE_ROWS, width: int = HOUR_MICROS,
) -> DataFrame:
    """The last ``keep`` scores per key; consecutive rows within one second collapse to the first."""
    sliced = _slice(df.select(key, ts, tie, score), key, ts, 1, slice_rows, width)
    order = W.partitionBy(*sliced.keys).orderBy(ts, tie)
    second = F.date_trunc("second", ts)
    deduped = sliced.finish(sliced.df.withColumn("_prev", F.lag(second).over(order))).filter(
        F.col("_prev").isNull() | (F.col("_prev") != second)
    )
    return last_rows(deduped.drop("_prev"), keep, key=key, ts=ts, tie=tie)


def score_trend(df: DataFrame, score: str, *, key: str = "asset_id", ts: str = "ts") -> DataFrame:
    """Whole-run trend: range-sorted by key and time, so the sort is spread over the cluster."""
    return df.select(key, ts, score).orderBy(key, ts)


def with_epoch(df: DataFrame, reset: Column, *, key: str = "asset_id", seq: str = "arrival_seq", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Buffer reset: rows from a reset on belong to a new epoch, a further partition key.

    The epoch is the sequence number of the latest reset at or before the row, a running maximum.
    """
    from furnacelens.operators.ordered import running_max_before

    at = F.when(reset, F.col(seq))
    out = running_max_before(df.withColumn("_reset_at", at), [key], seq, F.col("_reset_at"), "_before", slice_rows=slice_rows)
    return out.withColumn("epoch", F.coalesce(F.greatest("_reset_at", "_before"), F.lit(-1).cast("long"))).drop("_reset_at", "_before")
