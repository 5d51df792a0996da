"""Exact order statistics without collecting a column into one task.

Spark's exact ``percentile`` keeps every distinct value of a column in one aggregation buffer. Here a
sketch (``approxQuantile``) first brackets each wanted rank, a counting pass confirms the bracket, and
the exact aggregate only sees the rows inside it. Brackets are narrowed until they are small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_ROWS = 200_000
SKETCH_ERROR = 1e-3
MAX_ROUNDS = 8


@dataclass
class _Target:
    column: str
    rank: int  # 1-based rank wanted
    low: float = -math.inf
    high: float = math.inf
    below: int = 0
    within: int = 0


def _value(column: str) -> Column:
    x = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(x), x)


def _inside(t: _Target) -> Column:
    x = _value(t.column)
    if math.isinf(t.low) and math.isinf(t.high):
        return x
    return F.when((x >= F.lit(t.low)) & (x <= F.lit(t.high)), x)


def _narrow(df: DataFrame, targets: list[_Target], error: float) -> None:
    names = [f"t{i}" for i in range(len(targets))]
    wide = df.select(*[_inside(t).alias(n) for n, t in zip(names, targets)])
    centre = [(t.rank - t.below) / t.within for t in targets]
    probs = sorted({min(1.0, max(0.0, c + s)) for c in centre for s in (-2 * error, 2 * error)})
    found = wide.approxQuantile(names, probs, error)
    brackets = []
    for c, qs in zip(centre, found):
        lo = qs[probs.index(min(1.0, max(0.0, c - 2 * error)))]
        hi = qs[probs.index(min(1.0, max(0.0, c + 2 * error)))]
        brackets.append((lo, hi))
    counts = df.agg(*[
        e for i, (t, (lo, hi)) in enumerate(zip(targets, brackets)) for e in (
            F.count_if(_value(t.column) < F.lit(lo)).alias(f"b{i}"),
            F.count_if((_value(t.column) >= F.lit(lo)) & (_value(t.column) <= F.lit(hi))).alias(f"w{i}"),
        )
    ]).first()
    for i, (t, (lo, hi)) in enumerate(zip(targets, brackets)):
        below, within = counts[f"b{i}"], counts[f"w{i}"]
        if below < t.rank <= below + within:  # the sketch kept its promise
            t.low, t.high, t.below, t.within = lo, hi, below, within


def order_statistics(
    df: DataFrame, wanted: dict[str, Sequence[int]], counts: dict[str, int], *, exact_rows: int = EXACT_ROWS,
    error: float = SKETCH_ERROR,
) -> dict[str, dict[int, float]]:
    """The values at the wanted 1-based ranks of each column; nulls and NaN do not count."""
    targets = [_Target(c, r, within=counts[c]) for c, ranks in wanted.items() for r in sorted(set(ranks)) if counts[c] > 0]
    for _ in range(MAX_ROUNDS):
        # a bracket of equal values is one entry for the aggregate, however many rows it holds
        big = [t for t in targets if t.within > exact_rows and t.low < t.high]
        if not big:
            break
        sizes = [t.within for t in big]
        _narrow(df, big, error)
        if [t.within for t in big] == sizes:
            break
    result: dict[str, dict[int, float]] = {c: {} for c in wanted}
    if not targets:
        return result
    # targets that share a bracket (a column small enough to stay whole) share one aggregate
    shared: dict[tuple, list[_Target]] = {}
    for t in targets:
        shared.setdefault((t.column, t.low, t.high, t.below, t.within), []).append(t)
    aggs = []
    for i, group in enumerate(shared.values()):
        g = group[0]
        fractions = [(t.rank - g.below - 0.5) / g.within for t in group]
        aggs.append((i, group, fractions))
    staged = df.select(*[_inside(group[0]).alias(f"g{i}") for i, group, _f in aggs])
    row = staged.agg(*[
        F.expr(f"percentile_disc({fr!r}D) WITHIN GROUP (ORDER BY g{i})").alias(f"r{i}_{k}")
        for i, _group, fractions in aggs for k, fr in enumerate(fractions)
    ]).first()
    for i, group, _f in aggs:
        for k, t in enumerate(group):
            result[t.column][t.rank] = row[f"r{i}_{k}"]
    return result


def valid_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(_value(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"c{i}"] for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], *, discrete: bool = False, exact_rows: int = EXACT_ROWS
) -> dict[str, list[float | None]]:
    """Quantiles per column, linearly interpolated; with ``discrete`` the value at rank ceil(p * n)."""
    counts = valid_counts(df, columns)
    wanted: dict[str, list[int]] = {}
    for c in columns:
        n = counts[c]
        ranks = []
        for p in probs:
            if discrete:
                ranks.append(max(1, math.ceil(p * n)))
            else:
                h = (n - 1) * p
                ranks += [math.floor(h) + 1, math.ceil(h) + 1]
        wanted[c] = ranks
    values = order_statistics(df, wanted, counts, exact_rows=exact_rows)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n, got = counts[c], []
        for p in probs:
            if n == 0:
                got.append(None)
            elif discrete:
                got.append(values[c][max(1, math.ceil(p * n))])
            else:
                h = (n - 1) * p
                a, b = values[c][math.floor(h) + 1], values[c][math.ceil(h) + 1]
                got.append(a + (b - a) * (h - math.floor(h)))
        out[c] = got
    return out
