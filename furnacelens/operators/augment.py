"""Data augmentation: class draws, jitter, fresh timestamps and ids, segments, ramps, scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.catalogues import (
    SCENARIO_DECAYS,
    SCENARIO_OVERRIDES,
    SCENARIO_RAMP_ROWS,
    SCENARIO_RAMPS,
    SCENARIO_SEGMENTS,
    SCENARIO_START,
    SCENARIOS,
)
from furnacelens.functions.scalar import gaussian, stable_hash
from furnacelens.operators.ordered import broadcast_if_small
from furnacelens.operators.selection import class_sizes, draw_with_replacement, first_by_hash

# Jitter size, its floor, and the texts used when state metadata is absent.
JITTER_RELATIVE = 0.005
JITTER_ABSOLUTE = 0.01
JITTER_SMALL = 1e-3
METADATA_DEFAULTS = {
    "BF_State_ID": "PS001", "BF_State_Name": "Normal", "BF_State_Risk": "Safe",
    "CO_State_ID": "PS001", "CO_State_Name": "Normal", "CO_State_Risk": "Safe",
}
SAFETY_DEFAULT = 85.0


def overlay(df: DataFrame, updates: dict[str, object]) -> DataFrame:
    """What-if overlay: replace fields of every row."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in updates.items()})


def rows_per_class(df: DataFrame, n: int, label: str, ident: str, *, seed: int = 42) -> DataFrame:
    """n rows of each class; a class with fewer is drawn with replacement. Adds ``draw`` (0-based)."""
    sizes = class_sizes(df, label)
    small = [c for c, k in sizes.items() if k < n]
    known = [c for c in small if c is not None]
    listed = F.coalesce(F.col(label).isin(*known), F.lit(False)) if known else F.lit(False)
    enough = df.filter(F.when(F.col(label).isNull(), F.lit(None not in small)).otherwise(~listed)) if small else df  # null-safe
    picked = first_by_hash(enough, n, ident, by=label, seed=seed)
    order = W.partitionBy(label).orderBy(stable_hash(ident, seed), ident)  # n rows per class
    out = picked.withColumn("draw", F.row_number().over(order) - F.lit(1))
    if small:
        again = draw_rows(df, {c: n for c in small}, label, ident, seed=seed)
        out = out.unionByName(again.select(*[F.col(c).cast(t) for c, t in out.dtypes]))
    return out


def draw_rows(df: DataFrame, sizes: dict[str, int], label: str, ident: str, *, seed: int | str = 42) -> DataFrame:
    """For each class the given number of rows, drawn uniformly with replacement. Adds ``draw``."""
    draws = [{"class": c, "key": f"{c}/{i}", "draw": i} for c, k in sizes.items() for i in range(k)]
    out = draw_with_replacement(df, draws, ident, by=label, seed=seed)
    return out.withColumn("draw", F.col("draw").cast("int"))


def jitter(df: DataFrame, columns: Sequence[str], ident: str | Column, *, seed: int = 42) -> DataFrame:
    """Gaussian noise of half a percent of the reading, or a small constant near zero."""
    made = {}
    for c in columns:
        x = F.col(c)
        std = F.when(F.abs(x) > JITTER_SMALL, F.abs(x) * F.lit(JITTER_RELATIVE)).otherwise(F.lit(JITTER_ABSOLUTE))
        made[c] = x + std * gaussian(ident, f"{seed}/{c}")
    return df.withColumns(made)


def minute_timestamps(df: DataFrame, step: Column, start: str = SCENARIO_START, out: str = "Timestamp") -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + step * F.lit(60))
    return df.withColumn(out, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))


def test_ids(df: DataFrame, label: str, draw: str, out: str = "Event_ID") -> DataFrame:
    letter = F.substring(F.col(label), 1, 1)
    return df.withColumn(out, F.format_string("TEST_EV_%s_%04d", letter, F.col(draw).cast("long") + F.lit(1000)))


def default_metadata(df: DataFrame, safety: str = "Safety_Index") -> DataFrame:
    """State texts and safety value where they are absent or null."""
    made = {
        c: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d) for c, d in METADATA_DEFAULTS.items()
    }
    made[safety] = F.coalesce(F.col(safety), F.lit(SAFETY_DEFAULT)) if safety in df.columns else F.lit(SAFETY_DEFAULT)
    return df.withColumns(made)


def concat_segments(segments: Sequence[DataFrame], out: str = "segment") -> DataFrame:
    """Segments one after the other, each tagged with its place."""
    tagged = [s.withColumn(out, F.lit(i)) for i, s in enumerate(segments)]
    result = tagged[0]
    for t in tagged[1:]:
        result = result.unionByName(t)
    return result


def ramp_rows(df: DataFrame, ramps: dict[str, tuple[float, float]], first: int, length: int, step: str = "step") -> DataFrame:
    factor = (F.col(step) - F.lit(first)) / F.lit(float(length))
    return df.withColumns({
        c: F.when(F.col(step) >= first, F.lit(start) + factor * F.lit(delta)).otherwise(F.col(c))
        for c, (start, delta) in ramps.items()
    })


def decay_rows(df: DataFrame, columns: Sequence[str], first: int, length: int, *, by: Sequence[str], step: str = "step") -> DataFrame:
    """Fall linearly to zero from the value on the anchor row; a group without one keeps its values."""
    anchors = df.filter(F.col(step) == first).select(*by, F.lit(True).alias("_has_anchor"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    joined = df.join(broadcast_if_small(anchors), list(by), "left")  # one anchor row per group at most
    factor = (F.col(step) - F.lit(first)) / F.lit(float(length))
    made = {
        c: F.when((F.col(step) >= first) & F.col("_has_anchor"), F.greatest(F.lit(0.0), F.col(f"_a_{c}") * (F.lit(1.0) - factor))).otherwise(F.col(c))
        for c in columns
    }
    return joined.withColumns(made).drop("_has_anchor", *[f"_a_{c}" for c in columns])


def override_rows(df: DataFrame, values: dict[str, object], first: int = 0, step: str = "step") -> DataFrame:
    return df.withColumns({c: F.when(F.col(step) >= first, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def scenario_bases(df: DataFrame, scenarios: Sequence[str], label: str, ident: str, *, seed: int = 42) -> DataFrame:
    """The drawn rows of several scenarios, found in one pass; ``segment`` and ``step`` order them."""
    draws = []
    for s in scenarios:
        first = 0
        for i, (risk, rows) in enumerate(SCENARIO_SEGMENTS[s]):
            draws += [
                {"class": risk, "key": f"{risk}/{k}", "seed": f"{seed}/{s}/{i}", "scenario": s, "segment": i, "step": first + k}
                for k in range(rows)
            ]
            first += rows
    out = draw_with_replacement(df, draws, ident, by=label)
    return out.withColumns({"segment": F.col("segment").cast("int"), "step": F.col("step").cast("int")})


def build_scenarios(df: DataFrame, scenarios: Sequence[str], label: str, ident: str, *, seed: int = 42) -> DataFrame:
    """Each scenario's ramps, decays and overrides on its own drawn rows."""
    from furnacelens.session import materialise

    # the drawn rows (some hundreds) are read once per scenario, so they are written first
    base = materialise(scenario_bases(df, scenarios, label, ident, seed=seed), "scenario-rows")
    parts = []
    for s in scenarios:
        out = base.filter(F.col("scenario") == s)
        first, length = SCENARIO_RAMP_ROWS.get(s, (0, 1))
        if s in SCENARIO_DECAYS:
            out = decay_rows(out, SCENARIO_DECAYS[s], first, length, by=["scenario"])
        if s in SCENARIO_RAMPS:
            out = ramp_rows(out, SCENARIO_RAMPS[s], first, length)
        if s in SCENARIO_OVERRIDES:
            out = override_rows(out, SCENARIO_OVERRIDES[s], first)
        parts.append(minute_timestamps(out, F.col("step")))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def scenario_table(spark) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, name string, expected string, description string")
