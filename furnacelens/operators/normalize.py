"""Normalisation: canonical timestamp, sensor, category and boolean values; recommendation schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.constants import (
    BOOLEAN_DEFAULTS,
    CATEGORY_DEFAULTS,
    CATEGORY_DOMAINS,
    DEFAULT_SAFETY_INDEX,
    FALSE_TOKENS,
    RAW_SENSORS,
    SENSOR_DEFAULTS,
    TRUE_TOKENS,
)


def canonical_timestamp(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(F.date_trunc("second", c), "yyyy-MM-dd HH:mm:ss")


def sensor_value(text: Column, default: float) -> Column:
    """Number from text; missing, empty, unreadable and NaN become the default."""
    fallback = F.lit(float(default))
    return F.coalesce(F.nanvl(text.try_cast("double"), fallback), fallback)  # the text is parsed once


def category_value(text: Column, domain: list[str], default: str) -> Column:
    return F.when(text.isin(*domain), text).otherwise(F.lit(default))


def boolean_value(text: Column, default: bool) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False).otherwise(F.lit(default))


def normalised_fields(packet: str = "packet") -> dict[str, Column]:
    m = F.col(packet)
    fields = {s: sensor_value(m[s], SENSOR_DEFAULTS[s]) for s in RAW_SENSORS}
    fields.update({c: category_value(m[c], d, CATEGORY_DEFAULTS[c]) for c, d in CATEGORY_DOMAINS.items()})
    fields.update({b: boolean_value(m[b], d) for b, d in BOOLEAN_DEFAULTS.items()})
    return fields


def normalise_packets(df: DataFrame, *, packet: str = "packet", ts: str = "ts", keep: list[str] | None = None) -> DataFrame:
    """Flat, fully typed, null-free packets; ts is cut to the second."""
    keep = keep if keep is not None else [c for c in df.columns if c not in (packet, ts, "payload")]
    return df.select(
        *keep,
        F.date_trunc("second", ts).alias("ts"),
        canonical_timestamp(ts).alias("Timestamp"),
        *[c.alias(n) for n, c in normalised_fields(packet).items()],
    )


def attach_safety_index(df: DataFrame, source: str | None = None, out: str = "Safety_Index") -> DataFrame:
    supplied = F.col(source) if source else F.lit(None).cast("double")
    return df.withColumn(out, F.coalesce(supplied, F.lit(DEFAULT_SAFETY_INDEX)))


def _first_text(df: DataFrame, names: list[str], default: str | None) -> Column:
    parts = [F.when(F.col(n) != "", F.col(n)) for n in names if n in df.columns]
    parts.append(F.lit(default).cast("string"))
    return F.trim(F.coalesce(*parts))


def unify_recommendations(df: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Legacy and current recommendation rows in one schema; rows without an action are set apart."""
    unified = df.select(
        *keep,
        _first_text(df, ["priority", "severity"], "HIGH").alias("priority"),
        _first_text(df, ["action", "recommended_action"], None).alias("action"),
        _first_text(df, ["reason", "description"], "Safety threshold limit exceeded").alias("reason"),
        _first_text(df, ["category", "hazard_category", "process_area"], "General").alias("category"),
    )
    return unified.filter(F.col("action").isNotNull()), unified.filter(F.col("action").isNull())
