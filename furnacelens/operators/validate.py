"""Packet validation: presence, timestamp, order, fields, numbers, bounds, categories, verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.constants import BOOLEAN_DEFAULTS, CATEGORY_DOMAINS, RAW_SENSORS, SENSOR_BOUNDS
from furnacelens.operators.ordered import SLICE_ROWS, running_max_before

REQUIRED_FIELDS = RAW_SENSORS + list(CATEGORY_DOMAINS) + list(BOOLEAN_DEFAULTS)

PLAIN_NUMBER = r"\A-?[0-9]{1,30}(\.[0-9]{1,30})?\z"


def has_timestamp(packet: str = "packet") -> Column:
    return F.coalesce(F.map_contains_key(packet, F.lit("Timestamp")), F.lit(False))


def parse_timestamp(text: Column) -> Column:
    """Second format for long text, minute format for short, ISO-8601 for the rest, else null."""
    with_seconds = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    with_minutes = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))
    # ISO text starts with a full date, so a bare year or a time of day does not pass
    iso_value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(F.when(F.length(text) > 16, with_seconds).otherwise(with_minutes), iso_value)


def missing_fields(packet: str = "packet") -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in REQUIRED_FIELDS]), F.map_keys(packet))


def unreadable_sensors(packet: str = "packet") -> Column:
    """Sensors whose value is present but is not a number."""
    # plain digits always parse, and the pattern costs a fraction of parsing seventeen of them
    bad = [
        F.when(~F.col(packet)[s].rlike(PLAIN_NUMBER) & F.col(packet)[s].try_cast("double").isNull(), F.lit(s)) for s in RAW_SENSORS
    ]
    return F.array_compact(F.array(*bad))


def out_of_bounds(packet: str = "packet") -> Column:
    """Sensors outside their physical bounds: a warning, not a rejection."""
    flags = []
    for s, (low, high) in SENSOR_BOUNDS.items():
        v = F.col(packet)[s].try_cast("double")
        flags.append(F.when((v < F.lit(low)) | ((v > F.lit(high)) & ~F.isnan(v)), F.lit(s)))
    return F.array_compact(F.array(*flags))


def unknown_categories(packet: str = "packet") -> Column:
    flags = [
        F.when(F.col(packet)[c].isNotNull() & ~F.col(packet)[c].isin(*domain), F.lit(c))
        for c, domain in CATEGORY_DOMAINS.items()
    ]
    return F.array_compact(F.array(*flags))


def check_fields(df: DataFrame, packet: str = "packet") -> DataFrame:
    """The checks that look at one packet only: adds ts and the columns order_verdict reads."""
    return df.withColumns({
        "ts": parse_timestamp(F.col(packet)["Timestamp"]),
        "_readable": F.col(packet).isNotNull(),
        "_has_ts": has_timestamp(packet),
        "_complete": F.coalesce(F.size(missing_fields(packet)) == 0, F.lit(False)),
        "_numeric": F.coalesce(F.size(unreadable_sensors(packet)) == 0, F.lit(False)),
    })


def order_verdict(
    checked: DataFrame, *, key: str = "asset_id", seq: str = "arrival_seq", slice_rows: int = SLICE_ROWS,
    width: int = 65_536,
) -> DataFrame:
    """Adds reason (null when accepted) and is_valid.

    A packet is out of order when its timestamp is not later than every accepted one before it. A
    packet rejected only for its order never raises that maximum, so the running maximum over all
    otherwise sound packets is the same number, and a maximum can be computed slice by slice.
    """
    sound = F.col("ts").isNotNull() & F.col("_complete") & F.col("_numeric")
    ordered = running_max_before(
        checked, [key], seq, F.when(sound, F.col("ts")), "_last_ts", slice_rows=slice_rows, width=width
    )
    reason = (
        F.when(~F.col("_readable"), "malformed_packet")
        .when(~F.col("_has_ts"), "missing_timestamp")
        .when(F.col("ts").isNull(), "bad_timestamp")
        .when(F.col("ts") <= F.col("_last_ts"), "out_of_order")
        .when(~F.col("_complete"), "missing_fields")
        .when(~F.col("_numeric"), "not_numeric")
    )
    return ordered.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).drop(
        "_readable", "_has_ts", "_complete", "_numeric", "_last_ts"
    )


def validate_packets(df: DataFrame, *, packet: str = "packet", **order) -> DataFrame:
    """Full verdict on decoded packets, all columns kept (also the mode that only tags)."""
    return order_verdict(check_fields(df, packet), **order)


def split_verdict(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and the quarantine with its reasons."""
    return validated.filter("is_valid"), validated.filter("NOT is_valid")
