"""The telemetry view over the events table, and its raw packet form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furnacelens.constants import RAW_SENSORS, RISK_CLASSES
from furnacelens.functions.scalar import ramp

# ---------------------------------------------------------------------------
# Sensor -> (multiplier p, low, high) of the test binding.
# ---------------------------------------------------------------------------
SENSOR_BINDING = {
    "BF_Blast_Flow": (7919, 1450.0, 1600.0),
    "BF_Top_Temperature": (104729, 150.0, 380.0),
    "CO_Gas_Pressure": (1299709, 2.0, 6.0),
    "CO_CO": (15485863, 0.5, 30.0),
    "BF_H2": (32452843, 0.5, 10.0),
    "CO_NH3": (49979687, 0.05, 14.0),
    "BF_Blower_Current": (67867967, 2500.0, 3500.0),
    "BF_Blower_Vibration": (86028121, 0.6, 4.2),
    "BF_Burden_Level": (101, 1.5, 2.5),
    "BF_Cooling_Water_Flow": (211, 170.0, 60.0),
    "BF_Cooling_Water_Temperature": (307, 30.0, 65.0),
    "BF_Top_Pressure": (401, 1.4, 1.6),
    "CO_Oven_Temperature": (503, 980.0, 1220.0),
    "CO_Flue_Temperature": (601, 1150.0, 1360.0),
    "CO_Pusher_Current": (701, 120.0, 180.0),
    "CO_Pusher_Vibration": (809, 0.8, 4.4),
    "CO_Quenching_Water_Flow": (907, 80.0, 120.0),
    "CO_Steam_Temperature": (1013, 225.0, 330.0),
    "Ambient_Temp": (1103, 15.0, 44.0),
    "Worker_Count": (1201, 0.0, 12.0),
    "BF_CO": (1301, 1.0, 210.0),
    "BF_Gas_Pressure": (1409, 1.5, 5.0),
}
FAULT_DIVISORS = [97, 101, 103, 107, 109, 113, 127, 131, 457]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sensor(name: str) -> str:
    """One sensor as SQL text: low + (high - low) * fraction * severity, all in doubles."""
    p, low, high = SENSOR_BINDING[name]
    fraction = f"CAST((event_id * {p}L) % 1009L AS DOUBLE) / 1008D"
    severity = "CAST(asset_id + 1 AS DOUBLE) / 8D"
    value = f"{low!r}D + {high - low!r}D * ({fraction}) * ({severity})"
    return f"CAST(floor({value}) AS DOUBLE)" if name == "Worker_Count" else value


def telemetry_view(events: DataFrame) -> DataFrame:
    """One clean packet per event; a projection, so unused sensors are pruned."""
    return events.selectExpr("*", "user_id % 8 AS asset_id").selectExpr(
        "event_id", "asset_id", "event_id AS arrival_seq", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value",
        *[f"{_sensor(s)} AS {s}" for s in RAW_SENSORS],
        "CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Morning' ELSE 'Afternoon' END AS Shift_Type",
        """CASE (event_id % 13) % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Hot Work' WHEN 2 THEN 'Confined Space'
           ELSE 'General' END AS Permit_Type""",
        "CASE WHEN event_id % 11 = 0 THEN 'Worker No PPE' ELSE 'Normal' END AS CCTV_Event",
        "event_id % 7 <> 0 AS PPE_Compliance",
        "event_id % 4 = 0 AS Maintenance_Active",
        "event_id % 5 <> 0 AS Gas_Test_Completed",
    )


def with_label(df: DataFrame, out: str = "Future_Risk_Level") -> DataFrame:
    """Risk class from the highest of the gas, equipment and thermal readings."""
    hazard = F.greatest(
        ramp("BF_CO", 40, 200), ramp("BF_H2", 3, 10), ramp("CO_CO", 5, 25), ramp("CO_NH3", 3, 15),
        ramp("BF_Blower_Vibration", 1.2, 3.5), ramp("CO_Pusher_Vibration", 1.8, 4.0),
        ramp("BF_Cooling_Water_Temperature", 38, 60), ramp("CO_Flue_Temperature", 1220, 1350),
        F.when(
            (F.col("BF_Top_Temperature") > 900) | (F.col("CO_Oven_Temperature") > 1400), F.lit(0.0)
        ).otherwise(F.greatest(ramp("BF_Top_Temperature", 220, 350), ramp("CO_Oven_Temperature", 1100, 1200))),
        ramp("CO_Steam_Temperature", 240, 320),
        F.when((F.col("Ambient_Temp") > 42) | (F.col("Ambient_Temp") < 8), F.lit(100.0)).otherwise(F.lit(0.0)),
    )
    # limits at 40, 70 and 90 as a table by tens: the hazard is referenced once, a CASE would repeat it
    by_tens = [RISK_CLASSES[(t >= 4) + (t >= 7) + (t >= 9)] for t in range(11)]
    tens = F.floor(hazard / F.lit(10.0)).cast("int")
    return df.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in by_tens]), tens + F.lit(1)))


def raw_packets(events: DataFrame) -> DataFrame:
    """The same readings as JSON packets with injected faults: asset_id, arrival_seq, payload."""
    faults = " ".join(f"WHEN event_id % {n} = 0 THEN {n}" for n in FAULT_DIVISORS)
    t = telemetry_view(events).selectExpr("*", f"CASE {faults} ELSE 0 END AS hit", "date_trunc('second', ts) AS sec")
    fields = {s: f"CAST({s} AS STRING)" for s in RAW_SENSORS}
    fields |= {c: c for c in ("Shift_Type", "Permit_Type", "CCTV_Event")}
    fields |= {c: f"CAST({c} AS STRING)" for c in ("PPE_Compliance", "Maintenance_Active", "Gas_Test_Completed")}
    fields["Timestamp"] = """CASE hit WHEN 109 THEN date_format(ts, 'yyyy-MM-dd HH:mm')
        WHEN 113 THEN date_format(sec - INTERVAL 2 DAYS, 'yyyy-MM-dd HH:mm:ss')
        ELSE date_format(sec, 'yyyy-MM-dd HH:mm:ss') END"""
    fields["CO_CO"] = "CASE WHEN hit <> 97 THEN CAST(CO_CO AS STRING) END"
    fields["BF_H2"] = "CASE WHEN hit = 101 THEN 'bad' ELSE CAST(BF_H2 AS STRING) END"
    fields["BF_Top_Pressure"] = "CASE WHEN hit = 457 THEN '0.3' ELSE CAST(BF_Top_Pressure AS STRING) END"
    fields["BF_Top_Temperature"] = "CASE WHEN hit = 457 THEN '950' ELSE CAST(BF_Top_Temperature AS STRING) END"
    fields["Permit_Type"] = "CASE WHEN hit = 127 THEN 'Unknown' ELSE Permit_Type END"
    fields["PPE_Compliance"] = """CASE WHEN hit = 131 THEN element_at(array('Yes', 'no', '1'), CAST(event_id % 3 + 1 AS INT))
        ELSE CAST(PPE_Compliance AS STRING) END"""
    packet = "map(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    kept = f"map_filter({packet}, (k, v) -> NOT (hit = 103 AND k = 'CO_NH3') AND NOT (hit = 107 AND k = 'Timestamp'))"
    return t.selectExpr("asset_id", "arrival_seq", f"to_json({kept}) AS payload")
