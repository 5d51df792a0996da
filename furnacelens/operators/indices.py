"""Domain risk indices. All are column arithmetic; only the lead indicator needs earlier rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.constants import PHYSICAL_SENSORS, SAFETY_LAG_ROWS
from furnacelens.functions.scalar import ramp
from furnacelens.operators.rolling import rolling_stats

# ---------------------------------------------------------------------------
# Gradient scales, ramps, plausibility ranges, weights.
# ---------------------------------------------------------------------------
STABILITY_SCALES = {
    "BF_Top_Pressure": 2.0, "BF_Blast_Flow": 1000.0, "CO_Gas_Pressure": 5.0, "CO_Oven_Temperature": 200.0,
}
GAS_RAMPS = {"BF_CO": (40, 200), "BF_H2": (3, 10), "CO_CO": (5, 25), "CO_NH3": (3, 15)}
STRESS_RAMPS = {
    "BF_Blower_Vibration": (1.2, 3.5), "CO_Pusher_Vibration": (1.8, 4.0),
    "BF_Cooling_Water_Temperature": (38, 60), "CO_Flue_Temperature": (1220, 1350),
}
PLAUSIBLE = {
    "BF_Top_Pressure": (0.5, 3.5), "BF_Top_Temperature": (100.0, 400.0), "BF_Blower_Vibration": (0.0, 8.0),
    "CO_Oven_Temperature": (800.0, 1300.0), "CO_Gas_Pressure": (2.0, 15.0),
}
EXPOSURE_EVENTS = ["Worker No PPE", "Unauthorized Entry"]
INSTRUMENT_FAILURE = "PS022"
INDEX_COLUMNS = [
    "Process_Stability_Index", "Gas_Risk_Index", "Equipment_Health_Index", "Worker_Exposure_Index",
    "Thermal_Risk_Index", "Maintenance_Risk_Index", "Compound_Risk_Score", "Safety_Index",
    "Data_Quality_Score", "Safety_Lead_Indicator",
]


def _instrument_failure(df: DataFrame | None) -> Column:
    if df is not None and "BF_State_ID" in df.columns:
        return F.coalesce(F.col("BF_State_ID") == INSTRUMENT_FAILURE, F.lit(False))
    return F.lit(False)


def stability_loss(gradient=lambda s: F.col(f"{s}_roll_grad_5")) -> Column:
    terms = [F.abs(gradient(s)) / F.lit(scale) for s, scale in STABILITY_SCALES.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.least(F.lit(100.0), F.lit(200.0) * total)


def process_stability() -> Column:
    return F.lit(100.0) - stability_loss()


def gas_risk() -> Column:
    return F.greatest(*[ramp(s, a, b) for s, (a, b) in GAS_RAMPS.items()])


def equipment_health() -> Column:
    return F.lit(100.0) - F.greatest(*[ramp(s, a, b) for s, (a, b) in STRESS_RAMPS.items()])


def worker_exposure(df: DataFrame | None = None, gas: Column | None = None) -> Column:
    gas = gas if gas is not None else gas_risk()
    workers = F.least(F.lit(40.0), F.greatest(F.lit(0.0), F.col("Worker_Count") / F.lit(10.0) * F.lit(40.0)))
    ppe = F.when(~F.col("PPE_Compliance"), F.lit(30.0)).otherwise(F.lit(0.0))
    camera = F.when(F.col("CCTV_Event").isin(*EXPOSURE_EVENTS), F.lit(30.0)).otherwise(F.lit(0.0))
    gas_part = F.when(_instrument_failure(df), F.lit(0.0)).otherwise(F.lit(0.3) * gas)
    return F.when(F.col("Worker_Count") == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), workers + ppe + camera + gas_part))


def thermal_risk(df: DataFrame | None = None) -> Column:
    ignore = (F.col("BF_Top_Temperature") > 900.0) | (F.col("CO_Oven_Temperature") > 1400.0) | _instrument_failure(df)
    furnace = F.when(ignore, F.lit(0.0)).otherwise(
        F.greatest(ramp("BF_Top_Temperature", 220, 350), ramp("CO_Oven_Temperature", 1100, 1200))
    )
    ambient = F.when((F.col("Ambient_Temp") > 42.0) | (F.col("Ambient_Temp") < 8.0), F.lit(100.0)).otherwise(F.lit(0.0))
    return F.greatest(furnace, ramp("CO_Steam_Temperature", 240, 320), ambient)


def maintenance_risk() -> Column:
    permit = (
        F.when(F.col("Permit_Type") == "Hot Work", F.lit(30.0))
        .when(F.col("Permit_Type") == "Confined Space", F.lit(40.0)).otherwise(F.lit(0.0))
    )
    gas_test = F.when(~F.col("Gas_Test_Completed"), F.lit(30.0)).otherwise(F.lit(0.0))
    night = F.when(F.col("Shift_Type") == "Night", F.lit(10.0)).otherwise(F.lit(0.0))
    score = F.least(F.lit(100.0), F.lit(30.0) + permit + gas_test + night)
    return F.when(F.col("Maintenance_Active"), score).otherwise(F.lit(0.0))


def compound_risk() -> Column:
    """From the index columns: worst risk plus a share of the others."""
    risks = [
        F.lit(100.0) - F.col("Equipment_Health_Index"), F.col("Worker_Exposure_Index"), F.col("Gas_Risk_Index"),
        F.col("Thermal_Risk_Index"), F.col("Maintenance_Risk_Index"), F.lit(100.0) - F.col("Process_Stability_Index"),
    ]
    total = risks[0]
    for r in risks[1:]:
        total = total + r
    worst = F.greatest(*risks)
    return F.least(F.lit(100.0), worst + F.lit(0.15) * (total - worst))


def safety_index(supplied: Column | None = None) -> Column:
    own = F.lit(100.0) - F.col("Compound_Risk_Score")
    return own if supplied is None else F.coalesce(supplied, own)


def data_quality() -> Column:
    misses = [
        F.when((F.col(s) < low) | (F.col(s) > high), F.lit(1)).otherwise(F.lit(0)) for s, (low, high) in PLAUSIBLE.items()
    ]
    total = misses[0]
    for m in misses[1:]:
        total = total + m
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.lit(5.0) * total)


def lead_indicator(safety: str, lagged: str) -> Column:
    steep = " OR ".join(f"abs({s}_roll_grad_5) > 0.05D * abs({s})" for s in PHYSICAL_SENSORS)
    return F.expr(f"CASE WHEN {safety} - {lagged} < -2D OR (({steep}) AND {safety} < 95D) THEN 1D ELSE 0D END")


def pointwise_indices(df: DataFrame) -> DataFrame:
    """The four indices that look at the current packet only."""
    return df.withColumns({
        "Gas_Risk_Index": gas_risk(),
        "Equipment_Health_Index": equipment_health(),
        "Thermal_Risk_Index": thermal_risk(df),
        "Maintenance_Risk_Index": maintenance_risk(),
        "Data_Quality_Score": data_quality(),
    }).withColumn("Worker_Exposure_Index", worker_exposure(df, F.col("Gas_Risk_Index")))


def risk_indices(
    df: DataFrame, *, safety: str | None = None, lead: bool = True, keep_gradients: bool = False, **window
) -> DataFrame:
    """All indices. ``df`` holds packets; gradients are computed unless the columns are there already.

    With a supplied safety column the lag rides on the same window as the gradients: one shuffle.
    A derived safety value depends on the gradients, so its lag is a second window over the same
    partitioning and order.
    """
    needed = PHYSICAL_SENSORS if lead else list(STABILITY_SCALES)
    have = all(f"{s}_roll_grad_5" in df.columns for s in needed)
    base = df
    if not have:
        extra = None
        if safety and lead:
            extra = {"_safety_lag": (f"first_value(`{safety}`)", SAFETY_LAG_ROWS)}
        base = rolling_stats(df, needed, [5], ["grad"], extra=extra, **window)
    out = pointwise_indices(base).withColumn("Process_Stability_Index", process_stability())
    out = out.withColumn("Compound_Risk_Score", compound_risk())
    out = out.withColumn("Safety_Index", safety_index(F.col(safety) if safety else None))
    if lead:
        if "_safety_lag" not in out.columns:
            from furnacelens.operators.rolling import lagged_safety

            out = lagged_safety(out, out="_safety_lag", **window)
        out = out.withColumn("Safety_Lead_Indicator", lead_indicator("Safety_Index", "_safety_lag"))
    if not have and not keep_gradients:
        out = out.drop(*[f"{s}_roll_grad_5" for s in needed])
    return out.drop("_safety_lag")
