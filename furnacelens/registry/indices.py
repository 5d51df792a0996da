"""Risk index queries (F) and the flagship aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.functions.scalar import r6
from furnacelens.operators import indices as X
from furnacelens.operators.rolling import rolling_stats
from furnacelens.registry.base import (
    EXPOSURE_SQL,
    GAS_SQL,
    MAINT_SQL,
    QUALITY_SQL,
    STRESS_SQL,
    THERMAL_SQL,
    query,
    rnd,
    rounded,
    telemetry,
)

FLAGSHIP = "flagship_asset_risk"


@query(FLAGSHIP, f"""
SELECT asset_id, count(*) AS readings, {rnd('min(Process_Stability_Index)', 'min_stability')},
  {rnd('avg(Process_Stability_Index)', 'avg_stability')}, {rnd('max(Gas_Risk_Index)', 'max_gas_risk')}
FROM idx0 GROUP BY asset_id""", ["idx0"])
def flagship(spark, sf):
    t = rolling_stats(telemetry(spark, sf), list(X.STABILITY_SCALES), [5], ["grad"])
    scored = t.select("asset_id", X.process_stability().alias("s"), X.gas_risk().alias("g"))
    return scored.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("readings"), r6(F.min("s")).alias("min_stability"), r6(F.avg("s")).alias("avg_stability"),
        r6(F.max("g")).alias("max_gas_risk"),
    )


@query("f01_process_stability", f"SELECT event_id, {rnd('Process_Stability_Index', 'Process_Stability_Index')} FROM idx0", ["idx0"])
def f01(spark, sf):
    t = rolling_stats(telemetry(spark, sf), list(X.STABILITY_SCALES), [5], ["grad"])
    return t.select("event_id", r6(X.process_stability()).alias("Process_Stability_Index"))


def _pointwise(name, column, spark_expr, sql):
    @query(name, f"SELECT event_id, {rnd(sql, column)} FROM tel")
    def run(spark, sf):
        return telemetry(spark, sf).select("event_id", r6(spark_expr()).alias(column))


_pointwise("f02_gas_risk", "Gas_Risk_Index", X.gas_risk, GAS_SQL)
_pointwise("f03_equipment_health", "Equipment_Health_Index", X.equipment_health, f"100e0 - {STRESS_SQL}")
_pointwise("f04_worker_exposure", "Worker_Exposure_Index", X.worker_exposure, EXPOSURE_SQL)
_pointwise("f05_thermal_risk", "Thermal_Risk_Index", X.thermal_risk, THERMAL_SQL)
_pointwise("f06_maintenance_risk", "Maintenance_Risk_Index", X.maintenance_risk, MAINT_SQL)
_pointwise("f09_data_quality", "Data_Quality_Score", X.data_quality, QUALITY_SQL)


@query("f07_compound_risk", f"SELECT event_id, {rnd('Compound_Risk_Score', 'Compound_Risk_Score')} FROM idx1", ["idx1"])
def f07(spark, sf):
    return rounded(X.risk_indices(telemetry(spark, sf), lead=False), ["event_id"], ["Compound_Risk_Score"])


@query("f08_safety_index", f"""
SELECT event_id, {rnd("CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE Safety_Index END", 'Safety_Index')}
FROM idx2""", ["idx2"])
def f08(spark, sf):
    supplied = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 100).cast("double"))
    t = telemetry(spark, sf).withColumn("supplied", supplied)
    return rounded(X.risk_indices(t, safety="supplied", lead=False), ["event_id"], ["Safety_Index"])


@query("f10_safety_lead", f"SELECT event_id, {rnd('Safety_Lead_Indicator', 'Safety_Lead_Indicator')} FROM idx", ["idx"])
def f10(spark, sf):
    return rounded(X.risk_indices(telemetry(spark, sf)), ["event_id"], ["Safety_Lead_Indicator"])


@query("f12_all_indices", "SELECT event_id, asset_id, " + ", ".join(rnd(c, c) for c in X.INDEX_COLUMNS) + " FROM idx", ["idx"])
def f12(spark, sf):
    return rounded(X.risk_indices(telemetry(spark, sf)), ["event_id", "asset_id"], X.INDEX_COLUMNS)


@query("f12_all_indices_sliced", "SELECT event_id, asset_id, " + ", ".join(rnd(c, c) for c in X.INDEX_COLUMNS) + " FROM idx", ["idx"])
def f12_sliced(spark, sf):
    """The same block with hot assets cut into slices of about a thousand rows."""
    t = X.risk_indices(telemetry(spark, sf), slice_rows=1000)
    return rounded(t, ["event_id", "asset_id"], X.INDEX_COLUMNS)
