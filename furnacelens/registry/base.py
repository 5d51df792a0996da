"""Registration helpers, shared inputs, and the SQL views the oracle statements build on."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furnacelens.constants import PHYSICAL_SENSORS, RAW_SENSORS, SENSOR_DEFAULTS
from furnacelens.functions.scalar import ROUND_SHIFT, r6
from furnacelens.sources import telemetry as tele

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ("tel",)):
    """Register a query under ``name``; ``sql`` is its twin over the listed views."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return fn
    return register


# -- Spark inputs ------------------------------------------------------------
def events(spark, sf):
    return tele.table(spark, sf, "events")


def telemetry(spark, sf) -> DataFrame:
    return tele.telemetry_view(events(spark, sf))


def labelled(spark, sf) -> DataFrame:
    return tele.with_label(telemetry(spark, sf))


def raw(spark, sf) -> DataFrame:
    return tele.raw_packets(events(spark, sf))


def spread_raw(spark, sf) -> DataFrame:
    """Raw packets built by all cores, also where a range of events lies in a few row groups of the file."""
    return tele.raw_packets(events(spark, sf).repartition(2 * spark.sparkContext.defaultParallelism, "event_id"))


def lineitem(spark, sf) -> DataFrame:
    return tele.table(spark, sf, "lineitem")


def orders(spark, sf) -> DataFrame:
    return tele.table(spark, sf, "orders")


def predictions(spark, sf) -> DataFrame:
    """Synthetic scores: event_id, label, prob_0..3, prediction, confidence, class names."""
    from furnacelens.operators.features import label_index
    from furnacelens.operators.metrics import score_columns

    base = labelled(spark, sf).withColumn("label", label_index("Future_Risk_Level"))
    raws = []
    for k in range(4):
        w = F.lit(1) + (F.col("event_id") * F.lit(31 + 2 * k)) % F.lit(97)
        raws.append((w + F.when((F.col("label") == k) & (F.col("event_id") % 10 != 0), F.lit(150)).otherwise(F.lit(0))).cast("double"))
    staged = base.withColumns({f"_w{k}": w for k, w in enumerate(raws)})
    total = F.lit(4.0) + F.when(F.col("event_id") % 10 != 0, F.lit(150.0)).otherwise(F.lit(0.0))
    for k in range(4):
        total = total + ((F.col("event_id") * F.lit(31 + 2 * k)) % F.lit(97)).cast("double")
    probs = staged.withColumns({f"prob_{k}": F.col(f"_w{k}") / total for k in range(4)})
    return score_columns(probs.drop("_w0", "_w1", "_w2", "_w3"))


def rounded(df: DataFrame, keys: Sequence[str], values: Sequence[str], digits: int = 6) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keys], *[r6(v, digits).alias(v) for v in values])


# -- SQL building blocks -----------------------------------------------------
def d(x: float) -> str:
    """A double literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def rnd(expr: str, name: str | None = None, digits: int = 6) -> str:
    out = f"round(CAST({expr} AS DOUBLE) + {ROUND_SHIFT * 10.0**-digits!r}, {digits}) + 0e0"
    return f'{out} AS "{name}"' if name else out


def ramp_sql(x: str, a: float, b: float) -> str:
    return f"least(100e0, greatest(0e0, ({x} - {d(a)}) / {d(b - a)} * 100e0))"


def _sensor_sql(name: str) -> str:
    p, lo, hi = tele.SENSOR_BINDING[name]
    value = f"{d(lo)} + {d(hi - lo)} * (((event_id * {p}) % 1009) / 1008e0) * (CAST(asset_id + 1 AS DOUBLE) / 8e0)"
    return f"CAST(floor({value}) AS DOUBLE) AS {name}" if name == "Worker_Count" else f"{value} AS {name}"


_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

_VIEWS["tel"] = ((), f"""
SELECT event_id, asset_id, event_id AS arrival_seq, ts, event_type, value,
  {", ".join(_sensor_sql(s) for s in RAW_SENSORS)},
  CASE WHEN hour(ts) < 8 THEN 'Night' WHEN hour(ts) < 16 THEN 'Morning' ELSE 'Afternoon' END AS Shift_Type,
  CASE (event_id % 13) % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Hot Work' WHEN 2 THEN 'Confined Space' ELSE 'General' END AS Permit_Type,
  CASE WHEN event_id % 11 = 0 THEN 'Worker No PPE' ELSE 'Normal' END AS CCTV_Event,
  event_id % 7 <> 0 AS PPE_Compliance, event_id % 4 = 0 AS Maintenance_Active, event_id % 5 <> 0 AS Gas_Test_Completed
FROM (SELECT *, user_id % 8 AS asset_id FROM events)""")

GAS_SQL = f"greatest({ramp_sql('BF_CO', 40, 200)}, {ramp_sql('BF_H2', 3, 10)}, {ramp_sql('CO_CO', 5, 25)}, {ramp_sql('CO_NH3', 3, 15)})"
STRESS_SQL = (
    f"greatest({ramp_sql('BF_Blower_Vibration', 1.2, 3.5)}, {ramp_sql('CO_Pusher_Vibration', 1.8, 4.0)}, "
    f"{ramp_sql('BF_Cooling_Water_Temperature', 38, 60)}, {ramp_sql('CO_Flue_Temperature', 1220, 1350)})"
)
THERMAL_SQL = (
    "greatest(CASE WHEN BF_Top_Temperature > 900 OR CO_Oven_Temperature > 1400 THEN 0e0 ELSE "
    f"greatest({ramp_sql('BF_Top_Temperature', 220, 350)}, {ramp_sql('CO_Oven_Temperature', 1100, 1200)}) END, "
    f"{ramp_sql('CO_Steam_Temperature', 240, 320)}, CASE WHEN Ambient_Temp > 42 OR Ambient_Temp < 8 THEN 100e0 ELSE 0e0 END)"
)
EXPOSURE_SQL = (
    "CASE WHEN Worker_Count = 0 THEN 0e0 ELSE least(100e0, least(40e0, greatest(0e0, Worker_Count / 10e0 * 40e0)) + "
    "CASE WHEN NOT PPE_Compliance THEN 30e0 ELSE 0e0 END + "
    f"CASE WHEN CCTV_Event IN ('Worker No PPE', 'Unauthorized Entry') THEN 30e0 ELSE 0e0 END + 0.3e0 * {GAS_SQL}) END"
)
MAINT_SQL = (
    "CASE WHEN Maintenance_Active THEN least(100e0, 30e0 + CASE Permit_Type WHEN 'Hot Work' THEN 30e0 WHEN 'Confined Space' "
    "THEN 40e0 ELSE 0e0 END + CASE WHEN NOT Gas_Test_Completed THEN 30e0 ELSE 0e0 END + CASE WHEN Shift_Type = 'Night' "
    "THEN 10e0 ELSE 0e0 END) ELSE 0e0 END"
)
QUALITY_SQL = (
    "greatest(0e0, 100e0 - 5e0 * (CAST(BF_Top_Pressure < 0.5e0 OR BF_Top_Pressure > 3.5e0 AS INT) + "
    "CAST(BF_Top_Temperature < 100 OR BF_Top_Temperature > 400 AS INT) + "
    "CAST(BF_Blower_Vibration < 0 OR BF_Blower_Vibration > 8 AS INT) + "
    "CAST(CO_Oven_Temperature < 800 OR CO_Oven_Temperature > 1300 AS INT) + "
    "CAST(CO_Gas_Pressure < 2 OR CO_Gas_Pressure > 15 AS INT)))"
)
LABEL_SQL = f"""CASE WHEN greatest({GAS_SQL}, {STRESS_SQL}, {THERMAL_SQL}) < 40 THEN 'Low'
  WHEN greatest({GAS_SQL}, {STRESS_SQL}, {THERMAL_SQL}) < 70 THEN 'Medium'
  WHEN greatest({GAS_SQL}, {STRESS_SQL}, {THERMAL_SQL}) < 90 THEN 'High' ELSE 'Critical' END"""
_VIEWS["lab"] = (("tel",), f"SELECT *, {LABEL_SQL} AS Future_Risk_Level FROM tel")
_VIEWS["lab_num"] = (("lab",), """
SELECT *, CASE Future_Risk_Level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS label FROM lab""")


def hash_sql(ident: str, seed) -> str:
    return f"CAST('0x' || substr(md5(CAST({ident} AS VARCHAR) || '|{seed}'), 1, 8) AS BIGINT)"


def grad_sql(s: str, w: int = 5) -> str:
    win = f"(PARTITION BY asset_id ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {win} > 1 THEN ({s} - first_value({s}) OVER {win}) / count(*) OVER {win} ELSE 0e0 END"


_VIEWS["grads"] = (("tel",), f"""
SELECT *, {", ".join(f"{grad_sql(s)} AS g_{s}" for s in PHYSICAL_SENSORS)} FROM tel""")

_VIEWS["idx0"] = (("grads",), f"""
SELECT *, 100e0 - least(100e0, 200e0 * (abs(g_BF_Top_Pressure) / 2e0 + abs(g_BF_Blast_Flow) / 1000e0
    + abs(g_CO_Gas_Pressure) / 5e0 + abs(g_CO_Oven_Temperature) / 200e0)) AS Process_Stability_Index,
  {GAS_SQL} AS Gas_Risk_Index, 100e0 - {STRESS_SQL} AS Equipment_Health_Index, {EXPOSURE_SQL} AS Worker_Exposure_Index,
  {THERMAL_SQL} AS Thermal_Risk_Index, {MAINT_SQL} AS Maintenance_Risk_Index, {QUALITY_SQL} AS Data_Quality_Score
FROM grads""")
_RISKS = [
    "100e0 - Equipment_Health_Index", "Worker_Exposure_Index", "Gas_Risk_Index", "Thermal_Risk_Index",
    "Maintenance_Risk_Index", "100e0 - Process_Stability_Index",
]
_VIEWS["idx1"] = (("idx0",), f"""
SELECT *, least(100e0, greatest({", ".join(_RISKS)}) + 0.15e0 * (({" + ".join(f"({r})" for r in _RISKS)})
  - greatest({", ".join(_RISKS)}))) AS Compound_Risk_Score FROM idx0""")
_VIEWS["idx2"] = (("idx1",), "SELECT *, 100e0 - Compound_Risk_Score AS Safety_Index FROM idx1")
_VIEWS["idx"] = (("idx2",), f"""
SELECT *, CASE WHEN Safety_Index - safety_lag < -2 OR (({" OR ".join(f"abs(g_{s}) > 0.05e0 * abs({s})" for s in PHYSICAL_SENSORS)})
  AND Safety_Index < 95) THEN 1e0 ELSE 0e0 END AS Safety_Lead_Indicator
FROM (SELECT *, first_value(Safety_Index) OVER (PARTITION BY asset_id ORDER BY ts, event_id
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS safety_lag FROM idx2)""")

# raw layer: the fault that applies, the parsed timestamp, and every field after normalisation
_VIEWS["faulty"] = (("tel",), f"""
SELECT *, CASE {" ".join(f"WHEN event_id % {n} = 0 THEN {n}" for n in tele.FAULT_DIVISORS)} ELSE 0 END AS hit FROM tel""")
_VIEWS["parsed"] = (("faulty",), """
SELECT *, CASE hit WHEN 107 THEN NULL WHEN 109 THEN date_trunc('minute', ts)
  WHEN 113 THEN date_trunc('second', ts) - INTERVAL 2 DAY ELSE date_trunc('second', ts) END AS pts,
  hit NOT IN (101, 103, 107) AS sound FROM faulty""")
_VIEWS["verdict"] = (("parsed",), """
SELECT *, CASE WHEN hit = 107 THEN 'missing_timestamp' WHEN pts <= last_ts THEN 'out_of_order'
  WHEN hit = 103 THEN 'missing_fields' WHEN hit = 101 THEN 'not_numeric' END AS reason
FROM (SELECT *, max(CASE WHEN sound THEN pts END) OVER (PARTITION BY asset_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts FROM parsed)""")
_REPLACED = {
    "CO_CO": f"CASE WHEN hit = 97 THEN {d(SENSOR_DEFAULTS['CO_CO'])} ELSE CO_CO END",
    "BF_H2": f"CASE WHEN hit = 101 THEN {d(SENSOR_DEFAULTS['BF_H2'])} ELSE BF_H2 END",
    "CO_NH3": f"CASE WHEN hit = 103 THEN {d(SENSOR_DEFAULTS['CO_NH3'])} ELSE CO_NH3 END",
    "BF_Top_Pressure": "CASE WHEN hit = 457 THEN 0.3e0 ELSE BF_Top_Pressure END",
    "BF_Top_Temperature": "CASE WHEN hit = 457 THEN 950e0 ELSE BF_Top_Temperature END",
    "Permit_Type": "CASE WHEN hit = 127 THEN 'None' ELSE Permit_Type END",
    "PPE_Compliance": "CASE WHEN hit = 131 THEN event_id % 3 <> 1 ELSE PPE_Compliance END",
}
_VIEWS["norm"] = (("verdict",), f"""
SELECT * REPLACE ({", ".join(f"{e} AS {c}" for c, e in _REPLACED.items())}) FROM verdict""")

_VIEWS["flow_grads"] = (("norm",), f"""
SELECT * EXCLUDE (ts), {", ".join(f"{grad_sql(s).replace('ORDER BY ts, event_id', 'ORDER BY pts, event_id')} AS g_{s}"
  for s in ("BF_Top_Pressure", "BF_Blast_Flow", "CO_Gas_Pressure", "CO_Oven_Temperature"))} FROM norm WHERE reason IS NULL""")
_VIEWS["flow_idx"] = (("flow_grads",), _VIEWS["idx0"][1].replace("FROM grads", "FROM flow_grads"))

_VIEWS["pred"] = (("lab_num",), """
SELECT *, CASE prediction WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS predicted_class
FROM (SELECT *, greatest(prob_0, prob_1, prob_2, prob_3) AS confidence,
    CASE greatest(prob_0, prob_1, prob_2, prob_3) WHEN prob_0 THEN 0 WHEN prob_1 THEN 1 WHEN prob_2 THEN 2 ELSE 3 END AS prediction
  FROM (SELECT *, w0 / (w0 + w1 + w2 + w3) AS prob_0, w1 / (w0 + w1 + w2 + w3) AS prob_1,
      w2 / (w0 + w1 + w2 + w3) AS prob_2, w3 / (w0 + w1 + w2 + w3) AS prob_3
    FROM (SELECT *, """ + ", ".join(
    f"CAST(1 + (event_id * {31 + 2 * k}) % 97 + CASE WHEN label = {k} AND event_id % 10 <> 0 THEN 150 ELSE 0 END AS DOUBLE) AS w{k}"
    for k in range(4)
) + " FROM lab_num)))")
_VIEWS["pred_long"] = (("pred",), " UNION ALL ".join(
    f"SELECT {k} AS class, prob_{k} AS p, CAST(label = {k} AS INT) AS y FROM pred" for k in range(4)
))


def with_views(views: Sequence[str], sql: str) -> str:
    ordered: list[str] = []

    def add(v: str) -> None:
        for dep in _VIEWS[v][0]:
            add(dep)
        if v not in ordered:
            ordered.append(v)

    for v in views:
        add(v)
    if not ordered:
        return sql
    return "WITH " + ", ".join(f"{v} AS ({_VIEWS[v][1]})" for v in ordered) + "\n" + sql


def col_list(cols: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in cols]
