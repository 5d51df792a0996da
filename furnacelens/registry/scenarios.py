"""Data augmentation queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.catalogues import (
    SCENARIO_DECAYS,
    SCENARIO_OVERRIDES,
    SCENARIO_RAMP_ROWS,
    SCENARIO_RAMPS,
    SCENARIO_SEGMENTS,
)
from furnacelens.functions.scalar import r6
from furnacelens.operators import augment as P
from furnacelens.registry.base import d, hash_sql, labelled, query, rnd

LABEL = "Future_Risk_Level"


def draw_sql(sizes: dict[str, int], seed) -> str:
    """Rows drawn with replacement: position = hash(class/draw) mod class size."""
    draws = " UNION ALL ".join(f"SELECT '{c}' AS cls, unnest(range({n})) AS draw" for c, n in sizes.items())
    return f"""(SELECT t.*, draw FROM ({draws}) JOIN (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY {hash_sql('event_id', 'order')}, event_id) AS pos,
  count(*) OVER (PARTITION BY {LABEL}) AS n FROM lab) t ON t.{LABEL} = cls AND pos = {hash_sql("cls || '/' || draw", seed)} % n + 1)"""


@query("p01_rows_per_class", f"""SELECT event_id, {LABEL}, CAST(rk - 1 AS INTEGER) AS draw FROM (
  SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY {hash_sql('event_id', 42)}, event_id) AS rk FROM lab) WHERE rk <= 100""", ["lab"])
def p01(spark, sf):
    return P.rows_per_class(labelled(spark, sf), 100, LABEL, "event_id").select("event_id", LABEL, "draw")


@query("p02_draw_with_replacement", f"SELECT event_id, {LABEL}, CAST(draw AS INTEGER) AS draw FROM {draw_sql({'Low': 500, 'Critical': 300}, 7)}", ["lab"])
def p02(spark, sf):
    return P.draw_rows(labelled(spark, sf), {"Low": 500, "Critical": 300}, LABEL, "event_id", seed=7).select("event_id", LABEL, "draw")


def _u(part: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42/CO_CO/{part}'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0"


@query("p03_relative_jitter", f"""SELECT event_id, PPE_Compliance, {rnd(f"CO_CO + CASE WHEN abs(CO_CO) > 1e-3 THEN abs(CO_CO) * 0.005e0 ELSE 0.01e0 END * sqrt(-2e0 * ln({_u('a')})) * cos(6.283185307179586e0 * {_u('b')})", 'CO_CO')} FROM lab""", ["lab"])
def p03(spark, sf):
    return P.jitter(labelled(spark, sf), ["CO_CO"], "event_id").select("event_id", "PPE_Compliance", r6("CO_CO").alias("CO_CO"))


@query("p04_minute_timestamps", "SELECT event_id, strftime(TIMESTAMP '2026-10-01 09:00:00' + to_minutes(event_id), '%Y-%m-%d %H:%M:%S') AS Timestamp FROM lab", ["lab"])
def p04(spark, sf):
    return P.minute_timestamps(labelled(spark, sf), F.col("event_id")).select("event_id", "Timestamp")


@query("p05_test_ids", f"SELECT event_id AS source_id, 'TEST_EV_' || substr({LABEL}, 1, 1) || '_' || printf('%04d', event_id + 1000) AS test_id FROM lab", ["lab"])
def p05(spark, sf):
    return P.test_ids(labelled(spark, sf), LABEL, "event_id", out="test_id").select(F.col("event_id").alias("source_id"), "test_id")


@query("p06_metadata_defaults", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'PS022' ELSE 'PS001' END AS BF_State_ID, 'Normal' AS CO_State_Name,
  {rnd('CASE WHEN event_id % 3 = 0 THEN value ELSE 85e0 END', 'Safety_Index')}, {rnd('CO_CO', 'CO_CO')} FROM lab""", ["lab"])
def p06(spark, sf):
    e = F.col("event_id")
    t = labelled(spark, sf).withColumns({"BF_State_ID": F.when(e % 2 == 0, "PS022"), "Safety_Index": F.when(e % 3 == 0, F.col("value"))})
    out = P.overlay(P.default_metadata(t), {"CO_CO": F.col("CO_CO")})
    return out.select("event_id", "BF_State_ID", "CO_State_Name", r6("Safety_Index").alias("Safety_Index"), r6("CO_CO").alias("CO_CO"))


@query("p07_segments", f"""SELECT 0 AS segment, event_id, CAST(draw AS INTEGER) AS step FROM {draw_sql({'Low': 15}, '42/s2/0')}
UNION ALL SELECT 1, event_id, CAST(draw + 15 AS INTEGER) FROM {draw_sql({'Medium': 35}, '42/s2/1')}""", ["lab"])
def p07(spark, sf):
    return P.scenario_bases(labelled(spark, sf), ["s2"], LABEL, "event_id").select("segment", "event_id", "step")


@query("p08_linear_ramp", f"SELECT event_id, {rnd('CASE WHEN event_id >= 500 THEN 2e0 + (event_id - 500) / 35e0 * 2.2e0 ELSE BF_Gas_Pressure END', 'BF_Gas_Pressure')} FROM lab", ["lab"])
def p08(spark, sf):
    out = P.ramp_rows(labelled(spark, sf), {"BF_Gas_Pressure": (2.0, 2.2)}, 500, 35, step="event_id")
    return out.select("event_id", r6("BF_Gas_Pressure").alias("BF_Gas_Pressure"))


@query("p09_decay_from_anchor", f"""SELECT asset_id, event_id, {rnd('CASE WHEN pos >= 10 THEN greatest(0e0, anchor * (1e0 - (pos - 10) / 40e0)) ELSE BF_Blast_Flow END', 'BF_Blast_Flow')}
FROM (SELECT *, max(CASE WHEN pos = 10 THEN BF_Blast_Flow END) OVER (PARTITION BY asset_id) AS anchor FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_id) - 1 AS pos FROM lab))""", ["lab"])
def p09(spark, sf):
    from furnacelens.operators.ordered import row_positions

    t = row_positions(labelled(spark, sf), ["asset_id"], F.col("event_id"), ["event_id"], "pos", width=4096)
    out = P.decay_rows(t.withColumn("pos", F.col("pos") - 1), ["BF_Blast_Flow"], 10, 40, by=["asset_id"], step="pos")
    return out.select("asset_id", "event_id", r6("BF_Blast_Flow").alias("BF_Blast_Flow"))


@query("p10_constant_overrides", f"""SELECT event_id, CASE WHEN event_id >= 50 THEN 'Hot Work' ELSE Permit_Type END AS Permit_Type,
  {rnd('CASE WHEN event_id >= 50 THEN 1.8e0 ELSE BF_CO END', 'BF_CO')} FROM lab""", ["lab"])
def p10(spark, sf):
    out = P.override_rows(labelled(spark, sf), {"Permit_Type": "Hot Work", "BF_CO": 1.8}, 50, step="event_id")
    return out.select("event_id", "Permit_Type", r6("BF_CO").alias("BF_CO"))


SHOWN = ["BF_Gas_Pressure", "BF_CO", "BF_Cooling_Water_Flow", "BF_Top_Temperature", "BF_Blower_Vibration", "BF_Blast_Flow", "CO_Pusher_Current", "Worker_Count"]


def _scenario_sql(s: str) -> str:
    parts, first = [], 0
    for i, (risk, n) in enumerate(SCENARIO_SEGMENTS[s]):
        parts.append(f"SELECT *, draw + {first} AS step FROM {draw_sql({risk: n}, f'42/{s}/{i}')}")
        first += n
    start, length = SCENARIO_RAMP_ROWS.get(s, (0, 1))
    cols = []
    for c in SHOWN:
        e = c
        if c in SCENARIO_RAMPS.get(s, {}):
            a, delta = SCENARIO_RAMPS[s][c]
            e = f"CASE WHEN step >= {start} THEN {d(a)} + (step - {start}) / {d(length)} * {d(delta)} ELSE {c} END"
        if c in SCENARIO_DECAYS.get(s, []):
            e = f"CASE WHEN step >= {start} THEN greatest(0e0, max(CASE WHEN step = {start} THEN {c} END) OVER () * (1e0 - (step - {start}) / {d(length)})) ELSE {c} END"
        if c in SCENARIO_OVERRIDES.get(s, {}):
            e = f"CASE WHEN step >= {start} THEN {d(SCENARIO_OVERRIDES[s][c])} ELSE {c} END"
        cols.append(rnd(e, c))
    return f"""SELECT '{s}' AS scenario, CAST(step AS INTEGER) AS step, strftime(TIMESTAMP '2026-10-01 09:00:00' + to_minutes(CAST(step AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS Timestamp,
  event_id, {', '.join(cols)} FROM ({' UNION ALL '.join(parts)})"""


@query("p11_scenarios", " UNION ALL ".join(f"({_scenario_sql(s)})" for s in SCENARIO_SEGMENTS), ["lab"])
def p11(spark, sf):
    """All seven scenarios from their specifications."""
    t = labelled(spark, sf).select("event_id", LABEL, *SHOWN, "CO_Gas_Pressure", "CO_CO", "CO_Pusher_Vibration", "BF_Blower_Current",
                                   "BF_Cooling_Water_Temperature", "CO_Oven_Temperature", "Maintenance_Active", "Permit_Type", "PPE_Compliance", "Gas_Test_Completed")
    out = P.build_scenarios(t, list(SCENARIO_SEGMENTS), LABEL, "event_id")
    return out.select("scenario", "step", "Timestamp", "event_id", *[r6(c).alias(c) for c in SHOWN])
