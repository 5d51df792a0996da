"""Projection, filter and conversion queries (B) and feature vectors (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.constants import LEAKAGE_CATEGORY, PHYSICAL_SENSORS, RAW_SENSORS
from furnacelens.functions.scalar import finite_or, null_if_not_finite, r6, truthy_or
from furnacelens.operators import features as FS
from furnacelens.operators import vector as V
from furnacelens.operators.augment import overlay
from furnacelens.operators.indices import risk_indices
from furnacelens.operators.metrics import misclassified
from furnacelens.operators.rolling import latest_row, rolling_stats
from furnacelens.registry.base import labelled, predictions, query, raw, rnd, rounded, telemetry
from furnacelens.sources.files import decode_packets

KNOWN = ["Timestamp", "CO_CO", "BF_H2", "CO_NH3"]


@query("b01_known_keys", """SELECT event_id AS arrival_seq, CASE hit WHEN 103 THEN 'BF_H2,CO_CO,Timestamp' WHEN 107 THEN 'BF_H2,CO_CO,CO_NH3'
  ELSE 'BF_H2,CO_CO,CO_NH3,Timestamp' END AS keys FROM faulty""", ["faulty"])
def b01(spark, sf):
    kept = F.map_filter("packet", lambda k, v: k.isin(*KNOWN))
    return decode_packets(raw(spark, sf)).select("arrival_seq", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


_LEAKY = ["Future_Risk_Level", "Safety_Index", "Compound_Risk_Score", "Event_ID", "BF_State_ID", "Rule_R001", "Rule_R016"]




@query("b02_leakage_removal", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')}, '{','.join(sorted(_LEAKY))}' AS removed, 34 AS columns_left FROM tel")
def b02(spark, sf):
    # Spark resolves names without case, so the id column is renamed before the text Event_ID is added
    base = labelled(spark, sf).withColumnRenamed("event_id", "rid")
    e = F.col("rid")
    wide = base.withColumns({
        "Safety_Index": F.col("value"), "Compound_Risk_Score": F.lit(100.0) - F.col("value"), "Event_ID": e.cast("string"),
        "BF_State_ID": F.lit("PS001"), "Rule_R001": (e % 2).cast("int"), "Rule_R016": (e % 3).cast("int"),
    })
    clean, removed = FS.remove_leakage(wide)
    return clean.select(F.col("rid").alias("event_id"), r6("CO_CO").alias("CO_CO"), F.lit(",".join(sorted(removed))).alias("removed"), F.lit(len(clean.columns)).alias("columns_left"))


@query("b02_removal_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'Active Safety Rule' if c.startswith('Rule_') else LEAKAGE_CATEGORY.get(c, 'State Metadata')}' AS category, count({e}) AS filled FROM lab"
    for c, e in [("Safety_Index", "value"), ("Compound_Risk_Score", "value"), ("Future_Risk_Level", "Future_Risk_Level"), ("Rule_R001", "event_id")]), ["lab"])
def b02_report(spark, sf):
    wide = labelled(spark, sf).withColumns({
        "Safety_Index": F.col("value"), "Compound_Risk_Score": F.lit(100.0) - F.col("value"), "Rule_R001": (F.col("event_id") % 2).cast("int")})
    _clean, removed = FS.remove_leakage(wide)
    one = wide.agg(*[F.count(c).alias(c) for c in removed])
    filled = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in removed])))
    return FS.removal_report(wide, removed).join(F.broadcast(filled), "column")


@query("b03_class_filter", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')} FROM lab WHERE Future_Risk_Level = 'Critical'", ["lab"])
def b03(spark, sf):
    return rounded(labelled(spark, sf).filter(F.col("Future_Risk_Level") == "Critical"), ["event_id"], ["CO_CO"])


@query("b04_wrong_predictions", "SELECT event_id, label, prediction FROM pred WHERE NOT (label = prediction)", ["pred"])
def b04(spark, sf):
    p = predictions(spark, sf)
    return p.filter(~(F.col("label") == F.col("prediction"))).select("event_id", "label", "prediction")


@query("b05_column_alignment", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')}, 0e0 AS Not_Measured, {rnd('BF_H2', 'BF_H2')} FROM tel")
def b05(spark, sf):
    t = telemetry(spark, sf)
    wanted = ["CO_CO", "Not_Measured", "BF_H2"]
    return t.select("event_id", *[(r6(c) if c in t.columns else F.lit(0.0)).alias(c) for c in wanted])


@query("b06_numeric_columns", f"SELECT event_id, asset_id, {rnd('value', 'value')}, 26 AS numeric_columns FROM tel")
def b06(spark, sf):
    t = FS.numeric_only(telemetry(spark, sf))
    return t.select("event_id", "asset_id", r6("value").alias("value"), F.lit(len(t.columns)).alias("numeric_columns"))


@query("b07_label_map", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE label END AS label_or_null,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE label END AS label_or_zero FROM lab_num""", ["lab_num"])
def b07(spark, sf):
    t = labelled(spark, sf).withColumn("risk", F.when(F.col("event_id") % 9 == 0, "Extreme").otherwise(F.col("Future_Risk_Level")))
    return t.select("event_id", FS.label_index("risk").alias("label_or_null"), FS.label_index("risk", unknown=0).alias("label_or_zero"))


@query("b08_unknown_labels", "SELECT DISTINCT event_type AS risk FROM events WHERE event_type NOT IN ('Low', 'Medium', 'High', 'Critical')", [])
def b08(spark, sf):
    t = labelled(spark, sf).withColumn("risk", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.col("Future_Risk_Level")))
    return FS.unknown_labels(t, "risk")


@query("b09_correct_flag", "SELECT event_id, Future_Risk_Level = predicted_class AS correct FROM pred", ["pred"])
def b09(spark, sf):
    return predictions(spark, sf).select("event_id", (F.col("Future_Risk_Level") == F.col("predicted_class")).alias("correct"))


@query("b10_row_number", """SELECT Row_Number, event_id, Future_Risk_Level, predicted_class FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) AS Row_Number FROM pred) WHERE Future_Risk_Level <> predicted_class""", ["pred"])
def b10(spark, sf):
    out = misclassified(predictions(spark, sf), "Future_Risk_Level", "predicted_class", "event_id")
    return out.select("Row_Number", "event_id", "Future_Risk_Level", "predicted_class")


@query("b11_field_overlay", f"SELECT event_id, 22.5e0 AS BF_CO, {rnd('BF_H2 * 1.1e0', 'BF_H2')}, {rnd('CO_CO', 'CO_CO')}, false AS Maintenance_Active FROM tel")
def b11(spark, sf):
    out = overlay(telemetry(spark, sf), {"BF_CO": 22.5, "BF_H2": F.col("BF_H2") * F.lit(1.1), "Maintenance_Active": False})
    return out.select("event_id", "BF_CO", r6("BF_H2").alias("BF_H2"), r6("CO_CO").alias("CO_CO"), "Maintenance_Active")


def odd_values(df):
    x = F.col("value")
    e = F.col("event_id")
    return df.withColumn("odd", F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 7 == 1, F.lit(float("inf"))).when(e % 7 == 2, None).when(e % 7 == 3, F.lit(0.0)).otherwise(x))


@query("b12_nan_to_null", f"SELECT event_id, CASE WHEN event_id % 7 < 3 THEN NULL WHEN event_id % 7 = 3 THEN 0e0 ELSE {rnd('value')} END AS odd FROM tel")
def b12(spark, sf):
    return odd_values(telemetry(spark, sf)).select("event_id", r6(null_if_not_finite("odd")).alias("odd"))


@query("b13_sanitise", f"SELECT event_id, CASE WHEN event_id % 7 <= 3 THEN 0e0 ELSE {rnd('value')} END AS odd FROM tel")
def b13(spark, sf):
    return odd_values(telemetry(spark, sf)).select("event_id", r6(finite_or("odd", 0.0)).alias("odd"))


@query("b14_truthy_default", f"SELECT event_id, CASE WHEN event_id % 7 IN (2, 3) OR value = 0 THEN 1.5e0 ELSE {rnd('value')} END AS v FROM tel WHERE event_id % 7 > 1")
def b14(spark, sf):
    t = odd_values(telemetry(spark, sf)).filter(F.col("event_id") % 7 > 1)
    return t.select("event_id", r6(truthy_or("odd", 1.5)).alias("v"))


# -- vectors -----------------------------------------------------------------
FEATURES = [
    "CO_CO", "BF_CO_roll_avg_5", "Gas_Risk_Index", "PPE_Compliance", "Permit_Type_Hot Work", "Permit_Type_None", "Shift_Type_Night",
    "Maintenance_Active_True", "Gas_Test_Completed_False", "Never_Seen",
]


def merged(spark, sf):
    rolled = rolling_stats(telemetry(spark, sf), ["BF_CO", *PHYSICAL_SENSORS], [5], ["avg", "grad"])
    return risk_indices(rolled, lead=False)


def vectors(spark, sf):
    return V.assemble_features(merged(spark, sf), FEATURES, keep=["asset_id", "event_id", "ts", "arrival_seq"])


_VEC_SQL = {
    "CO_CO": rnd("CO_CO"),
    "BF_CO_roll_avg_5": rnd("avg(BF_CO) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"),
    "Gas_Risk_Index": rnd("Gas_Risk_Index"), "PPE_Compliance": "CAST(PPE_Compliance AS DOUBLE)",
    "Permit_Type_Hot Work": "CAST(Permit_Type = 'Hot Work' AS DOUBLE)", "Permit_Type_None": "CAST(Permit_Type = 'None' AS DOUBLE)",
    "Shift_Type_Night": "CAST(Shift_Type = 'Night' AS DOUBLE)", "Maintenance_Active_True": "CAST(Maintenance_Active AS DOUBLE)",
    "Gas_Test_Completed_False": "CAST(NOT Gas_Test_Completed AS DOUBLE)", "Never_Seen": "0e0",
}


@query("g01_merge_precedence", f"SELECT event_id, {rnd('CO_CO * 2', 'CO_CO')}, {rnd('BF_H2 + 1', 'BF_H2')}, {rnd('CO_NH3', 'CO_NH3')} FROM tel")
def g01(spark, sf):
    """A rolling block and a derived block that repeat packet columns: the later block wins."""
    t = telemetry(spark, sf)
    blocks = [
        {c: F.col(c) for c in RAW_SENSORS}, {"CO_CO": F.col("CO_CO") * F.lit(3), "BF_H2": F.col("BF_H2") + F.lit(1)},
        {"CO_CO": F.col("CO_CO") * F.lit(2)},
    ]
    order = V.merge_blocks(*[list(b) for b in blocks])
    final = {c: next(b[c] for b in reversed(blocks) if c in b) for c in order}
    return t.select("event_id", *[r6(final[c]).alias(c) for c in ("CO_CO", "BF_H2", "CO_NH3")])


def _vec(name, cols):
    @query(name, "SELECT event_id, " + ", ".join(f'{_VEC_SQL[c]} AS "{c}"' for c in cols) + " FROM idx0", ["idx0"])
    def run(spark, sf):
        return rounded(vectors(spark, sf), ["event_id"], cols)


_vec("g02_direct_features", ["CO_CO", "BF_CO_roll_avg_5", "Gas_Risk_Index", "PPE_Compliance"])
_vec("g03_one_hot_category", ["Permit_Type_Hot Work", "Permit_Type_None", "Shift_Type_Night"])
_vec("g04_one_hot_boolean", ["Maintenance_Active_True", "Gas_Test_Completed_False"])
_vec("g05_unknown_feature", ["Never_Seen"])


@query("g06_strict_check", f"SELECT event_id, CASE WHEN event_id % 7 < 3 THEN 'odd' END AS bad_feature, {rnd('CO_CO', 'CO_CO')} FROM tel")
def g06(spark, sf):
    t = V.assemble_features(odd_values(telemetry(spark, sf)), ["CO_CO", "odd"], keep=["event_id"])
    return V.check_features(t, ["CO_CO", "odd"], mode="tag").select("event_id", "bad_feature", r6("CO_CO").alias("CO_CO"))


@query("g07_latest_vector", "SELECT asset_id, " + ", ".join(f'arg_max(v{i}, event_id) AS "{c}"' for i, c in enumerate(FEATURES))
       + " FROM (SELECT asset_id, event_id, " + ", ".join(f"{_VEC_SQL[c]} AS v{i}" for i, c in enumerate(FEATURES)) + " FROM idx0) GROUP BY asset_id", ["idx0"])
def g07(spark, sf):
    return rounded(latest_row(vectors(spark, sf), FEATURES), ["asset_id"], FEATURES)


@query("g07_vector_schema", " UNION ALL ".join(f"SELECT {i + 1} AS position, '{c}' AS feature, count(*) AS rows FROM tel" for i, c in enumerate(FEATURES)))
def g07_schema(spark, sf):
    v = vectors(spark, sf)
    filled = v.agg(*[F.count(f"`{c}`").alias(c) for c in FEATURES])
    long = filled.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("rows")) for c in FEATURES])))
    return V.schema_table(v, FEATURES).join(F.broadcast(long), "feature").select("position", "feature", "rows")
