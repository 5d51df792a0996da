"""Source and sink queries (A). Files are written from the tables, read back, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.functions.scalar import r6
from furnacelens.operators import metrics as K
from furnacelens.operators import rules as R
from furnacelens.operators.prep import fit_prep
from furnacelens.operators.selection import stratified_split
from furnacelens.registry.base import events, hash_sql, labelled, lineitem, orders, predictions, query, rnd, telemetry
from furnacelens.registry.ops import RULES_SQL
from furnacelens.session import scratch_path
from furnacelens.sources import files as S


@query("a01_csv_scan", f"""SELECT l_orderkey, l_linenumber, {rnd('l_extendedprice', 'l_extendedprice')}, l_returnflag,
  strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem""", [])
def a01(spark, sf):
    src = lineitem(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    path = S.write_csv(src, scratch_path(spark, "csv"))
    back = S.read_training_csv(spark, path, src.schema)
    return back.withColumn("l_extendedprice", r6("l_extendedprice"))


@query("a02_text_csv", """SELECT event_id, Permit_Type, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'None' END AS note, false AS any_null FROM
  (SELECT CAST(event_id AS VARCHAR) AS event_id, Permit_Type, event_id % 3 AS m, event_id AS e FROM tel) t(eid, Permit_Type, m, event_id)
  """.replace("SELECT event_id, Permit_Type", "SELECT eid AS event_id, Permit_Type", 1))
def a02(spark, sf):
    """The word None and empty text survive a round trip as text."""
    src = telemetry(spark, sf).select(
        F.col("event_id").cast("string"), "Permit_Type", F.when(F.col("event_id") % 3 == 0, "").otherwise("None").alias("note"))
    path = S.write_csv(src, scratch_path(spark, "text-csv"), text_safe=True)
    back = S.read_text_csv(spark, path, src.columns)
    return back.withColumn("any_null", F.col("Permit_Type").isNull() | F.col("note").isNull())


@query("a03_structure_report", """SELECT count(*) AS rows, 34 AS columns, true AS target_present, count(*) <> 50000 AS rows_unexpected,
  true AS columns_unexpected, true AS success, CAST(NULL AS VARCHAR) AS error FROM tel
UNION ALL SELECT count(*), 33, false, count(*) <> 50000, true, false, 'Target column ''Future_Risk_Level'' not found' FROM tel""")
def a03(spark, sf):
    t = labelled(spark, sf)
    args = {"expected_rows": 50000, "expected_columns": 193}
    good = S.structure_report(t.drop("value"), "Future_Risk_Level", **args)
    return good.unionByName(S.structure_report(t.drop("value", "Future_Risk_Level"), "Future_Risk_Level", **args))


@query("a04_footprint", f"""SELECT 'orders' AS name, {rnd("sum(8 * 4 + octet_length(o_orderstatus::BLOB) + octet_length(o_orderpriority::BLOB)) / 1048576e0", 'footprint_mb')} FROM orders
UNION ALL SELECT 'events', {rnd("sum(8 * 4 + octet_length(event_type::BLOB) + octet_length(props::BLOB)) / 1048576e0", 'footprint_mb')} FROM events""", [])
def a04(spark, sf):
    parts = [S.footprint_mb(t).withColumn("name", F.lit(n)) for n, t in (("orders", orders(spark, sf)), ("events", events(spark, sf)))]
    return parts[0].unionByName(parts[1]).select("name", r6("footprint_mb").alias("footprint_mb"))


@query("a05_rule_catalogue", f"""SELECT rule_id, rule_name, risk_level, action AS recommended_action,
  count(*) FILTER (fired = rule_id) AS fired, 0 AS rules_without_file FROM {RULES_SQL} CROSS JOIN (
  SELECT 'R004' AS fired FROM tel WHERE BF_CO >= 3 AND Worker_Count > 0 UNION ALL SELECT 'R011' FROM tel WHERE CO_CO >= 3 AND Maintenance_Active
  UNION ALL SELECT 'R016' FROM tel WHERE CO_NH3 >= 0.5e0) GROUP BY ALL""")
def a05(spark, sf):
    """The catalogue written as a JSON array, read back, and joined to what fired; a missing file gives no rules."""
    path = scratch_path(spark, "rules")
    rules = S.load_rules(spark)
    rules.agg(F.to_json(F.collect_list(F.struct(*rules.columns))).alias("value")).write.text(path)  # 20 rows
    catalogue = S.load_rules(spark, path)
    absent = S.load_rules(spark, scratch_path(spark, "no-such-file")).count()
    fired = R.triggered_long(telemetry(spark, sf), ["event_id"], catalogue).groupBy("rule_id").agg(F.count(F.lit(1)).alias("fired"))
    return catalogue.join(F.broadcast(fired), "rule_id", "left").select(  # at most one row per rule
        "rule_id", "rule_name", "risk_level", "recommended_action", F.coalesce("fired", F.lit(0)).alias("fired"), F.lit(absent).alias("rules_without_file"))


@query("a07_chronological_replay", f"""SELECT event_id, asset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {rnd('CO_CO', 'CO_CO')}
FROM tel ORDER BY ts, event_id LIMIT 1000""")
def a07(spark, sf):
    t = telemetry(spark, sf)
    return S.replay(t, "ts", 1000, "event_id").select("event_id", "asset_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), r6("CO_CO").alias("CO_CO"))


def split_sql(ident: str = "event_id", label: str = "Future_Risk_Level", source: str = "lab") -> str:
    return f"""(SELECT *, CASE WHEN rk <= floor(n * 0.7e0 + 0.5e0) THEN 'train' WHEN rk <= floor(n * 0.85e0 + 0.5e0) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(ident, 42)}, {ident}) AS rk, count(*) OVER (PARTITION BY {label}) AS n FROM {source}))"""


@query("a08_feature_set_export", f"""SELECT fs AS feature_set, split, count(*) AS rows, {rnd('sum(CO_CO)', 'sum_co', 4)},
  {rnd("sum(CASE WHEN fs = 'FeatureSet_A' THEN BF_H2 END)", 'sum_h2', 4)} FROM {split_sql()} CROSS JOIN (VALUES ('FeatureSet_A'), ('FeatureSet_B')) v(fs) GROUP BY ALL""", ["lab"])
def a08(spark, sf):
    t = stratified_split(labelled(spark, sf), "Future_Risk_Level", "event_id")
    sets = {"FeatureSet_A": ["CO_CO", "BF_H2"], "FeatureSet_B": ["CO_CO"]}
    path = S.write_feature_sets(t, sets, "Future_Risk_Level", scratch_path(spark, "feature-sets"))
    back = spark.read.option("mergeSchema", True).parquet(path)
    return back.groupBy("feature_set", "split").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum("CO_CO"), 4).alias("sum_co"), r6(F.sum("BF_H2"), 4).alias("sum_h2"))


@query("a09_a10_saved_preprocessing")
def a09(spark, sf):
    """Fit, save, load, and apply the loaded state: 1 when both give the same row."""
    from furnacelens.operators.prep import PrepModel

    t = telemetry(spark, sf).select("event_id", "CO_CO", "BF_H2", "Permit_Type", "PPE_Compliance")
    model = fit_prep(t, exclude=["event_id"])
    loaded = PrepModel.load(spark, model.save(spark, scratch_path(spark, "prep")))
    a = model.transform(t, keep=["event_id"])
    b = loaded.transform(t, keep=["event_id"])
    cols = [c for c in a.columns if c != "event_id"]
    pair = a.select("event_id", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("a")).join(
        b.select("event_id", F.struct(*[F.col(f"`{c}`") for c in cols]).alias("b")), "event_id")
    return pair.select("event_id", (F.col("a") == F.col("b")).cast("int").alias("same"))


@query("a12_misclassified_sink", """SELECT Row_Number, event_id, Future_Risk_Level AS actual, predicted_class AS predicted FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) AS Row_Number FROM pred) WHERE label <> prediction""", ["pred"])
def a12(spark, sf):
    wrong = K.misclassified(predictions(spark, sf), "label", "prediction", "event_id").select(
        "Row_Number", "event_id", F.col("Future_Risk_Level").alias("actual"), F.col("predicted_class").alias("predicted"))
    path = scratch_path(spark, "misclassified")
    wrong.write.parquet(path)
    return spark.read.parquet(path)


@query("a14_scenario_csv_sink", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')}, Future_Risk_Level FROM lab WHERE Future_Risk_Level = 'High'", ["lab"])
def a14(spark, sf):
    src = labelled(spark, sf).filter("Future_Risk_Level = 'High'").select("event_id", r6("CO_CO").alias("CO_CO"), "Future_Risk_Level")
    path = S.write_csv(src, scratch_path(spark, "scenario-csv"))
    return S.read_training_csv(spark, path, T.StructType(src.schema.fields))
