"""Cleaning, encoding, scaling and split queries (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.functions.scalar import r6
from furnacelens.operators import prep as P
from furnacelens.operators.quantiles import exact_quantiles
from furnacelens.operators.selection import stratified_split
from furnacelens.operators.vector import FeatureSchemaError
from furnacelens.registry.base import labelled, lineitem, query, rnd, telemetry
from furnacelens.registry.sources import split_sql

NUM = ["CO_CO", "BF_H2", "BF_Top_Temperature", "Worker_Count"]
_GAPS = {"CO_CO": 5, "BF_H2": 7}


def dirty(spark, sf):
    """Nulls, NaN and infinities in two numeric columns, nulls in text and booleans, two constant columns."""
    e = F.col("event_id")
    return telemetry(spark, sf).select(
        "event_id",
        F.when(e % 5 == 0, None).when(e % 5 == 1, F.lit(float("inf"))).otherwise(F.col("CO_CO")).alias("CO_CO"),
        F.when(e % 7 == 0, F.lit(float("nan"))).when(e % 7 == 1, F.lit(float("-inf"))).otherwise(F.col("BF_H2")).alias("BF_H2"),
        "BF_Top_Temperature", "Worker_Count",
        F.when(e % 3 == 0, None).otherwise(F.col("Shift_Type")).alias("Shift_Type"),
        F.when(e % 4 == 0, None).otherwise(F.col("Gas_Test_Completed")).alias("Gas_Test_Completed"),
        F.lit(7.0).alias("Flat"), F.lit("same").alias("Label_Const"), F.lit(None).cast("double").alias("Empty"),
    )


DIRTY = """(SELECT event_id, CASE WHEN event_id % 5 > 1 THEN CO_CO END AS CO_CO, CASE WHEN event_id % 7 > 1 THEN BF_H2 END AS BF_H2,
  BF_Top_Temperature, Worker_Count, CASE WHEN event_id % 3 > 0 THEN Shift_Type END AS Shift_Type,
  CASE WHEN event_id % 4 > 0 THEN Gas_Test_Completed END AS Gas_Test_Completed FROM tel)"""


@query("h01_infinities_to_null", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')}, {rnd('BF_H2', 'BF_H2')} FROM {DIRTY}")
def h01(spark, sf):
    t = P.infinities_to_null(dirty(spark, sf))
    return t.select("event_id", r6("CO_CO").alias("CO_CO"), r6("BF_H2").alias("BF_H2"))


_PROFILED = ["event_id", "CO_CO", "BF_H2", "BF_Top_Temperature", "Worker_Count", "Shift_Type", "Gas_Test_Completed"]


@query("h02_null_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM {DIRTY}" for c in _PROFILED))
def h02(spark, sf):
    return P.null_profile(dirty(spark, sf).select(*_PROFILED))


@query("h03_h04_text_and_boolean_fill", f"SELECT event_id, coalesce(Shift_Type, 'None') AS Shift_Type, coalesce(Gas_Test_Completed, false) AS Gas_Test_Completed FROM {DIRTY}")
def h03(spark, sf):
    t = dirty(spark, sf).select("event_id", "Shift_Type", "Gas_Test_Completed")
    return P.fit_cleaning(t, drop_constant=False).transform(t)


_MEDIAN = f"(SELECT median(CO_CO) AS m1, median(BF_H2) AS m2 FROM {DIRTY})"


@query("h05_median_fill", f"""SELECT event_id, {rnd('coalesce(CO_CO, m1)', 'CO_CO')}, {rnd('coalesce(BF_H2, m2)', 'BF_H2')}, 0e0 AS Empty
FROM {DIRTY} CROSS JOIN {_MEDIAN}""")
def h05(spark, sf):
    t = dirty(spark, sf).select("event_id", "CO_CO", "BF_H2", "Empty")
    out = P.fit_cleaning(t, drop_constant=False).transform(t)
    return out.select("event_id", *[r6(c).alias(c) for c in ("CO_CO", "BF_H2", "Empty")])


@query("h05_exact_median_bracketed", f"""SELECT 'l_extendedprice' AS name, {rnd('median(l_extendedprice)', 'median', 4)}, {rnd('quantile_cont(l_extendedprice, 0.9)', 'p90', 4)} FROM lineitem
UNION ALL SELECT 'l_quantity', {rnd('median(l_quantity)', 'median', 4)}, {rnd('quantile_cont(l_quantity, 0.9)', 'p90', 4)} FROM lineitem""", [])
def h05_bracketed(spark, sf):
    """The sketch-and-bracket way, forced by a low limit on rows per exact aggregate."""
    cols = ["l_extendedprice", "l_quantity"]
    got = exact_quantiles(lineitem(spark, sf), cols, [0.5, 0.9], exact_rows=2000)
    rows = [(c, *got[c]) for c in cols]
    df = spark.createDataFrame(rows, "name string, median double, p90 double")
    return df.select("name", r6("median", 4).alias("median"), r6("p90", 4).alias("p90"))


@query("h06_constant_columns", f"SELECT event_id, {rnd('BF_Top_Temperature', 'BF_Top_Temperature')}, 'Empty,Flat,Label_Const' AS dropped, 7 AS columns_left FROM tel")
def h06(spark, sf):
    t = dirty(spark, sf)
    model = P.fit_cleaning(t)
    out = model.transform(t)
    return out.select("event_id", r6("BF_Top_Temperature").alias("BF_Top_Temperature"), F.lit(",".join(sorted(model.dropped))).alias("dropped"), F.lit(len(out.columns)).alias("columns_left"))


_HOW = {"CO_CO": "filled with column median", "BF_H2": "filled with column median", "Shift_Type": "filled with None", "Gas_Test_Completed": "filled with false"}


@query("h07_cleaning_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, '{_HOW.get(c, 'no missing values')}' AS strategy FROM {DIRTY}" for c in _PROFILED
) + " UNION ALL SELECT 'Flat', 0, 'constant column dropped' UNION ALL SELECT 'Label_Const', 0, 'constant column dropped' UNION ALL SELECT 'Empty', count(*), 'constant column dropped' FROM tel")
def h07(spark, sf):
    t = dirty(spark, sf)
    return P.fit_cleaning(t).report(t)


_KINDS = {"Shift_Type": "categorical", "PPE_Compliance": "boolean", "Permit_Type": "categorical", "CO_CO": "numeric", "event_id": "numeric", "Maintenance_Active": "boolean"}


@query("h08_column_kinds", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(DISTINCT {c}) AS distinct_values FROM tel" for c, k in _KINDS.items()))
def h08(spark, sf):
    t = telemetry(spark, sf).select(*_KINDS)
    kinds = P.column_kinds(t.schema)
    from furnacelens.operators.features import column_profile

    profile = column_profile(t, list(_KINDS)).select(F.col("Feature_Name").alias("column"), F.col("Unique_Values").alias("distinct_values"))
    named = spark.createDataFrame(list(kinds.items()), "column string, kind string")
    return profile.join(F.broadcast(named), "column")


@query("h09_one_hot", "SELECT event_id, " + ", ".join(
    f"CAST({c} = '{v}' AS DOUBLE) AS \"{c}_{v}\"" for c, vs in (("Permit_Type", ["Confined Space", "General", "Hot Work", "None"]), ("CCTV_Event", ["Normal", "Worker No PPE"])) for v in vs) + " FROM tel")
def h09(spark, sf):
    t = telemetry(spark, sf)
    made = P.one_hot(P.fit_categories(t, ["Permit_Type", "CCTV_Event"]))
    return t.select("event_id", *[e.alias(n) for n, e in made.items()])


@query("h09_one_hot_lineitem", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CAST(l_returnflag = '{v}' AS DOUBLE) AS l_returnflag_{v}" for v in "ANR") + " FROM lineitem", [])
def h09_lineitem(spark, sf):
    t = lineitem(spark, sf)
    made = P.one_hot(P.fit_categories(t, ["l_returnflag"]))
    return t.select("l_orderkey", "l_linenumber", *[e.alias(n) for n, e in made.items()])


@query("h10_boolean_to_int", "SELECT event_id, CAST(PPE_Compliance AS INTEGER) AS PPE_Compliance FROM tel")
def h10(spark, sf):
    return telemetry(spark, sf).select("event_id", F.col("PPE_Compliance").cast("int").alias("PPE_Compliance"))


def ratio_sql(cols, source) -> str:
    q = ", ".join(f"quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(cols))
    hits = " + ".join(f"CAST({c} < a{i} - 1.5e0 * (b{i} - a{i}) OR {c} > b{i} + 1.5e0 * (b{i} - a{i}) AS INT)" for i, c in enumerate(cols))
    return f"SELECT sum({hits}) / (count(*) * {len(cols)}e0) FROM {source} CROSS JOIN (SELECT {q} FROM {source})"


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SENS = ["CO_CO", "BF_H2", "CO_NH3", "BF_CO", "BF_Top_Temperature"]


@query("h11_h12_outlier_ratio", " UNION ALL ".join(
    f"SELECT '{n}' AS name, {rnd(f'({ratio_sql(c, s)})', 'ratio')}, CASE WHEN ({ratio_sql(c, s)}) > 0.01 THEN 'robust' ELSE 'standard' END AS strategy"
    for n, c, s in (("lineitem", _LI, "lineitem"), ("telemetry", _SENS, "tel"))))
def h11(spark, sf):
    rows = []
    for n, cols, t in (("lineitem", _LI, lineitem(spark, sf)), ("telemetry", _SENS, telemetry(spark, sf))):
        ratio = P.outlier_ratio(t.select(*cols), cols)
        rows.append((n, ratio, P.choose_strategy(ratio)))
    return spark.createDataFrame(rows, "name string, ratio double, strategy string").withColumn("ratio", r6("ratio"))


def _scaled(name, strategy, centre, spread):
    q = ", ".join(f"{centre.format(c=c)} AS m{i}, {spread.format(c=c)} AS s{i}" for i, c in enumerate(NUM))
    cols = ", ".join(rnd(f"({c} - m{i}) / CASE WHEN s{i} = 0 THEN 1e0 ELSE s{i} END", c) for i, c in enumerate(NUM))

    @query(name, f"SELECT event_id, {cols} FROM tel CROSS JOIN (SELECT {q} FROM tel)")
    def run(spark, sf):
        t = telemetry(spark, sf)
        made = P.scale(P.fit_scaler(t, NUM, strategy))
        return t.select("event_id", *[r6(made[c]).alias(c) for c in NUM])


_scaled("h13_robust_scale", "robust", "median({c})", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")
_scaled("h14_standard_scale", "standard", "avg({c})", "stddev_pop({c})")


@query("h15_transform_with_fitted_state", f"""SELECT event_id, {rnd('(CO_CO - m) / s', 'CO_CO')}, CAST(Permit_Type = 'None' AS DOUBLE) AS Permit_Type_None,
  CAST(PPE_Compliance AS INTEGER) AS PPE_Compliance FROM tel CROSS JOIN (SELECT avg(CO_CO) AS m, stddev_pop(CO_CO) AS s FROM {split_sql()} WHERE split = 'train')""", ["lab"])
def h15(spark, sf):
    """Fitted on the training split only, applied to every row."""
    t = stratified_split(labelled(spark, sf), "Future_Risk_Level", "event_id")
    cols = ["event_id", "CO_CO", "Permit_Type", "PPE_Compliance"]
    model = P.fit_prep(t.filter("split = 'train'").select(*cols), exclude=["event_id"], strategy="standard")
    out = model.transform(t.select(*cols), keep=["event_id"])
    return out.select("event_id", r6("CO_CO").alias("CO_CO"), "Permit_Type_None", "PPE_Compliance")


@query("h16_schema_mismatch", f"SELECT event_id, 'CO_CO' AS missing, 'Ambient_Temp' AS unexpected, {rnd('BF_H2', 'BF_H2')} FROM tel")
def h16(spark, sf):
    t = telemetry(spark, sf)
    model = P.fit_prep(t.select("CO_CO", "BF_H2"), strategy="standard")
    other = t.select("event_id", "BF_H2", "Ambient_Temp")
    try:
        model.transform(other, keep=["event_id"])
    except FeatureSchemaError as e:
        return other.select("event_id", F.lit(",".join(e.missing)).alias("missing"), F.lit(",".join(e.unexpected)).alias("unexpected"), r6("BF_H2").alias("BF_H2"))
    raise AssertionError("the mismatch was not noticed")


@query("h17_stratified_split", f"SELECT event_id, Future_Risk_Level, split FROM {split_sql()}", ["lab"])
def h17(spark, sf):
    return stratified_split(labelled(spark, sf), "Future_Risk_Level", "event_id").select("event_id", "Future_Risk_Level", "split")


@query("h17_stratified_split_orders", f"SELECT o_orderkey, split FROM {split_sql('o_orderkey', 'o_orderstatus', 'orders')}", [])
def h17_orders(spark, sf):
    from furnacelens.registry.base import orders

    return stratified_split(orders(spark, sf), "o_orderstatus", "o_orderkey").select("o_orderkey", "split")


_U = "(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|42/CO_CO/{p}'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0"


@query("h18_training_noise", f"""SELECT event_id, split, {rnd(f"CO_CO + CASE WHEN split = 'test' THEN 0e0 ELSE 0.05e0 * sqrt(-2e0 * ln({_U.format(p='a')})) * cos(6.283185307179586e0 * {_U.format(p='b')}) END", 'CO_CO')}
FROM {split_sql()}""", ["lab"])
def h18(spark, sf):
    t = stratified_split(labelled(spark, sf), "Future_Risk_Level", "event_id")
    return P.add_training_noise(t, ["CO_CO"], "event_id").select("event_id", "split", r6("CO_CO").alias("CO_CO"))


@query("h19_feature_set_projection", f"SELECT split, count(*) AS rows, {rnd('avg(CO_CO)', 'CO_CO')}, {rnd('avg(BF_H2)', 'BF_H2')} FROM {split_sql()} GROUP BY split", ["lab"])
def h19(spark, sf):
    chosen = ["CO_CO", "BF_H2", "Not_There"]
    t = stratified_split(labelled(spark, sf), "Future_Risk_Level", "event_id")
    sub = t.select("split", *[c for c in chosen if c in t.columns])
    return sub.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("CO_CO")).alias("CO_CO"), r6(F.avg("BF_H2")).alias("BF_H2"))


@query("a13_report_tables", " UNION ALL ".join(
    f"SELECT 'cleaning' AS report, '{c}' AS item, count(*) - count({c}) AS n FROM {DIRTY}" for c in _PROFILED
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'catalogue', '{c}', count(DISTINCT {c}) FROM {DIRTY}" for c in ("Shift_Type", "Worker_Count", "event_id")))
def a13(spark, sf):
    """Cleaning and catalogue reports written as tables and read back."""
    from furnacelens.operators.features import feature_catalogue
    from furnacelens.session import materialise

    t = dirty(spark, sf)
    cleaning = materialise(P.fit_cleaning(t.select(*_PROFILED)).report(t), "cleaning-report")
    catalogue = materialise(feature_catalogue(t.select("Shift_Type", "Worker_Count", "event_id")), "catalogue")
    return cleaning.select(F.lit("cleaning").alias("report"), F.col("column").alias("item"), F.col("null_count").alias("n")).unionByName(
        catalogue.select(F.lit("catalogue").alias("report"), F.col("Feature_Name").alias("item"), F.col("Unique_Values").alias("n")))


_BUNDLED = "(SELECT event_id, coalesce(CO_CO, (SELECT median(CO_CO) FROM {d})) AS CO_CO, coalesce(BF_H2, (SELECT median(BF_H2) FROM {d})) AS BF_H2, " \
    "coalesce(Shift_Type, 'None') AS Shift_Type, coalesce(Gas_Test_Completed, false) AS Gas_Test_Completed FROM {d})".format(d=DIRTY)


@query("a09_a10_k02_bundle_restart", f"""SELECT event_id, {rnd('(CO_CO - m1) / s1', 'CO_CO')}, {rnd('(BF_H2 - m2) / s2', 'BF_H2')},
  CAST(Gas_Test_Completed AS DOUBLE) AS Gas_Test_Completed, 'Shift_Type_' || Shift_Type AS hot
FROM {_BUNDLED} CROSS JOIN (SELECT avg(CO_CO) AS m1, stddev_pop(CO_CO) AS s1, avg(BF_H2) AS m2, stddev_pop(BF_H2) AS s2 FROM {_BUNDLED})""")
def a09_bundle(spark, sf):
    """Clean, encode, scale and align fitted as one PipelineModel, saved, loaded back as after a restart, and applied
    to the raw rows: medians fill nulls, NaN and infinities; the one-hot column set to 1 is named in ``hot``."""
    from pyspark.ml import PipelineModel

    from furnacelens.operators.bundle import preparation
    from furnacelens.session import scratch_path

    cols = ["CO_CO", "BF_H2", "Shift_Type", "Gas_Test_Completed"]
    t = dirty(spark, sf).select("event_id", *cols)
    path = scratch_path(spark, "bundle")
    preparation(cols, keep=["event_id"]).fit(t).save(path)
    out = PipelineModel.load(path).transform(t)
    hot = [c for c in out.columns if c.startswith("Shift_Type_")]
    name = F.coalesce(*[F.when(F.col(c) == 1.0, F.lit(c)) for c in hot]) if hot else F.lit(None).cast("string")
    return out.select("event_id", r6("CO_CO").alias("CO_CO"), r6("BF_H2").alias("BF_H2"), "Gas_Test_Completed", name.alias("hot"))
