"""Feature catalogue, ranking and feature set queries (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.constants import DOMAIN_RULES, FEATURE_SET_SIZES
from furnacelens.functions.scalar import r6
from furnacelens.operators import features as I
from furnacelens.operators.indices import risk_indices
from furnacelens.operators.rolling import rolling_stats
from furnacelens.operators.selection import first_by_hash
from furnacelens.registry.base import hash_sql, labelled, lineitem, query, rnd, telemetry

COLS = ["CO_CO", "BF_CO", "BF_H2", "CO_NH3", "BF_Blower_Vibration", "BF_Cooling_Water_Flow", "CO_Oven_Temperature", "Worker_Count"]


def numbered(spark, sf):
    return labelled(spark, sf).withColumn("label", I.label_index("Future_Risk_Level")).select("event_id", "label", *COLS)


CATALOGUE = {
    "asset_id": ("asset_id", "Integer"), "CO_CO": ("CO_CO", "Float"), "BF_H2_Flag": ("CASE WHEN event_id % 3 > 0 THEN BF_H2 END", "Float"),
    "CO_CO_roll_avg_5": ("CO_CO_roll_avg_5", "Float"), "Gas_Risk_Index": ("Gas_Risk_Index", "Float"), "Worker_Count": ("Worker_Count", "Float"),
    "PPE_Compliance": ("PPE_Compliance", "Boolean"), "Permit_Type": ("Permit_Type", "Categorical"), "Shift_Type": ("Shift_Type", "Categorical"),
    "Ambient_Temp": ("Ambient_Temp", "Float"), "Gas_Test_Completed": ("Gas_Test_Completed", "Boolean"),
}
_CAT_SRC = "(SELECT *, avg(CO_CO) OVER (PARTITION BY asset_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS CO_CO_roll_avg_5 FROM idx0)"


def _domain_py(name: str) -> str:
    return next((dom for dom, marks in DOMAIN_RULES if any(m in name for m in marks)), "General Context")


def catalogue_table(spark, sf):
    t = risk_indices(rolling_stats(telemetry(spark, sf), ["CO_CO", "BF_Top_Pressure", "BF_Blast_Flow", "CO_Gas_Pressure", "CO_Oven_Temperature"], [5], ["avg", "grad"]), lead=False)
    t = t.withColumn("BF_H2_Flag", F.when(F.col("event_id") % 3 > 0, F.col("BF_H2")))
    return t.select("Timestamp" if "Timestamp" in t.columns else F.lit("x").alias("Timestamp"), *[r6(c).alias(c) if k == "Float" else F.col(c) for c, (_e, k) in CATALOGUE.items()])


def _cat_expr(c):
    e, k = CATALOGUE[c]
    return rnd(e) if k == "Float" else e


@query("i01_domain_class", " UNION ALL ".join(f"SELECT '{c}' AS Feature_Name, '{_domain_py(c)}' AS Domain_Area, count({c}) AS readings FROM tel" for c in
       ["CO_CO", "BF_H2", "Worker_Count", "PPE_Compliance", "Permit_Type", "Ambient_Temp", "Shift_Type", "Maintenance_Active", "value"]))
def i01(spark, sf):
    names = ["CO_CO", "BF_H2", "Worker_Count", "PPE_Compliance", "Permit_Type", "Ambient_Temp", "Shift_Type", "Maintenance_Active", "value"]
    one = telemetry(spark, sf).agg(*[F.count(c).alias(c) for c in names])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("Feature_Name"), F.col(c).alias("readings")) for c in names])))
    return long.withColumn("Domain_Area", I.domain_of(F.col("Feature_Name")))


@query("i02_data_type", " UNION ALL ".join(f"SELECT '{c}' AS Feature_Name, '{k}' AS Data_Type, count({c}) AS readings FROM tel" for c, k in
       [("CO_CO", "Float"), ("event_id", "Integer"), ("PPE_Compliance", "Boolean"), ("Permit_Type", "Categorical"), ("Shift_Type", "Categorical"), ("ts", "Numeric")]))
def i02(spark, sf):
    t = telemetry(spark, sf).select("CO_CO", "event_id", "PPE_Compliance", "Permit_Type", "Shift_Type", "ts")
    one = t.agg(*[F.count(c).alias(c) for c in t.columns])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("Feature_Name"), F.lit(I.data_type_of(f)).alias("Data_Type"), F.col(f.name).alias("readings")) for f in t.schema.fields])))


@query("i03_nulls_and_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS Feature_Name, count(*) - count({c}) AS Null_Count, count(DISTINCT {c}) AS Unique_Values FROM lineitem" for c in
    ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"]), [])
def i03(spark, sf):
    return I.column_profile(lineitem(spark, sf), ["l_orderkey", "l_quantity", "l_returnflag", "l_shipdate"])


@query("i04_feature_catalogue", " UNION ALL ".join(
    f"SELECT '{c}' AS Feature_Name, '{k}' AS Data_Type, '{_domain_py(c)}' AS Domain_Area, count(*) - count({_cat_expr(c)}) AS Null_Count, count(DISTINCT {_cat_expr(c)}) AS Unique_Values FROM {_CAT_SRC}"
    for c, (_e, k) in CATALOGUE.items()), ["idx0"])
def i04(spark, sf):
    return I.feature_catalogue(catalogue_table(spark, sf))


@query("i05_sample", f"SELECT event_id, {rnd('CO_CO', 'CO_CO')} FROM tel ORDER BY {hash_sql('event_id', 42)}, event_id LIMIT 5000")
def i05(spark, sf):
    return first_by_hash(telemetry(spark, sf), 5000, "event_id").select("event_id", r6("CO_CO").alias("CO_CO"))


@query("i06_variance", " UNION ALL ".join(f"SELECT '{c}' AS feature, {rnd(f'var_samp({c})', 'Variance', 4)} FROM tel" for c in COLS))
def i06(spark, sf):
    return I.variances(telemetry(spark, sf), COLS).select("feature", r6("Variance", 4).alias("Variance"))


def _avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0)"


_SPEARMAN = " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(abs(corr(a, b)), 0e0) AS Correlation FROM (SELECT {_avg_rank(c)} AS a, {_avg_rank('label')} AS b FROM lab_num)" for c in COLS)


@query("i07_rank_correlation", f"SELECT feature, {rnd('Correlation', 'Correlation')} FROM ({_SPEARMAN})", ["lab_num"])
def i07(spark, sf):
    return I.spearman(numbered(spark, sf), COLS, "label").select("feature", r6("Correlation").alias("Correlation"))


@query("i07_rank_correlation_sliced", f"SELECT feature, {rnd('Correlation', 'Correlation')} FROM ({_SPEARMAN})", ["lab_num"])
def i07_sliced(spark, sf):
    """Each column ranked in slices of about a thousand rows."""
    return I.spearman(numbered(spark, sf), COLS, "label", slice_rows=1000).select("feature", r6("Correlation").alias("Correlation"))


def _edges(c: str) -> str:
    picks = ", ".join(f"max(CASE WHEN rn = greatest(1, CAST(ceil({i / 10!r}e0 * n) AS BIGINT)) THEN {c} END) AS e{i}" for i in range(1, 10))
    return f"(SELECT {picks} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM lab_num))"


def _mi(c: str) -> str:
    # equal edges count once, so the bin is the number of distinct edges below the value
    bins = f"len(list_distinct(list_filter([{', '.join(f'e{i}' for i in range(1, 10))}], lambda e: e < {c})))"
    return f"""SELECT '{c}' AS feature, greatest(0e0, sum(n * 1e0 / nn * ln(n * 1e0 * nn / (nx * ny)))) AS mi FROM (
  SELECT n, sum(n) OVER (PARTITION BY b) AS nx, sum(n) OVER (PARTITION BY label) AS ny, sum(n) OVER () AS nn FROM (
    SELECT b, label, count(*) AS n FROM (SELECT label, {bins} AS b FROM lab_num CROSS JOIN {_edges(c)}) GROUP BY ALL))"""


_MI = " UNION ALL ".join(_mi(c) for c in COLS)


@query("i08_mutual_information", f"SELECT feature, {rnd('mi', 'Mutual_Information')} FROM ({_MI})", ["lab_num"])
def i08(spark, sf):
    return I.mutual_information(numbered(spark, sf), COLS, "label").select("feature", r6("Mutual_Information").alias("Mutual_Information"))


def _importance(name, extra):
    @query(name)
    def run(spark, sf):
        sample = first_by_hash(numbered(spark, sf), I.SAMPLE_ROWS, "event_id")
        return I._importances(sample, COLS, "label", "importance", extra=extra, trees=50, depth=8, seed=42)


_importance("i09_forest_importance", False)
_importance("i10_extra_trees_importance", True)

_LONG3 = f"""(SELECT feature, 'Variance' AS metric, v AS value FROM ({' UNION ALL '.join(f"SELECT '{c}' AS feature, round(var_samp({c}), 4) AS v FROM lab_num" for c in COLS)})
UNION ALL SELECT feature, 'Correlation', round(Correlation, 6) FROM ({_SPEARMAN}) UNION ALL SELECT feature, 'Mutual_Information', round(mi, 6) FROM ({_MI}))"""


def three_metrics(spark, sf):
    t = numbered(spark, sf)
    wide = I.variances(t, COLS).join(I.spearman(t, COLS, "label"), "feature").join(I.mutual_information(t, COLS, "label"), "feature")
    wide = wide.withColumns({"Variance": F.round("Variance", 4), "Correlation": F.round("Correlation", 6), "Mutual_Information": F.round("Mutual_Information", 6)})
    return I.rank_metrics(I.to_metrics_long(wide, ["Variance", "Correlation", "Mutual_Information"]))


_RANKED = f"(SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank FROM {_LONG3})"


@query("i11_metric_ranks", f"SELECT feature, metric, CAST(rank AS INTEGER) AS rank FROM {_RANKED}", ["lab_num"])
def i11(spark, sf):
    return three_metrics(spark, sf).select("feature", "metric", "rank")


@query("i12_average_rank", f"SELECT feature, {rnd('avg(rank)', 'Average_Rank')} FROM {_RANKED} GROUP BY feature", ["lab_num"])
def i12(spark, sf):
    return I.average_ranks(three_metrics(spark, sf)).select("feature", r6("Average_Rank").alias("Average_Rank"))


@query("i12_full_ranking")
def i12_full(spark, sf):
    """All five rankers over the table, trees on the sample."""
    return I.rank_features(numbered(spark, sf), COLS, "label", "event_id")


@query("i13_feature_sets", f"""SELECT fs AS feature_set, CAST(position AS INTEGER) AS position, feature FROM (
  SELECT feature, row_number() OVER (ORDER BY r, feature) AS position FROM (SELECT feature, avg(rank) AS r FROM {_RANKED} GROUP BY feature))
CROSS JOIN (VALUES ('FeatureSet_A', NULL), ('FeatureSet_B', 5), ('FeatureSet_C', 3)) v(fs, k) WHERE k IS NULL OR position <= k""", ["lab_num"])
def i13(spark, sf):
    """The set sizes are parameters; this table has eight features, so smaller ones than the defaults."""
    sizes = dict(zip(FEATURE_SET_SIZES, (None, 5, 3)))
    return I.feature_sets(I.average_ranks(three_metrics(spark, sf)), sizes)
