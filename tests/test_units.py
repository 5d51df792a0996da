"""Literal cases: packets, buffers, ramps, indices, vectors, rules, health, recommendations."""

import math

import pytest
from pyspark.sql import functions as F

from furnacelens.constants import BOOLEAN_DEFAULTS, CATEGORY_DEFAULTS, PHYSICAL_SENSORS, SENSOR_DEFAULTS
from furnacelens.operators import health as H
from furnacelens.operators import metrics as K
from furnacelens.operators import normalize as D
from furnacelens.operators import prep as P
from furnacelens.operators import rules as R
from furnacelens.operators import validate as C
from furnacelens.operators import vector as V
from furnacelens.operators.indices import risk_indices
from furnacelens.operators.rolling import last_rows, rolling_stats
from furnacelens.sources.files import decode_packets, load_rules


def packet(ts="2026-03-01 10:00:00", drop=(), **over):
    p = {"Timestamp": ts, **SENSOR_DEFAULTS, **CATEGORY_DEFAULTS, **BOOLEAN_DEFAULTS, **over}
    return {k: v for k, v in p.items() if k not in drop}


def raw(spark, packets):
    import json

    rows = [(1, i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(packets)]
    return spark.createDataFrame(rows, "asset_id long, arrival_seq long, payload string")


def reasons(spark, packets):
    out = C.validate_packets(decode_packets(raw(spark, packets)))
    return [r.reason for r in out.orderBy("arrival_seq").collect()]


def test_verdicts(spark):
    assert reasons(spark, [
        packet(), packet(drop=["Timestamp"]), packet(), packet("2026-03-01 10:01"), packet("2026-03-01 10:02:00", drop=["CO_CO"]),
        packet("2026-03-01 10:03:00", CO_CO="oops"), packet("not a time"), "{broken", packet("2026-03-01T10:04:00Z"),
        packet("2026-03-01 10:02:30"), packet("2026-03-01 10:05:00", CO_CO=None),
    ]) == [
        None, "missing_timestamp", "out_of_order", None, "missing_fields", "not_numeric", "bad_timestamp", "malformed_packet",
        None, "out_of_order", None,
    ]


def test_rejected_packets_do_not_move_the_clock(spark):
    assert reasons(spark, [packet("2026-03-01 12:00:00", CO_CO="x"), packet("2026-03-01 11:00:00")]) == ["not_numeric", None]


def test_warnings_do_not_reject(spark):
    d = decode_packets(raw(spark, [packet(CO_CO=500, Permit_Type="Odd")]))
    row = d.select(C.out_of_bounds().alias("b"), C.unknown_categories().alias("c")).first()
    assert row.b == ["CO_CO"] and row.c == ["Permit_Type"] and reasons(spark, [packet(CO_CO=500)]) == [None]


def test_normalisation_of_mixed_types(spark):
    d = decode_packets(raw(spark, [packet("2026-03-01 10:00", CO_CO="7.5", BF_H2="", CO_NH3="NaN", PPE_Compliance="No", Gas_Test_Completed=0, Maintenance_Active="t", Shift_Type="Dawn")]))
    row = D.normalise_packets(d.withColumn("ts", C.parse_timestamp(F.col("packet")["Timestamp"]))).first()
    assert row.Timestamp == "2026-03-01 10:00:00" and row.CO_CO == 7.5 and row.BF_H2 == 1.5 and row.CO_NH3 == 0.1
    assert (row.PPE_Compliance, row.Gas_Test_Completed, row.Maintenance_Active, row.Shift_Type) == (False, False, True, "Morning")


@pytest.fixture(scope="module")
def ramp(spark):
    t = spark.range(1, 11).select(F.lit(1).cast("long").alias("asset_id"), F.col("id").alias("arrival_seq"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    return t.select("*", *[F.col("arrival_seq").cast("double").alias(s) for s in PHYSICAL_SENSORS])


def test_ramp_statistics(ramp):
    rows = rolling_stats(ramp, ["CO_CO"], [5]).orderBy("arrival_seq").collect()
    assert rows[0].CO_CO_roll_grad_5 == 0.0 and rows[0].CO_CO_roll_roc_5 == 0.0 and rows[0].CO_CO_roll_std_5 == 0.0
    for r in rows[4:]:
        assert r.CO_CO_roll_avg_5 == pytest.approx(r.arrival_seq - 2) and r.CO_CO_roll_grad_5 == pytest.approx(0.8)
        assert r.CO_CO_roll_std_5 == pytest.approx(math.sqrt(2))


def test_buffer_keeps_the_newest(ramp):
    kept = last_rows(ramp.select("asset_id", "arrival_seq", "ts"), 5).orderBy("slot").collect()
    assert [r.arrival_seq for r in kept] == [6, 7, 8, 9, 10] and [r.slot for r in kept] == [1, 2, 3, 4, 5]


def test_indices(spark):
    t = spark.createDataFrame([(1, 1, *SENSOR_DEFAULTS.values(), "Morning", "General", "Normal", True, True, True)],
                              "asset_id long, arrival_seq long, " + ", ".join(f"{s} double" for s in SENSOR_DEFAULTS) + ", Shift_Type string, Permit_Type string, CCTV_Event string, PPE_Compliance boolean, Maintenance_Active boolean, Gas_Test_Completed boolean")
    row = risk_indices(t.withColumn("ts", F.timestamp_seconds(F.lit(0)))).first()
    assert row.Gas_Risk_Index == 0.0 and row.Maintenance_Risk_Index == 30.0 and row.Process_Stability_Index == 100.0
    assert row.Worker_Exposure_Index == 20.0 and row.Safety_Lead_Indicator == 0.0 and 0 <= row.Safety_Index <= 100
    quiet = risk_indices(t.withColumns({"ts": F.timestamp_seconds(F.lit(0)), "Worker_Count": F.lit(0.0), "BF_Top_Temperature": F.lit(950.0), "BF_State_ID": F.lit("PS022")})).first()
    assert quiet.Worker_Exposure_Index == 0.0 and quiet.Thermal_Risk_Index == pytest.approx(12.5)


def test_vector_rules(spark):
    t = spark.createDataFrame([(2.0, "Hot Work", True, float("nan"))], "CO_CO double, Permit_Type string, PPE_Compliance boolean, bad double")
    features = ["Permit_Type_Hot Work", "CO_CO", "PPE_Compliance_True", "PPE_Compliance_False", "Unseen"]
    made = V.assemble_features(t, features)
    assert made.columns == features and list(made.first()) == [1.0, 2.0, 1.0, 0.0, 0.0]
    with pytest.raises(V.FeatureSchemaError):
        V.check_features(made.select("CO_CO"), features)
    with pytest.raises(V.FeatureSchemaError):
        V.check_features(made.select(*[f"`{f}`" for f in reversed(features)]), features)
    with pytest.raises(Exception, match="not a finite number in feature: bad"):
        V.check_features(V.assemble_features(t, ["CO_CO", "bad"]), ["CO_CO", "bad"]).collect()


def test_cleaning(spark):
    t = spark.createDataFrame([("a", 1.0, None, "Day", True, 4, "k"), ("b", None, 2.0, None, None, 5, "k"), ("c", 3.0, 6.0, "Night", False, 6, "k")],
                              "Timestamp string, x double, y double, Shift_Type string, flag boolean, n int, same string")
    model = P.fit_cleaning(t)
    out = model.transform(t)
    assert model.dropped == ["same"] and out.filter(" OR ".join(f"{c} IS NULL" for c in out.columns)).count() == 0
    assert out.filter("Timestamp = 'b'").first().x == 2.0 and dict(out.dtypes)["n"] == "int"
    prep = P.fit_prep(out)
    names = prep.transform(out).columns
    assert {"Shift_Type_Day", "Shift_Type_Night", "Shift_Type_None"} <= set(names) and prep.transform(out).count() == 3


def test_schema_mismatch(spark):
    t = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "CO_CO double, CO_Gas_Pressure double")
    with pytest.raises(V.FeatureSchemaError) as e:
        P.fit_prep(t).transform(t.select("CO_CO"))
    assert e.value.missing == ["CO_Gas_Pressure"]


def test_rules(spark):
    flags = spark.createDataFrame([(1, "1"), (2, "0")], "id int, Rule_R001 string")
    got = {r.id: [x.rule_id for x in r.recommendations] for r in R.recommend(flags).collect()}
    assert got == {1: ["R001"], 2: []}
    plain = spark.createDataFrame([(0.8, 3.0, 0.0, 0.0, False), (0.1, 0.0, 9.0, 0.0, False)], "CO_NH3 double, Worker_Count double, BF_CO double, CO_CO double, Maintenance_Active boolean")
    assert [[x.rule_id for x in r.recommendations] for r in R.recommend(plain).collect()] == [["R016"], []]
    assert load_rules(spark).count() == 20 and load_rules(spark, "/tmp/no-such-rules.json").count() == 0


def test_status(spark):
    t = spark.createDataFrame([(30.0, 0.0, 0.0), (60.0, 0.0, 0.0), (210.0, 0.0, 0.0), (30.0, 2.0, 0.0), (30.0, 10.0, 0.0), (30.0, 0.0, 11.0)], "lat double, loss double, idle double")
    got = [r[0] for r in t.select(H.status(F.col("lat"), F.col("loss"), F.col("idle"))).collect()]
    assert got == ["HEALTHY", "WARNING", "CRITICAL", "WARNING", "CRITICAL", "DEGRADED"]
    u = spark.range(1).select(F.lit(15).alias("n"), F.lit(1).alias("a"), F.lit(10).alias("b"))
    row = u.select(H.buffer_utilisation(F.col("n")).alias("u"), H.loss_rate("a", "b").alias("l")).first()
    assert (row.u, row.l) == (50.0, 10.0)


def test_recommendation_schema(spark):
    t = spark.createDataFrame([
        (1, "Critical", "Stop the pusher", "Vibration", "Coke Oven", None, None, None, None),
        (2, None, None, None, None, "High", "Evacuate", "Gas rising", "Toxic Exposure"),
        (3, None, "Check", None, None, None, None, "Seen", "Compliance"), (4, "Low", None, None, None, None, "", "x", "y"),
    ], "id int, priority string, action string, reason string, category string, severity string, recommended_action string, description string, hazard_category string")
    good, bad = D.unify_recommendations(t, ["id"])
    rows = {r.id: tuple(r)[1:] for r in good.collect()}
    assert rows == {
        1: ("Critical", "Stop the pusher", "Vibration", "Coke Oven"), 2: ("High", "Evacuate", "Gas rising", "Toxic Exposure"),
        3: ("HIGH", "Check", "Seen", "Compliance"),
    }
    assert [r.id for r in bad.collect()] == [4]


@pytest.mark.parametrize("matrix, accuracy, precision, recall", [
    ([[2999, 1, 0, 0], [15, 2235, 0, 0], [0, 0, 1500, 0], [0, 0, 0, 750]], 0.997867, [0.9950, 0.9996, 1.0, 1.0], [0.9997, 0.9933, 1.0, 1.0]),
    ([[100, 0, 0, 0], [1, 99, 0, 0], [0, 28, 72, 0], [0, 0, 0, 100]], 0.9275, [0.9901, 0.7795, 1.0, 1.0], [1.0, 0.99, 0.72, 1.0]),
])
def test_golden_matrices(spark, matrix, accuracy, precision, recall):
    cells = spark.createDataFrame([(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)], "label int, prediction int, n long")
    rows = K.per_class(cells).orderBy("class").collect()
    assert [round(r.precision, 4) for r in rows] == precision and [round(r.recall, 4) for r in rows] == recall
    assert K.accuracy_summary(cells).first().accuracy == pytest.approx(accuracy, abs=1e-6)


def test_tree_attribution_matches_brute_force():
    """The pattern table against Shapley values summed over all orderings."""
    import itertools

    import numpy as np

    from furnacelens.operators.attribution import _pattern_table

    zero = np.array([0.3, 0.6, 0.5])
    table = _pattern_table(zero)
    for pattern in range(8):
        one = [(pattern >> i) & 1 for i in range(3)]
        phi = np.zeros(3)
        for order in itertools.permutations(range(3)):
            known = set()
            for i in order:
                def value(s):
                    return np.prod([one[j] if j in s else zero[j] for j in range(3)])
                phi[i] += value(known | {i}) - value(known)
                known.add(i)
        assert table[pattern] == pytest.approx(phi / 6)


def test_scratch_folder_without_the_setting(spark, monkeypatch):
    from pyspark.sql.conf import RuntimeConfig

    from furnacelens.session import materialise, shared_dir

    get = RuntimeConfig.get
    monkeypatch.setattr(RuntimeConfig, "get", lambda self, key, *default: None if key == "spark.checkpoint.dir" else get(self, key, *default))
    assert shared_dir(spark) == shared_dir(spark)
    assert materialise(spark.range(3), "three").count() == 3
