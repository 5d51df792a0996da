"""Rolling means and variances on arrays: equal, bit for bit, to Spark's own frames, without a sliding frame in the plan."""

import random

from furnacelens.operators.rolling import rolling_stats


def _rows(spark):
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), -0.0, 0.0]
    made = []
    for i in range(900):
        key = rng.choice([None, "a", "a", "a", "b", "c"])
        x = rng.choice(odd) if rng.random() < 0.1 else rng.uniform(-5, 5) + 1e4 * i
        made.append((key, i // 3, i, None if key == "c" else x, float(i % 7)))
    made.append(("lone", 1, 900, 2.0, None))
    return spark.createDataFrame(made, "asset_id string, s long, arrival_seq long, x double, y double").selectExpr("*", "timestamp_seconds(s) AS ts")


def test_frames_equal_the_windows(spark):
    df = _rows(spark)
    names = [f"{c}_roll_{s}_{w}" for c in "xy" for s in ("avg", "var", "grad") for w in (1, 4, 9)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames reach over several batches
    try:
        got = rolling_stats(df, ["x", "y"], [1, 4, 9], ["avg", "var", "grad"], keep=["arrival_seq"], extra={"most": ("max(y)", 3)})
        got = {r.arrival_seq: r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    over = "OVER (PARTITION BY asset_id ORDER BY ts, arrival_seq ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    want = ["arrival_seq", f"max(y) {over.format(2)} AS most"]
    for c in "xy":
        v = f"nullif({c}, double('NaN'))"
        for w in (1, 4, 9):
            o = over.format(w - 1)
            want += [f"avg({v}) {o} AS {c}_roll_avg_{w}", f"var_pop({v}) {o} AS {c}_roll_var_{w}"]
            want += [f"CASE WHEN count(1) {o} > 1 THEN ({v} - first_value({v}) {o}) / count(1) {o} ELSE 0D END AS {c}_roll_grad_{w}"]
    rows = df.selectExpr(*want).collect()
    assert len(rows) == len(got) == 901
    for r in rows:
        assert [repr(r[n]) for n in ["most", *names]] == [repr(got[r.arrival_seq][n]) for n in ["most", *names]]


def test_no_sliding_frame_of_an_aggregate(spark):
    out = rolling_stats(_rows(spark), ["x", "y"], [5, 30], keep=["arrival_seq"])
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert rolling_stats(_rows(spark), [], [5], keep=["arrival_seq"]).count() == 901
