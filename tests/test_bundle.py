"""The preparation bundle: one PipelineModel, saved and loaded, equal per row; fitted state used on new rows."""

import math

from pyspark.ml import PipelineModel

from furnacelens.operators.bundle import preparation

ROWS = [(1, 1.0, "a", True), (2, 3.0, None, None), (3, None, "b", False), (4, float("nan"), "a", True), (5, 5.0, "b", None)]
SCHEMA = "id long, x double, cat string, flag boolean"


def test_loaded_bundle_equals_fitted_and_keeps_its_medians(spark, tmp_path):
    t = spark.createDataFrame(ROWS, SCHEMA)
    fitted = preparation(["x", "cat", "flag"], keep=["id"]).fit(t)
    fitted.save(str(tmp_path / "bundle"))
    loaded = PipelineModel.load(str(tmp_path / "bundle"))
    assert sorted(fitted.transform(t).collect()) == sorted(loaded.transform(t).collect())
    assert loaded.transform(t).columns == ["id", "cat_None", "cat_a", "cat_b", "flag", "x"]
    # new rows after the restart: median of the finite fitted values (3.0), mean 3.0 and deviation of the cleaned column
    fresh = spark.createDataFrame([(9, None, "z", None), (10, float("inf"), None, True)], SCHEMA)
    out = {r.id: r for r in loaded.transform(fresh).collect()}
    sd = math.sqrt(sum((v - 3.0) ** 2 for v in [1.0, 3.0, 3.0, 3.0, 5.0]) / 5)
    assert out[9].x == 0.0 and out[10].x == 0.0 and sd > 0
    assert (out[9].cat_a, out[9].cat_b, out[9].cat_None) == (0.0, 0.0, 0.0)  # unseen category sets nothing
    assert out[10].cat_None == 1.0 and out[9].flag == 0.0 and out[10].flag == 1.0


def test_missing_fitted_column_is_zero(spark):
    t = spark.createDataFrame(ROWS, SCHEMA)
    model = preparation(["x", "cat"], keep=["id"]).fit(t)
    align = model.stages[-1]
    got = align.transform(t.select("id", "x")).collect()
    assert all(r.cat_a == 0.0 and r.cat_b == 0.0 for r in got)
