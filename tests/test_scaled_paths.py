"""Steps changed for size: narrow validation of hot assets, number checks without parsing, attribution without row objects."""

import numpy as np
from pyspark.sql import functions as F

from furnacelens.operators import attribution as A
from furnacelens.operators.normalize import sensor_value
from furnacelens.operators.validate import RAW_SENSORS, unreadable_sensors
from furnacelens.plans.flow import validated_packets
from furnacelens.registry.base import raw


def test_hot_assets_are_validated_from_the_named_fields(spark, sf):
    packets = raw(spark, sf)
    whole = validated_packets(packets).select("arrival_seq", "is_valid", "reason", "ts")
    cut = validated_packets(packets, fields=["CO_CO"], slice_rows=50, width=64)
    assert [c for c in cut.columns if c in RAW_SENSORS] == ["CO_CO"]
    assert sorted(cut.select(*whole.columns).collect(), key=str) == sorted(whole.collect(), key=str)


def test_numbers_as_the_cast_reads_them(spark):
    texts = ["1", "-2.5", "1e5", " 7 ", "NaN", "Infinity", "bad", "", "1.", ".5", "+3", "1\n", "9" * 40, None]
    s = RAW_SENSORS[0]
    df = spark.createDataFrame([(t, {s: t}) for t in texts], "t string, packet map<string,string>")
    number = F.col("t").try_cast("double")
    rows = df.select(
        F.size(unreadable_sensors()).alias("bad"), (F.col("t").isNotNull() & number.isNull()).cast("int").alias("want"),
        sensor_value(F.col("t"), 4.5).alias("v"), F.coalesce(F.when(~F.isnan(number), number), F.lit(4.5)).alias("w"),
    ).collect()
    assert all(r.bad == r.want and r.v == r.w for r in rows)


def test_contributions_are_built_without_an_object_per_feature(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 0), (2, None, 9.0, 1)], "id long, a double, b double, prediction int")
    leaves = [(1.0, np.array([0.2, 0.8]), [(0, -np.inf, 1.0, 0.5)]), (1.0, np.array([0.6, 0.4]), [(1, 3.0, np.inf, 0.25)])]
    out = A.tree_contributions(df, ["a", "b"], leaves, "prediction", ["id"])
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    rows = {r.id: [(c.feature, c.val, round(c.contribution, 9)) for c in r.contributions] for r in out.collect()}
    assert rows == {1: [("a", 0.5, 0.1), ("b", 2.0, -0.15)], 2: [("a", None, -0.4), ("b", 9.0, 0.3)]}
