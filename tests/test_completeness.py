"""Rows that the fixtures lack: null classes, groups without an anchor, bad values in pruned columns, text after an object."""

import pytest
from pyspark.sql import functions as F

from furnacelens.operators.augment import decay_rows
from furnacelens.operators.metrics import confusion_long
from furnacelens.operators.selection import stratified_split
from furnacelens.operators.vector import check_features
from furnacelens.sources.files import decode_packets


def test_null_class_is_divided_too(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "a").alias("y"))
    counts = {(r.y, r.split): r["count"] for r in stratified_split(df, "y", "id").groupBy("y", "split").count().collect()}
    assert counts[(None, "train")] == counts[("a", "train")] == 350 and counts[(None, "valid")] == counts[("a", "valid")]


def test_group_without_anchor_keeps_its_rows(spark):
    df = spark.createDataFrame([("a", s, 8.0) for s in range(6)] + [("b", s, 5.0) for s in (0, 1, 5)], "g string, step int, x double")
    got = {(r.g, r.step): r.x for r in decay_rows(df, ["x"], 2, 4, by=["g"]).collect()}
    assert len(got) == 9 and got[("b", 5)] == 5.0 and got[("a", 4)] == 4.0


def test_guard_survives_pruning(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan"))], "id int, a double, b double")
    with pytest.raises(Exception, match="not a finite number"):
        check_features(df, ["a", "b"]).select("id").collect()


def test_text_after_the_object_is_rejected(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} trailing {"b":2}', '{"a":1}x}', '{"a":1},{"b":2}', "[1]", None]
    rows = decode_packets(spark.createDataFrame([(t,) for t in texts], "payload string")).collect()
    assert [r.packet is not None for r in rows] == [True, True, False, False, False, False, False]


def test_unknown_class_stops_the_matrix(spark):
    df = spark.createDataFrame([(0, 0), (None, 1)], "label int, prediction int")
    with pytest.raises(Exception, match="unknown class"):
        confusion_long(df).collect()
