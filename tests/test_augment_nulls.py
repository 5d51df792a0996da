"""rows_per_class with a null class: kept beside a small class, drawn up when it is small itself."""

from collections import Counter

from furnacelens.operators.augment import rows_per_class


def test_null_class_kept_beside_a_small_class(spark):
    rows = [(i, None) for i in range(100)] + [(100 + i, "a") for i in range(50)] + [(200 + i, "b") for i in range(3)]
    df = spark.createDataFrame(rows, "id long, label string")
    got = Counter(r.label for r in rows_per_class(df, 10, "label", "id").collect())
    assert got == {None: 10, "a": 10, "b": 10}


def test_small_null_class_is_drawn_with_replacement(spark):
    rows = [(i, None) for i in range(3)] + [(100 + i, "a") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = rows_per_class(df, 10, "label", "id").collect()
    assert Counter(r.label for r in out) == {None: 10, "a": 10}
    assert {r.id for r in out if r.label is None} <= {0, 1, 2}
    assert sorted(r.draw for r in out if r.label is None) == list(range(10))
