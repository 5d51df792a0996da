"""Sliced operators against plain windows on keys of very different sizes."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.operators.ordered import global_row_number, row_positions, running_max_before, slice_keys, time_axis
from furnacelens.operators.quantiles import exact_quantiles
from furnacelens.operators.ranked import value_runs
from furnacelens.operators.rolling import rolling_stats, score_history, window_rows
from furnacelens.operators.selection import first_by_hash, rows_at_ranks, stratified_split


@pytest.fixture(scope="module")
def skewed(spark):
    """Asset 0 holds a third of the rows, most of them in one burst; asset 9 has a single row."""
    rows = spark.range(3000).select(
        F.col("id").alias("arrival_seq"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") == 1, 9).otherwise(F.col("id") % 5 + 1).cast("long").alias("asset_id"),
    )
    seconds = F.when((F.col("asset_id") == 0) & (F.col("arrival_seq") > 900), F.lit(500_000) + F.col("arrival_seq") / 50).otherwise(F.col("arrival_seq") * 600)
    return rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + seconds)).withColumn(
        "x", (F.col("arrival_seq") * 7919 % 1009).cast("double")).cache()


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("slice_rows", [40, 100, 333])
def test_rolling_equals_plain_window(skewed, slice_rows):
    names = [f"x_roll_{s}_{w}" for s in ("avg", "std", "grad", "roc") for w in (5, 30)]
    kw = {"columns": ["x"], "windows": [5, 30], "stats": ["avg", "std", "grad", "roc"], "keep": ["arrival_seq"]}
    plain = rolling_stats(skewed, **kw)
    cut = rolling_stats(skewed, slice_rows=slice_rows, **kw)
    rounded = [F.round(n, 8).alias(n) for n in names]
    assert pairs(plain.select("arrival_seq", *rounded), "arrival_seq", *names) == pairs(cut.select("arrival_seq", *rounded), "arrival_seq", *names)


def test_no_slice_outgrows_its_bound(skewed):
    cut = slice_keys(skewed, ["asset_id"], time_axis("ts"), lookback=29, slice_rows=100)
    assert cut.hot
    biggest = cut.df.groupBy(*cut.keys).count().agg(F.max("count")).first()[0]
    assert biggest <= 100 + 2 * 4 * 100
    own = cut.finish(cut.df)
    assert own.count() == skewed.count() and own.select("arrival_seq").distinct().count() == skewed.count()


def test_cold_keys_are_left_alone(skewed):
    assert not slice_keys(skewed, ["asset_id"], time_axis("ts"), lookback=29).hot


def test_running_max_and_positions(skewed):
    order = W.partitionBy("asset_id").orderBy("arrival_seq")
    value = F.when(F.col("arrival_seq") % 4 != 0, F.col("x"))
    want = skewed.withColumn("m", F.max(value).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("n", F.row_number().over(order).cast("long"))
    got = running_max_before(skewed, ["asset_id"], "arrival_seq", value, "m", width=16, slice_rows=50)
    assert sorted(map(str, pairs(got, "arrival_seq", "m"))) == sorted(map(str, pairs(want, "arrival_seq", "m")))
    numbered = row_positions(skewed, ["asset_id"], F.col("arrival_seq"), ["arrival_seq"], "n", width=16, slice_rows=50)
    assert pairs(numbered, "arrival_seq", "n") == pairs(want, "arrival_seq", "n")


def test_global_row_number(skewed):
    got = global_row_number(skewed.filter("arrival_seq % 7 <> 0"), "arrival_seq", "n", slices=8, slice_rows=100)
    ordered = [r.n for r in got.orderBy("arrival_seq").collect()]
    assert ordered == list(range(1, len(ordered) + 1))


def test_window_rows_and_history(skewed):
    a = window_rows(skewed, ["arrival_seq"], 4)
    b = window_rows(skewed, ["arrival_seq"], 4, slice_rows=60)
    assert pairs(a, "arrival_seq", "window") == pairs(b, "arrival_seq", "window")
    h1, h2 = score_history(skewed, "x"), score_history(skewed, "x", slice_rows=60)
    assert pairs(h1, "asset_id", "slot", "x") == pairs(h2, "asset_id", "slot", "x")


@pytest.mark.parametrize("exact_rows", [10, 200, 10_000])
def test_exact_quantiles(skewed, exact_rows):
    import numpy as np

    t = skewed.withColumn("tied", F.when(F.col("arrival_seq") % 3 < 2, F.lit(5.0)).otherwise(F.col("x")))
    got = exact_quantiles(t, ["x", "tied"], [0.0, 0.25, 0.5, 0.9, 1.0], exact_rows=exact_rows)
    for c in ("x", "tied"):
        values = [r[0] for r in t.select(c).collect()]
        assert got[c] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])))


def test_quantiles_skip_null_and_nan(spark):
    t = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(t, ["v"], [0.5]) == {"v": [2.0]}
    assert exact_quantiles(t.filter("v IS NULL"), ["v"], [0.5]) == {"v": [None]}


def test_value_runs_sliced(skewed):
    measures = {"y": {"x": (F.col("arrival_seq") % 2).cast("int")}}
    for down in (False, True):
        a = value_runs(skewed, {"x": "x"}, measures, descending=down)
        b = value_runs(skewed, {"x": "x"}, measures, descending=down, slice_rows=200)
        cols = ["value", "n", "y", "n_before", "y_before"]
        assert pairs(a, *cols) == pairs(b, *cols)


@pytest.mark.parametrize("leaf_rows", [1, 20, 100_000])
def test_split_and_sample_by_digits(skewed, leaf_rows):
    t = stratified_split(skewed, "asset_id", "arrival_seq", leaf_rows=leaf_rows)
    for r in t.groupBy("asset_id").pivot("split", ["train", "valid", "test"]).count().na.fill(0).collect():
        n = r.train + r.valid + r.test
        assert r.train == int(n * 0.7 + 0.5) and r.train + r.valid == int(n * 0.85 + 0.5)
    sample = first_by_hash(skewed, 77, "arrival_seq", leaf_rows=leaf_rows)
    assert sample.count() == 77
    ranked = rows_at_ranks(skewed, "asset_id", "arrival_seq", 1, {0: [1, 500, 1000]}, {0: 1000}, leaf_rows=leaf_rows)
    assert sorted(r._rank for r in ranked.collect()) == [1, 500, 1000]


@pytest.mark.parametrize("slice_rows", [2_000_000, 60])
def test_rolling_with_missing_readings_and_drift(spark, slice_rows):
    """Null first reading, NaN and null inside, a drift of a million a row: as numpy has it, cut or not."""
    n = 200
    x = [None if i in (0, 50, 51) else float("nan") if i in (1, 90) else 1e6 * i + i % 3 for i in range(n)]
    df = spark.createDataFrame([(1, i, x[i]) for i in range(n)], "asset_id long, arrival_seq long, x double").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("arrival_seq") * 600))
    got = rolling_stats(df, ["x"], [3], ["avg", "var", "grad"], keep=["arrival_seq"], slice_rows=slice_rows).orderBy("arrival_seq").collect()
    assert len(got) == n
    for i, r in enumerate(got):
        rows = x[max(0, i - 2) : i + 1]
        held = [v for v in rows if v is not None and v == v]
        if not held:
            assert r.x_roll_avg_3 is None and r.x_roll_var_3 is None
            continue
        mean = sum(held) / len(held)
        assert r.x_roll_avg_3 == pytest.approx(mean, rel=1e-12)
        assert r.x_roll_var_3 == pytest.approx(sum((v - mean) ** 2 for v in held) / len(held), rel=1e-9, abs=1e-6)
        ends = [v for v in (rows[0], rows[-1]) if v is not None and v == v]
        assert r.x_roll_grad_3 == (None if len(ends) < 2 else pytest.approx((rows[-1] - rows[0]) / len(rows)))
