"""Rolling window queries (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.constants import PHYSICAL_SENSORS, ROLLING_WINDOWS
from furnacelens.functions.scalar import r6
from furnacelens.operators import rolling as E
from furnacelens.operators.indices import risk_indices
from furnacelens.operators.ops_scores import health_score
from furnacelens.operators.ordered import HOUR_MICROS, row_positions, time_axis
from furnacelens.registry.base import (
    lineitem,
    predictions,
    query,
    rnd,
    rounded,
    telemetry,
)

ORDER = "PARTITION BY asset_id ORDER BY ts, event_id"
STAT_SQL = {
    "avg": lambda s, w: f"avg({s}) OVER w{w}",
    "var": lambda s, w: f"greatest(0e0, var_pop({s}) OVER w{w})",
    "std": lambda s, w: f"sqrt(greatest(0e0, var_pop({s}) OVER w{w}))",
    "grad": lambda s, w: f"CASE WHEN count(*) OVER w{w} > 1 THEN ({s} - first_value({s}) OVER w{w}) / count(*) OVER w{w} ELSE 0e0 END",
    "roc": lambda s, w: f"CASE WHEN count(*) OVER w{w} > 1 THEN ({s} - first_value({s}) OVER w{w}) / (first_value({s}) OVER w{w} + 1e-6) ELSE 0e0 END",
}
WINDOW_SQL = "WINDOW " + ", ".join(
    f"w{w} AS ({ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in ROLLING_WINDOWS
)


def roll_sql(sensors, windows, stats, digits=6) -> str:
    cols = ", ".join(rnd(STAT_SQL[st](s, w), f"{s}_roll_{st}_{w}", digits) for s in sensors for st in stats for w in windows)
    return f"SELECT event_id, {cols} FROM tel {WINDOW_SQL}"


def roll_names(sensors, windows, stats):
    return [f"{s}_roll_{st}_{w}" for s in sensors for st in stats for w in windows]


def _single(name, stat):
    sensors = ["CO_CO", "BF_Top_Temperature", "CO_Gas_Pressure"]

    @query(name, roll_sql(sensors, ROLLING_WINDOWS, [stat]))
    def run(spark, sf):
        out = E.rolling_stats(telemetry(spark, sf), sensors, ROLLING_WINDOWS, [stat], keep=["event_id"])
        return rounded(out, ["event_id"], roll_names(sensors, ROLLING_WINDOWS, [stat]))


for _name, _stat in [
    ("e06_rolling_mean", "avg"), ("e07_rolling_variance", "var"), ("e08_rolling_std", "std"),
    ("e09_rolling_gradient", "grad"), ("e10_rolling_rate_of_change", "roc"),
]:
    _single(_name, _stat)


@query("e12_rolling_block", roll_sql(PHYSICAL_SENSORS, ROLLING_WINDOWS, E.STATS, 4))
def e12(spark, sf):
    out = E.rolling_stats(telemetry(spark, sf), keep=["event_id"])
    return rounded(out, ["event_id"], roll_names(PHYSICAL_SENSORS, ROLLING_WINDOWS, E.STATS), 4)


@query("e12_rolling_block_sliced", roll_sql(["CO_CO", "BF_H2"], ROLLING_WINDOWS, E.STATS))
def e12_sliced(spark, sf):
    """Hot assets cut into slices of about 500 rows with a 29-row halo; must equal the plain window."""
    out = E.rolling_stats(telemetry(spark, sf), ["CO_CO", "BF_H2"], keep=["event_id"], slice_rows=500)
    return rounded(out, ["event_id"], roll_names(["CO_CO", "BF_H2"], ROLLING_WINDOWS, E.STATS))


# missing readings (null, and NaN in the Spark table; the first row of an asset among them) and a strong drift
GAPS = f"""(SELECT event_id, asset_id, ts, CASE WHEN event_id % 7 = 3 OR n <= 2 THEN NULL ELSE CO_CO + 1e3 * n END AS x
  FROM (SELECT *, row_number() OVER ({ORDER}) AS n FROM tel))"""


@query("e12_rolling_gaps", f"""
SELECT event_id, {rnd('avg(x) OVER w', 'x_roll_avg_5', 2)}, {rnd('var_pop(x) OVER w', 'x_roll_var_5', 0)},
  {rnd('CASE WHEN count(*) OVER w > 1 THEN (x - first_value(x) OVER w) / count(*) OVER w ELSE 0e0 END', 'x_roll_grad_5', 3)}
FROM {GAPS} WINDOW w AS ({ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def e12_gaps(spark, sf):
    """Nulls, NaN and drift, on uncut and on sliced keys alike."""
    t = row_positions(telemetry(spark, sf), ["asset_id"], time_axis("ts"), ["ts", "arrival_seq"], "n", width=HOUR_MICROS)
    missing = F.when(F.col("event_id") % 2 == 0, F.lit(float("nan")))
    gap = (F.col("event_id") % 7 == 3) | (F.col("n") <= 2)
    t = t.withColumn("x", F.when(gap, missing).otherwise(F.col("CO_CO") + 1e3 * F.col("n")))
    out = E.rolling_stats(t, ["x"], [5], ["avg", "var", "grad"], keep=["event_id"], slice_rows=500)
    return out.select("event_id", r6("x_roll_avg_5", 2).alias("x_roll_avg_5"), r6("x_roll_var_5", 0).alias("x_roll_var_5"),
                      r6("x_roll_grad_5", 3).alias("x_roll_grad_5"))


@query("e06_rolling_lineitem", f"""
SELECT l_orderkey, l_linenumber, l_suppkey, {rnd('avg(l_extendedprice) OVER w', 'l_extendedprice_roll_avg_15', 4)},
  {rnd('stddev_pop(l_quantity) OVER w', 'l_quantity_roll_std_15')}
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 8 + l_linenumber
  ROWS BETWEEN 14 PRECEDING AND CURRENT ROW)""", [])
def e06_lineitem(spark, sf):
    t = lineitem(spark, sf).withColumn("tie", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    keep = ["l_orderkey", "l_linenumber", "l_suppkey"]
    day = 86_400_000_000
    out = E.rolling_stats(
        t, ["l_extendedprice", "l_quantity"], [15], ["avg", "std"], key="l_suppkey", ts="l_shipdate", tie="tie", keep=keep, width=day
    )
    return out.select(*keep, r6("l_extendedprice_roll_avg_15", 4).alias("l_extendedprice_roll_avg_15"),
                      r6("l_quantity_roll_std_15").alias("l_quantity_roll_std_15"))


@query("e01_bounded_buffer", f"""
SELECT asset_id, event_id, CAST(slot AS INTEGER) AS slot, {rnd('CO_CO', 'CO_CO')} FROM (
  SELECT *, n - back + 1 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) AS back,
    least(30, count(*) OVER (PARTITION BY asset_id)) AS n FROM tel) WHERE back <= 30)""")
def e01(spark, sf):
    out = E.last_rows(telemetry(spark, sf).select("asset_id", "ts", "arrival_seq", "event_id", "CO_CO"), 30)
    return out.select("asset_id", "event_id", "slot", r6("CO_CO").alias("CO_CO"))


@query("e02_window_rows", f"""
SELECT event_id, array_to_string(list_transform(list(event_id) OVER ({ORDER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  lambda x: CAST(x AS VARCHAR)), ',') AS window_ids FROM tel""")
def e02(spark, sf):
    t = telemetry(spark, sf).select("asset_id", "ts", "arrival_seq", "event_id")
    out = E.window_rows(t, ["event_id"], 5)
    return out.select("event_id", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("window_ids"))


@query("e03_buffer_size_ready", f"""
SELECT event_id, count(*) OVER b AS buffer_size, count(*) OVER b >= 5 AS ready_5, count(*) OVER b >= 15 AS ready_15,
  count(*) OVER b >= 30 AS ready_30 FROM tel WINDOW b AS ({ORDER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def e03(spark, sf):
    out = E.buffer_state(telemetry(spark, sf), "CO_CO")
    return out.select("event_id", "buffer_size", "ready_5", "ready_15", "ready_30")


@query("e04_latest_oldest", f"""
SELECT event_id, {rnd('CO_CO', 'latest')}, {rnd(f'first_value(CO_CO) OVER ({ORDER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)', 'oldest')} FROM tel""")
def e04(spark, sf):
    out = E.buffer_state(telemetry(spark, sf), "CO_CO", ready=[])
    return rounded(out, ["event_id"], ["latest", "oldest"])


@query("e04_asset_edges", f"""
SELECT asset_id, {rnd('arg_max(CO_CO, event_id)', 'latest')}, {rnd('arg_min(CO_CO, event_id)', 'oldest')} FROM tel GROUP BY asset_id""")
def e04_edges(spark, sf):
    return rounded(E.edge_rows(telemetry(spark, sf), "CO_CO"), ["asset_id"], ["latest", "oldest"])


@query("e05_buffer_reset", f"""
SELECT event_id, epoch, count(*) OVER (PARTITION BY asset_id, epoch ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS buffer_size
FROM (SELECT *, coalesce(max(CASE WHEN event_id % 211 = 0 THEN event_id END) OVER (PARTITION BY asset_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS epoch FROM tel)""")
def e05(spark, sf):
    """A reset starts a new epoch; the buffer never looks across it."""
    from pyspark.sql import Window as W

    t = telemetry(spark, sf).select("asset_id", "ts", "arrival_seq", "event_id")
    out = E.with_epoch(t, F.col("event_id") % 211 == 0)
    frame = W.partitionBy("asset_id", "epoch").orderBy("ts", "arrival_seq").rowsBetween(-29, 0)
    return out.select("event_id", "epoch", F.count(F.lit(1)).over(frame).alias("buffer_size"))


_SELECTED = [*PHYSICAL_SENSORS, "BF_CO", "BF_Gas_Pressure"]


@query("e11_sensor_selection", " UNION ALL ".join(
    f"SELECT '{s}' AS sensor, count({s}) AS readings, {rnd(f'avg({s})', 'mean')} FROM tel" for s in _SELECTED))
def e11(spark, sf):
    """The sensor columns of a table that also holds index and context columns, each profiled."""
    t = risk_indices(telemetry(spark, sf), lead=False).drop("event_id", "asset_id", "arrival_seq", "value")
    sensors = E.numeric_sensor_columns(t)
    one = t.agg(*[F.struct(F.count(s).alias("readings"), F.avg(s).alias("mean")).alias(s) for s in sensors])
    items = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(f"{s}.readings"), F.col(f"{s}.mean")) for s in sensors])
    return one.select(F.inline(items)).select("sensor", "readings", r6("mean").alias("mean"))


@query("e13_latest_statistics", f"""
SELECT asset_id, {rnd('arg_max(a, event_id)', 'CO_CO_roll_avg_30')}, {rnd('arg_max(s, event_id)', 'CO_CO_roll_std_30')} FROM (
  SELECT asset_id, event_id, avg(CO_CO) OVER w AS a, stddev_pop(CO_CO) OVER w AS s FROM tel
  WINDOW w AS ({ORDER} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) GROUP BY asset_id""")
def e13(spark, sf):
    names = ["CO_CO_roll_avg_30", "CO_CO_roll_std_30"]
    out = E.rolling_stats(telemetry(spark, sf), ["CO_CO"], [30], ["avg", "std"], keep=["asset_id", "ts", "arrival_seq"])
    return rounded(E.latest_row(out, names), ["asset_id"], names)


@query("e14_lagged_safety", f"SELECT event_id, {rnd('safety_lag', 'safety_lag')} FROM idx", ["idx"])
def e14(spark, sf):
    return rounded(E.lagged_safety(risk_indices(telemetry(spark, sf), lead=False)), ["event_id"], ["safety_lag"])


SCORE_SQL = """greatest(5, least(100, CAST(trunc(CASE predicted_class WHEN 'Low' THEN 100e0 - (1e0 - confidence) * 20e0
  WHEN 'Medium' THEN 70e0 - (1e0 - confidence) * 20e0 WHEN 'High' THEN 45e0 - (1e0 - confidence) * 25e0
  ELSE 20e0 - (1e0 - confidence) * 15e0 END) AS INTEGER)))"""


@query("e15_score_history", f"""
SELECT asset_id, event_id, health_score, CAST(n - back + 1 AS INTEGER) AS slot FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC, event_id DESC) AS back,
    least(20, count(*) OVER (PARTITION BY asset_id)) AS n
  FROM (SELECT asset_id, event_id, ts, {SCORE_SQL} AS health_score,
      date_trunc('second', ts) AS sec,
      lag(date_trunc('second', ts)) OVER ({ORDER}) AS prev_sec FROM pred)
  WHERE prev_sec IS NULL OR prev_sec <> sec) WHERE back <= 20""", ["pred"])
def e15(spark, sf):
    scored = predictions(spark, sf).withColumn("health_score", health_score())
    out = E.score_history(scored, "health_score")
    return out.select("asset_id", F.col("arrival_seq").alias("event_id"), "health_score", "slot")


@query("e16_score_trend", f"SELECT asset_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {SCORE_SQL} AS health_score FROM pred", ["pred"])
def e16(spark, sf):
    out = E.score_trend(predictions(spark, sf).withColumn("health_score", health_score()), "health_score")
    return out.select("asset_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "health_score")
