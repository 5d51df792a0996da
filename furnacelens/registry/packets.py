"""Packet validation (C), normalisation (D) and stream health (N) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.catalogues import RULES
from furnacelens.constants import BOOLEAN_DEFAULTS, CATEGORY_DOMAINS, RAW_SENSORS, SENSOR_BOUNDS
from furnacelens.functions.scalar import r6
from furnacelens.operators import health as H
from furnacelens.operators import normalize as D
from furnacelens.operators import rules as R
from furnacelens.operators import validate as C
from furnacelens.operators.ordered import row_positions
from furnacelens.plans.flow import packet_indices, validated_packets
from furnacelens.registry.base import d, query, raw, rnd, rounded, telemetry
from furnacelens.sources.files import decode_packets


def decoded(spark, sf):
    return decode_packets(raw(spark, sf))


def verdicts(spark, sf, **order):
    return C.validate_packets(decoded(spark, sf), **order)


@query("a06_json_decode", f"""
SELECT event_id AS arrival_seq, CASE hit WHEN 103 THEN 28 WHEN 107 THEN 28 ELSE 29 END AS fields,
  {rnd("CASE WHEN hit = 97 THEN NULL ELSE CO_CO END", 'CO_CO')}, false AS rejected FROM faulty
UNION ALL SELECT event_id, NULL, NULL, true FROM faulty""", ["faulty"])
def a06(spark, sf):
    """Every packet once as sent and once cut short; the cut ones are not JSON and are rejected."""
    r = raw(spark, sf)
    broken = r.withColumn("payload", F.expr("substring(payload, 1, length(payload) - 1)"))
    both = decode_packets(r.unionByName(broken))
    return both.select(
        "arrival_seq", F.when(F.col("packet").isNotNull(), F.size("packet")).alias("fields"),
        r6(F.col("packet")["CO_CO"].try_cast("double")).alias("CO_CO"), F.col("packet").isNull().alias("rejected"),
    )


@query("c01_timestamp_presence", "SELECT event_id AS arrival_seq, hit <> 107 AS has_timestamp FROM faulty", ["faulty"])
def c01(spark, sf):
    return decoded(spark, sf).select("arrival_seq", C.has_timestamp().alias("has_timestamp"))


@query("c02_timestamp_parse", "SELECT event_id AS arrival_seq, strftime(pts, '%Y-%m-%d %H:%M:%S') AS ts FROM parsed", ["parsed"])
def c02(spark, sf):
    ts = C.parse_timestamp(F.col("packet")["Timestamp"])
    return decoded(spark, sf).select("arrival_seq", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"))


_ORDER_SQL = "SELECT asset_id, event_id AS arrival_seq, coalesce(reason = 'out_of_order', false) AS late FROM verdict"


def _late(df):
    return df.select("asset_id", "arrival_seq", F.coalesce(F.col("reason") == "out_of_order", F.lit(False)).alias("late"))


@query("c03_out_of_order", _ORDER_SQL, ["verdict"])
def c03(spark, sf):
    return _late(validated_packets(raw(spark, sf)))


@query("c03_out_of_order_sliced", _ORDER_SQL, ["verdict"])
def c03_sliced(spark, sf):
    """Hot assets cut into slices of about 500 packets; the running maximum is carried across."""
    return _late(validated_packets(raw(spark, sf), slice_rows=500, width=256))


@query("c04_missing_fields", "SELECT event_id AS arrival_seq, CASE hit WHEN 103 THEN 'CO_NH3' ELSE '' END AS missing FROM faulty", ["faulty"])
def c04(spark, sf):
    return decoded(spark, sf).select("arrival_seq", F.array_join(C.missing_fields(), ",").alias("missing"))


@query("c05_not_numeric", "SELECT event_id AS arrival_seq, CASE hit WHEN 101 THEN 'BF_H2' ELSE '' END AS unreadable FROM faulty", ["faulty"])
def c05(spark, sf):
    return decoded(spark, sf).select("arrival_seq", F.array_join(C.unreadable_sensors(), ",").alias("unreadable"))


def _sent(s: str) -> str:
    return {
        "CO_CO": "CASE WHEN hit <> 97 THEN CO_CO END", "BF_H2": "CASE WHEN hit <> 101 THEN BF_H2 END",
        "CO_NH3": "CASE WHEN hit <> 103 THEN CO_NH3 END",
        "BF_Top_Pressure": "CASE WHEN hit = 457 THEN 0.3e0 ELSE BF_Top_Pressure END",
        "BF_Top_Temperature": "CASE WHEN hit = 457 THEN 950e0 ELSE BF_Top_Temperature END",
    }.get(s, s)


@query("c06_out_of_bounds", " UNION ALL ".join(
    f"SELECT '{s}' AS sensor, count(*) AS n FROM faulty WHERE ({_sent(s)}) < {d(lo)} OR ({_sent(s)}) > {d(hi)} HAVING count(*) > 0"
    for s, (lo, hi) in SENSOR_BOUNDS.items()), ["faulty"])
def c06(spark, sf):
    hits = decoded(spark, sf).select(F.explode(C.out_of_bounds()).alias("sensor"))
    return hits.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


@query("c07_unknown_category", "SELECT event_id AS arrival_seq, CASE hit WHEN 127 THEN 'Permit_Type' ELSE '' END AS unknown FROM faulty", ["faulty"])
def c07(spark, sf):
    return decoded(spark, sf).select("arrival_seq", F.array_join(C.unknown_categories(), ",").alias("unknown"))


@query("c08_verdict", "SELECT asset_id, event_id AS arrival_seq, reason IS NULL AS is_valid, reason FROM verdict", ["verdict"])
def c08(spark, sf):
    return verdicts(spark, sf).select("asset_id", "arrival_seq", "is_valid", "reason")


@query("c08_quarantine", "SELECT asset_id, reason, count(*) AS n FROM verdict WHERE reason IS NOT NULL GROUP BY ALL", ["verdict"])
def c08_quarantine(spark, sf):
    _accepted, rejected = C.split_verdict(verdicts(spark, sf))
    return rejected.groupBy("asset_id", "reason").agg(F.count(F.lit(1)).alias("n"))


# -- normalisation -----------------------------------------------------------
@query("d01_canonical_timestamp", """SELECT event_id AS arrival_seq, strftime(pts, '%Y-%m-%d %H:%M:%S') AS Timestamp
FROM verdict WHERE reason IS NULL""", ["verdict"])
def d01(spark, sf):
    return validated_packets(raw(spark, sf)).filter("is_valid").select("arrival_seq", D.canonical_timestamp("ts").alias("Timestamp"))


@query("d02_sensor_values", "SELECT event_id AS arrival_seq, " + ", ".join(rnd(s, s) for s in RAW_SENSORS) + " FROM norm", ["norm"])
def d02(spark, sf):
    fields = D.normalised_fields()
    return decoded(spark, sf).select("arrival_seq", *[r6(fields[s]).alias(s) for s in RAW_SENSORS])


@query("d03_category_values", "SELECT event_id AS arrival_seq, Shift_Type, Permit_Type, CCTV_Event FROM norm", ["norm"])
def d03(spark, sf):
    fields = D.normalised_fields()
    return decoded(spark, sf).select("arrival_seq", *[fields[c].alias(c) for c in CATEGORY_DOMAINS])


@query("d04_boolean_values", "SELECT event_id AS arrival_seq, PPE_Compliance, Maintenance_Active, Gas_Test_Completed FROM norm", ["norm"])
def d04(spark, sf):
    fields = D.normalised_fields()
    return decoded(spark, sf).select("arrival_seq", *[fields[c].alias(c) for c in BOOLEAN_DEFAULTS])


@query("d05_safety_default", f"""SELECT event_id, {rnd("CASE WHEN event_id % 4 = 0 THEN value ELSE 100e0 END", 'Safety_Index')} FROM tel""")
def d05(spark, sf):
    t = telemetry(spark, sf).withColumn("sent", F.when(F.col("event_id") % 4 == 0, F.col("value")))
    return rounded(D.attach_safety_index(t, "sent"), ["event_id"], ["Safety_Index"])


_RECS = {r[0]: r for r in RULES}


def _rec_case(field: int) -> str:
    return "CASE " + " ".join(f"WHEN rule_id = '{k}' THEN '{_RECS[k][field]}'" for k in ("R004", "R011", "R016")) + " END"


@query("d06_recommendation_schema", f"""
SELECT event_id, rule_id, CASE WHEN event_id % 5 = 0 THEN 'HIGH' ELSE {_rec_case(8)} END AS priority, {_rec_case(9)} AS action,
  CASE WHEN event_id % 6 = 0 THEN 'Safety threshold limit exceeded' ELSE {_rec_case(7)} END AS reason,
  CASE WHEN event_id % 9 = 0 THEN {_rec_case(2)} ELSE {_rec_case(3)} END AS category
FROM (SELECT event_id, unnest(list_filter([CASE WHEN BF_CO >= 3 AND Worker_Count > 0 THEN 'R004' END,
  CASE WHEN CO_CO >= 3 AND Maintenance_Active THEN 'R011' END, CASE WHEN CO_NH3 >= 0.5e0 THEN 'R016' END],
  lambda x: x IS NOT NULL)) AS rule_id FROM tel) WHERE event_id % 8 <> 0""")
def d06(spark, sf):
    """Fired rules with fields blanked on some rows; rows without an action go to the second output."""
    fired = R.triggered_long(telemetry(spark, sf), ["event_id"])
    e = F.col("event_id")
    sent = fired.select(
        "event_id", "rule_id", "process_area",
        F.when(e % 9 != 0, F.col("hazard_category")).alias("hazard_category"),
        F.when(e % 6 != 0, F.concat(F.lit(" "), "compound_risk_reason")).alias("description"),
        F.when(e % 5 != 0, F.col("risk_level")).otherwise("").alias("severity"),
        F.when(e % 8 != 0, F.concat("recommended_action", F.lit("  "))).alias("recommended_action"),
    )
    good, _without_action = D.unify_recommendations(sent, ["event_id", "rule_id"])
    return good


# -- stream health -----------------------------------------------------------
def health_rows(spark, sf):
    """Validated packets with the text timestamp and a latency reading (the event value, in ms)."""
    from furnacelens.registry.base import events

    v = validated_packets(raw(spark, sf), fields=[]).select("asset_id", "arrival_seq", "is_valid", "ts")
    v = v.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    extra = events(spark, sf).select(F.col("event_id").alias("arrival_seq"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("arrived"))
    return v.join(extra, "arrival_seq")


_HEALTH_SQL = "(SELECT *, strftime(pts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM verdict)"


@query("n01_packets_received", f"""
SELECT asset_id, count(*) AS packets_received, arg_max(ts_text, event_id) AS last_packet_timestamp,
  count(*) FILTER (reason IS NOT NULL) AS packets_failed_validation,
  round(100e0 * count(*) FILTER (reason IS NOT NULL) / count(*), 2) AS packet_loss_rate_pct FROM {_HEALTH_SQL} GROUP BY asset_id""", ["verdict"])
def n01(spark, sf):
    v = validated_packets(raw(spark, sf), fields=[]).withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    out = H.packet_counts(v, ["asset_id"], ts_text="ts_text", seq="arrival_seq", valid="is_valid")
    return out.drop("packets_accepted")


@query("n02_failed_by_reason", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM verdict GROUP BY ALL", ["verdict"])
def n02(spark, sf):
    v = validated_packets(raw(spark, sf), fields=[])
    return v.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("n03_loss_rate", """
SELECT asset_id, hour(ts) AS hour, round(100e0 * count(*) FILTER (reason IS NOT NULL) / count(*), 2) AS packet_loss_rate_pct
FROM (SELECT asset_id, event_id, reason, pts AS ts FROM verdict) GROUP BY ALL""", ["verdict"])
def n03(spark, sf):
    v = validated_packets(raw(spark, sf), fields=[]).withColumn("hour", F.hour("ts").cast("long"))
    out = H.packet_counts(v, ["asset_id", "hour"], ts_text="ts", seq="arrival_seq", valid="is_valid")
    return out.select("asset_id", "hour", "packet_loss_rate_pct")


@query("n04_buffer_utilisation", """
SELECT asset_id, day, round(least(count(*), 30) / 30e0 * 100e0, 2) AS buffer_utilization_pct FROM (
  SELECT asset_id, strftime(pts, '%Y-%m-%d %H') AS day FROM verdict WHERE reason IS NULL) GROUP BY ALL""", ["verdict"])
def n04(spark, sf):
    v = validated_packets(raw(spark, sf), fields=[]).filter("is_valid").withColumn("day", F.date_format("ts", "yyyy-MM-dd HH"))
    return v.groupBy("asset_id", "day").agg(H.buffer_utilisation(F.count(F.lit(1))).alias("buffer_utilization_pct"))


def ema_sql(keys: str, source: str) -> str:
    return f"""SELECT {keys}, arg_max(value, event_id) AS latest_ms, sum(0.1e0 * pow(0.9e0, behind) * value) AS average_ms
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY event_id DESC) - 1 AS behind FROM {source}) GROUP BY {keys}"""


@query("n05_latency_average", f"SELECT event_type, {rnd('latest_ms', 'latest_ms')}, {rnd('average_ms', 'average_ms')} FROM ({ema_sql('event_type', 'events')})", [])
def n05(spark, sf):
    from furnacelens.registry.base import events

    out = H.latency_ema(events(spark, sf), ["event_type"], "event_id", "value")
    return rounded(out, ["event_type"], ["latest_ms", "average_ms"])


@query("n05_latency_average_sliced", f"SELECT event_type, {rnd('latest_ms', 'latest_ms')}, {rnd('average_ms', 'average_ms')} FROM ({ema_sql('event_type', 'events')})", [])
def n05_sliced(spark, sf):
    from furnacelens.registry.base import events

    out = H.latency_ema(events(spark, sf), ["event_type"], "event_id", "value", width=64, slice_rows=200)
    return rounded(out, ["event_type"], ["latest_ms", "average_ms"])


_STATUS_SQL = """CASE WHEN {idle} > 10 THEN 'DEGRADED' WHEN {lat} >= 200 OR {loss} >= 10 THEN 'CRITICAL'
  WHEN {lat} >= 50 OR {loss} >= 2 THEN 'WARNING' ELSE 'HEALTHY' END"""


@query("n06_status", f"""
SELECT event_id AS arrival_seq, {_STATUS_SQL.format(idle="date_diff('microsecond', prev, ts) / 6e8", lat="value", loss="event_id % 13")} AS status
FROM (SELECT event_id, value, ts, lag(ts) OVER (PARTITION BY asset_id ORDER BY ts, event_id) AS prev FROM tel)""")
def n06(spark, sf):
    """Status per reading: the gap to the previous one (in tens of minutes) stands for the idle time."""
    from pyspark.sql import Window as W

    t = telemetry(spark, sf)
    prev = F.lag("ts").over(W.partitionBy("asset_id").orderBy("ts", "arrival_seq"))
    idle = (F.unix_micros("ts") - F.unix_micros("prev")) / F.lit(6e8)
    return t.withColumn("prev", prev).select("arrival_seq", H.status(F.col("value"), F.col("event_id") % 13, idle).alias("status"))


@query("n07_snapshot", f"""
SELECT asset_id, packets_received, packets_failed_validation, packet_loss_rate_pct, last_packet_timestamp,
  {rnd('latest_ms', 'latest_ms')}, {rnd('average_ms', 'average_ms')}, least(accepted, 30) AS buffer_size, 30 AS buffer_capacity,
  round(least(accepted, 30) / 30e0 * 100e0, 2) AS buffer_utilization_pct,
  {_STATUS_SQL.format(idle="idle", lat="latest_ms", loss="exact_loss")} AS status
FROM (SELECT asset_id, count(*) AS packets_received, count(*) FILTER (reason IS NOT NULL) AS packets_failed_validation,
    count(*) FILTER (reason IS NULL) AS accepted, 100e0 * count(*) FILTER (reason IS NOT NULL) / count(*) AS exact_loss,
    round(100e0 * count(*) FILTER (reason IS NOT NULL) / count(*), 2) AS packet_loss_rate_pct,
    arg_max(strftime(pts, '%Y-%m-%d %H:%M:%S'), CASE WHEN pts IS NOT NULL THEN event_id END) AS last_packet_timestamp,
    date_diff('second', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS idle FROM verdict GROUP BY asset_id)
JOIN ({ema_sql('asset_id', 'tel')}) USING (asset_id)""", ["verdict"])
def n07(spark, sf):
    v = health_rows(spark, sf)
    out = H.snapshot(
        v, ["asset_id"], ts="arrived", ts_text="ts_text", seq="arrival_seq", valid="is_valid", latency="latency_ms",
        as_of=F.lit("2024-01-31 00:00:00"),
    )
    return out.select(
        "asset_id", "packets_received", "packets_failed_validation", "packet_loss_rate_pct", "last_packet_timestamp",
        r6("latest_ms").alias("latest_ms"), r6("average_ms").alias("average_ms"), "buffer_size", "buffer_capacity",
        "buffer_utilization_pct", "status",
    )


@query("n08_progress_summary", f"""
SELECT (pos - 1) // 100 AS block, max(pos) AS processed, count(*) FILTER (reason IS NOT NULL) AS failed, {rnd('avg(value)', 'mean_latency_ms')}
FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM verdict) GROUP BY 1""", ["verdict"])
def n08(spark, sf):
    from furnacelens.operators.ordered import global_row_number

    v = health_rows(spark, sf)
    out = H.progress_summary(global_row_number(v, "arrival_seq", "pos"), "pos", "is_valid", "latency_ms")
    return out.select("block", "processed", "failed", r6("mean_latency_ms").alias("mean_latency_ms"))


@query("n08_final_report", f"""
SELECT count(*) AS total_packets, count(*) FILTER (reason IS NOT NULL) AS failed_packets, {rnd('avg(value)', 'avg_total_ms')},
  {rnd('avg(value * 0.7e0)', 'avg_inference_ms')}, round(100e0 * count(*) FILTER (reason IS NOT NULL) / count(*), 2) AS packet_loss_rate_pct,
  {rnd('avg(value) - avg(value * 0.7e0)', 'avg_engine_ms')} FROM verdict""", ["verdict"])
def n08_final(spark, sf):
    v = health_rows(spark, sf).withColumn("inference_ms", F.col("latency_ms") * F.lit(0.7))
    out = H.final_report(v, "is_valid", "latency_ms", "inference_ms")
    return out.select(
        "total_packets", "failed_packets", "packet_loss_rate_pct",
        *[r6(c).alias(c) for c in ("avg_total_ms", "avg_inference_ms", "avg_engine_ms")],
    )


@query("n08_positions_sliced", "SELECT event_id, row_number() OVER (PARTITION BY asset_id ORDER BY event_id) AS pos FROM tel")
def n08_positions(spark, sf):
    """Arrival positions per asset, numbered slice by slice."""
    t = telemetry(spark, sf).select("asset_id", "event_id")
    return row_positions(t, ["asset_id"], F.col("event_id"), ["event_id"], "pos", width=128, slice_rows=300).select("event_id", "pos")


@query("flow_packet_indices", f"""
SELECT event_id AS arrival_seq, {rnd('Gas_Risk_Index', 'Gas_Risk_Index')}, {rnd('Process_Stability_Index', 'Process_Stability_Index')},
  {rnd('Thermal_Risk_Index', 'Thermal_Risk_Index')}, {rnd('Data_Quality_Score', 'Data_Quality_Score')}, 100e0 AS Safety_Index
FROM flow_idx""", ["flow_idx"])
def flow_indices(spark, sf):
    """Raw packets to risk indices: decode, check, order, normalise, window, score."""
    out = packet_indices(raw(spark, sf))
    return out.select("arrival_seq", *[r6(c).alias(c) for c in (
        "Gas_Risk_Index", "Process_Stability_Index", "Thermal_Risk_Index", "Data_Quality_Score", "Safety_Index")])
