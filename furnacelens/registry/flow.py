"""Streaming and scenario-run queries: the stateful parts and the whole flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.functions.scalar import r6
from furnacelens.operators.features import forest
from furnacelens.operators.ops_scores import health_score
from furnacelens.operators.training import score
from furnacelens.plans.flow import validated_packets
from furnacelens.registry.base import query, raw, rnd, spread_raw
from furnacelens.registry.models import FEATURES, fit
from furnacelens.session import scratch_path
from furnacelens.sources.files import decode_packets
from furnacelens.streaming import stateful as ST

COLS = ["CO_CO", "BF_H2"]
_W = "PARTITION BY asset_id ORDER BY pts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


@query("stream_order_and_rolling", f"""
SELECT event_id AS arrival_seq, {rnd(f"avg(CO_CO) OVER ({_W.format(4)})", 'CO_CO_roll_avg_5')}, {rnd(f"stddev_pop(CO_CO) OVER ({_W.format(29)})", 'CO_CO_roll_std_30')},
  {rnd(f"(BF_H2 - first_value(BF_H2) OVER ({_W.format(4)})) / count(*) OVER ({_W.format(4)})", 'BF_H2_roll_grad_5')}
FROM (SELECT * EXCLUDE (ts) FROM norm WHERE reason IS NULL)""", ["norm"])
def stream(spark, sf):
    """Raw packets through Structured Streaming: order check and rolling statistics with per-asset state."""
    from furnacelens.streaming.verdict import write_in_order

    folder = scratch_path(spark, "packets")
    r = spread_raw(spark, sf)
    write_in_order(r, folder, "arrival_seq", 1)  # a stream replays files in arrival order, a bounded number of rows each
    ST.use_rocksdb(spark)
    packets = ST.read_packets(spark, folder, r.schema, files_per_trigger=1)
    out = ST.ordered_rolling(ST.checked_stream(decode_packets(packets), COLS), COLS, [5, 30], ["avg", "std", "grad"])
    sink = scratch_path(spark, "stream-out")
    ST.run_available(out, sink, scratch_path(spark, "stream-state"))
    names = ["CO_CO_roll_avg_5", "CO_CO_roll_std_30", "BF_H2_roll_grad_5"]
    return spark.read.schema(out.schema).parquet(sink).select("arrival_seq", *[r6(n).alias(n) for n in names])


@query("o10_scenario_run")
def o10(spark, sf):
    """Every packet through check, normalise, score and health; rejected packets stay, tagged."""
    model, _test = fit(spark, sf, forest("label", trees=20, depth=6))
    tagged = validated_packets(raw(spark, sf)).select("asset_id", "arrival_seq", "ts", "is_valid", "reason", *FEATURES)
    scored = score(model, tagged)
    return scored.select("asset_id", "arrival_seq", "is_valid", "reason", "predicted_class", "confidence", health_score().alias("health_score"))


def _tagged_run(spark, sf, pieces: int = 5):
    """Raw packets with their arrival time and latency, replayed in ``pieces`` triggers (more beyond a million packets) through the tagged processor."""
    from furnacelens.registry.base import events
    from furnacelens.streaming import verdict as V

    extra = events(spark, sf).select(F.col("event_id").alias("arrival_seq"), F.col("value").alias("latency_ms"), F.col("ts").cast("timestamp").alias("arrived"))
    packets = spread_raw(spark, sf).join(extra, "arrival_seq")
    folder = scratch_path(spark, "replay")
    V.write_in_order(packets, folder, "arrival_seq", pieces, clock="arrived")
    ST.use_rocksdb(spark)  # transformWithState keeps its state in RocksDB
    stream = V.verdict_stream(spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(folder), arrived="arrived", latency="latency_ms", context=["payload"])
    return V.run_triggers(spark, stream, scratch_path(spark, "tagged-out"), scratch_path(spark, "tagged-state"))


@query("c08_stream_verdict", "SELECT asset_id, event_id AS arrival_seq, reason IS NULL AS is_valid, reason FROM verdict", ["verdict"])
def c08_stream(spark, sf):
    """The verdict of every packet from the stream's accepted and quarantined outputs, over five triggers or more."""
    out = _tagged_run(spark, sf).filter(F.col("tag").isin("accepted", "quarantined"))
    return out.select("asset_id", "arrival_seq", (F.col("tag") == "accepted").alias("is_valid"), "reason")


@query("n07_stream_health", f"""
SELECT asset_id, count(*) AS packets_received, count(*) FILTER (reason IS NOT NULL) AS packets_failed_validation,
  round(100e0 * count(*) FILTER (reason IS NOT NULL) / count(*), 2) AS packet_loss_rate_pct, {rnd('latest_ms', 'latest_ms')}, {rnd('average_ms', 'average_ms')}
FROM verdict JOIN (SELECT asset_id, arg_max(value, event_id) AS latest_ms, sum(0.1e0 * pow(0.9e0, behind) * value) AS average_ms
  FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_id DESC) - 1 AS behind FROM tel) GROUP BY asset_id) USING (asset_id)
GROUP BY asset_id, latest_ms, average_ms""", ["verdict"])
def n07_stream(spark, sf):
    """Health of each asset after its last trigger, from the stream's health output."""
    health = _tagged_run(spark, sf).filter(F.col("tag") == "health")
    last = health.groupBy("asset_id").agg(F.max_by(F.struct("received", "failed", "loss_pct", "latest_ms", "average_ms"), "received").alias("h"))
    return last.select(
        "asset_id", F.col("h.received").alias("packets_received"), F.col("h.failed").alias("packets_failed_validation"),
        F.col("h.loss_pct").alias("packet_loss_rate_pct"), r6(F.col("h.latest_ms")).alias("latest_ms"), r6(F.col("h.average_ms")).alias("average_ms"),
    )
