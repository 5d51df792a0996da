"""The tagged stream processor: verdict across triggers, context carried, stall and expiry timers, health totals."""

import json

import numpy as np
from pyspark.sql import functions as F

from furnacelens.session import scratch_path
from furnacelens.streaming import stateful as ST
from furnacelens.streaming import verdict as V
from furnacelens.operators.validate import REQUIRED_FIELDS

SCHEMA = "asset_id long, arrival_seq long, payload string, latency_ms double, arrived timestamp"


def packet(ts, **extra):
    body = {f: "1" for f in REQUIRED_FIELDS}
    body.update({"Shift_Type": "Day", "Permit_Type": "None", "CCTV_Event": "Normal", "PPE_Compliance": "true",
                 "Maintenance_Active": "false", "Gas_Test_Completed": "true", "Timestamp": ts})
    body.update(extra)
    return json.dumps({k: v for k, v in body.items() if v is not None})


def test_reasons_match_the_batch_rule():
    t = np.array([10, 5, 20, V.NONE, 15, 30], np.int64)
    ok = np.ones(6, bool)
    running = np.maximum.accumulate(np.r_[V.NONE, np.where(ok & (t != V.NONE), t, V.NONE)])
    why = V.reasons(ok, ok, t, ok, ok, running[:-1])
    assert list(why) == [None, "out_of_order", None, "bad_timestamp", "out_of_order", None]


def test_tagged_outputs_over_triggers(spark):
    rows = [
        (1, 1, packet("2024-01-01 00:00:00"), 10.0, "2024-01-01 00:00:00"),
        (1, 2, packet("2024-01-01 00:00:01"), 300.0, "2024-01-01 00:00:01"),
        (2, 3, packet("2024-01-01 00:00:02"), 10.0, "2024-01-01 00:00:02"),
        # second trigger: asset 1 goes back in time; asset 2 sends nothing for a minute
        (1, 4, packet("2024-01-01 00:00:00"), 10.0, "2024-01-01 00:00:30"),
        (1, 5, "not json", 10.0, "2024-01-01 00:00:40"),
        # third trigger: far later, so asset 2's stall timer has fired and asset 1 goes on
        (1, 6, packet("2024-01-01 00:01:30"), 10.0, "2024-01-01 00:01:30"),
    ]
    df = spark.createDataFrame(rows, "asset_id long, arrival_seq long, payload string, latency_ms double, arrived string")
    df = df.withColumn("arrived", F.to_timestamp("arrived"))
    folder = scratch_path(spark, "tagged-test")
    V.write_in_order(df, folder, "arrival_seq", 3)
    ST.use_rocksdb(spark)
    stream = V.verdict_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), arrived="arrived", latency="latency_ms", context=["payload"])
    out = V.run_triggers(spark, stream, scratch_path(spark, "tagged-test-out"), scratch_path(spark, "tagged-test-state")).collect()
    verdicts = {r.arrival_seq: (r.tag, r.reason) for r in out if r.tag in ("accepted", "quarantined")}
    assert verdicts == {1: ("accepted", None), 2: ("accepted", None), 3: ("accepted", None), 4: ("quarantined", "out_of_order"),
                        5: ("quarantined", "malformed_packet"), 6: ("accepted", None)}
    assert {r.arrival_seq: r.payload for r in out if r.tag == "quarantined"}[5] == "not json"
    stalls = [r for r in out if r.tag == "stall"]
    assert [(r.asset_id, r.status, r.at_ms) for r in stalls if r.asset_id == 2] == [(2, "DEGRADED", 1704067202000 + 10000)]
    last = max((r for r in out if r.tag == "health" and r.asset_id == 1), key=lambda r: r.received)
    assert (last.received, last.failed, last.loss_pct) == (5, 2, 40.0) and last.status == "CRITICAL"


def test_replay_files_are_bounded_and_late_packets_keep_their_verdict(spark):
    # 60 packets crowded at one end of the sequence; the second half arrived, by its stamps, an hour before the first
    rows = [(1, i if i < 59 else 10**6, packet(f"2024-01-01 02:00:{i:02d}"), 1.0, f"2024-01-01 {2 if i < 30 else 1:02d}:00:{i:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "asset_id long, arrival_seq long, payload string, latency_ms double, arrived string")
    df = df.withColumn("arrived", F.to_timestamp("arrived"))
    folder = scratch_path(spark, "bounded-test")
    V.write_in_order(df, folder, "arrival_seq", 2, clock="arrived", rows=20)
    held = spark.read.parquet(folder).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in held) == 60 and max(r["count"] for r in held) <= 20
    ST.use_rocksdb(spark)
    stream = V.verdict_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), arrived="arrived", latency="latency_ms", context=["payload"])
    out = V.run_triggers(spark, stream, scratch_path(spark, "bounded-out"), scratch_path(spark, "bounded-state"))
    assert out.filter(F.col("tag") == "accepted").count() == 60


def test_replay_keeps_packets_without_a_sequence(spark):
    df = spark.createDataFrame([(1, None), (1, 5), (1, 9)], "asset_id long, arrival_seq long")
    folder = scratch_path(spark, "unordered-test")
    V.write_in_order(df, folder, "arrival_seq", 1)
    assert spark.read.parquet(folder).count() == 3


def test_frames_equal_one_by_one():
    x = np.random.default_rng(1).normal(size=(40, 2))
    at = np.arange(3, 40)
    n = np.minimum(at + 1, 30)[:, None]
    mean = ST._over_frames(x, at, 30) / n
    var = ST._over_frames(x, at, 30, mean) / n
    assert np.allclose(mean, [x[max(0, i - 29): i + 1].mean(axis=0) for i in at], rtol=0, atol=1e-15)
    assert np.allclose(var, [x[max(0, i - 29): i + 1].var(axis=0) for i in at], rtol=0, atol=1e-15)
