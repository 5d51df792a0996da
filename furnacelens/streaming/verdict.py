"""Packet verdict, quarantine and health on a stream: one stateful processor, several outputs told apart by a tag.

Per asset the processor keeps the latest accepted timestamp and the running health figures (value states) and two
event-time timers: the moment the asset would count as stalled, and the moment its state expires. Spark gives value
states a time-to-live only in processing time; here the expiry is an event-time timer that clears them, so an asset
silent for ``ttl_ms`` of event time releases its state, and results do not depend on the wall clock. Its output rows carry a ``tag``:

* ``accepted`` / ``quarantined``: every packet, in arrival order within the asset, with its reason and the context
  columns handed in (as text);
* ``health``: after each micro-batch with packets of the asset, the figures so far: received, failed, loss, latest
  latency and its exponential average, buffer use and status;
* ``stall``: when the watermark passes the last arrival plus ``STALL_SECONDS`` without a packet, a DEGRADED row.

The verdict equals the batch verdict: reasons in the order malformed, missing timestamp, bad timestamp, out of order
(not later than every sound packet before it), missing fields, not numeric. Within a micro-batch the running maximum
is numpy's accumulate over the sound timestamps, seeded with the state; no loop per packet. A micro-batch of one asset
is one call, so the replay's bound on a micro-batch (``TRIGGER_ROWS``) also bounds that call.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from furnacelens.constants import BUFFER_ROWS, EMA_ALPHA, LATENCY_LIMITS_MS, LOSS_LIMITS_PCT, STALL_SECONDS
from furnacelens.operators.validate import check_fields
from furnacelens.sources.files import decode_packets

STATE_TTL_MS = 24 * 3600 * 1000
TRIGGER_ROWS = 1_000_000  # packets of one replay file, so of one micro-batch
GROUP_BYTES = 8 << 20  # row groups of a replay file: small, so that one file is decoded by many tasks
OUT_ROWS = 10_000
NONE = np.iinfo(np.int64).min
FLAGS = ("_readable", "_has_ts", "_complete", "_numeric")  # of check_fields; handed on without the underscore
TOTALS = T.StructType([T.StructField(n, t) for n, t in (
    ("received", T.LongType()), ("failed", T.LongType()), ("accepted", T.LongType()), ("latest", T.DoubleType()),
    ("ema", T.DoubleType()), ("last_ms", T.LongType()),
)])


def reasons(readable, has_ts, ts, complete, numeric, last_before) -> np.ndarray:
    """The batch verdict's reason of each packet, None when accepted."""
    late = (ts != NONE) & (last_before != NONE) & (ts <= last_before)
    choice = [~readable, ~has_ts, ts == NONE, late, ~complete, ~numeric]
    names = ["malformed_packet", "missing_timestamp", "bad_timestamp", "out_of_order", "missing_fields", "not_numeric"]
    return np.select(choice, names, default=None).astype(object)


def status(latest: float, loss_pct: float, stalled: bool = False) -> str:
    if stalled:
        return "DEGRADED"
    if latest >= LATENCY_LIMITS_MS["critical"] or loss_pct >= LOSS_LIMITS_PCT["critical"]:
        return "CRITICAL"
    if latest >= LATENCY_LIMITS_MS["warning"] or loss_pct >= LOSS_LIMITS_PCT["warning"]:
        return "WARNING"
    return "HEALTHY"


class PacketVerdict(StatefulProcessor):
    """Verdict per packet, health per batch, stall per silent asset; ``context`` columns ride along as text."""

    def __init__(self, context: Sequence[str], ttl_ms: int = STATE_TTL_MS):
        self.context, self.ttl_ms = list(context), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last_ts", T.StructType([T.StructField("us", T.LongType())]))
        self.totals = handle.getValueState("totals", TOTALS)

    def _row(self, key, tag: str, n: int = 1, **values) -> pd.DataFrame:
        cols = {"asset_id": [key[0]] * n, "tag": [tag] * n}
        for name in ("arrival_seq", "reason", "ts_us", "received", "failed", "loss_pct", "latest_ms", "average_ms", "buffer_pct", "status", "at_ms", *self.context):
            cols[name] = values.get(name, [None] * n)
        return pd.DataFrame(cols)

    def _health(self, key, t: tuple, tag: str, at_ms: int, stalled: bool) -> pd.DataFrame:
        received, failed, accepted, latest, ema, _ = t
        loss = 100.0 * failed / received if received else 0.0
        return self._row(
            key, tag, received=[received], failed=[failed], loss_pct=[round(loss, 2)], latest_ms=[latest], average_ms=[ema],
            buffer_pct=[round(100.0 * min(accepted, BUFFER_ROWS) / BUFFER_ROWS, 2)], status=[status(latest, loss, stalled)], at_ms=[at_ms],
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("arrival_seq", kind="stable", ignore_index=True)
        ts = batch["ts_us"].fillna(NONE).astype(np.int64).to_numpy()
        flags = {f: batch[f[1:]].fillna(False).astype(bool).to_numpy() for f in FLAGS}
        sound = flags["_readable"] & (ts != NONE) & flags["_complete"] & flags["_numeric"]
        seed = self.last.get()[0] if self.last.exists() else NONE
        running = np.maximum.accumulate(np.r_[seed, np.where(sound, ts, NONE)])
        why = reasons(flags["_readable"], flags["_has_ts"], ts, flags["_complete"], flags["_numeric"], running[:-1])
        self.last.update((int(running[-1]),))

        received, failed, accepted, latest, ema, last_ms = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.0, 0.0, NONE)
        x = batch["latency_ms"].fillna(0.0).to_numpy(dtype=float)
        n = len(batch)
        weights = EMA_ALPHA * (1 - EMA_ALPHA) ** np.arange(n - 1, -1, -1)
        ema = float(ema * (1 - EMA_ALPHA) ** n + (weights * x).sum())
        arrived = batch["arrived_ms"].to_numpy(dtype=np.int64)
        bad = int(sum(w is not None for w in why))
        totals = (received + n, failed + bad, accepted + n - bad, float(x[-1]), ema, int(max(last_ms, arrived.max())))
        self.totals.update(totals)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(totals[-1] + int(STALL_SECONDS * 1000))
        self.handle.registerTimer(totals[-1] + self.ttl_ms)

        for at in range(0, n, OUT_ROWS):  # the context is most of a packet: it goes out in pieces, not copied whole
            part = batch.iloc[at:at + OUT_ROWS]
            reason, us = why[at:at + OUT_ROWS], ts[at:at + OUT_ROWS]
            carried = {c: part[c].astype(object).where(part[c].notna(), None).map(lambda v: None if v is None else str(v)).tolist() for c in self.context}
            yield self._row(
                key, "packet", len(part), arrival_seq=part["arrival_seq"].tolist(), reason=list(reason), ts_us=[None if t == NONE else int(t) for t in us],
                at_ms=arrived[at:at + OUT_ROWS].tolist(), **carried,
            ).assign(tag=["quarantined" if w is not None else "accepted" for w in reason])
        yield self._health(key, totals, "health", totals[-1], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            return
        totals, at = self.totals.get(), expiredTimerInfo.getExpiryTimeInMs()
        if at >= totals[-1] + self.ttl_ms:  # silent for the time-to-live: the state goes
            self.last.clear()
            self.totals.clear()
            return
        yield self._health(key, totals, "stall", at, True)

    def close(self) -> None:
        pass


def output_schema(context: Sequence[str]) -> T.StructType:
    fields = [("asset_id", T.LongType()), ("tag", T.StringType()), ("arrival_seq", T.LongType()), ("reason", T.StringType()), ("ts_us", T.LongType()),
              ("received", T.LongType()), ("failed", T.LongType()), ("loss_pct", T.DoubleType()), ("latest_ms", T.DoubleType()),
              ("average_ms", T.DoubleType()), ("buffer_pct", T.DoubleType()), ("status", T.StringType()), ("at_ms", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField(c, T.StringType()) for c in context])


def prepared(packets: DataFrame, *, arrived: str, latency: str, context: Sequence[str] = ()) -> DataFrame:
    """Stateless half: decode and check each packet on the map side; typed columns and context go on."""
    checked = check_fields(decode_packets(packets))
    return checked.select(
        "asset_id", "arrival_seq", F.unix_micros("ts").alias("ts_us"), *[F.coalesce(F.col(f), F.lit(False)).alias(f[1:]) for f in FLAGS],
        F.col(latency).cast("double").alias("latency_ms"), F.col(arrived).alias("arrived"), F.unix_millis(arrived).alias("arrived_ms"), *context,
    )


def verdict_stream(packets: DataFrame, *, arrived: str, latency: str, context: Sequence[str] = (), ttl_ms: int = STATE_TTL_MS) -> DataFrame:
    """Tagged rows of every packet, health after every batch and stalls; ``arrived`` is the event-time column."""
    ready = prepared(packets, arrived=arrived, latency=latency, context=context).withWatermark("arrived", "0 seconds")
    return ready.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=PacketVerdict(context, ttl_ms), outputStructType=output_schema(context), outputMode="Append", timeMode="EventTime",
    )


def replay_cuts(df: DataFrame, order: str, pieces: int, rows: int = TRIGGER_ROWS) -> list[int]:
    """Where each replay file begins: ``pieces`` equal ranges of ``order``, or, beyond ``rows`` rows, as many ranges of about
    equal row counts as keep each within ``rows`` (rows of one ``order`` value stay together)."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(order)).first()
    if low is None:
        return []
    if n <= rows:
        step = (high - low) // pieces + 1
        return [low + i * step for i in range(pieces)]
    pieces = max(pieces, -(-5 * n // (4 * rows)))
    inner = df.filter(F.col(order).isNotNull()).approxQuantile(order, [i / pieces for i in range(1, pieces)], 0.1 / pieces)
    return sorted({low, *(int(q) for q in inner)})


def write_in_order(df: DataFrame, folder: str, order: str, pieces: int, *, clock: str | None = None, rows: int = TRIGGER_ROWS) -> None:
    """Replay files: ranges of ``order``, each written after the one before, so a file source reads them in order.

    A file holds at most about ``rows`` rows, so triggers grow in number, not in size. Rows without an order come last.
    ``clock`` is the arrival time: no packet arrives before the files ahead of it, so one stamped earlier is set to a
    millisecond after their latest. Without that the watermark would drop it as late and it would get no verdict.
    """
    cuts = replay_cuts(df, order, pieces, rows)
    if not cuts:
        df.repartition(1).write.parquet(folder)
        return
    latest = {}
    if clock is not None:
        piece = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order)))
        latest = {r["piece"]: r["at"] for r in df.groupBy(piece.alias("piece")).agg(F.max(F.unix_millis(clock)).alias("at")).collect()}
    ahead = None
    for i, cut in enumerate(cuts):
        last = i + 1 == len(cuts)
        part = df.filter((F.col(order) >= cut) | F.col(order).isNull() if last else (F.col(order) >= cut) & (F.col(order) < cuts[i + 1]))
        if ahead is not None:
            part = part.withColumn(clock, F.when(F.unix_millis(clock) <= ahead, F.timestamp_millis(F.lit(ahead + 1))).otherwise(F.col(clock)))
        part.repartition(1).write.option("parquet.block.size", GROUP_BYTES).mode("append").parquet(folder)  # one file, so one trigger
        at = latest.get(i + 1)
        if at is not None:
            ahead = at if ahead is None else max(at, ahead + 1)


def run_triggers(spark: SparkSession, stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Run every available trigger, then read the sink."""
    q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(stream.schema).parquet(sink)
