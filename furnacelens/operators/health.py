"""Stream health: counts, loss, buffer use, latency averages, status, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.constants import BUFFER_ROWS, EMA_ALPHA, LATENCY_LIMITS_MS, LOSS_LIMITS_PCT, STALL_SECONDS
from furnacelens.operators.ordered import SLICE_ROWS, slice_keys


def packet_counts(
    df: DataFrame, keys: list[str], *, ts_text: str, seq: str, valid: str, arrival: str | None = None
) -> DataFrame:
    """Received, failed, loss rate and the timestamp of the last packet to arrive."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets_received"),
        F.count_if(~F.col(valid)).alias("packets_failed_validation"),
        F.max_by(ts_text, seq).alias("last_packet_timestamp"),
        F.count_if(F.col(valid)).alias("packets_accepted"),
        *([F.max(arrival).alias("_last_arrival")] if arrival else []),
    )
    return agg.withColumn("packet_loss_rate_pct", loss_rate("packets_failed_validation", "packets_received"))


def loss_rate(failed: str, received: str) -> Column:
    return F.when(
        F.col(received) > 0, F.round(F.col(failed) / F.col(received) * F.lit(100.0), 2)
    ).otherwise(F.lit(0.0))


def buffer_utilisation(accepted: Column, capacity: int = BUFFER_ROWS) -> Column:
    size = F.least(accepted, F.lit(max(1, capacity)))
    return F.round(size / F.lit(float(max(1, capacity))) * F.lit(100.0), 2)


def latency_ema(
    df: DataFrame, keys: list[str], seq: str, latency: str, *, alpha: float = EMA_ALPHA, width: int = 65_536,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Latest latency and its exponential average per group, seeded at 0.

    The average is a sum with weight alpha * (1 - alpha)^(rows after this one), so slices are summed
    independently and scaled by the number of rows behind them; no group is folded in one task.
    """
    sliced = slice_keys(df.select(*keys, seq, latency), keys, F.col(seq), width=width, slice_rows=slice_rows)
    part = W.partitionBy(*sliced.keys)
    after = F.row_number().over(part.orderBy(F.desc(seq))) - F.lit(1)
    weighted = sliced.df.withColumn("_after", after)
    term = F.lit(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_after")) * F.col(latency)
    per_slice = weighted.groupBy(*sliced.keys).agg(
        F.sum(term).alias("_e"), F.count(F.lit(1)).alias("_n"), F.max(seq).alias("_last"),
        F.max_by(latency, seq).alias("_latest"),
    )
    behind = W.partitionBy(*keys).orderBy(F.desc("_last")).rowsBetween(W.unboundedPreceding, -1)
    scaled = per_slice.withColumn("_behind", F.coalesce(F.sum("_n").over(behind), F.lit(0)))
    return scaled.groupBy(*keys).agg(
        F.max_by("_latest", "_last").alias("latest_ms"),
        F.sum(F.col("_e") * F.pow(F.lit(1.0 - alpha), F.col("_behind"))).alias("average_ms"),
    )


def status(latency: Column, loss_pct: Column, idle_seconds: Column | None = None) -> Column:
    """A stall outranks the latency and loss limits."""
    out = F.when(
        (latency >= LATENCY_LIMITS_MS["critical"]) | (loss_pct >= LOSS_LIMITS_PCT["critical"]), "CRITICAL"
    ).when((latency >= LATENCY_LIMITS_MS["warning"]) | (loss_pct >= LOSS_LIMITS_PCT["warning"]), "WARNING").otherwise("HEALTHY")
    if idle_seconds is None:
        return out
    return F.when(F.coalesce(idle_seconds, F.lit(0.0)) > STALL_SECONDS, "DEGRADED").otherwise(out)


def snapshot(
    df: DataFrame, keys: list[str], *, ts: str, ts_text: str, seq: str, valid: str, latency: str,
    as_of: Column | None = None, capacity: int = BUFFER_ROWS, slice_rows: int = SLICE_ROWS, width: int = 65_536,
) -> DataFrame:
    """The full metrics row per group. ``as_of`` replaces the wall clock."""
    counts = packet_counts(df, keys, ts_text=ts_text, seq=seq, valid=valid, arrival=ts)
    ema = latency_ema(df, keys, seq, latency, slice_rows=slice_rows, width=width)
    out = counts.join(ema, keys)
    idle = (
        (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("_last_arrival").cast("timestamp"))) / F.lit(1e6)
        if as_of is not None else F.lit(0.0)
    )
    exact_loss = F.col("packets_failed_validation") / F.col("packets_received") * F.lit(100.0)
    return out.withColumns({
        "time_since_last_packet_seconds": F.round(idle, 3),
        "buffer_size": F.least(F.col("packets_accepted"), F.lit(capacity)).cast("long"),
        "buffer_capacity": F.lit(capacity),
        "buffer_utilization_pct": buffer_utilisation(F.col("packets_accepted"), capacity),
        "status": status(F.col("latest_ms"), exact_loss, idle),
    }).drop("_last_arrival", "packets_accepted")


def progress_summary(df: DataFrame, position: str, valid: str, latency: str, *, every: int = 100) -> DataFrame:
    """One row per block of ``every`` packets, blocks counted by arrival position (1-based)."""
    block = F.floor((F.col(position) - F.lit(1)) / F.lit(every)).cast("long")
    return df.groupBy(block.alias("block")).agg(
        F.max(position).alias("processed"),
        F.count_if(~F.col(valid)).alias("failed"),
        F.avg(latency).alias("mean_latency_ms"),
    )


def final_report(df: DataFrame, valid: str, total: str, inference: str) -> DataFrame:
    received, failed = F.count(F.lit(1)), F.count_if(~F.col(valid))
    agg = df.agg(
        received.alias("total_packets"), failed.alias("failed_packets"), F.avg(total).alias("avg_total_ms"),
        F.avg(inference).alias("avg_inference_ms"),
    )
    return agg.withColumns({
        "packet_loss_rate_pct": loss_rate("failed_packets", "total_packets"),
        "avg_engine_ms": F.col("avg_total_ms") - F.col("avg_inference_ms"),
    })
