"""Order check and rolling statistics on a stream.

Per asset the state is the last accepted timestamp and the last rows of the window: a bounded amount
whatever the length of the stream. Stateless checks and all index arithmetic stay ordinary columns
before and after the stateful step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from furnacelens.constants import ROLLING_WINDOWS
from furnacelens.operators.rolling import GRADIENT_GUARD, STATS

NONE = np.iinfo(np.int64).min
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_packets(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Packets from a folder of parquet files, oldest file first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


def _over_frames(values: np.ndarray, at: np.ndarray, w: int, centre: np.ndarray | None = None) -> np.ndarray:
    """Sum over the last ``w`` rows up to each row of ``at``, oldest first; squared distances where a ``centre`` is given."""
    total = np.zeros((len(at), values.shape[1]))
    for back in range(w - 1, -1, -1):
        inside = at >= back
        x = values[at[inside] - back]
        total[inside] += x if centre is None else (x - centre[inside]) ** 2
    return total


class OrderedRolling(StatefulProcessor):
    """Rejects late packets, then appends window statistics of the accepted ones."""

    def __init__(self, columns: Sequence[str], windows: Sequence[int], stats: Sequence[str]):
        self.columns, self.windows, self.stats = list(columns), list(windows), list(stats)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_ts", T.StructType([T.StructField("us", T.LongType())]))
        self.rows = handle.getListState(
            "window", T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch is bounded by the source option; its chunks must be ordered together
        batch = pd.concat(list(rows)).sort_values("arrival_seq", kind="stable")
        last = self.last.get()[0] if self.last.exists() else None
        sound = batch["sound"].to_numpy(dtype=bool)
        us = np.where(sound, batch["ts_us"].fillna(NONE).astype(np.int64), NONE)
        # a packet refused for its order never raises the latest timestamp, so the running maximum over sound ones decides
        running = np.maximum.accumulate(np.r_[NONE if last is None else last, us])
        accepted = us > running[:-1]
        kept = batch[accepted]
        if kept.empty:
            return
        cap = max(self.windows)
        history = [list(r[0]) for r in self.rows.get()] if self.rows.exists() else []
        values = np.vstack([np.asarray(history, dtype=float).reshape(-1, len(self.columns)), kept[self.columns].to_numpy(dtype=float)])
        self.last.update((int(running[-1]),))
        self.rows.put([(row.tolist(),) for row in values[-cap:]])
        yield self._block(kept, values, len(history))

    def _block(self, kept: pd.DataFrame, values: np.ndarray, offset: int) -> pd.DataFrame:
        made: dict[str, object] = {c: kept[c].to_numpy() for c in ("asset_id", "arrival_seq", "ts_us")}
        for w in self.windows:
            at = np.arange(offset, len(values))
            n = np.minimum(at + 1, w).astype(float)
            mean = _over_frames(values, at, w) / n[:, None]
            var = _over_frames(values, at, w, mean) / n[:, None]
            first = values[np.maximum(at + 1 - w, 0)]
            now = values[offset:]
            grad = np.where(n[:, None] > 1, (now - first) / n[:, None], 0.0)
            roc = np.where(n[:, None] > 1, (now - first) / (first + GRADIENT_GUARD), 0.0)
            blocks = {"avg": mean, "var": var, "std": np.sqrt(var), "grad": grad, "roc": roc}
            for s in self.stats:
                for j, c in enumerate(self.columns):
                    made[f"{c}_roll_{s}_{w}"] = blocks[s][:, j]
        for j, c in enumerate(self.columns):
            made[c] = values[offset:, j]
        return pd.DataFrame(made)

    def close(self) -> None:
        pass


def output_schema(columns: Sequence[str], windows: Sequence[int], stats: Sequence[str]) -> T.StructType:
    fields = [T.StructField(n, T.LongType()) for n in ("asset_id", "arrival_seq", "ts_us")]
    fields += [T.StructField(f"{c}_roll_{s}_{w}", T.DoubleType()) for w in windows for s in stats for c in columns]
    fields += [T.StructField(c, T.DoubleType()) for c in columns]
    return T.StructType(fields)


def ordered_rolling(
    stream: DataFrame, columns: Sequence[str], windows: Sequence[int] = ROLLING_WINDOWS, stats: Sequence[str] = STATS
) -> DataFrame:
    """``stream`` carries asset_id, arrival_seq, ts_us, sound and the columns; accepted rows come out."""
    needed = stream.select("asset_id", "arrival_seq", "ts_us", "sound", *columns)
    return needed.groupBy("asset_id").transformWithStateInPandas(
        statefulProcessor=OrderedRolling(columns, windows, stats),
        outputStructType=output_schema(columns, windows, stats),
        outputMode="Append",
        timeMode="None",
    )


def checked_stream(decoded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stateless half of validation and normalisation, ready for ``ordered_rolling``."""
    from furnacelens.operators.normalize import normalised_fields
    from furnacelens.operators.validate import check_fields

    checked = check_fields(decoded)
    fields = normalised_fields()
    sound = F.col("ts").isNotNull() & F.col("_readable") & F.col("_complete") & F.col("_numeric")
    return checked.select(
        "asset_id", "arrival_seq", F.unix_micros(F.date_trunc("second", "ts")).alias("ts_us"),
        F.coalesce(sound, F.lit(False)).alias("sound"), *[fields[c].alias(c) for c in columns],
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
