"""Which keys may occur ``least`` times or more: counts of 32-bit hash buckets, range by range.

Every task sorts the buckets of its keys and sends, per range of 2**22 buckets, their low 16 bits and how many lie in
each 2**16 of them: two bytes a key instead of a row. A bucket occurring more than ``least`` times in a flush is sent
``least`` times, which is enough. Keys of one bucket only add up, so no frequent key is missed; some rare ones pass.
The frequent buckets are broadcast as a bitmap of 2**BITS bits (32 MB), whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furnacelens.llm.words import U

BITS = 28  # of the broadcast bitmap
RANGE_BITS = 22  # buckets of a range, counted at once
FLUSH = 1 << 22  # keys a task holds
FIELDS = "range long, sizes binary, lows binary"


def _packed(buckets: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    """A row per range of the buckets: numbers of entries per 2**16 buckets, low 16 bits of the entries."""
    b = np.sort(buckets)
    if len(b) > least:
        b = b[np.r_[np.ones(least, bool), b[least:] != b[:-least]]]
    ranges = np.arange((1 << 32 - RANGE_BITS) + 1, dtype=np.int64) << RANGE_BITS
    at = np.searchsorted(b, ranges[:-1].astype(np.uint32)).tolist() + [len(b)]
    sizes = np.bincount(b >> np.uint32(16), minlength=1 << 16).astype("<u4").reshape(len(ranges) - 1, -1)
    lows = b.astype("<u2").tobytes()
    used = [k for k in range(len(ranges) - 1) if at[k] < at[k + 1]]
    if used:
        cells = [pa.array(used, pa.int64()), pa.array([sizes[k].tobytes() for k in used], pa.binary()), pa.array([lows[2 * at[k] : 2 * at[k + 1]] for k in used], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["range", "sizes", "lows"])


def _unpacked(sizes: bytes, lows: bytes) -> np.ndarray:
    """The entries of a row, as places in their range."""
    n = np.frombuffer(sizes, "<u4")
    return np.repeat(np.arange(len(n), dtype=np.uint32) << np.uint32(16), n) + np.frombuffer(lows, "<u2")


def frequent(source: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], least: int):
    """A broadcast bitmap of the buckets in which ``least`` keys or more fall; ``keys_of`` yields 64-bit hashes."""
    import zstandard

    spark = source.sparkSession
    per_range = 1 << BITS - (32 - RANGE_BITS)  # bits of the bitmap

    def counted(batches):
        held, n = [], 0
        for keys in keys_of(batches):
            held.append((keys >> U(32)).astype(np.uint32))
            n += len(keys)
            if n >= FLUSH:
                yield from _packed(np.concatenate(held), least)
                held, n = [], 0
        if n:
            yield from _packed(np.concatenate(held), least)

    def merged(batches):
        at, held, n, counts = None, [], 0, None

        def fold():
            return np.bincount(np.concatenate(held), minlength=1 << RANGE_BITS).astype(np.int64) + (0 if counts is None else counts)

        def out():
            if counts is None:
                place, c = np.unique(np.concatenate(held), return_counts=True)
                hot = place[c >= least]
            else:
                hot = np.flatnonzero(fold() >= least)
            bits = np.zeros(per_range, bool)
            bits[hot >> (32 - BITS)] = True
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zstandard.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["range", "bits"])

        for b in batches:
            for k, sizes, lows in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != at:
                    if at is not None:
                        yield out()
                    at, held, n, counts = k, [], 0, None
                x = _unpacked(sizes.as_py(), lows.as_py())
                held.append(x)
                n += len(x)
                if n >= 2 * FLUSH:
                    counts = fold()
                    held, n = [np.zeros(0, np.uint32)], 0
        if at is not None:
            yield out()

    rows = source.mapInArrow(counted, FIELDS)
    found = rows.repartition("range").sortWithinPartitions("range").mapInArrow(merged, "range long, bits binary")
    full = np.zeros(1 << BITS - 3, np.uint8)
    size = per_range >> 3
    for r in found.collect():  # bounded by the bitmap together
        full[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(zstandard.decompress(bytes(r.bits)), np.uint8)
    return spark.sparkContext.broadcast(full)


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bucket of each key is flagged."""
    at = (keys >> U(64 - BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
