"""A count-min sketch with counters that stop at two, built per task and merged block by block.

A key's estimate is the least of its DEPTH counters, so it is never below its true count: a key that occurs twice
is always estimated repeated. Size is fixed by ``bits`` (DEPTH * 2**bits counters; 2**bits / 2 bytes are broadcast
for DEPTH 4), whatever the input: a sketch too small for its input lets more keys pass and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furnacelens.llm.words import U, salted

DEPTH = 4
BITS = 26
BLOCK_BITS = 21  # counters in a block that is merged on its own


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(salted(keys, 101 + d) >> U(64 - bits)).astype(np.int64) for d in range(DEPTH)]


class Partial:
    """One task's counters, as two bitmaps per row: counted once at least, twice at least."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, keys: np.ndarray) -> None:
        for d, at in enumerate(_places(keys, self.bits)):
            at.sort()
            fresh = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
            again = at[~fresh]
            at = at[fresh]
            byte, bit = at >> 3, (np.uint8(1) << (at & 7).astype(np.uint8))
            seen = (self.once[d][byte] & bit) != 0
            np.bitwise_or.at(self.twice[d], byte[seen], bit[seen])
            np.bitwise_or.at(self.twice[d], again >> 3, np.uint8(1) << (again & 7).astype(np.uint8))
            np.bitwise_or.at(self.once[d], byte, bit)

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = 1 << (min(BLOCK_BITS, self.bits) - 3)
        import zstandard  # used only where sketches are packed, so the package imports without it

        pack = zstandard.ZstdCompressor(level=1)
        for d in range(DEPTH):
            for b in range(self.once.shape[1] // size):
                one = self.once[d, b * size : (b + 1) * size]
                if one.any():
                    two = self.twice[d, b * size : (b + 1) * size]
                    yield d << 20 | b, pack.compress(one.tobytes()), pack.compress(two.tobytes())


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block: folds the partial bitmaps of a block one after the other."""
    import zstandard

    open_, at = zstandard.ZstdDecompressor(), None
    once = twice = None

    def out():
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "bits": pa.array([zstandard.compress(twice.tobytes(), 1)], pa.binary())})

    for b in batches:
        for block, o, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            o, t = (np.frombuffer(open_.decompress(x.as_py()), np.uint8) for x in (o, t))
            if block != at:
                if at is not None:
                    yield out()
                at, once, twice = block, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if at is not None:
        yield out()


def build(source: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int = BITS, tasks: int | None = None):
    """Sketch of all keys of ``source``; returns a broadcast of the repeated bitmaps.

    The broadcast has a fixed bound: DEPTH * 2**bits / 8 bytes (32 MB by default). Tasks are few and large, as each
    of them sends a sketch.
    """
    import zstandard

    spark = source.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism

    def counted(batches):
        part = Partial(bits)
        for keys in keys_of(batches):
            part.add(keys)
        for block, o, t in part.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "once": pa.array([o], pa.binary()), "twice": pa.array([t], pa.binary())})

    n = min(tasks, DEPTH << max(0, bits - BLOCK_BITS))
    partial = source.coalesce(tasks).mapInArrow(counted, "block long, once binary, twice binary")
    merged = partial.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_merged, "block long, bits binary")
    full = np.zeros((DEPTH, 1 << (bits - 3)), np.uint8)
    size = 1 << (min(BLOCK_BITS, bits) - 3)
    for r in merged.collect():  # bounded by DEPTH * 2**bits / 8 bytes together
        d, b = r.block >> 20, r.block & 0xFFFFF
        full[d, b * size : (b + 1) * size] = np.frombuffer(zstandard.decompress(bytes(r.bits)), np.uint8)
    return spark.sparkContext.broadcast(full)


def repeated(twice: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's estimate is two or more."""
    bits = twice.shape[1].bit_length() + 2
    out = np.ones(len(keys), bool)
    for d, at in enumerate(_places(keys, bits)):
        out &= (twice[d][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
