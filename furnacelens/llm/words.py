"""Word and window hashes over Arrow text columns: numpy kernels shared by the operators.

Texts are never cut: a batch is handled in row slices of half a MB, one long text is a slice of its own.
Hashes are 64-bit polynomial sums over random byte values, mixed afterwards; equal words give equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 19

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: everything but ASCII white space
NON_SPACE = ~ASCII_SPACE
#: digits, lower-case a-z and all bytes of non-ASCII characters
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


BYTE_VALUES = salted(np.arange(256, dtype=U), 1)
BASE = 0xD6E8FEB86659FD93


@cache
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p, dtype=U))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    bits = max(16, int(n).bit_length())
    if bits > 23:  # of one very long text: not kept
        return _powers.__wrapped__(base, bits)
    return _powers(base, bits)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the row offsets into them; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with about ``most`` bytes of ``column``; at least a row each."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield b.slice(i, j - i)


@dataclass
class Words:
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of rows, in bytes
    starts: np.ndarray  # of words, in bytes
    ends: np.ndarray
    first: np.ndarray  # of each row, its first word; one more at the end
    row: np.ndarray  # of each word
    hash: np.ndarray  # of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(column: pa.Array, inside: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of the bytes flagged in ``inside`` (after ``fold``), row by row, with their hashes."""
    data, off = texts(column)
    n = len(data)
    flag = (inside[fold])[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = flag[:-1], flag[1:]
        before[off[:-1][off[:-1] < n]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(flag & ~before), np.flatnonzero(flag & ~after) + 1
    first = np.searchsorted(starts, off)
    up, down = powers(BASE, n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(BYTE_VALUES[fold][data] * up[:n], out=c[1:])
    h = mix((c[ends] - c[starts]) * down[starts])
    return Words(data, off, starts, ends, first, np.repeat(np.arange(len(off) - 1), np.diff(first)), h)


def windows(w: Words, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k words from each word on, whether they lie in one row); k words less one at the end have none."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, U), np.zeros(0, bool)
    h = salted(w.hash, salt) if salt else w.hash
    up, down = powers(BASE, n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=c[1:])
    m = n - k + 1
    return mix((c[k:] - c[:m]) * down[:m]), w.row[:m] == w.row[k - 1 :]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def distinct_by(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Indices of the first of each (row, value), sorted by row as they stand."""
    _, i = np.unique(mix(values ^ mix(row.astype(U) + U(77))), return_index=True)
    return np.sort(i)
