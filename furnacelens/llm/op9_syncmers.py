"""Document fingerprints from closed syncmers.

A ``K``-character window is a closed syncmer when its smallest ``S``-character gram (by hash) is its first or its last:
a choice that no text outside the window affects, so equal passages give equal anchors wherever they stand. All anchors
of the whole text are found; the fingerprint keeps the ``KEEP`` of least hash with their places, which samples the text
evenly whatever its length. Likeness is the share of the least ``KEEP`` anchors of both fingerprints together that both
hold at one common displacement (positional matching; the displacement most anchors agree on).

The edited text replaces the last floor(n / 2) code points of a document by the first as many of the next one in
descending order of ids (after the last: the first). Documents are dealt into ranges of ids; the document after a range
is sent along with it, so every text is read, shuffled and fingerprinted once.

Defined cases. Null text is empty. Texts shorter than ``K``, or without a syncmer, have one anchor: the whole text.
Empty texts have the empty fingerprint; two of them are alike (1), else 0. Rows with one id keep an unstated order,
null ids come last. Other columns are ignored. One document is its own next.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.words import BASE, U, mix, slices

K, S, KEEP = 16, 8, 64
ROWS_PER_RANGE = 4096
MOST_RANGES = 8192  # beyond it ranges grow; a range is sorted by Spark and read as a stream


def _grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the S-grams and K-grams, by doubling."""
    h, size, out = mix(x.astype(U)), 1, {}
    while size < K:
        h = h[:-size] * U(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
        out[size] = h
    return mix(out[S]), mix(out[K])


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the closed syncmers of code points, the first of each hash."""
    if len(x) >= K:
        s, k = _grams(x)
        span = K - S + 1  # S-grams in a window
        low, width = s, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        n = len(k)
        at = np.flatnonzero((s[:n] == low) | (s[span - 1 : span - 1 + n] == low))
        if len(at):
            return k[at], at
    if not len(x):
        return np.zeros(0, U), np.zeros(0, np.int64)
    up = np.full(len(x), BASE, U).cumprod()
    return mix(np.array([(mix(x.astype(U)) * up).sum(dtype=U)], U)), np.zeros(1, np.int64)


def fingerprint(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The KEEP anchors of least 32-bit hash, ascending, and their places."""
    h, at = anchors(x)
    h = h >> U(32)
    if len(h) > 4 * KEEP:  # all but the least need no sorting
        bound = np.partition(h, 4 * KEEP)[4 * KEEP]
        near = h <= bound
        if len(np.unique(h[near])) >= KEEP:
            h, at = h[near], at[near]
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    return h[first][:KEEP].astype(np.uint32), at[first][:KEEP].astype(np.uint32)


def text_of(f: tuple[np.ndarray, np.ndarray]) -> str:
    """Hexadecimal: 8 digits of hash and 8 of place for each anchor."""
    return np.stack(f, 1).astype(">u4").tobytes().hex()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    least = np.union1d(a[0], b[0])[:KEEP]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = a[0][i] <= least[-1]
    if not both.any():
        return 0.0
    shift = a[1][i][both].astype(np.int64) - b[1][j][both]
    return float(np.unique(shift, return_counts=True)[1].max() / len(least))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _cuts(docs: DataFrame, rows: int) -> list[int]:
    """Cuts between ranges of ids."""
    ids = docs.select("doc").filter("doc IS NOT NULL")
    n = min(MOST_RANGES, max(1, ids.count() // rows))
    cuts = sorted(set(ids.approxQuantile("doc", [i / n for i in range(1, n)], min(0.01, 0.1 / n)))) if n > 1 else []
    return [int(c) for c in cuts]


def in_ranges(docs: DataFrame, id_col: str, text_col: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(range, doc, text), and (range, head): the greatest id of each range that has rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    cuts = _cuts(docs, rows)
    # ranges are numbered downwards, so that the next document is in the same or the next range; null ids come last
    above = F.expr(f"cast({len(cuts)} - size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < doc)) as long)") if cuts else F.lit(0).cast("long")
    placed = docs.select(F.when(F.col("doc").isNull(), len(cuts) + 1).otherwise(above).alias("range"), "doc", "text")
    heads = placed.groupBy("range").agg(F.max("doc").alias("head"))
    return placed, heads


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS_PER_RANGE) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    placed, heads = in_ranges(docs, id_col, text_col, rows)
    found = sorted((r.range, r.head) for r in heads.collect())  # a row per range
    before = {r: found[i - 1][0] for i, (r, _) in enumerate(found)}
    lead = F.create_map(*[F.lit(x) for p in found for x in (p[0], before[p[0]])]) if found else None
    heads_of = [F.struct(F.lit(r).cast("long").alias("r"), F.lit(h).cast("long").alias("h")) for r, h in found]
    if not found:
        copies = placed.withColumn("extra", F.lit(0))
    else:
        # exactly one row of each range is its head, also where an id occurs twice
        head = F.array_contains(F.array(*heads_of), F.struct(F.col("range").alias("r"), F.col("doc").alias("h"))) | (F.col("doc").isNull() & F.lit(any(h is None for _, h in found)))
        copies = placed.withColumn("_head", head).select(
            F.explode(F.when(F.col("_head"), F.array(F.struct("range", F.lit(0).alias("extra")), F.struct(lead[F.col("range")].alias("range"), F.lit(1).alias("extra"))))
                      .otherwise(F.array(F.struct("range", F.lit(0).alias("extra"))))).alias("x"), "doc", "text"
        ).select("x.range", "x.extra", "doc", "text")

    def of(batches):
        last = None  # the document whose next is still to come: (range, doc, text, fingerprint)
        out: list[tuple] = []

        def flush():
            nonlocal out
            cols = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f"c{i}" for i in range(7)])
            out = []
            return b

        for b in slices(batches, "text"):
            for place, extra, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                if last is not None and extra and last[0] == "closed":
                    continue
                x = _codes(text or "")
                f = fingerprint(x)
                if last is not None and last[0] == place:
                    _, own, y, g = last
                    half = len(y) // 2
                    edited = np.concatenate([y[: len(y) - half], x[:half]])
                    e = fingerprint(edited)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest()
                    out.append((own, len(y), sha, text_of(g), text_of(e), likeness(g, e), likeness(g, f)))
                last = ("closed",) if extra else (place, doc, x, f)
            yield flush()

    n = max(1, len(found))
    dealt = copies.repartitionByRange(n, "range").sortWithinPartitions("range", "extra", F.desc_nulls_last("doc"))
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("range", "extra", "doc", "text").mapInArrow(of, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
