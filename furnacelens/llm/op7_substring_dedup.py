"""Substring dedup by a count-min prefilter.

A window is ``width`` consecutive words (runs of non-white-space) of one document. Pass one counts every window through
its smallest ``ANCHOR``-word gram in merged partition sketches: all occurrences of a window hold that gram, so its
count is never below the window's. Pass two groups exactly (96-bit hashes) only the windows estimated repeated, finds
the smallest document of each, and a word is removed where a window covering it also starts in a smaller document.

Defined cases. Null or empty text, or fewer words than a window: nothing is removed. Rows with one id are one document.
A null id is no document to be smaller than another, and nothing of it is removed. Other columns are ignored.
Skew: (window, document) rows are distinct and combine before the shuffle; the join back may be split by AQE.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm import sketch
from furnacelens.llm.words import NON_SPACE, U, Words, distinct_by, signed, slices, split, windows

ANCHOR = 9


def anchors(w: Words, width: int) -> np.ndarray:
    """Of each window, the smallest hash among its grams."""
    k = min(ANCHOR, width)
    g, _ = windows(w, k, salt=3)
    m = len(w.hash) - width + 1
    out = g[:m].copy()
    for j in range(1, width - k + 1):
        np.minimum(out, g[j : j + m], out=out)
    return out


def _usable(batch: pa.RecordBatch, width: int):
    w = split(batch.column(1), NON_SPACE)
    h, ok = windows(w, width)
    ok &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)[w.row[: len(ok)]]
    return w, h, np.flatnonzero(ok)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> DataFrame:
    """(h, g, doc): each window hash estimated repeated, once per document holding it."""
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def keys(batches):
        for b in slices(batches, "text"):
            w, h, ok = _usable(b, width)
            if len(ok):
                a, row = anchors(w, width)[ok], w.row[ok]
                moved = np.r_[True, (a[1:] != a[:-1]) | (row[1:] != row[:-1])]
                a, row = a[moved], row[moved]
                yield a[distinct_by(a, row)]

    seen = sketch.build(source, keys, bits)

    def rows(batches):
        for b in slices(batches, "text"):
            w, h, ok = _usable(b, width)
            if not len(ok):
                continue
            ok = ok[sketch.repeated(seen.value, anchors(w, width)[ok])]
            ok = ok[distinct_by(h[ok], w.row[ok])]
            g = (windows(w, width, salt=5)[0][ok] >> U(32)).astype(np.int64).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[ok])), pa.array(g), b.column(0).take(pa.array(w.row[ok]))], ["h", "g", "doc"])

    return source.mapInArrow(rows, "h long, g int, doc long")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, bits: int = sketch.BITS) -> DataFrame:
    """(id, kept text, n_words, n_removed) of every row."""
    found = repeated_windows(docs, id_col, text_col, width, bits)
    first = found.groupBy("h", "g").agg(F.min("doc").alias("least"))
    late = found.join(first, ["h", "g"]).filter("doc > least").groupBy("doc").agg(F.collect_list("h").alias("hits"))
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def cut(batches):
        for b in slices(batches, "text"):
            w = split(b.column(1), NON_SPACE)
            h, ok = windows(w, width)
            hits = b.column(2)
            data, kept, n_removed = w.data.tobytes(), [], []
            for i in range(b.num_rows):
                words = data[w.offsets[i] : w.offsets[i + 1]].split()
                lo, hi = w.first[i], w.first[i + 1]
                gone = np.zeros(hi - lo + 1, np.int64)
                if hits[i].is_valid and hi - lo >= width:
                    at = np.flatnonzero(np.isin(signed(h[lo : hi - width + 1]), hits[i].values.to_numpy()))
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + width, -1)
                keep = np.cumsum(gone[:-1]) == 0
                n_removed.append(int((~keep).sum()))
                kept.append(b" ".join(compress(words, keep.tolist()) if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(w.counts, pa.int64()), pa.array(n_removed, pa.int64())],
                [id_col, "kept", "n_words", "n_removed"],
            )

    kind = dict(docs.dtypes)[id_col]
    return base.join(late, "doc", "left").select("doc", "text", "hits").mapInArrow(cut, f"`{id_col}` {kind}, kept string, n_words long, n_removed long")


def digest(frame: DataFrame) -> DataFrame:
    return frame.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM late, (SELECT unnest(range(0, 13)) AS j)),
each AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
