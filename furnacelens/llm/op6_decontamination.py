"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are lower-cased runs of letters, digits and non-ASCII characters. A pattern is ``width`` consecutive words of an
item (an item of fewer words is one pattern). Patterns of one length share a shift table over hashed blocks of up to
three words: the cursor of a document jumps by the table's value, at a shift of zero the block's bucket gives the
patterns that end there, and a direct word-by-word comparison confirms an occurrence. The cursors of a slice move
together, one numpy step for all; long documents get several cursors.

The benchmark is read in blocks of at most ``block_bytes`` of text (by hash of the item), each broadcast with the scan
of all documents; the hits of several blocks are merged per document. Documents are never shuffled with their text.

Defined cases. Null or empty text, of either table: no words, no pattern. Rows of one item id are one item, rows of one
document id separate documents (with several blocks: merged). A null item id is left out. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.words import ALNUM, LOWER, U, mix, salted, slices, split

BLOCK_WORDS = 3
TABLE_BITS = 20
CURSOR_WORDS = 4096  # of a document, searched by one cursor


def _block(h: np.ndarray, b: int) -> np.ndarray:
    """Hash of the b words that end at each word from the b-th on."""
    out = salted(h[b - 1 :], 41)
    for j in range(1, b):
        out = mix(out + salted(h[b - 1 - j : len(h) - j], 41 + j))
    return out


class WuManber:
    """Patterns of one length, as word hashes, and the items that hold them."""

    def __init__(self, patterns: np.ndarray, items: list[list[int]]) -> None:
        self.patterns, self.m = patterns, patterns.shape[1]
        self.b = min(BLOCK_WORDS, self.m)
        self.shift = np.full(1 << TABLE_BITS, self.m - self.b + 1, np.int16)
        for j in range(self.m - self.b + 1):  # blocks from the start of the patterns to their end
            h = _block(patterns[:, j : j + self.b].ravel(), self.b)[:: self.b]
            np.minimum.at(self.shift, (h >> U(64 - TABLE_BITS)).astype(np.int64), np.int16(self.m - self.b - j))
        suffix = _block(patterns[:, self.m - self.b :].ravel(), self.b)[:: self.b]
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.order = suffix[order], order
        self.items = [items[i] for i in range(len(items))]

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word at which an occurrence starts, pattern) over rows of words that begin at ``first``."""
        m, none = self.m, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(h) < m:
            return none
        block = _block(h, self.b)
        # cursors: the last word of the first window, and the last word at which a window of the cursor may end
        begin, end = first[:-1], first[1:]
        n = np.maximum(end - begin - m + 1, 0)
        parts = -(-n // CURSOR_WORDS)
        row = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begin[row] + m - 1 + k * CURSOR_WORDS
        stop = np.minimum(at + CURSOR_WORDS, end[row])
        found = []
        while len(at):
            x = block[at - self.b + 1]
            jump = self.shift[(x >> U(64 - TABLE_BITS)).astype(np.int64)].astype(np.int64)
            hit = jump == 0
            if hit.any():
                found.append(at[hit])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none
        at = np.concatenate(found)
        x = block[at - self.b + 1]
        lo, hi = np.searchsorted(self.suffix, x, "left"), np.searchsorted(self.suffix, x, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(at)), n)
        p = self.order[np.repeat(lo, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)]
        start = at[which] - m + 1
        for j in range(m - 1, -1, -1):  # direct comparison, word by word
            same = h[start + j] == self.patterns[p, j]
            start, p = start[same], p[same]
        return start, p


def compile_patterns(items: list[tuple[int, str]], width: int) -> list[WuManber]:
    """One search table per pattern length."""
    w = split(pa.array([t for _, t in items], pa.string()), ALNUM, LOWER)
    by_length: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
    for i, (item, _) in enumerate(items):
        h = w.hash[w.first[i] : w.first[i + 1]]
        m = min(width, len(h))
        for j in range(len(h) - m + 1 if m else 0):
            by_length[m][h[j : j + m].tobytes()].add(item)
    return [WuManber(np.frombuffer(b"".join(p), U).reshape(-1, m), [sorted(v) for v in p.values()]) for m, p in sorted(by_length.items())]


def _scan(docs: DataFrame, tables) -> DataFrame:
    """(doc, n_words, hits [start, end) without overlaps, items) of every row."""
    def of(batches):
        for b in slices(batches, "text"):
            w = split(b.column(1), ALNUM, LOWER)
            mark, items = np.zeros(len(w.hash) + 1, np.int64), [set() for _ in range(b.num_rows)]
            for t in tables.value:
                start, p = t.find(w.hash, w.first)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + t.m, -1)
                for r, q in zip(w.row[start].tolist() if len(start) else [], p.tolist()):
                    items[r].update(t.items[q])
            covered = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
            edge = np.diff(covered.astype(np.int8))
            # a row's edge also ends a stretch
            lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            hits: list[list] = [[] for _ in range(b.num_rows)]
            for i, j in zip(lo.tolist(), hi.tolist()):
                while i < j:
                    r = int(w.row[i])
                    e = min(j, int(w.first[r + 1]))
                    hits[r].append({"s": i - int(w.first[r]), "e": e - int(w.first[r])})
                    i = e
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(w.counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ],
                ["doc", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(of, "doc long, n_words long, hits array<struct<s: long, e: long>>, items array<long>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_words, n_hit, hits, items) of every row; ``hits`` are [s, e) ranges of words, in order."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    scans = []
    for i in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i) if blocks > 1 else items
        tables = compile_patterns([(r.item, r.text) for r in part.collect()], width)  # a block: about block_bytes
        scans.append(_scan(docs, spark.sparkContext.broadcast(tables)))
    if blocks == 1:
        merged = scans[0]
    else:
        every = scans[0]
        for s in scans[1:]:
            every = every.unionByName(s)
        merged = every.groupBy("doc").agg(
            F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
    # ranges of several blocks may overlap: each counts from where the ones before it ended
    n_hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
    return merged.select(F.col("doc").alias(id_col), "n_words", n_hit.alias("n_hit"), "hits", "items")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), contaminated().alias("contaminated"))


SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM words),
items AS (SELECT id, ws, least(13, len(ws)) AS m FROM w WHERE kind = 'i' AND len(ws) > 0),
pat AS (SELECT DISTINCT id AS item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM items)),
docs AS (SELECT id AS doc_id, ws FROM w WHERE kind = 'd'),
win AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM
  (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM pat) WHERE len(ws) >= m)),
occ AS (SELECT doc_id, i, win.m, item_id FROM win JOIN pat USING (m, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
