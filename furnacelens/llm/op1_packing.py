"""Packing by concatenating and cutting: two-pass prefix sums, then fixed windows.

Pass one encodes every whole text once, appends the end id and writes the ids with their task's number and the place in
the task. Task totals give global offsets; pass two cuts the one long stream at multiples of ``length`` and returns a
boundary record per piece. All sequences are full but the last; ids move through no shuffle.

Defined cases. Null or empty text: the end id alone. Repeated rows and ids: a document per row. Null ids stay null.
No documents: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.offsets import prefix_sums
from furnacelens.llm.tokens import DROPPED, encode, vocabulary
from furnacelens.llm.words import slices
from furnacelens.session import materialise

SLICE = 1 << 20


def encode_documents(docs: DataFrame, id_col: str, text_col: str, path: str, blank: str, end_id: int) -> DataFrame:
    """(part, doc, at, n, ids): ids little-endian with ``width`` bytes each, ``at`` ids of the same task before them."""
    def of(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text", SLICE):
            e = encode(b.column(1), path, blank)
            n = np.diff(e.first) + 1
            ids = np.insert(e.ids, e.first[1:], end_id)
            ends = np.cumsum(n)
            raw, width = ids.tobytes(), ids.itemsize
            cells = [raw[(j - k) * width : j * width] for j, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part)), b.column(0), pa.array(at + ends - n), pa.array(n), pa.array(np.full(len(n), width, np.int32)), pa.array(cells, pa.binary())],
                ["part", "doc", "at", "n", "width", "ids"],
            )
            at += int(ends[-1])

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return source.mapInArrow(of, f"part long, doc {dict(docs.dtypes)[id_col]}, at long, n long, width int, ids binary")


def pack(docs: DataFrame, path: str, blank: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    ``ids`` are little-endian unsigned 32-bit integers.
    """
    encoded = materialise(encode_documents(docs, id_col, text_col, path, blank, end_id), "encoded")
    placed = encoded.join(prefix_sums(encoded, "part", "n"), "part").select("doc", (F.col("at") + F.col("n_before")).alias("at"), "n", "width", "ids")

    def cut(batches):
        for b in slices(batches, "ids", SLICE):
            at, n = b.column(1).to_numpy(), b.column(2).to_numpy()
            row, start, size, crc, body = [], [], [], [], []
            for i, (a, k, width, cell) in enumerate(zip(at.tolist(), n.tolist(), b.column(3).to_pylist(), b.column(4))):
                ids = np.frombuffer(cell.as_buffer(), np.uint16 if width == 2 else np.uint32).astype("<u4")
                s = 0
                while s < k:
                    e = min(k, s + length - (a + s) % length)
                    raw = ids[s:e].tobytes()
                    row.append(i)
                    start.append(s)
                    size.append(e - s)
                    crc.append(zlib.crc32(raw))
                    if with_ids:
                        body.append(raw)
                    s = e
            row, start = np.array(row, np.int64), np.array(start, np.int64)
            place = at[row] + start
            arrays = [b.column(0).take(pa.array(row)), pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(place // length), pa.array(place % length)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(body, pa.binary())] if with_ids else []), [f"c{i}" for i in range(7 + with_ids)])

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, n_tokens, ids, pieces): each packed sequence, padded with zeros; a group has at most ``length`` pieces."""
    one = F.struct("offset", F.col("length").alias("size"), "start", F.col(id_col).alias("doc"), "ids")
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(one)).alias("p"))
    joined = F.expr("aggregate(p, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))")
    return whole.select(
        "sequence_id", "n_tokens", F.rpad(joined, 4 * length, b"\x00").alias("ids"),
        F.expr("transform(p, x -> named_struct('doc', x.doc, 'start', x.start, 'offset', x.offset, 'length', x.size))").alias("pieces"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, vocabulary("word_bpe_49k.json"), DROPPED, end_id=2, with_ids=False)
