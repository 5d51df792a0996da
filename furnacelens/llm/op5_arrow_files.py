"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by id and sorted; each task encodes its whole texts and streams them to one Arrow IPC
file: ``input_ids`` and ``mask`` are fixed-size lists (a batch is one flat buffer, so any sequence is a view at a
computed place of the memory-mapped file), ``doc_id`` and ``doc_end`` are boundary records of the documents that end in
the sequence. The last sequence of a file is padded with zeros and masked. Nothing is compressed, for zero-copy access.

Files lie in the shared folder under names no other attempt uses; the manifest, written by Spark, lists those of the
attempts that succeeded, so a lost or repeated task leaves at most an unlisted file.

Defined cases. Null or empty text: the end id alone. Rows with one id keep an unstated order. Null ids come first.
No documents: no file and no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.offsets import prefix_sums
from furnacelens.llm.tokens import GLUED, encode, encoder, vocabulary
from furnacelens.llm.words import slices
from furnacelens.session import materialise, scratch_path

SLICE = 1 << 20
SEQUENCES = 128  # in a batch


def _open(path: str):
    """(filesystem, path in it)."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else f"/{path}")


def file_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("input_ids", pa.list_(pa.field("item", kind, nullable=False), length)),
        ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length)),
        ("doc_id", pa.list_(pa.int64())),
        ("doc_end", pa.list_(pa.int32())),
    ])


class _Writer:
    """Gathers ids and document ends, and writes whole batches."""

    def __init__(self, sink, length: int, dtype) -> None:
        self.length, self.dtype = length, dtype
        self.schema = file_schema(length, pa.from_numpy_dtype(dtype))
        self.file = pa.ipc.new_file(sink, self.schema)
        self.ids, self.docs, self.ends = np.zeros(0, dtype), [], np.zeros(0, np.int64)
        self.sequences = 0

    def add(self, ids: np.ndarray, docs: list, ends: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += docs
        size = self.length * SEQUENCES
        while len(self.ids) >= size:
            self._batch(size)

    def _batch(self, size: int) -> None:
        real = min(size, len(self.ids))
        body = np.zeros(size, self.dtype)
        body[:real] = self.ids[:real]
        done = int(np.searchsorted(self.ends, real, "right"))
        n = size // self.length
        at = (self.ends[:done] - 1) // self.length
        cuts = pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32())
        cols = [
            pa.FixedSizeListArray.from_arrays(pa.array(body), type=self.schema.field(0).type),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(size) < real), type=self.schema.field(1).type),
            pa.ListArray.from_arrays(cuts, pa.array(self.docs[:done], pa.int64())),
            pa.ListArray.from_arrays(cuts, pa.array(self.ends[:done] - at * self.length, pa.int32())),
        ]
        self.file.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.ids, self.docs, self.ends = self.ids[real:], self.docs[done:], self.ends[done:] - real
        self.sequences += n

    def close(self) -> None:
        if len(self.ids):
            self._batch(-(-len(self.ids) // self.length) * self.length)
        self.file.close()


def write_files(docs: DataFrame, folder: str, path: str, blank: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; returns their manifest (part, path, sequences, docs, tokens) in order of ids."""
    def of(batches):
        part, to, writer, n_docs, n_tokens = TaskContext.get().partitionId(), None, None, 0, 0
        for b in slices(batches, "text", SLICE):
            if writer is None:
                store, name = _open(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow")
                store.create_dir(name.rpartition("/")[0], recursive=True)
                to = store.open_output_stream(name)
                full = f"{folder}/{name.rpartition('/')[2]}"
                writer = _Writer(to, length, encoder(path, blank).dtype)
            e = encode(b.column(1), path, blank)
            ids = np.insert(e.ids, e.first[1:], end_id)
            writer.add(ids, b.column(0).to_pylist(), np.cumsum(np.diff(e.first) + 1))
            n_docs, n_tokens = n_docs + b.num_rows, n_tokens + len(ids)
        if writer is not None:
            writer.close()
            to.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [full], "sequences": [writer.sequences], "docs": [n_docs], "tokens": [n_tokens]})

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc").sortWithinPartitions("doc")
    return materialise(ordered.mapInArrow(of, "part long, path string, sequences long, docs long, tokens long"), "manifest")


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-mapped where the file is local."""
    store, name = _open(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file) and mask of the i-th sequence."""
    b = reader.get_batch(i // SEQUENCES)
    k, length = i % SEQUENCES, b.schema.field(0).type.list_size
    ids = b.column(0).values.to_numpy(zero_copy_only=True)[k * length : (k + 1) * length]
    return ids, b.column(1).values.slice(k * length, length).to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    placed = manifest.join(prefix_sums(manifest, "part", "tokens"), "part").select("path", "tokens_before")

    def of(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader, left = open_file(path), []
                for i in range(reader.num_record_batches):
                    x = reader.get_batch(i)
                    length = x.schema.field(0).type.list_size
                    ids = x.column(0).values.to_numpy(zero_copy_only=True)
                    docs, ends = x.column(2), x.column(3)
                    seq = np.repeat(np.arange(x.num_rows), np.diff(ends.offsets.to_numpy()))
                    at, out = 0, ([], [], [])
                    for e in (seq * length + ends.values.to_numpy()).tolist():
                        left.append(ids[at:e])
                        n, crc = 0, 0
                        for p in left:
                            n, crc = n + len(p), zlib.crc32(p.astype("<u4").tobytes(), crc)
                        for o, v in zip(out, (start, n, crc)):
                            o.append(v)
                        start, at, left = start + n, e, []
                    real = int(x.column(1).values.true_count)
                    if real > at:
                        left.append(ids[at:real])
                    yield pa.RecordBatch.from_arrays([docs.values, *(pa.array(o, pa.int64()) for o in out)], ["doc", "start", "n", "crc"])

    # one row per file: dealt out evenly
    return placed.repartition(max(1, manifest.count())).mapInArrow(of, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_files(docs, scratch_path(spark, "arrow"), vocabulary("byte_bpe_50k.json"), GLUED, end_id=0))
