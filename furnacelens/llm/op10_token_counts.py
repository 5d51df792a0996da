"""Token counts by field and section, from one encoding of the whole document.

A document is its fields, joined by line breaks; every field is cut into sections, here its lines. Sections tile the
document: a line break belongs to the section it ends. The document is encoded once, whole; the character span of each
token is joined to the sections it meets (both ordered, by binary search), and a token is counted once:

* ``first``: for the section of its first character,
* ``last``: for the section of its last character,
* ``most``: for the section with most of its characters, the earlier one on a tie.

Counts add up to the tokens of the document. Defined cases: a null field is empty and has one empty section with no
token; null ids stay null; repeated rows are separate documents; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.tokens import GLUED, encode, vocabulary
from furnacelens.llm.words import slices, texts

RULES = ("first", "last", "most")


def allocate(begin: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it meets several); section i is [bounds[i], bounds[i + 1])."""
    a = np.searchsorted(bounds, begin, "right") - 1
    z = np.searchsorted(bounds, np.maximum(end - 1, begin), "right") - 1
    crossing = z > a
    if rule == "first":
        return a, crossing
    if rule == "last":
        return z, crossing
    out = a.copy()
    most = np.minimum(end, bounds[a + 1]) - begin
    step = np.flatnonzero(crossing)
    j = 1
    while len(step):  # as often as one token meets sections
        s = a[step] + j
        part = np.minimum(end[step], bounds[s + 1]) - bounds[s]
        better = part > most[step]
        out[step[better]], most[step[better]] = s[better], part[better]
        j += 1
        step = step[a[step] + j <= z[step]]
    return out, crossing


def token_counts(docs: DataFrame, fields: list[str], path: str, blank: str, rule: str = "most", id_col: str = "doc_id") -> DataFrame:
    """(id, field, section, n_chars, n_tokens, n_crossing): a row for each line of each field, numbered from 0.

    Put the longest field last: work is sliced by its size.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = pa.array(fields)

    def of(batches):
        for b in slices(batches, f"_f{len(fields) - 1}"):
            parts = [pc.fill_null(c, "").cast(pa.large_string()) for c in b.columns[1:]]
            whole = pc.binary_join_element_wise(*parts, pa.scalar("\n", pa.large_string()))
            e = encode(whole, path, blank, spans=True)
            data, off = texts(whole)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            # bytes at which fields and lines begin
            size = np.stack([pc.binary_length(p).to_numpy() for p in parts], 1)
            begin_field = (off[:-1, None] + np.concatenate([np.zeros((len(size), 1), np.int64), np.cumsum(size + 1, 1)[:, :-1]], 1)).ravel()
            line = np.flatnonzero(data == 10) + 1
            line = np.setdiff1d(line, begin_field)
            # a break at the very end of a row ends its last line and begins the next row
            line = line[~np.isin(line, off)]
            ends_row = begin_field.reshape(len(size), -1)[:, -1] + size[:, -1]
            at = np.concatenate([begin_field, line])
            kind = np.concatenate([np.tile(np.arange(len(fields)), len(size)), np.full(len(line), -1)])
            # an empty last field begins where the next row does: rows are told apart first
            row = np.concatenate([np.repeat(np.arange(len(size)), len(fields)), np.searchsorted(ends_row, line, "left")])
            order = np.lexsort((np.arange(len(at)), at, row))
            at, kind, row = at[order], kind[order], row[order]
            field_at = np.maximum.accumulate(np.where(kind >= 0, np.arange(len(kind)), 0))
            bounds = np.append(chars[at], chars[-1])
            base = np.repeat(chars[off[:-1]], np.diff(e.first))
            to, crossing = allocate(base + e.spans[:, 0], base + e.spans[:, 1], bounds, rule)
            n = np.bincount(to, minlength=len(at))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)), names.take(pa.array(kind[field_at])), pa.array(np.arange(len(at)) - field_at, pa.int64()),
                    pa.array(np.diff(bounds)), pa.array(n), pa.array(np.bincount(to[crossing], minlength=len(at))),
                ],
                ["doc", "field", "section", "n_chars", "n_tokens", "n_crossing"],
            )

    columns = [F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)]
    source = docs.select(F.col(id_col).alias("doc"), *columns)
    kind = dict(docs.dtypes)[id_col]
    return source.mapInArrow(of, f"`{id_col}` {kind}, field string, section long, n_chars long, n_tokens long, n_crossing long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, ["source", "lang", "text"], vocabulary("byte_bpe_50k.json"), GLUED)
