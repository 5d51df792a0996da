"""op8's signatures of long texts: few, and none lost where only empty segments agree."""

import os

import numpy as np
import pyarrow as pa
import pytest

from furnacelens.llm import op8_ngram_jaccard as op8
from furnacelens.llm.words import U, salted


def _signatures(tokens, schemes):
    h = np.array(tokens, U)
    return op8.signatures(h, np.zeros(len(h), np.int64), np.array([0, len(h)]), schemes)[0]


def test_signatures_grow_with_the_size():
    rng = np.random.default_rng(5)
    schemes = op8.Schemes({300: 5000, 8400: 50, 20_000: 5}, 80, 100)
    for size in (300, 8400, 20_000):
        assert len(_signatures(rng.integers(0, 1 << 63, size), schemes)) < 3 * size


@pytest.mark.parametrize("spares", [2, 8])
def test_sets_that_agree_in_empty_segments_only(monkeypatch, spares):
    """One token of every occupied segment is changed: the links with the most differences that a scheme has to find."""
    monkeypatch.setattr(op8, "_spares", lambda h, size: (spares, 0.0, 0.0))
    rng = np.random.default_rng(9)
    schemes = op8.Schemes({500: 1000}, 80, 100)
    k = next(k for k in range(len(schemes.edges)) if schemes.edges[k + 2] > 400)
    n, m = schemes.edges[k + 2] - 1, int(schemes.m[k])
    schemes.m[k + 1] = 0  # the scheme of larger sets would find them too
    place = lambda x: (salted(x, 1000) % U(m)).astype(int)
    tried = 0
    while tried < 5:
        x = rng.integers(0, 1 << 63, n).astype(U)
        used = rng.permutation(np.unique(place(x)))
        if len(used) > 2 * (n // 9):  # too few empty segments: the pair would not be a link
            continue
        tried += 1
        out, into = used[::2], used[1::2]
        gone = [np.flatnonzero(place(x) == s)[0] for s in out]
        new = rng.integers(0, 1 << 63, 200 * m).astype(U)
        new = [new[place(new) == s][0] for s in into]
        new += list(x[gone[len(new):]] ^ U(1 << 63)) if len(gone) > len(new) else []
        y = np.concatenate([np.delete(x, gone), np.array(new, U)])
        same = len(np.intersect1d(x, y))
        assert 100 * same >= 80 * (len(x) + len(y) - same)
        assert len(np.intersect1d(_signatures(x, schemes), _signatures(y, schemes)))


def test_sketches_are_destroyed_once_used(spark, monkeypatch):
    """Each of them holds 32 MB in every process; the driver's garbage collection may come too late."""
    made, build = [], op8.sketch.build
    monkeypatch.setattr(op8.sketch, "build", lambda *a: made.append(build(*a)) or made[-1])
    texts = [" ".join(f"w{j + (1000 if j == i else 0)}" for j in range(40)) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = op8.jaccard_components(docs, bits=16)
    assert made and not any(os.path.exists(b._path) for b in made)
    assert found.count() == 8


def test_texts_are_hashed_in_small_slices(monkeypatch):
    """A worker's memory beside the sketch follows the slice; every row still comes out, in order."""
    texts = [" ".join(f"w{i}x{j}" for j in range(150)) for i in range(1500)]
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(1500), pa.int64()), "text": pa.array(texts)})
    seen, shingles = [], op8.shingles
    monkeypatch.setattr(op8, "shingles", lambda column, k: seen.append(sum(len(t) for t in column.to_pylist())) or shingles(column, k))

    class Docs:
        def mapInArrow(self, of, schema):
            return list(of([batch]))

    class Sketch:
        value = np.full((4, 1 << 13), 255, np.uint8)

    monkeypatch.setattr(op8.sketch, "build", lambda docs, keys, bits: [list(keys([batch])), Sketch][1])
    sets = pa.Table.from_batches(op8._sets(Docs(), 4))
    assert sets.column("doc").to_pylist() == list(range(1500)) and set(sets.column("n").to_pylist()) == {147}
    found, _ = op8._repeated(Docs(), 4, op8.Schemes({147: 1500}, 85, 100), 16)
    assert len({(r["s"], r["t"]) for b in found for r in b.to_pylist()}) == 1500
    assert sum(map(len, texts)) > 1 << 20 and max(seen) <= (1 << 17) + max(map(len, texts))
