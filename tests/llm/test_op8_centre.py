"""op8: signatures that a scheme promises, and near copies with edits of their own that make no groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furnacelens.llm import op8_ngram_jaccard as op8
from furnacelens.llm.words import U, signed


def test_links_share_the_promised_signatures():
    rng = np.random.default_rng(11)
    tried = 0
    for n in (40, 147, 390, 900):
        schemes = op8.Schemes({n: 1000}, 85, 100)
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n).astype(U)
            gone, new = rng.integers(0, 1 + 15 * n // 100, 2)
            y = np.concatenate([x[gone:], rng.integers(0, 1 << 63, new).astype(U)])
            same = n - gone
            if 100 * same < 85 * (n + len(y) - same):
                continue
            sizes = np.array([n, len(y)])
            sig, at, lower, chosen, occupied = op8._entries(np.concatenate([x, y]), np.repeat([0, 1], sizes), np.r_[0, np.cumsum(sizes)], schemes)
            for i in range(2):
                for j in range(2):
                    if chosen[i, 0] != chosen[j, 1] or not occupied[i, 0]:
                        continue
                    tried += 1
                    both = len(np.intersect1d(sig[(at == 0) & (lower == i)], sig[(at == 1) & (lower == j)]))
                    assert both >= max(occupied[i, 0], occupied[j, 1]) - 15 * (n + len(y)) // 185
                    assert both >= max(occupied[i, r] - schemes.differ(sizes, chosen[i])[r] for i, r in ((i, 0), (j, 1)))
    assert tried > 100


@pytest.mark.parametrize("most", [30, 45])
def test_copies_with_edits_of_their_own_make_few_groups(spark, most):
    """Replaced tokens of 300 copies: those beyond the limit from the centre link with none, so no pair is left to compare."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 147).astype(U)
    sets = [base]
    for i in range(300):
        x = base.copy()
        at = rng.choice(147, rng.integers(0, most), replace=False)
        x[at] = rng.integers(0, 1 << 63, len(at)).astype(U)
        sets.append(x)
    shared = rng.integers(0, 1 << 63, 30).astype(U)  # two far from the centre, but near each other
    for i in range(2):
        x = base.copy()
        x[20:50] = shared
        x[60 + i] = U(i + 5)
        sets.append(x)
    pivot = sets[150]
    rows = [(1, i, len(x), bytearray(np.setdiff1d(x, pivot).tobytes()), bytearray(np.setdiff1d(pivot, x).tobytes())) for i, x in enumerate(sets)]
    near = op8._centred(spark.createDataFrame(rows, "p long, rep long, n long, added binary, removed binary"))
    got = {r.rep: r for r in near.collect()}
    for i, x in enumerate(sets):
        assert got[i].size == len(np.setxor1d(x, base)) and got[i].centre == 147
        assert set(np.frombuffer(bytes(got[i].added), U)) == set(x) - set(base) and set(np.frombuffer(bytes(got[i].removed), U)) == set(base) - set(x)
    e = {i: 185 * got[i].size - 15 * 147 for i in got}
    e0 = min(e.values())
    limited = [(1, i, 147, max(1, -((-e[i] - e0) // 370)) if e[i] + e0 > 0 else (e[i] - e0) // 370 + 1, e[i], e[i] + e0 <= 0, 147, bytearray(got[i].added), bytearray(got[i].removed)) for i in got]
    d = spark.createDataFrame(limited, "p long, rep long, n long, need long, e long, linked boolean, centre long, added binary, removed binary")
    found, _ = op8._repeated_differences(d, 20)
    groups = op8._common_differences(found, 85, 100).groupBy("key").agg(F.collect_set("rep").alias("reps")).filter("size(reps) > 1").collect()
    far = len(sets)
    assert any({far - 1, far - 2} <= set(r.reps) for r in groups)
    assert sum(len(r.reps) for r in groups) < 3 * len(sets)


def test_bodies_of_a_tie(spark):
    """Sizes and intersection of every pair; differences only of near ones."""
    a, b, c = (np.array(x, U) for x in ([1, 2, 3, 4], [2, 3, 4, 5], [9, 10, 11]))
    bodies = spark.createDataFrame([(i, len(x), bytearray(np.sort(x).tobytes())) for i, x in enumerate((a, b, c))], "rep long, n long, body binary")
    got = {r.rep: r for r in op8._differences(spark.createDataFrame([(0, 0), (0, 1), (0, 2)], "u long, v long"), bodies).collect()}
    assert (got[1].m, got[1].n, got[1].same) == (4, 4, 3) and list(np.frombuffer(bytes(got[1].added), np.int64)) == [5]
    assert list(np.frombuffer(bytes(got[1].removed), np.int64)) == [1] and got[2].added is None and got[2].same == 0
    assert got[0].added is not None and len(got[0].added) == 0 and signed(a)[0] == 1
