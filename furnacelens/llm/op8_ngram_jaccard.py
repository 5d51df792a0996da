"""Exact Jaccard join on word shingles by a universe partition and the pigeonhole principle.

Sets whose Jaccard likeness is ``num/den`` or more differ in at most H tokens, H growing with their sizes. Sizes are
cut into bands; a scheme serves two adjacent bands and hashes the token universe into m segments. With a budget of
sum(theta + 1) > H over the segments, one segment of two linked sets differs in no more than its theta tokens: theta 0
indexes a segment's subset of tokens, theta 1 also its one-deletion neighbourhood. Which of the two a scheme takes is
decided by cost from the corpus' own size histogram (index entries against expected chance meetings). Segments too
small to tell sets apart are never indexed; spare segments make up for them, as many as such segments are to be
expected in sets of the scheme. A set with more of them than spares also indexes combinations of up to three of the
first ones, all but as many as the spares allow: two sets with more in common than there are spares share their first
three, so nothing is lost.

Equal sets are one class from the start. Signatures that occur once go by the count-min sketch. Two sets that differ in
d tokens agree in m - d segments at least, so a scheme promises a link a number of common signatures; sets and pairs
with fewer drop out before anything is measured. Groups of equal signatures with few pairs across components are
compared pair by pair; in the others every set is measured against the pivot of its group, the set with the most
repeated signatures, so that the groups of one text's near copies share one pivot. Likeness is a metric, so a linked
pair lies within the pivot's near sets (likeness 1/2 or more) or within its far sets (1/2 plus the most that a link
allows, or less). Near sets are known by their difference d from the centre, the tokens that most of the pivot's near
sets have (a pivot's own edits would be in the differences of all others): sets x and y link if and only if
e(x) + e(y) <= 2 (den + num) |d(x) & d(y)|, where e = (den + num) |d| - (den - num) |set|. All that reach this with an
empty intersection link to the set of least e; a pair that does not needs common tokens in its differences, so the
tokens in a prefix of d (repeated ones only, those the centre lacks first) are the groups of the next turn, see
``_common_differences``. Far sets are taken as differences from the empty set once, whatever the pivot; in later turns
they stay in their group, which has another pivot then. So a thousand copies with edits of their own cost a thousand
measurements and no pairs.
Nothing is capped: the last turn compares all that is left.

Defined cases. Null text or no words: empty set, linked with nothing, its own component. Fewer words than a shingle:
the whole sequence is the one shingle. Rows with one id are one node. A row with null id takes the component of an
equal set, else null, and links nothing itself. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.llm import sketch
from furnacelens.llm.components import components
from furnacelens.llm.words import LOWER, NON_SPACE, U, distinct_by, mix, salted, signed, slices, split, windows
from furnacelens.session import materialise

SPARE = 2  # least number of segments beyond H + 1 where theta is 0
NAMED = 3  # segments too small to tell sets apart that make one index entry
FEW_PAIRS = 2  # pairs across components per set of a group, up to which they are compared at once; four times as many each turn
SLICE_BYTES = 1 << 17  # of text hashed at once: what is held beside it is some sixty times as large
SCHEMES = ("scheme", "occupied", "hot")  # columns of the signatures, not of later groups
TURNS = 4  # pivots of a group; what is left after the last one is compared whatever its size


def shingles(column: pa.Array, k: int):
    """(hash, row) of the distinct shingles, by row; row pointers."""
    w = split(column, NON_SPACE, LOWER)
    h, ok = windows(w, k)
    at = np.flatnonzero(ok)
    hs, rows = [h[at]], [w.row[at]]
    for short in range(1, k):
        r = np.flatnonzero(w.counts == short)
        if len(r):
            hs.append(windows(w, short, salt=short)[0][w.first[r]])
            rows.append(r)
    h, row = np.concatenate(hs), np.concatenate(rows)
    i = distinct_by(h, row)
    h, row = h[i], row[i]
    order = np.argsort(row, kind="stable")
    h, row = h[order], row[order]
    return h, row, np.searchsorted(row, np.arange(len(column) + 1))


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    c = np.zeros(len(x) + 1, U)
    np.cumsum(x, out=c[1:])
    return c[ptr[1:]] - c[ptr[:-1]]


def _spares(h: int, size: float) -> tuple[int, float, float]:
    """(spares, entries, chance): the cheapest number of spares for sets of ``size`` tokens that differ in up to ``h``.

    The entries of a set are its segments and the expected combinations of empty ones; the chance is that of a meeting
    of two unlike sets in a combination.
    """
    best, s = None, SPARE
    while best is None or h + 1 + s < best[1]:
        m = h + 1 + s
        empty = math.exp(-size / m)
        mean = m * empty
        sd = math.sqrt(max(mean * (1 - (1 + size / m) * empty), 1e-9))
        lows = np.arange(s + 1, s + 2 + int(max(0.0, mean - s) + 8 * sd + 8))
        chance = np.exp(-(((lows - mean) / sd) ** 2) / 2) / (sd * math.sqrt(2 * math.pi))
        named = min(NAMED, s + 1)
        x = lows - s - 1.0
        made = float((chance * np.prod([(x + i) / i for i in range(1, named + 1)], axis=0)).sum())
        if best is None or m + made < best[1]:
            best = s, m + made, made * min(1.0, made) * empty**named
        s += 1 + s // 8
    return best


class Schemes:
    """Size bands and, per scheme, the numbers of segments and spares and whether they index one-deletion neighbourhoods."""

    def __init__(self, histogram: dict[int, int], num: int, den: int) -> None:
        self.num, self.den = num, den
        self.edges = [1]
        top = max(histogram, default=1)
        while self.edges[-1] <= top * den // num + 1:
            self.edges.append(self.edges[-1] * den // num + 1)
        self.edges += [self.edges[-1] * den // num + 1, 1 << 62]
        e = self.edges
        counts = np.zeros(len(e), np.int64)
        for n, c in histogram.items():
            counts[self.band(n)] += c
        self.m, self.theta, self.spare = (np.zeros(len(e), np.int64) for _ in range(3))
        for k in range(len(e) - 2):
            h = (den - num) * 2 * (e[k + 2] - 1) // (den + num)  # the most by which two sets of the scheme differ
            if h < 1 or e[k + 2] > 1 << 60:
                continue
            sets, size = float(counts[k] + counts[k + 1]), (e[k] + e[k + 1]) / 2
            spare, entries, chance = _spares(h, float(e[k]))
            m0, m1 = h + 1 + spare, (h + 2) // 2
            a1 = size / m1
            cost0 = sets * entries + sets**2 / 2 * chance
            cost1 = sets * (m1 + size) + (sets**2 / 2 * m1 * ((1 + a1) * math.exp(-a1)) ** 2 if m1 > 1 else 0)
            self.m[k], self.theta[k], self.spare[k] = (m1, 1, 0) if cost1 < cost0 else (m0, 0, spare)

    def differ(self, n: np.ndarray, scheme: np.ndarray) -> np.ndarray:
        """The most by which a set of n tokens and any it links with in the scheme differ."""
        top = np.minimum(np.array(self.edges)[np.minimum(scheme + 2, len(self.edges) - 1)] - 1, n * self.den // self.num)
        return (self.den - self.num) * (n + top) // (self.den + self.num)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1


def signatures(h: np.ndarray, row: np.ndarray, ptr: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of all sets under both their schemes."""
    return _entries(h, row, ptr, schemes)[:2]


def _entries(h: np.ndarray, row: np.ndarray, ptr: np.ndarray, schemes: Schemes) -> tuple:
    """(signature, row, whether under the lower scheme); schemes and occupied segments of each row, lower scheme last.

    Two sets of a theta-0 scheme that differ in d tokens agree in m - d segments; those that are not empty in both give
    one signature each. So the larger of their numbers of occupied segments, less d, is the least number of signatures
    they share. The number is 0 where the scheme promises none.
    """
    n = np.diff(ptr)
    chosen, occupied = np.zeros((2, len(n)), np.int64), np.zeros((2, len(n)), np.int64)
    band = np.searchsorted(schemes.edges, n, "right") - 1
    value, place = salted(h, 11), salted(h, 1000)
    out, rows, lower = [], [], []
    for which, scheme in enumerate((band, band - 1)):
        made = len(out)
        chosen[which] = scheme
        m = np.where((scheme >= 0) & (n > 0), schemes.m[scheme], 0)
        if not m.any():
            continue
        theta = schemes.theta[scheme]
        base = np.concatenate([[0], np.cumsum(m)])
        used = np.flatnonzero(m[row] > 0)
        r = row[used]
        seg = base[r] + (place[used] % m[r].astype(U)).astype(np.int64)
        total, size = np.zeros(base[-1], U), np.bincount(seg, minlength=base[-1])
        np.add.at(total, seg, value[used])
        owner = np.repeat(np.arange(len(m)), m)
        # one name for a segment of a scheme, the same in every set
        name = salted((scheme[owner].astype(U) << U(32)) + (np.arange(base[-1]) - base[owner]).astype(U), 31)
        low = size <= theta[owner]
        full = size > 0
        # a lone token of a deletion scheme still meets its equal and a pair less one
        out.append(mix(total + name)[full])
        rows.append(owner[full])
        near = np.flatnonzero((theta[r] == 1) & (size[seg] > 1))
        out.append(mix(total[seg[near]] - value[used][near] + name[seg[near]]))
        rows.append(r[near])
        spare = schemes.spare[scheme]
        lows = np.bincount(owner[low], minlength=len(m))
        for i in np.flatnonzero(lows > spare):
            named = min(NAMED, int(spare[i]) + 1)
            names = name[base[i] : base[i + 1]][low[base[i] : base[i + 1]]][: lows[i] - spare[i] - 1 + named]
            c = np.array(list(combinations(range(len(names)), named)))
            out.append(mix(names[c].sum(axis=1, dtype=U) + U(9)))
            rows.append(np.full(len(c), i))
        occupied[which] = np.where((m > 0) & (theta == 0), m - lows, 0)
        lower += [np.full(len(x), which) for x in out[made:]]
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), chosen, occupied
    return np.concatenate(out), np.concatenate(rows), np.concatenate(lower), chosen, occupied


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, n, s, t): set size and a digest of 128 bits."""
    def of(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            h, row, ptr = shingles(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ptr)), pa.array(signed(_sums(salted(h, 21), ptr))), pa.array(signed(_sums(salted(h, 22), ptr)))], ["doc", "n", "s", "t"]
            )

    return docs.mapInArrow(of, "doc long, n long, s long, t long")


def _repeated(docs: DataFrame, k: int, schemes: Schemes, bits: int) -> tuple:
    """(key, s, t, doc, n, scheme, occupied, need): signatures estimated repeated, with the digest of their set; and the
    sketch, to be destroyed. Sets with fewer than ``need`` of them in a scheme link with nothing there and give none.
    """
    def keys(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            yield signatures(*shingles(b.column(1), k), schemes)[0]

    seen = sketch.build(docs, keys, bits)

    def rows(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            h, row, ptr = shingles(b.column(1), k)
            sig, at, lower, chosen, occupied = _entries(h, row, ptr, schemes)
            n = np.diff(ptr)
            need = np.where(occupied > 0, np.maximum(occupied - schemes.differ(n, chosen), 0), 0)
            hit = sketch.repeated(seen.value, sig)
            hits = np.bincount(lower[hit] * len(n) + at[hit], minlength=2 * len(n)).reshape(2, -1)
            hit &= (hits >= need)[lower, at]
            s, t = signed(_sums(salted(h, 21), ptr)), signed(_sums(salted(h, 22), ptr))
            sig, at, lower = sig[hit], at[hit], lower[hit]
            small = [pa.array(x.astype(np.int32)) for x in (chosen[lower, at], occupied[lower, at], need[lower, at])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(sig)), pa.array(s[at]), pa.array(t[at]), b.column(0).take(pa.array(at)), pa.array(n[at]), *small],
                ["key", "s", "t", "doc", "n", "scheme", "occupied", "need"],
            )

    return docs.mapInArrow(rows, "key long, s long, t long, doc long, n long, scheme int, occupied int, need int"), seen


def _bodies(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, n, body): sorted shingle hashes of the wanted documents."""
    def of(batches):
        for b in slices(batches, "text", SLICE_BYTES):
            h, _, ptr = shingles(b.column(1), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ptr)), pa.array([np.sort(h[i:j]).tobytes() for i, j in zip(ptr[:-1], ptr[1:])], pa.binary())], ["rep", "n", "body"]
            )

    return docs.join(wanted.select(F.col("rep").alias("doc")), "doc").select("doc", "text").mapInArrow(of, "rep long, n long, body binary")


def _with_bodies(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (u, v, ...) with the bodies of both."""
    x = bodies.select(F.col("rep").alias("u"), F.col("body").alias("bu"))
    y = bodies.select(F.col("rep").alias("v"), F.col("body").alias("bv"))
    return pairs.join(x, "u").join(y, "v")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _measure(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(u, v, m, n, same): set sizes and the exact intersection of every pair (u, v)."""
    def of(batches):
        for b in batches:
            sets = [[np.frombuffer(z.as_buffer(), U) for z in b.column(i)] for i in (2, 3)]
            m, n = (pa.array([len(x) for x in s], pa.int64()) for s in sets)
            same = pa.array([_common(x, y) for x, y in zip(*sets)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), m, n, same], ["u", "v", "m", "n", "same"])

    return _with_bodies(pairs, bodies).select("u", "v", "bu", "bv").mapInArrow(of, "u long, v long, m long, n long, same long")


def _tokens(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) if x.is_valid else np.zeros(0, U) for x in column]


def _differences(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(p, rep, m, n, same, added, removed): sizes, intersection and, for near sets, how each set differs from its pivot."""
    def of(batches):
        for b in batches:
            sizes, added, removed = [], [], []
            for p, x in zip(_tokens(b.column(2)), _tokens(b.column(3))):
                same = _common(p, x)
                near = 3 * same >= len(p) + len(x)
                sizes.append((len(p), len(x), same))
                added.append(np.setdiff1d(x, p, assume_unique=True).tobytes() if near else None)
                removed.append(np.setdiff1d(p, x, assume_unique=True).tobytes() if near else None)
            sizes = np.array(sizes, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(x) for x in sizes], pa.array(added, pa.binary()), pa.array(removed, pa.binary())],
                ["p", "rep", "m", "n", "same", "added", "removed"],
            )

    joined = _with_bodies(pairs, bodies).select("u", "v", "bu", "bv")
    return joined.mapInArrow(of, "p long, rep long, m long, n long, same long, added binary, removed binary")


def _centred(near: DataFrame) -> DataFrame:
    """(p, rep, n, size, centre, added, removed): differences from the centre of each pivot's near sets, the tokens that most of them have.

    A pivot's own edits are in the differences of all sets from it; the centre has none, so what two differences then
    have in common is their own. Any set can be differed from: links follow from differences and sizes alone.
    """
    def counted(batches):
        for b in batches:
            p = b.column(0).to_numpy()
            for in_pivot, i in ((False, 1), (True, 2)):
                tokens = _tokens(b.column(i))
                owner = np.repeat(p, [len(x) for x in tokens])
                found, c = np.unique(np.stack([owner, signed(np.concatenate([*tokens, np.zeros(0, U)]))]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1]), pa.array(np.full(len(c), in_pivot)), pa.array(c)], ["p", "token", "in_pivot", "c"])

    sizes = near.groupBy("p").agg(F.count("*").alias("sets")).filter("sets > 2")  # no token differs in most of two, one being the pivot
    counts = near.join(sizes, "p", "left_semi").select("p", "added", "removed").mapInArrow(counted, "p long, token long, in_pivot boolean, c long")
    most = counts.groupBy("p", "token", "in_pivot").agg(F.sum("c").alias("c")).join(sizes, "p").filter("2 * c > sets")
    flips = most.groupBy("p").agg(*[F.collect_list(F.when(F.col("in_pivot") == x, F.col("token"))).alias(c) for c, x in (("gained", False), ("lost", True))])

    def of(batches):
        for b in batches:
            size, centre, out = [], [], ([], [])
            gained, lost = ([np.sort(np.array(x or [], np.int64).view(U)) for x in b.column(i).to_pylist()] for i in (5, 6))
            for n, added, removed, g, z in zip(b.column(2).to_pylist(), _tokens(b.column(3)), _tokens(b.column(4)), gained, lost):
                less = lambda x, y: np.setdiff1d(x, y, assume_unique=True)
                pair = [np.concatenate([less(added, g), less(z, removed)]), np.concatenate([less(removed, z), less(g, added)])]
                size.append(len(pair[0]) + len(pair[1]))
                centre.append(n - len(pair[0]) + len(pair[1]))
                for column, x in zip(out, pair):
                    column.append(np.sort(x).tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size, pa.int64()), pa.array(centre, pa.int64()), *[pa.array(x, pa.binary()) for x in out]], ["p", "rep", "n", "size", "centre", "added", "removed"])

    return near.select("p", "rep", "n", "added", "removed").join(flips, "p", "left").mapInArrow(of, "p long, rep long, n long, size long, centre long, added binary, removed binary")


def _repeated_differences(d: DataFrame, bits: int) -> tuple:
    """(p, rep, n, need, e, linked, centre, qa, q, tokens) and the sketch: the tokens of each difference that are estimated repeated for its pivot.

    One order per pivot: tokens the pivot lacks, then tokens of the pivot.
    """
    def tokens(b):
        for p, added, removed in zip(b.column(0).to_numpy().view(U), b.column(7), b.column(8)):
            name = mix(np.array([p], U) + U(5))
            yield [mix(np.frombuffer(x.as_buffer(), U) ^ name) for x in (added, removed)]

    def keys(batches):
        for b in batches:
            for pair in tokens(b):
                yield np.concatenate(pair)

    seen = sketch.build(d, keys, bits)

    def of(batches):
        for b in batches:
            found = [[np.sort(x[sketch.repeated(seen.value, x)]) for x in pair] for pair in tokens(b)]
            qa, found = np.array([len(x) for x, _ in found], np.int64), [np.concatenate(x) for x in found]
            q = np.array([len(x) for x in found], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(q)]).astype(np.int32)), pa.array(signed(np.concatenate([*found, np.zeros(0, U)]))))
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(qa), pa.array(q), lists], ["p", "rep", "n", "need", "e", "linked", "centre", "qa", "q", "tokens"])

    return d.mapInArrow(of, "p long, rep long, n long, need long, e long, linked boolean, centre long, qa long, q long, tokens array<long>"), seen


def _common_differences(found: DataFrame, num: int, den: int) -> DataFrame:
    """(key, rep, n): a group per pivot and token; sets with ``need`` common tokens in their differences share one.

    Single tokens are common to none, so a set whose difference has fewer than ``need`` others has no further link.
    Tokens of the centre that both lack count for nothing by themselves: each makes the partner's e larger by as much as
    it is worth, so of added tokens a link has in common at least a = (e + 2 num m - (den + num) |centre|) /
    (2 (den + num)), m being the partner's size. A strong set, with a >= 1, meets all its partners by added tokens. The
    others meet by all tokens, and there what a set needs grows with the least e left among its partners: a set linked to
    the one of least e looks for sets that are not, those look for any. Every set takes all but the last need - 1 tokens.
    """
    unit = 2 * (den + num)
    lo = found.groupBy("p").agg(F.min("n").alias("lo"))
    a = F.expr(f"ceil((e + {2 * num} * greatest(lo, ({num} * n + {den - 1}) div {den}) - {den + num} * centre) / {unit})").cast("long")
    left = found.filter("need <= q").join(lo, "p").withColumn("a", F.when(F.col("centre") == 0, F.greatest(a, "need")).otherwise(a))
    left = left.withColumn("strong", F.expr("NOT linked AND a >= 1")).withColumn("by_any", ~F.col("strong")).withColumn("by_added", F.expr("qa >= CASE WHEN strong THEN a ELSE 1 END"))
    left = left.select("p", "rep", "n", "need", "e", "linked", "qa", "q", "tokens", "a", "strong", "by_any", "by_added")
    for _ in range(2):
        least = left.groupBy("p").agg(
            F.min(F.expr("CASE WHEN by_any AND NOT linked THEN e END")).alias("open"), F.min(F.expr("CASE WHEN by_any THEN e END")).alias("any"),
            F.min(F.expr("CASE WHEN by_added AND strong THEN a END")).alias("least_a"),
        )
        needed = F.expr(f"CASE WHEN by_any THEN greatest(need, ceil((e + CASE WHEN linked THEN open ELSE any END) / {unit})) ELSE need END").cast("long")
        left = left.join(least, "p").withColumn("need", needed).withColumn("a", F.expr("CASE WHEN strong THEN a ELSE least_a END"))
        left = left.withColumn("by_any", F.expr("by_any AND need <= q AND (NOT linked OR open IS NOT NULL)")).withColumn("by_added", F.expr("coalesce(by_added AND a <= qa, false)"))
        left = left.drop("open", "any", "least_a").filter("by_any OR by_added")
    both = F.expr("""concat(CASE WHEN by_added THEN slice(tokens, 1, cast(qa - a + 1 AS int)) ELSE cast(array() AS array<long>) END,
        CASE WHEN by_any THEN transform(slice(tokens, 1, cast(q - need + 1 AS int)), x -> ~x) ELSE cast(array() AS array<long>) END)""")
    return left.select(F.explode(both).alias("key"), "rep", "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, bits: int = sketch.BITS) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    sets = materialise(_sets(docs, k), "sets")
    classes = sets.filter("n > 0").groupBy("s", "t", "n").agg(F.min("doc").alias("rep"))
    # as many rows as there are set sizes between powers of 1.02: a few hundred
    level = F.floor(F.log(F.col("n")) / math.log(1.02))
    histogram = {r.n: r.c for r in classes.groupBy(level).agg(F.max("n").alias("n"), F.count("*").alias("c")).collect()}
    schemes = Schemes(histogram, num, den)

    found, seen = _repeated(docs, k, schemes, bits)
    # one shuffle: equal sets have equal signatures, so the least id of a set within a group is that of its class
    once = found.repartition("key").groupBy("key", "s", "t").agg(
        F.min("doc").alias("rep"), *[F.first(c).alias(c) for c in ("n", "scheme", "occupied", "need")]).filter("rep IS NOT NULL")
    shared = once.withColumn("sets", F.count("*").over(Window.partitionBy("key"))).filter("sets > 1")
    enough = shared.withColumn("hits", F.count("*").over(Window.partitionBy("rep", "scheme"))).filter("hits >= need")
    keys = materialise(enough.select("key", "rep", "n", "scheme", "occupied"), "keys")
    seen.destroy()  # 32 MB of each process, else kept until the driver collects its garbage
    bodies = materialise(_bodies(docs, keys.select("rep").distinct(), k), "bodies")
    links = comp = None

    def link(new):
        nonlocal links, comp
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            comp = materialise(components(links), "components")

    def compare(keys, few):
        x = few.select("key", F.col("rep").alias("u"), F.col("n").alias("m"), F.col("comp").alias("c"), *[F.col(c).alias(f"{c}_") for c in few.columns if c in SCHEMES])
        pairs = x.join(few, "key").filter("c < comp").filter(f"{den} * least(n, m) >= {num} * greatest(n, m)")
        if "scheme" in keys.columns:  # signatures: a link shares as many as its scheme promises, some in larger groups
            pairs = pairs.groupBy(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v"), "scheme", (F.col("n") + F.col("m")).alias("both"), F.greatest("occupied", "occupied_").alias("occupied"), F.least("hot", "hot_").alias("hot")).agg(F.count("*").alias("hits"))
            pairs = pairs.filter(f"hits + hot >= occupied - {den - num} * both div {den + num}")
        else:
            pairs = pairs.select(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v"))
        found = materialise(_measure(pairs.select("u", "v").distinct(), bodies), "compared")
        link(found.filter(f"{den} * same >= {num} * (m + n - same)").select("u", "v"))

    def still_open(keys, turn):
        named = keys.withColumn("comp", F.col("rep")) if comp is None else keys.join(
            comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        size = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
            F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("comps"))
        few = F.lit(True) if turn == TURNS else F.expr(f"size * size - same <= {2 * FEW_PAIRS * 4**turn} * size")
        found = named.join(size.filter("comps > 1").select("key", few.alias("few")), "key")
        if "scheme" in keys.columns:
            found = found.withColumn("hot", F.count(F.when(~F.col("few"), 1)).over(Window.partitionBy("rep", "scheme")))
        return materialise(found.select("key", "rep", "n", "comp", "few", *[c for c in found.columns if c in SCHEMES]), "open")

    for turn in count():
        groups = still_open(keys, turn)
        few, keys = groups.filter("few"), groups.filter("NOT few")
        if not few.isEmpty():
            compare(keys, few)
        if keys.isEmpty():
            break
        weight = keys.groupBy("rep").agg(F.count("*").alias("w"))
        pivot = keys.join(weight, "rep").groupBy("key").agg(F.max(F.struct("w", F.xxhash64("rep", F.lit(turn)), F.col("rep").alias("p"), F.col("n").alias("m"))).alias("x")).select("key", "x.p", "x.m")
        named = keys.join(pivot, "key").select("key", "rep", "n", "p", "m")
        close = F.expr("2 * least(n, m) >= greatest(n, m)")  # else the set is far without measuring
        measured = materialise(_differences(named.filter(close).select(F.col("p").alias("u"), F.col("rep").alias("v")).distinct(), bodies), "measured")
        near = materialise(_centred(measured.filter("3 * same >= m + n").select("p", "rep", "n", "added", "removed")), "near").withColumn("e", F.expr(f"{den + num} * size - {den - num} * n"))
        least = near.groupBy("p").agg(F.min(F.struct("e", "rep")).alias("x"), F.max("e").alias("most")).select("p", F.col("x.e").alias("e0"), F.col("x.rep").alias("r0"), "most")
        near = near.join(least, "p")
        link(materialise(near.filter("e + e0 <= 0 AND rep <> r0").select(F.col("rep").alias("u"), F.col("r0").alias("v")), "linked"))
        # the common tokens without which a set has no further link
        need = F.expr(f"CASE WHEN e + e0 <= 0 THEN floor((e - e0) / {2 * (den + num)}) + 1 ELSE ceil((e + e0) / {2 * (den + num)}) END").cast("long")
        unlinked = near.filter("most + e0 > 0").withColumn("need", need).filter("need <= size").select("p", "rep", "n", "need", "e", F.expr("e + e0 <= 0").alias("linked"), "centre", "added", "removed")
        # far sets: as differences from the empty set
        not_far = measured.filter(f"2 * {den} * same >= {3 * den - 2 * num} * (m + n - same)").select("p", "rep")
        far = named.select("key", "p", "rep", "n").join(not_far, ["p", "rep"], "left_anti")
        if turn:  # less the near sets of a pivot: another one is next
            stay = far.select("key", "rep", "n")
        else:
            stay = None
            far = far.select("rep", "n").distinct().join(bodies.select("rep", "body"), "rep").select(
                F.lit(0).cast("long").alias("p"), "rep", "n", F.expr(f"({num} * n + {den - 1}) div {den}").alias("need"), F.expr(f"{2 * num} * n").alias("e"),
                F.lit(False).alias("linked"), F.lit(0).cast("long").alias("centre"), F.col("body").alias("added"), F.lit(b"").alias("removed"))
        d = materialise(unlinked if turn else unlinked.unionByName(far), "differences")
        found, seen = _repeated_differences(d, bits)
        tokens = _common_differences(materialise(found, "tokens"), num, den)
        keys = materialise(tokens if stay is None else tokens.unionByName(stay), "keys")
        seen.destroy()
    comp = spark.createDataFrame([], "node long, comp long") if comp is None else comp
    whole = sets.join(classes.select("s", "t", "rep"), ["s", "t"], "left").join(comp, F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("comp", "rep"))
    return whole.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all((coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM
  (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sets AS (SELECT doc_id, n, k, min(doc_id) OVER (PARTITION BY k) AS rep FROM
  (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS k FROM sh GROUP BY 1)),
reps AS (SELECT doc_id, n FROM sets WHERE doc_id = rep),
rare AS (SELECT g FROM sh JOIN reps USING (doc_id) GROUP BY 1 HAVING count(*) > 1),
rs AS (SELECT doc_id, g FROM sh JOIN reps USING (doc_id) JOIN rare USING (g)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs JOIN reps x ON u = x.doc_id JOIN reps y ON v = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM reps UNION SELECT reach.a, both_.v FROM reach JOIN both_ ON reach.b = both_.u),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN comp ON sets.rep = comp.a
"""
