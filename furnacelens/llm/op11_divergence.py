"""Source divergence audit: how far each source's term distribution lies from the other sources of its language.

Counting by length-bucketed packing. In each task the terms of a slice of rows are packed by byte length: up to 8 bytes
into one uint64 word, 9 to 16 bytes into two (big-endian, zero-padded; terms hold no zero byte, so packing is one to
one). Keys (group, words) are radix-sorted, 16 bits a pass, and counted by runs: occurrences and rows. Longer terms go
to buckets of one byte length each, sorted as fixed-width byte strings. Spark then sums the partial counts per
(lang, source, term), so a hot source or a frequent term reaches the shuffle as one row per task.

The audit. A term is kept in a language when at least ``min_docs`` of its documents hold it; V of them. A group
(lang, source) or a language with N occurrences of kept terms gives a kept term with count c the value
p = 1 + floor(1e9 * (c + 1) / (N + V)), exact in decimals. f(p, q) = floor((p - q)^2 / q).
Part ``pair``: for each other source of the language, the sum of f over all kept terms, q the other's p. Terms that
neither source holds share one p per source; they are counted, not listed, so the work is (cells held) x (sources of the
language). Part ``term``: for each kept term the group holds with p above the language's p, f against it; the first
``top_terms`` by value.

Defined cases. Null text, lang or source is ''. Terms are maximal runs of A-Z, a-z and non-ASCII characters, A-Z
lower-cased. Every occurring group takes part, also without terms; with V = 0 pair values are 0 and there are no terms.
A language with one source has no pair rows. Repeated rows count as documents each time. Ranks run from 1 by value
descending and item ascending (UTF-8 bytes); items are unique in a group and part, so ranks have no ties. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.llm.words import LOWER, U, slices, split
from furnacelens.session import materialise

# fixed values of the contract: term characters and the scale of p
TERM = np.zeros(256, bool)
TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BROADCAST_GROUPS = 200_000  # rows of the group table that may be broadcast; beyond, a salted join
SALTS = 64


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order of rows by uint64 ``keys``, most significant first: LSD radix sort, 16 bits a pass."""
    n = len(keys[0]) if keys else 0
    order = np.arange(n)
    for k in reversed(keys):
        for shift in range(0, 64, 16):
            digit = ((k[order] >> U(shift)) & U(0xFFFF)).astype(np.uint16)
            if digit.min(initial=0) == digit.max(initial=0):
                continue
            order = order[np.argsort(digit, kind="stable")]  # numpy sorts 16-bit keys by radix
    return order


def _runs(keys: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index, occurrences and distinct rows of each run of equal keys; ``keys`` sorted, ``row`` rising within runs."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, n])
    fresh = new.copy()
    fresh[1:] |= row[1:] != row[:-1]
    docs = np.add.reduceat(fresh.astype(np.int64), first)
    return first, count, docs


def term_counts(column: pa.Array, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(terms, group, occurrences, rows) of a slice: one entry per (group, term) present."""
    w = split(column, TERM, LOWER)
    data = LOWER[w.data]
    size = w.ends - w.starts
    g = group[w.row].astype(U)
    out_terms, out_group, out_count, out_docs = [], [], [], []
    short = size <= 16
    if short.any():
        idx = np.flatnonzero(short)
        at = w.starts[idx][:, None] + np.arange(16)
        mat = np.where(np.arange(16) < size[idx][:, None], data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8)
        words = mat.view(">u8").astype(U)
        hi, lo = words[:, 0].copy(), words[:, 1].copy()
        keys = [g[idx], hi, lo] if (size[idx] > 8).any() else [g[idx], hi]
        order = radix_order(keys)
        keys = [k[order] for k in keys]
        first, count, docs = _runs(keys, w.row[idx][order])
        packed = mat[order][first]
        length = (packed != 0).sum(1)
        flat = packed[np.arange(16) < length[:, None]]
        offsets = np.r_[0, np.cumsum(length)]
        out_terms.append(pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat.tobytes())]))
        out_group.append(keys[0][first]), out_count.append(count), out_docs.append(docs)
    for width in np.unique(size[~short]):  # a bucket per byte length, sorted as byte strings
        idx = np.flatnonzero(size == width)
        mat = data[w.starts[idx][:, None] + np.arange(width)]
        names, code = np.unique(mat.view(f"S{width}").ravel(), return_inverse=True)
        order = np.lexsort((w.row[idx], code, g[idx]))
        keys = [g[idx][order], code[order].astype(U)]
        first, count, docs = _runs(keys, w.row[idx][order])
        out_terms.append(pa.array([bytes(x) for x in names[keys[1][first].astype(np.int64)]], pa.binary()))
        out_group.append(keys[0][first]), out_count.append(count), out_docs.append(docs)
    return out_terms, out_group, out_count, out_docs


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, c, d): occurrences and documents of every term in every group."""

    def of(batches):
        for b in slices(batches, "text"):
            codes: dict = {}  # (lang, source) of each row: a step per document, not per term
            group = np.array([codes.setdefault(k, len(codes)) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            names = list(codes)
            terms, gs, cs, ds = term_counts(b.column(2), group)
            if not terms:
                continue
            g = np.concatenate(gs).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i][0] for i in g], pa.string()),
                    pa.array([names[i][1] for i in g], pa.string()),
                    pa.concat_arrays(terms).cast(pa.string()),
                    pa.array(np.concatenate(cs), pa.int64()),
                    pa.array(np.concatenate(ds), pa.int64()),
                ],
                ["lang", "source", "term", "c", "d"],
            )

    source = docs.select(
        F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(text_col).alias("text")
    )
    parts = source.mapInArrow(of, "lang string, source string, term string, c long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def _p(c: str, n: str, v: str) -> str:
    """1 + floor(SCALE * (c + 1) / (n + v)), exact; SQL text."""
    return f"CAST(1 + (CAST({SCALE} AS DECIMAL(38,0)) * CAST({c} + 1 AS DECIMAL(38,0))) div CAST({n} + {v} AS DECIMAL(38,0)) AS BIGINT)"


def _f_sql(p: str, q: str) -> str:
    """floor((p - q)^2 / q) in longs: p and q lie in 1 .. SCALE + 1, so the square stays below 2**63."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def _f(p: str, q: str):
    return F.expr(_f_sql(p, q))


def _with_languages(kept: DataFrame, langs: DataFrame, n_groups: int) -> DataFrame:
    """Each kept term with its language's row: a broadcast of the counted group table, else a join salted by term."""
    if n_groups <= BROADCAST_GROUPS:
        return kept.join(F.broadcast(langs), "lang")
    langs = langs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return kept.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(SALTS))).join(langs, ["lang", "_salt"]).drop("_salt")


# per kept term: p of each holding group (hp) and of the language (q); for every two groups that both hold it, what
# their pair takes beyond the histogram sums (the term's own f less its f against each one's p for terms it lacks)
TERM_ROW = {
    "hp": f"transform(held, x -> named_struct('s', x.s, 'c', x.c, 'p', {_p('x.c', 'element_at(nm, x.s)', 'V')}))",
    "q": _p("cl", "NL", "V"),
}
SHARED_ROWS = f"""flatten(transform(hp, x -> transform(filter(hp, y -> y.s != x.s), y -> named_struct('g', x.s, 'h', y.s,
  'e', {_f_sql('x.p', 'y.p')} - {_f_sql('x.p', 'element_at(zm, y.s)')} - {_f_sql('element_at(zm, x.s)', 'y.p')}))))"""


PAIR_CHUNK = 1 << 22  # pairs of holders listed at once in a task


def shared_pairs(hp: pa.ListArray, lang: pa.Array, keys: pa.Array, p0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, e, both) of one batch of term rows: per pair of group ids, the sum over terms both hold of
    f(p_g, p_h) - f(p_g, p0_h) - f(p0_g, p_h), and their number. Exact in int64 (every f is below 2**60)."""
    parent = hp.value_parent_indices().to_numpy().astype(np.int64)
    flat = hp.flatten()
    if not len(flat):
        return (np.zeros(0, np.int64),) * 4
    key = pc.binary_join_element_wise(lang.take(pa.array(parent)), flat.field("s"), "\x00")
    gid = pc.index_in(key, value_set=keys).to_numpy(zero_copy_only=False).astype(np.int64)
    p = flat.field("p").to_numpy(zero_copy_only=False).astype(np.int64)
    k = np.bincount(parent, minlength=len(hp))
    first = np.r_[0, np.cumsum(k)[:-1]]
    out_key, out_e = [], []
    terms = np.flatnonzero(k > 1)
    cost = np.cumsum(k[terms] ** 2)
    for chunk in np.split(terms, np.searchsorted(cost, np.arange(PAIR_CHUNK, cost[-1] if len(cost) else 0, PAIR_CHUNK))):
        if not len(chunk):
            continue
        elems = np.concatenate([np.arange(first[t], first[t] + k[t]) for t in chunk]) if len(chunk) < 64 else np.flatnonzero(np.isin(parent, chunk))
        size = k[parent[elems]]
        x = np.repeat(elems, size)
        block = np.repeat(np.cumsum(np.r_[0, size[:-1]]), size)
        y = np.repeat(first[parent[elems]], size) + (np.arange(len(x)) - block)
        keep = x != y
        x, y = x[keep], y[keep]
        px, py, zx, zy = p[x], p[y], p0[gid[x]], p0[gid[y]]
        out_e.append((px - py) ** 2 // py - (px - zy) ** 2 // zy - (zx - py) ** 2 // py)
        out_key.append(gid[x] * len(p0) + gid[y])
    if not out_key:
        return (np.zeros(0, np.int64),) * 4
    key, e = np.concatenate(out_key), np.concatenate(out_e)
    order = np.argsort(key, kind="stable")
    key, e = key[order], e[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts] // len(p0), key[starts] % len(p0), np.add.reduceat(e, starts), np.diff(np.r_[starts, len(key)])


def _shared(rows: DataFrame, groups: DataFrame, langs: DataFrame, n_groups: int) -> DataFrame:
    """(lang, g, h, e, both) of pairs of groups holding common terms: numpy over term rows with the group table
    broadcast (its size is counted), else Spark's generator over the same rows."""
    if n_groups > BROADCAST_GROUPS:
        pairs = _with_languages(rows, langs.select("lang", "zm"), n_groups).select("lang", F.explode(F.expr(SHARED_ROWS)).alias("r"))
        return pairs.groupBy("lang", "r.g", "r.h").agg(F.sum("r.e").alias("e"), F.count("*").alias("both"))
    table = groups.select("lang", "s", F.coalesce("p0", F.lit(1)).alias("p0")).orderBy("lang", "s").collect()  # at most BROADCAST_GROUPS rows
    shared = rows.sparkSession.sparkContext.broadcast(([f"{r.lang}\x00{r.s}" for r in table], np.array([r.p0 for r in table], np.int64)))

    def of(batches):
        names, p0 = shared.value
        keys = pa.array(names, pa.string())
        for b in batches:
            g, h, e, both = shared_pairs(b.column(1), b.column(0), keys, p0)
            if len(g):
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), pa.array(e), pa.array(both)], ["g", "h", "e", "both"])

    sums = rows.select("lang", "hp").mapInArrow(of, "g long, h long, e long, both long").groupBy("g", "h").agg(F.sum("e").alias("e"), F.sum("both").alias("both"))
    ids = rows.sparkSession.createDataFrame([(i, r.lang, r.s) for i, r in enumerate(table)], "i long, lang string, s string")
    sums = sums.join(F.broadcast(ids.withColumnsRenamed({"i": "g", "s": "gs"})), "g").join(F.broadcast(ids.select(F.col("i").alias("h"), F.col("s").alias("hs"))), "h")
    return sums.select("lang", F.col("gs").alias("g"), F.col("hs").alias("h"), "e", "both")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) as described above."""
    cells = counted(docs, text_col, lang_col, source_col)
    per_term = cells.groupBy("lang", "term").agg(F.sum("d").alias("df"), F.sum("c").alias("cl"), F.collect_list(F.struct(F.col("source").alias("s"), "c")).alias("held"))
    kept = materialise(per_term.filter(F.col("df") >= min_docs).drop("df"), "kept_terms")  # held: a pair per source at most
    size = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("cl").alias("NL"))
    held = kept.select("lang", F.inline("held")).groupBy("lang", "s").agg(F.sum("c").alias("N"), F.count("*").alias("T"))
    occurring = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("s")).distinct()
    groups = occurring.join(size, "lang", "left").join(held, ["lang", "s"], "left")
    groups = groups.select("lang", "s", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("V", "N", "T", "NL")])
    groups = materialise(groups.withColumn("p0", F.when(F.col("V") > 0, F.expr(_p("0", "N", "V")))), "groups")
    n_groups = groups.count()
    langs = groups.groupBy("lang").agg(F.first("V").alias("V"), F.first("NL").alias("NL"), F.collect_list(F.struct("s", "N", "p0")).alias("grp"))
    langs = langs.select(
        "lang", "V", "NL", F.map_from_entries(F.transform("grp", lambda y: F.struct(y["s"], y["N"]))).alias("nm"),
        F.map_from_entries(F.transform("grp", lambda y: F.struct(y["s"], y["p0"]))).alias("zm"),
    )
    rows = materialise(_with_languages(kept, langs, n_groups).withColumns({k: F.expr(v) for k, v in TERM_ROW.items()}).drop("held", "nm", "zm"), "term_rows")

    # part pair. Σ_t f(p_g, p_h) = Σ_{t in T_g} f(p_g, p0_h) + Σ_{t in T_h} f(p0_g, p_h) + Σ_{both hold t} (f(p_g, p_h) - the
    # two) + (V - |T_g ∪ T_h|) f(p0_g, p0_h). A group's p depends on the count alone, so the first two sums run over
    # histograms of (group, p); only pairs of groups that both hold a term are listed.
    shared = _shared(rows, groups, langs, n_groups)
    hist = rows.select("lang", F.inline("hp")).groupBy("lang", "s", "p").agg(F.count("*").alias("k"))
    g = groups.select("lang", F.col("s").alias("g"), "V", F.col("T").alias("tg"), F.col("p0").alias("p0g"))
    h = groups.select("lang", F.col("s").alias("h"), F.col("T").alias("th"), F.col("p0").alias("p0h"))
    pairs = g.join(h, "lang").filter(F.col("g") != F.col("h"))
    small = F.broadcast if n_groups <= BROADCAST_GROUPS else (lambda df: df)
    from_g = hist.withColumnRenamed("s", "g").join(small(h), "lang").filter(F.col("g") != F.col("h"))
    from_g = from_g.groupBy("lang", "g", "h").agg(F.sum(F.col("k") * _f("p", "p0h")).alias("sg"))
    from_h = hist.withColumnRenamed("s", "h").join(small(g.select("lang", "g", "p0g")), "lang").filter(F.col("g") != F.col("h"))
    from_h = from_h.groupBy("lang", "g", "h").agg(F.sum(F.col("k") * _f("p0g", "p")).alias("sh"))
    pairs = pairs.join(shared, ["lang", "g", "h"], "left").join(from_g, ["lang", "g", "h"], "left").join(from_h, ["lang", "g", "h"], "left")
    neither = F.col("V") - (F.col("tg") + F.col("th") - F.coalesce("both", F.lit(0)))
    total = F.coalesce("e", F.lit(0)) + F.coalesce("sg", F.lit(0)) + F.coalesce("sh", F.lit(0)) + neither * _f("p0g", "p0h")
    value = F.when(F.col("V") > 0, total).otherwise(F.lit(0))
    pairs = pairs.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), value.cast("long").alias("value"))
    order = [F.col("value").desc(), F.col("item").asc()]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    # part term: against the language's p; the first of each hash slice, then of the group
    above = rows.select("lang", "term", "q", F.explode(F.filter("hp", lambda x: x["p"] > F.col("q"))).alias("x"))
    terms = above.select("lang", F.col("x.s").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), _f("x.p", "q").alias("value"))
    spread = Window.partitionBy("lang", "source", "_s").orderBy(*order)
    terms = terms.withColumn("_s", F.pmod(F.xxhash64("item"), F.lit(SALTS))).withColumn("_r", F.row_number().over(spread)).filter(F.col("_r") <= top_terms)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).filter(F.col("rank") <= top_terms)
    cols = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*cols).unionByName(terms.select(*cols))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents
), t AS (
  SELECT lang, source, rid, translate(u.term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS u(term)
), cnt AS (
  SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS nd FROM t GROUP BY lang, source, term
), kept AS (
  SELECT lang, term FROM cnt GROUP BY lang, term HAVING sum(nd) >= 3
), vv AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c
  FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), n AS (
  SELECT lang, source, sum(c) AS n FROM dense GROUP BY lang, source
), nl AS (
  SELECT lang, sum(c) AS n FROM dense GROUP BY lang
), pg AS (
  SELECT dense.lang, dense.source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n.n + vv.v) AS p
  FROM dense JOIN n USING (lang, source) JOIN vv USING (lang)
), pl AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 1)) // (max(nl.n) + max(vv.v)) AS q
  FROM dense JOIN nl USING (lang) JOIN vv USING (lang) GROUP BY lang, term
), pair_sum AS (
  SELECT a.lang, a.source AS g, b.source AS h, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM pg a JOIN pg b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pair_sum s ON s.lang = x.lang AND s.g = x.source AND s.h = y.source
), terms AS (
  SELECT pg.lang, pg.source, 'term' AS part, pg.term AS item, ((pg.p - pl.q) * (pg.p - pl.q) // pl.q)::BIGINT AS value
  FROM pg JOIN pl USING (lang, term) WHERE pg.c > 0 AND pg.p > pl.q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
