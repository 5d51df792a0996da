"""Choosing rows by hash order: splits, samples and draws that do not depend on partitioning.

Ranking a whole class would sort it in one task. Ranks are found digit by digit instead: one
aggregate counts a class by the leading byte of the hash, which tells the byte that holds the wanted
rank; only rows with that byte are counted by their next byte, until few enough remain to be ranked.
A cut over a class becomes an exact threshold that applies to every row as a plain comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.functions.scalar import stable_hash

LEAF_ROWS = 200_000
DIGIT_BITS = 8
HASH_BITS = 32


def _prefix(level: int) -> Column:
    """The leading ``level`` bytes of the hash."""
    return F.shiftright(F.col("_h"), HASH_BITS - DIGIT_BITS * level) if level else F.lit(0).cast("long")


def class_sizes(df: DataFrame, by: str) -> dict:
    """Rows per class; one entry per class reaches the driver."""
    return {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}


def _beside(rows: DataFrame, small: DataFrame, by: str, other: str) -> DataFrame:
    """Inner join on (by, other) with a table bounded by the wanted ranks; a null class meets itself."""
    small = small.withColumnsRenamed({by: "_by", other: "_other"})
    met = rows.join(F.broadcast(small), F.col(by).eqNullSafe(F.col("_by")) & (F.col(other) == F.col("_other")))
    return met.drop("_by", "_other")


def rows_at_ranks(
    df: DataFrame, by: str, ident: str, seed: int | str, wanted: dict[object, list[int]], sizes: dict, *, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """The rows at the wanted 1-based ranks of each class in hash order, with ``_rank`` and ``_h``.

    The driver only holds one entry per wanted rank.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_h", stable_hash(ident, seed))
    key_type = df.schema[by].dataType.simpleString()
    schema = f"`{by}` {key_type}, _p long, _before long"
    open_groups = {(c, 0): (0, sizes[c]) for c, ks in wanted.items() if ks and c in sizes}
    leaves: list[tuple[int, dict]] = []
    level = 0
    while open_groups:
        small = {g: v for g, v in open_groups.items() if v[1] <= leaf_rows or level == HASH_BITS // DIGIT_BITS}
        if small:
            leaves.append((level, small))
        large = {g: v for g, v in open_groups.items() if g not in small}
        if not large:
            break
        marks = spark.createDataFrame([(c, p, b) for (c, p), (b, _n) in large.items()], schema)
        counted = (
            keyed.select(by, _prefix(level).alias("_p"), _prefix(level + 1).alias("_next"))
            .transform(lambda rows: _beside(rows, marks.drop("_before"), by, "_p"))  # at most one entry per wanted rank
            .groupBy(by, "_p", "_next").agg(F.count(F.lit(1)).alias("n"))
        )
        found: dict[tuple, list] = {}
        for r in counted.collect():  # 256 counts per open group
            found.setdefault((r[by], r["_p"]), []).append((r["_next"], r["n"]))
        open_groups = {}
        for (c, p), digits in found.items():
            at = large[(c, p)][0]
            for digit, n in sorted(digits):
                if any(at < k <= at + n for k in wanted[c]):
                    open_groups[(c, digit)] = (at, n)
                at += n
        level += 1
    ranks = spark.createDataFrame([(c, k) for c, ks in wanted.items() for k in sorted(set(ks))], f"`{by}` {key_type}, _rank long")
    parts = []
    for depth, groups in leaves:
        marks = spark.createDataFrame([(c, p, b) for (c, p), (b, _n) in groups.items()], schema)
        near = _beside(keyed.withColumn("_p", _prefix(depth)), marks, by, "_p")
        order = W.partitionBy(by, "_p").orderBy("_h", ident)  # at most leaf_rows rows
        ranked = near.withColumn("_rank", F.row_number().over(order) + F.col("_before")).drop("_p", "_before")
        parts.append(_beside(ranked, ranks, by, "_rank"))
    if not parts:
        return keyed.withColumn("_rank", F.lit(0).cast("long")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def thresholds(df: DataFrame, by: str, ident: str, seed: int | str, cuts: dict[object, list[int]], sizes: dict, **kw) -> dict:
    """(class, rank) -> (hash, id) of the row at that rank."""
    narrow = df.select(by, ident)
    rows = rows_at_ranks(narrow, by, ident, seed, cuts, sizes, **kw).collect()
    return {(r[by], r["_rank"]): (r["_h"], r[ident]) for r in rows}


def _upto(df: DataFrame, by: str, ident: str, seed: int | str, limits: dict[object, tuple | None]) -> Column:
    """True for rows at or before their class's threshold; no threshold means no row."""
    h, i, c = stable_hash(ident, seed), F.col(ident), F.col(by)
    id_type = df.schema[ident].dataType
    cond = F.lit(False)
    for value, limit in limits.items():
        if limit is None:
            continue
        same = c.isNull() if value is None else c == F.lit(value)
        cond = cond | (same & ((h < F.lit(limit[0])) | ((h == F.lit(limit[0])) & (i <= F.lit(limit[1]).cast(id_type)))))
    return F.coalesce(cond, F.lit(False))


def stratified_split(
    df: DataFrame, label: str, ident: str, *, seed: int = 42, ratio: tuple[float, float] = (0.70, 0.15), out: str = "split", **kw
) -> DataFrame:
    """Tag rows train / valid / test so that each class is divided in the given ratio. No full shuffle."""
    sizes = class_sizes(df, label)
    first = {c: int(n * ratio[0] + 0.5) for c, n in sizes.items()}
    second = {c: int(n * (ratio[0] + ratio[1]) + 0.5) for c, n in sizes.items()}
    cuts = {c: [k for k in (first[c], second[c]) if k > 0] for c in sizes}
    at = thresholds(df, label, ident, seed, cuts, sizes, **kw)
    train = _upto(df, label, ident, seed, {c: at.get((c, k)) for c, k in first.items()})
    valid = _upto(df, label, ident, seed, {c: at.get((c, k)) for c, k in second.items()})
    return df.withColumn(out, F.when(train, "train").when(valid, "valid").otherwise("test"))


def first_by_hash(df: DataFrame, n: int, ident: str, *, by: str | None = None, seed: int = 42, **kw) -> DataFrame:
    """Exactly n rows (or all) per class in hash order: a sample without replacement, found by a filter."""
    work, key = (df, by) if by else (df.withColumn("_all", F.lit(0)), "_all")
    sizes = class_sizes(work, key)
    cuts = {c: [min(n, size)] for c, size in sizes.items() if n > 0}
    at = thresholds(work, key, ident, seed, cuts, sizes, **kw)
    picked = work.filter(_upto(work, key, ident, seed, {c: at.get((c, ks[0])) for c, ks in cuts.items()}))
    return picked if by else picked.drop("_all")


def draw_with_replacement(
    df: DataFrame, draws: list[dict], ident: str, *, by: str, seed: int | str = 42, order_seed: int | str = "order", **kw
) -> DataFrame:
    """One uniformly drawn row per draw.

    Each draw is a dict with ``class``, a unique ``key`` and further columns to carry. The rank drawn is
    a hash of the key modulo the class size; only rows near the drawn ranks are moved.
    """
    import hashlib

    sizes = class_sizes(df, by)
    rows, wanted = [], {}
    for d in draws:
        size = sizes.get(d["class"], 0)
        if not size:
            raise ValueError(f"class {d['class']!r} has no rows to draw from")
        text = f"{d['key']}|{d.get('seed', seed)}"
        rank = int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % size + 1
        wanted.setdefault(d["class"], []).append(rank)
        rows.append({by: d["class"], "_rank": rank, **{k: v for k, v in d.items() if k not in ("class", "key", "seed")}})
    picked = rows_at_ranks(df, by, ident, order_seed, wanted, sizes, **kw).drop("_h")
    extra = [k for k in rows[0] if k not in (by, "_rank")] if rows else []
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    schema = T.StructType([T.StructField("_by", df.schema[by].dataType), T.StructField("_r", T.LongType())]
                          + [T.StructField(k, kinds[type(rows[0][k])]) for k in extra])
    drawn = df.sparkSession.createDataFrame([(r[by], r["_rank"], *[r[k] for k in extra]) for r in rows], schema)
    # one row per draw, made on the driver; a null class meets itself
    met = picked.join(F.broadcast(drawn), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_rank") == F.col("_r")))
    return met.drop("_by", "_r", "_rank")
