"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

DataFrame and SQL functions only. Base spans, per kind leftmost and non-overlapping: ``assign`` (a key word, optional
quote, ``:`` or ``=``, a value whose group of 12 characters or more survives), ``access`` (AKIA keys of 18 characters
or more) and ``hex`` (lower-case hex of 16 or more). ``split`` and ``regexp_extract_all`` walk one pattern alike, so the
pieces between matches and the matches interleave; a running sum of their lengths in a window per row gives each
match's start in code points. (Matches of ``AKIA[A-Z0-9]+`` and ``[0-9a-f]+`` shorter than the limit never overlap
a longer one, so the length goes into the pattern; the assign pattern keeps its test on group 2.)

The method adds spans of kind ``random``. Candidates are runs of ``min_length`` or more base64 / URL-safe characters.
Each is tested against "characters drawn uniformly from the alphabet its characters imply" (hex 16, alphanumeric 62,
base64 64, each split into classes: digits, upper, lower, symbols):
* alphabet uniformity: the chi-squared statistic as collisions, S = sum of squared character counts, with exact mean
  L + L(L-1)/K and variance 2L(L-1)(K-1)/K^2 (pairs sharing a position are uncorrelated); too many repeats reject;
* runs: changes of character class between neighbours against (L-1) q, q = 1 - sum of squared class shares, with the
  variance of 1-dependent indicators; too few changes (words, long runs) reject;
* serial correlation of neighbouring code points, about N(-1/L, 1/L); either sign rejects.
The battery's p-value is three times the least (Bonferroni). Benjamini-Hochberg at ``fdr`` runs per stratum of
encoding and length band (2**k to 2**(k+1) - 1 characters), since power grows with length: counts of p-values on a
grid of ``GRID_STEPS`` steps a decade give, per stratum, the largest grid point t with t <= fdr * R(t) / m, a
self-consistent step-up set. Candidates not rejected look random and are reported unless they overlap a base span.

Defined cases. Null text is empty: no spans, base_sha256 of the empty string. Rows are scanned as they are: repeated
rows give repeated results; null ids stay null. Ties of start order by kind: assign, access, hex, random. Other columns
are ignored. Skew: no grouping by any key of the data; rows are dealt by a row number to compute positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.session import materialise

# fixed values of the contract
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GROUP = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
HEX_LENGTH = 16
# the same classes with each character named: Java looks them up in one bitmap instead of range after range
CANDIDATE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
HEX_NAMED = f"[0123456789abcdef]{{{HEX_LENGTH},}}"
ASSIGN_AHEAD = "(?=[pPsStTaA])" + ASSIGN  # its first letters, tested at once
KEY_WORDS = ("passw", "secret", "token", "apikey", "api_key")  # one of them is in every match of ASSIGN
KINDS = ("assign", "access", "hex", "random")
# parameters of the method
MIN_LENGTH = 20
FDR = 0.01
GRID_STEPS = 10  # grid points a decade of p
GRID_DECADES = 40
ALPHABETS = {  # size and class shares (digits, upper, lower, symbols)
    "hex": (16, (10, 6, 0, 0)),
    "alnum": (62, (10, 26, 26, 0)),
    "base64": (64, (10, 26, 26, 2)),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a column named in a lambda is computed anew for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Array of (kind, order, i, piece length before, match length, group length, match) of each match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    parts = [F.split(text, pattern, -1).alias("piece"), matches, *([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group")] if group else [])]
    return F.transform(
        F.filter(F.arrays_zip(*parts), lambda x: x["match"].isNotNull()),  # there is a piece more than matches
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ko"), i.alias("i"), F.length(x["piece"]).alias("before"),
            F.length(x["match"]).alias("size"), F.length(x["group" if group else "match"]).alias("group"),
            (x["match"] if kind == "random" else F.lit(None).cast("string")).alias("token"),
        ),
    )


def _gates(text: Column, run: int) -> dict[str, Column]:
    """Per kind whether ``text`` may have a match; a text without it is spared the kind's patterns.

    The key words are sought in the lower-cased text, which keeps every ASCII match of them. One walk over the runs of
    candidate characters, none of it repeated, tells whether one is long enough for ``hex`` or ``random``.
    """
    low = F.lower(text)
    words = low.contains(KEY_WORDS[0])
    for w in KEY_WORDS[1:]:
        words = words | low.contains(w)
    long_run = text.rlike(rf"\A(?:[{CANDIDATE}]{{0,{run - 1}}}+[^{CANDIDATE}]++)*+[{CANDIDATE}]{{{run}}}")
    return {"assign": words, "access": text.contains("AKIA"), "hex": long_run, "random": long_run}


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), Abramowitz-Stegun 7.1.26 (absolute error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)  # P(N > |z|)
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(token: Column) -> Column:
    """(encoding, p): the battery's Bonferroni p-value that ``token`` is uniform over its implied alphabet."""
    return _let(F.split(token, ""), lambda chars: _let(F.transform(chars, lambda c: F.ascii(c)), lambda codes: _battery(token, chars, codes)))


def _battery(token: Column, chars: Column, codes: Column) -> Column:
    n = F.length(token).cast("double")
    enc = F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Za-z0-9]+$"), "alnum").otherwise("base64")
    size = F.when(enc == "hex", 16.0).when(enc == "alnum", 62.0).otherwise(64.0)
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(token) - F.length(F.replace(token, c)))
    s = F.aggregate(counts, F.lit(0).cast("long"), lambda a, k: a + k * k).cast("double")
    z_repeat = (s - (n + n * (n - 1) / size)) / F.sqrt(2 * n * (n - 1) * (size - 1) / (size * size))

    def cls(a: Column) -> Column:
        return F.when(a.between(48, 57), 0).when(a.between(65, 90), 1).when(a.between(97, 122), 2).otherwise(3)

    neighbours = F.slice(codes, F.lit(2), F.length(token) - 1)
    changes = F.zip_with(F.slice(codes, F.lit(1), F.length(token) - 1), neighbours, lambda x, y: F.when(cls(x) != cls(y), 1).otherwise(0))
    changes = F.aggregate(changes, F.lit(0), lambda a, x: a + x).cast("double")
    shares = {k: [x / a for x in c] for k, (a, c) in ALPHABETS.items()}
    sq = F.when(enc == "hex", sum(x * x for x in shares["hex"])).when(enc == "alnum", sum(x * x for x in shares["alnum"])).otherwise(sum(x * x for x in shares["base64"]))
    tri = {k: sum(x * (1 - x) ** 2 for x in v) for k, v in shares.items()}
    cube = F.when(enc == "hex", tri["hex"]).when(enc == "alnum", tri["alnum"]).otherwise(tri["base64"])
    q = 1 - sq
    var_changes = (n - 1) * q * (1 - q) + 2 * (n - 2) * (cube - q * q)
    z_runs = ((n - 1) * q - changes) / F.sqrt(F.greatest(var_changes, F.lit(1e-12)))

    total = F.aggregate(codes, F.lit(0.0), lambda a, v: a + v)
    dev = _let(total / n, lambda mean: F.transform(codes, lambda v: v.cast("double") - mean))

    def correlation(dev: Column) -> Column:
        products = F.zip_with(F.slice(dev, F.lit(1), F.length(token) - 1), F.slice(dev, F.lit(2), F.length(token) - 1), lambda x, y: x * y)
        num = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
        den = F.aggregate(dev, F.lit(0.0), lambda a, v: a + v * v)
        return _let(den, lambda den: F.when(den > 0, num / den).otherwise(F.lit(1.0)))

    r = _let(dev, correlation)
    z_corr = F.abs(r + 1 / n) * F.sqrt(n)
    tails = [_let(z, _upper_tail) for z in (z_repeat, z_runs, z_corr)]
    p = F.least(F.lit(1.0), 3 * F.least(tails[0], tails[1], 2 * tails[2]))
    return F.struct(enc.alias("enc"), p.alias("p"))


def thresholds(cands: DataFrame, fdr: float) -> DataFrame:
    """(enc, band, cut): candidates of a stratum with grid bin >= cut are rejected as not random."""
    counted = cands.groupBy("enc", "band", "bin").agg(F.count("*").alias("k"))
    stratum = Window.partitionBy("enc", "band")
    counted = counted.withColumn("m", F.sum("k").over(stratum)).withColumn("R", F.sum("k").over(stratum.orderBy(F.col("bin").desc())))
    ok = F.pow(F.lit(10.0), -F.col("bin") / GRID_STEPS) <= fdr * F.col("R") / F.col("m")
    return counted.filter(ok).groupBy("enc", "band").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, fdr: float = FDR) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), text.alias("_text"))
    gates = _gates(F.col("_text"), min(HEX_LENGTH, min_length))
    numbered = numbered.select("*", *[gates[k].alias(f"_{k}") for k in KINDS[:3]])
    part = {k: F.when(F.col(f"_{'hex' if k == 'random' else k}"), F.col("_text")).otherwise(F.lit("")) for k in KINDS}
    every = F.concat(
        _found(part["assign"], ASSIGN_AHEAD, "assign", 2), _found(part["access"], ACCESS, "access"), _found(part["hex"], HEX_NAMED, "hex"),
        _found(part["random"], f"[{CANDIDATE}]{{{min_length},}}", "random"),
    )
    rows = numbered.select("_row", "_id", F.explode_outer(every).alias("x"))
    rows = rows.select("_row", "_id", "x.kind", "x.ko", "x.i", "x.before", "x.size", "x.group", F.when(F.col("x.kind") == "random", battery(F.col("x.token"))).alias("t"))
    bins = F.least(F.floor(-GRID_STEPS * F.log10(F.greatest(F.col("t.p"), F.lit(1e-300)))), F.lit(GRID_STEPS * GRID_DECADES)).cast("int")
    band = F.floor(F.log2(F.col("size"))).cast("int")
    rows = materialise(rows.select("_row", "_id", "kind", "ko", "i", "before", "size", "group", F.col("t.enc").alias("enc"), F.col("t.p").alias("p"), bins.alias("bin"), band.alias("band")), "secret_rows")
    cuts = thresholds(rows.filter(F.col("kind") == "random"), fdr)  # a row per stratum: encodings x length bands

    rows = rows.join(F.broadcast(cuts), ["enc", "band"], "left").repartition("_row")
    kind_rows = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(kind_rows)).withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind").isin("assign", "access", "hex") & ((F.col("kind") != "assign") | (F.col("group") >= ASSIGN_GROUP))
    random = (F.col("kind") == "random") & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    rows = rows.withColumn("base", F.coalesce(base, F.lit(False)))
    by_start = Window.partitionBy("_row").orderBy("start")
    base_end = F.max(F.when(F.col("base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    base_next = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    clear = ~((F.coalesce(base_end, F.lit(-1)) > F.col("start")) | (F.coalesce(base_next, F.col("end")) < F.col("end")))
    rows = rows.withColumn("keep", F.col("base") | F.coalesce(random & clear, F.lit(False)))
    span = F.struct("start", "ko", "kind", "end")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    out = rows.groupBy("_row", "_id").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:3]],
        F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(F.when(F.col("keep"), span)).alias("a"),
    )
    return out.select(
        F.col("_id").alias(id_col), "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("b")), 256).alias("base_sha256"), joined(F.col("a")).alias("spans")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
