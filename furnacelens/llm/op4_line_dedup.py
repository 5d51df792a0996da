"""Line dedup: repeated runs of lines, found by prefix doubling over line ids. DataFrame functions only.

Every document is a sequence of line ids (128-bit hashes). A run is a stretch of whole lines with ``min_words`` words or
more; from each line on there is one least such run. Suffixes are named by their first 2**k lines, doubling k: the name
of a block is the place of its first occurrence in (id, line) order, found by grouping pairs of names of half the
length. Suffixes with one name are one longest-common-prefix interval of that depth; those alone in theirs are settled
and leave, so each round handles only what still repeats. The least run of a line is named by the two blocks of a power
of two that cover it; where that name is not its own place, an earlier copy exists and the run is deleted. Overlapping
deleted runs join to the maximal repeated runs, of which the first copy stays. Doubling ends when blocks are as long
as the longest least run (at most ``min_words`` lines), since longer repeats are unions of least runs.

Defined cases. Words of a line: blanks + 1, so a blank line counts one. Null text stays null, empty text empty; neither
has lines. A document whose lines all go has empty text. Rows alike in id and text are one document and are treated
alike; a null id counts as the smallest. Other columns pass through unless they bear a result's name.
Skew: names are grouped map side first, and joined back by joins that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.session import materialise

NULL_ID = -(1 << 63)
KEY = ["_o", "_h"]


def _keys(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_o"), F.xxhash64(text_col).alias("_h")]


def line_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_o, _h, i, a, b, w): each line's number, id and words."""
    lines = docs.filter(F.col(text_col) != "").select(*_keys(id_col, text_col), F.posexplode(F.split(text_col, "\n")).alias("i", "line"))
    words = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    return lines.select(*KEY, "i", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), words.cast("long").alias("w"))


def _named(rows: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """Rows whose ``by`` occurs again, with the place of its first occurrence as (no, nh, ni)."""
    first = rows.groupBy(*by).agg(F.min(F.struct(*KEY, "i")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    first = first.select(*by, F.col("f._o").alias("no"), F.col("f._h").alias("nh"), F.col("f.i").alias("ni"))
    return rows.join(first, by).select(*KEY, "i", *keep, "no", "nh", "ni")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """(_o, _h, runs): of each document the maximal runs of lines [s, e) of which an earlier copy exists."""
    every = materialise(line_ids(docs, id_col, text_col).dropDuplicates([*KEY, "i"]), "lines")
    level = _named(every, ["a", "b"], ["w"])
    # stretches of lines that all repeat; sums of words within them
    level = level.withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy(*KEY).orderBy("i")))
    line = Window.partitionBy(*KEY, "g").orderBy("i")
    level = level.withColumn("upto", F.sum("w").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    need = F.col("upto") - F.col("w") + min_words
    short = sum([F.coalesce((F.lead("upto", j).over(line) < need).cast("int"), F.lit(0)) for j in range(min_words - 1)], F.lit(0))
    level = level.withColumn("size", short + 1)
    level = level.withColumn("fits", need <= F.max("upto").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level = materialise(level.select(*KEY, "i", "size", "fits", "no", "nh", "ni"), "level")
    late, h = [], 1
    while h <= min_words:
        # least runs of h to 2h - 1 lines: their first and last h lines name them
        ends = level.select(*KEY, F.col("i").alias("j"), F.col("no").alias("lo"), F.col("nh").alias("lh"), F.col("ni").alias("li"))
        runs = level.filter(F.col("fits") & (F.col("size") >= h) & (F.col("size") < 2 * h)).withColumn("j", F.col("i") + F.col("size") - h)
        runs = runs.join(ends, [*KEY, "j"]).select(*KEY, "i", "size", "no", "nh", "ni", "lo", "lh", "li")
        again = _named(runs.withColumnsRenamed({"no": "xo", "nh": "xh", "ni": "xi"}), ["size", "xo", "xh", "xi", "lo", "lh", "li"], ["size"])
        late.append(again.filter("no <> _o OR nh <> _h OR ni <> i").select(*KEY, F.col("i").alias("s"), (F.col("i") + F.col("size")).alias("e")))
        h *= 2
        if h > min_words:
            break
        # with the name of the block that follows
        other = level.select(*KEY, (F.col("i") - h // 2).alias("i"), F.col("no").alias("ro"), F.col("nh").alias("rh"), F.col("ni").alias("ri"))
        pairs = level.join(other, [*KEY, "i"]).withColumnsRenamed({"no": "xo", "nh": "xh", "ni": "xi"})
        level = materialise(_named(pairs, ["xo", "xh", "xi", "ro", "rh", "ri"], ["size", "fits"]), "level")
        if level.isEmpty():
            break
    found = late[0]
    for x in late[1:]:
        found = found.unionByName(x)
    order = Window.partitionBy(*KEY).orderBy("s")
    fresh = F.coalesce((F.col("s") > F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    found = found.withColumn("fresh", fresh).withColumn("n", F.sum("fresh").over(order))
    islands = found.groupBy(*KEY, "n").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return islands.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """The rows with ``text_col`` less its repeated runs, and n_lines, n_removed (null text: 0)."""
    runs = repeated_runs(docs, id_col, text_col, min_words)
    clean = docs.drop("n_lines", "n_removed", *KEY, "_runs", "_lines").withColumns(dict(zip(KEY, _keys(id_col, text_col))))
    whole = clean.join(runs, KEY, "left").withColumn("_lines", F.when(F.col(text_col) != "", F.split(text_col, "\n")))
    kept = F.filter("_lines", lambda x, i: ~F.exists("_runs", lambda r: (i >= r["s"]) & (i < r["e"])))
    removed = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["e"] - r["s"])
    return whole.withColumns({
        text_col: F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.coalesce(removed, F.lit(0).cast("long")),
    }).drop(*KEY, "_runs", "_lines")


def query(spark, sf_dir: str) -> DataFrame:
    docs = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
l AS (SELECT doc_id, ls, list_transform(ls, lambda x: len(x) - len(replace(x, ' ', '')) + 1) AS ws, unnest(range(1, len(ls) + 1)) AS i FROM d),
s AS (SELECT doc_id, ls, i, min(n) AS n FROM (SELECT doc_id, ls, i, ws, unnest(range(1, 1 + least(13, len(ls) - i + 1))) AS n FROM l)
  WHERE list_sum(ws[i:i + n - 1]) >= 13 GROUP BY ALL),
r AS (SELECT doc_id, i, n, array_to_string(ls[i:i + n - 1], chr(10)) AS g FROM s),
late AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM late),
kept AS (SELECT doc_id, string_agg(ls[i], chr(10) ORDER BY i) AS t, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
