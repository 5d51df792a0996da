"""Phrase collocation mining by top-order marginalisation.

Every word position of a piece gives one lead window of three words from it on, padded with nulls where the piece
ends or the phrase is too rare to count. Only these longest windows are counted; Spark's ROLLUP over (lang, w1, w2, w3)
then sums successively shorter prefixes, so one grouping yields the counts of all phrases of 1, 2 and 3 words and the
number of words of each language, with no separate explosion per length (grouping_id tells the levels apart; a padded
window is no phrase of its level). A candidate of 2 to 3 words occurring ``min_count`` times or more is scored at each cut into a first part
and the rest, floor(1e6 * a^2 / (l * r)); the lowest cut counts, ties to the smallest cut. A candidate lying inside a
longer candidate that occurs at least half as often is dropped. Each language keeps its first ``top`` by score, count
and phrase.

Defined cases. Null text is empty, null lang is ``und``. Only A-Z are lower-cased. Pieces end at . , ; : ! ? and
\\x0A-\\x0D; words are runs of anything but space and tab. Arithmetic is exact (decimals; products may pass 64 bits).
Repeated rows count each time. An empty table, or one without candidates, gives no rows. Other columns are ignored.
Words and phrases are compared by 64-bit hashes within a task, by their text across tasks.
Skew: equal windows are added up map side before the shuffle, so a frequent word or a hot language reaches it as one row
per task; the top rows of a language are chosen per hash slice first, then among the slices' winners.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furnacelens.llm import buckets
from furnacelens.llm.words import LOWER, U, mix, salted, slices, split
from furnacelens.session import materialise

# fixed values of the contract
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[0x20, 0x09]] = False
MIN_COUNT = 10
HALF = 50  # percent of a candidate's count that a longer one must reach to absorb it
TOP = 2000
SLICES = 64
HELD = 400_000  # windows of some slices that a task adds up at once
BATCH = 50_000


def _hashes(b: pa.RecordBatch):
    """(words, word and pair in one piece with the next, pair hashes, triple hashes, languages, language of each row).

    Hashes are of 64 bits and take in the language; a last word has no pair, the last two have no triple.
    """
    w = split(b.column(1), IN_WORD, LOWER)
    langs = pc.fill_null(b.column(0), "und").dictionary_encode()
    salt = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], U)
    code = langs.indices.to_numpy()
    # pieces ended before each byte
    ended = np.concatenate([[0], np.cumsum(ENDS_PIECE[w.data])])
    linked = (w.row[:-1] == w.row[1:]) & (ended[w.ends[:-1]] == ended[w.starts[1:]])
    one = mix(w.hash + salt[code[w.row]]) if len(w.row) else w.hash
    pair = mix(one[:-1] + salted(w.hash[1:], 2))
    return w, linked, one, pair, mix(pair[:-1] + salted(w.hash[2:], 3)), langs.dictionary, code


def _columns(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))


def frequent_pairs(docs: DataFrame, min_count: int):
    """Bitmap of the pairs that may occur ``min_count`` times or more."""
    def keys(batches):
        for b in slices(batches, "text"):
            _, linked, _, pair, *_ = _hashes(b)
            yield pair[linked]

    return buckets.frequent(docs, keys, min_count)


def frequent_triples(docs: DataFrame, pairs, min_count: int):
    """Bitmap of the triples that may; both pairs of such a triple do."""
    def keys(batches):
        for b in slices(batches, "text"):
            _, linked, _, pair, triple, *_ = _hashes(b)
            hot = linked & buckets.passes(pairs.value, pair)
            yield triple[hot[:-1] & hot[1:]]

    return buckets.frequent(docs, keys, min_count)


def lead_windows(docs: DataFrame, pairs, triples) -> DataFrame:
    """(lang, w1, w2, w3, c): each word with the words after it in its piece, cut where a phrase is rare, and how often.

    Equal windows of a task are added up, some hundred thousand at a time.
    """
    def merged(held):
        keys, counts, rows = (list(x) for x in zip(*held))
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        _, at, which = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(which, counts, len(at)).astype(np.int64)
        t = pa.Table.from_batches(rows).take(pa.array(at)).append_column("c", pa.array(total))
        yield from t.combine_chunks().to_batches(BATCH)

    def of(batches):
        held, n = [], 0
        for b in slices(batches, "text"):
            w, linked, one, pair, triple, langs, code = _hashes(b)
            m = len(w.hash)
            if not m:
                continue
            two, three = np.zeros(m, bool), np.zeros(m, bool)
            two[:-1] = linked & buckets.passes(pairs.value, pair)
            three[:-2] = two[:-2] & two[1:-1] & buckets.passes(triples.value, triple) if m > 2 else False
            key = one.copy()
            key[:-1][two[:-1]] = pair[two[:-1]]
            if m > 2:
                key[:-2][three[:-2]] = triple[three[:-2]]
            key, at, counts = np.unique(key, return_index=True, return_counts=True)
            _, first, word = np.unique(w.hash, return_index=True, return_inverse=True)
            text = LOWER[w.data].tobytes()
            names = pa.array([text[i:j] for i, j in zip(w.starts[first].tolist(), w.ends[first].tolist())], pa.binary()).cast(pa.string())

            def words(step, kept):
                return names.take(pa.array(word[np.minimum(at + step, m - 1)], mask=~kept[at]))

            columns = [langs.take(pa.array(code[w.row[at]])), names.take(pa.array(word[at])), words(1, two), words(2, three)]
            held.append((key, counts, pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "w3"])))
            n += len(key)
            if n >= HELD:
                yield from merged(held)
                held, n = [], 0
        if held:
            yield from merged(held)

    return docs.mapInArrow(of, "lang string, w1 string, w2 string, w3 string, c long")


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> DataFrame:
    """(level, lang, w1, w2, w3, f): level 3, 2, 1 for phrases of that many words, 0 for all words of the language.

    Counts are exact for every word and for every pair and triple occurring ``min_count`` times or more: a window keeps
    its second word only where its first pair may be frequent and its third only where the triple and both its pairs
    may, since a phrase occurs no more often than any part of it. Pairs and then triples are judged by counts of hash
    buckets, which miss no frequent phrase. Shorter phrases are cut where they cannot count, and the trailing nulls of
    the rollup then gather them.
    """
    docs = _columns(docs, text_col, lang_col)
    pairs = frequent_pairs(docs, min_count)
    triples = frequent_triples(docs, pairs, min_count)
    windows = lead_windows(docs, pairs, triples).groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("c"))
    rolled = windows.rollup("lang", "w1", "w2", "w3").agg(F.sum("c").alias("f"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 0, 3).when(F.col("gid") == 1, 2).when(F.col("gid") == 3, 1).when(F.col("gid") == 7, 0)
    useful = (F.col("gid") == 0) & F.col("w3").isNotNull() | (F.col("gid") == 1) & F.col("w2").isNotNull() | F.col("gid").isin(3, 7)
    return rolled.filter(useful).select(level.alias("level"), "lang", "w1", "w2", "w3", "f")


def _score(a: str, l: str, r: str):
    return F.expr(f"(CAST(1000000 AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0)) * CAST({a} AS DECIMAL(38,0))) div (CAST({l} AS DECIMAL(38,0)) * CAST({r} AS DECIMAL(38,0)))")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` collocations."""
    # every count read below is of a candidate or of a part of one, so at least min_count: only those are written
    counts = phrase_counts(docs, text_col, lang_col, min_count)
    counts = materialise(counts.filter((F.col("level") == 0) | (F.col("f") >= min_count)), "phrase_counts")
    uni = counts.filter("level = 1").select("lang", F.col("w1").alias("u"), F.col("f").alias("fu"))
    bi = counts.filter("level = 2").select("lang", F.col("w1").alias("b1"), F.col("w2").alias("b2"), F.col("f").alias("fb"))
    n = counts.filter("level = 0").select("lang", F.col("f").alias("n"))
    pairs = counts.filter(f"level = 2 AND f >= {min_count}").select("lang", "w1", "w2", F.col("f").alias("a"))
    triples = materialise(counts.filter(f"level = 3 AND f >= {min_count}").select("lang", "w1", "w2", "w3", F.col("f").alias("a")), "triples")

    def unigram(df, word, name):
        return df.join(uni.withColumnsRenamed({"u": word, "fu": name}), ["lang", word])

    # a pair inside a triple that occurs at least HALF percent as often goes
    inside = triples.select("lang", "w1", "w2", F.col("a").alias("t")).unionByName(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.col("a").alias("t")))
    pairs = pairs.join(inside, (pairs.lang == inside.lang) & (pairs.w1 == inside.w1) & (pairs.w2 == inside.w2) & (100 * inside.t >= HALF * pairs.a), "left_anti")
    pairs = unigram(unigram(pairs, "w1", "l"), "w2", "r")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))

    t = unigram(triples, "w1", "l1").join(bi.withColumnsRenamed({"b1": "w2", "b2": "w3", "fb": "r1"}), ["lang", "w2", "w3"])
    t = unigram(t.join(bi.withColumnsRenamed({"b1": "w1", "b2": "w2", "fb": "l2"}), ["lang", "w1", "w2"]), "w3", "r2")
    t = t.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    second = F.col("s2") < F.col("s1")
    t = t.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    found = pairs.unionByName(t).join(n, "lang")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    found = found.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    found = found.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("_r") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), pos AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws[i] AS w1, CASE WHEN i + 1 <= len(ws) THEN ws[i + 1] END AS w2, CASE WHEN i + 2 <= len(ws) THEN ws[i + 2] END AS w3 FROM pos
), uni AS (SELECT lang, w1, count(*)::HUGEINT AS f FROM g GROUP BY lang, w1
), bi AS (SELECT lang, w1, w2, count(*)::HUGEINT AS f FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
), tri AS (SELECT lang, w1, w2, w3, count(*)::HUGEINT AS f FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3
), n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang
), tc AS (SELECT * FROM tri WHERE f >= 10
), bc AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, u1.f AS l, u2.f AS r, (1000000 * b.f * b.f) // (u1.f * u2.f) AS score
  FROM bi b JOIN uni u1 ON u1.lang = b.lang AND u1.w1 = b.w1 JOIN uni u2 ON u2.lang = b.lang AND u2.w1 = b.w2
  WHERE b.f >= 10 AND NOT EXISTS (
    SELECT 1 FROM tc WHERE tc.lang = b.lang AND 100 * tc.f >= 50 * b.f AND ((tc.w1 = b.w1 AND tc.w2 = b.w2) OR (tc.w2 = b.w1 AND tc.w3 = b.w2))
  )
), tcs AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, u1.f AS l1, b23.f AS r1, b12.f AS l2, u3.f AS r2,
    (1000000 * t.f * t.f) // (u1.f * b23.f) AS s1, (1000000 * t.f * t.f) // (b12.f * u3.f) AS s2
  FROM tc t JOIN uni u1 ON u1.lang = t.lang AND u1.w1 = t.w1 JOIN bi b23 ON b23.lang = t.lang AND b23.w1 = t.w2 AND b23.w2 = t.w3
  JOIN bi b12 ON b12.lang = t.lang AND b12.w1 = t.w1 AND b12.w2 = t.w2 JOIN uni u3 ON u3.lang = t.lang AND u3.w1 = t.w3
), allc AS (
  SELECT lang, phrase, a, l, r, score FROM bc
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2) FROM tcs
), ranked AS (
  SELECT allc.*, n.n, row_number() OVER (PARTITION BY allc.lang ORDER BY score DESC, a DESC, phrase ASC) AS rank FROM allc JOIN n USING (lang)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
