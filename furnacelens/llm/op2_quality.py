"""Document quality by hierarchical empirical Bayes.

Evidence of a document: a logistic model over counts of its whole text, fitted on at most ``sample_rows`` labelled rows.
Sites form levels, here hosts and paths within them. Each level's rate of good documents (labels where given, else the
model's probability) comes from one grouped aggregation and is shrunk toward the level above it: with n documents and
prior strength k, (sum + k * parent) / (n + k), where k follows from how much the sites differ beyond chance (method of
moments), so sparse sites stay near the global rate. A document's own share is left out of its sites' rates. Its quality
adds the log odds of its path to its evidence relative to the base rate.

Defined cases. Null text is empty text. A null host or path is a site of its own. Labels of several rows of one document
are averaged. Repeated rows are scored alike. Without labels the evidence is even and the base rate 0.5. Other columns
are ignored. Skew: sites are aggregated map side first; the site tables are joined back by size (broadcast only below
the session's limit, else by joins that AQE may split).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.llm.words import LOWER, NON_SPACE, distinct_by, slices, split
from furnacelens.session import materialise

NAMES = ("words", "length", "letters", "upper", "digits", "marks", "wide", "distinct", "repeats", "lines", "heavy", "short", "twins", "ends")


def text_features(column: pa.Array) -> np.ndarray:
    """Rows by NAMES: shares and logarithms of counts over whole texts."""
    w = split(column, NON_SPACE)
    d, n = w.data, len(column)

    def count(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return (c[w.offsets[1:]] - c[w.offsets[:-1]]).astype(float)

    low = LOWER[d]
    letter = (low >= 97) & (low <= 122)
    wide, digit, newline = d >= 128, (d >= 48) & (d <= 57), d == 10
    mark = (d > 32) & (d < 127) & ~letter & ~digit
    twin = np.concatenate([[False], mark[1:] & mark[:-1]]) if len(d) else mark
    size, words = np.maximum(np.diff(w.offsets), 1), np.maximum(w.counts, 1)
    by = lambda rows: np.bincount(rows, minlength=n).astype(float)
    again = w.row[1:][(w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])] if len(w.hash) else w.row
    long_ = w.ends - w.starts
    plain = (d[w.starts] >= 97) & (d[w.starts] <= 122) if len(d) else np.zeros(0, bool)
    return np.stack([
        np.log1p(w.counts), np.log1p(size / words), count(letter) / size, count(letter & (low != d)) / size, count(digit) / size, count(mark) / size,
        count(wide) / size, by(w.row[distinct_by(w.hash, w.row)]) / words, by(again) / words, np.log1p(count(newline)), by(w.row[long_ > 20]) / words,
        by(w.row[long_ < 4]) / words, count(twin) / size, by(w.row[plain]) / words,
    ], 1)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a logistic model on values and squares, by Newton steps."""
    x = np.concatenate([x, x**2], 1)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.append((x - mean) / scale, np.ones((len(x), 1)), 1)
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(b)), z.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, b


def evidence_table(docs: DataFrame, host: str, path: str, id_col: str, text_col: str) -> DataFrame:
    """(doc, host, path, f): features of every row, without its text."""
    def of(batches):
        for b in slices(batches, "text"):
            x = text_features(b.column(3))
            f = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], f], ["doc", "host", "path", "f"])

    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(text_col).alias("text"))
    return source.mapInArrow(of, "doc long, host string, path string, f array<double>")


def strength(sites: DataFrame, parent: str, total: int) -> float:
    """Prior strength from the spread of site means about their parents, beyond that of chance."""
    v = F.greatest(F.col(parent) * (1 - F.col(parent)), F.lit(1e-6))
    r = sites.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), 2)).alias("spread"), F.sum(v).alias("chance"), F.avg(v).alias("v")).first()
    tau = max(((r.spread or 0.0) - (r.chance or 0.0)) / max(total, 1), 1e-6)
    return min(1e6, max(1.0, (r.v or 0.25) / tau - 1))


def quality(docs: DataFrame, labels: DataFrame, host: str, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """(id, host, path, evidence, host_rate, path_rate, quality, keep) of every row."""
    spark = docs.sparkSession
    table = materialise(evidence_table(docs, host, path, id_col, text_col), "evidence")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    table = table.join(known, "doc", "left")
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    rows = table.filter(F.col("y").isNotNull() & (F.pmod(F.xxhash64("doc", F.lit(5)), F.lit(1 << 20)) < share * (1 << 20))).select("f", "y").collect()
    y = np.array([r.y for r in rows])
    model, base = None, 0.5
    if len(rows) and 0 < y.mean() < 1:
        model, base = fit(np.array([r.f for r in rows]), y), float(y.mean())
    if model:
        mean, scale, b = model
        k = len(NAMES)
        w = b[:-1] / scale
        score = F.lit(float(b[-1] - (mean * w).sum()))
        for j in range(k):
            score = score + F.col("f")[j] * float(w[j]) + F.col("f")[j] * F.col("f")[j] * float(w[k + j])
    else:
        score = F.lit(0.0)
    score = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), score))
    q = materialise(table.select("doc", "host", "path", score.alias("score")).withColumn("p", 1 / (1 + F.exp(-F.col("score")))).join(known, "doc", "left").select(
        "doc", "host", "path", "score", F.coalesce("y", "p").alias("q")), "rates")
    paths = q.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("q").alias("s"))
    paths = materialise(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    top = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    total, mu = top.n or 0, (top.s or 0.0) / max(top.n or 0, 1)
    mu = min(max(mu, 1e-3), 1 - 1e-3) if total else base
    k1 = strength(hosts.withColumn("mu", F.lit(mu)), "mu", total)
    hosts = hosts.withColumn("rate", (F.col("s") + k1 * mu) / (F.col("n") + k1))
    sites = paths.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).select(
        F.col("a.host").alias("h"), F.col("a.path").alias("t"), F.col("a.n").alias("n"), F.col("a.s").alias("s"), F.col("b.n").alias("hn"), F.col("b.s").alias("hs"), F.col("b.rate").alias("rate"))
    sites = materialise(sites, "sites")
    k2 = strength(sites, "rate", total)
    whole = q.join(sites, q["host"].eqNullSafe(sites["h"]) & q["path"].eqNullSafe(sites["t"]))
    host_rate = (F.col("hs") - F.col("q") + k1 * mu) / (F.col("hn") - 1 + k1)
    path_rate = (F.col("s") - F.col("q") + k2 * F.col("host_rate")) / (F.col("n") - 1 + k2)
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_rate")))
    logit = F.log(clipped / (1 - clipped)) + F.col("evidence")
    return (
        whole.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
        .withColumn("evidence", F.col("score") - float(np.log(base / (1 - base))))
        .withColumn("quality", 1 / (1 + F.exp(-logit)))
        .select(F.col("doc").alias(id_col), "host", "path", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= 0.5).alias("keep"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    """Hosts are the sources; a source's paths are its languages, the documents having no address of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "source", "lang")
