"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads again for the next. All
but the last return the columns of the documents. Defined cases: a null or letterless text is rejected by the first
stage; rows with one id are one document to the joins by id; an empty table stays empty. Extra columns pass through all
stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furnacelens.llm import op1_packing, op3_language, op4_line_dedup, op6_decontamination, op8_ngram_jaccard
from furnacelens.llm.tokens import DROPPED, vocabulary
from furnacelens.session import materialise

LEAST_SCORE = 0.5  # of a language's share of the words


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``chosen``; a null id matches a null id."""
    ids = chosen.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects text without a letter and text of which no language holds half."""
    found = op3_language.identify(docs, op3_language.train(docs))
    return _only(docs, found.filter((F.col("lang_pred") != op3_language.UND) & (F.col("score") >= LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs; a document of which nothing is left goes. ``n_chars`` follows the text."""
    found = op4_line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group; five-word shingles, likeness 0.8 or more."""
    found = op8_ngram_jaccard.jaccard_components(docs, k=5, num=80, den=100)
    return _only(docs, found.filter(F.col("component_id").isNull() | F.col("component_id").eqNullSafe(F.col("doc_id"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lies in passages of the benchmark."""
    found = op6_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _only(docs, found.filter(~op6_decontamination.contaminated()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences."""
    return op1_packing.pack(docs, vocabulary("word_bpe_49k.json"), DROPPED, end_id=2, with_ids=False)


STAGES = [
    ("language", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]

ORACLE_SQL = None  # language ID and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
