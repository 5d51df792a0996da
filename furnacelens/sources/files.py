"""File sources and sinks: CSV, JSON, parquet, rule catalogue, chronological replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.catalogues import RULE_FIELDS, RULES

RULE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RULE_FIELDS])
TEXT_NULL = "\u0001null\u0001"


def read_training_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with an explicit schema; the reader splits large files by itself."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV where the word None and empty strings are ordinary text, never null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True)
    read = reader.option("nullValue", TEXT_NULL).option("emptyValue", "").csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])  # an unquoted blank is empty text


def write_csv(df: DataFrame, path: str, *, text_safe: bool = False) -> str:
    writer = df.write.option("header", True)
    if text_safe:
        writer = writer.option("nullValue", TEXT_NULL)
    writer.csv(path)
    return path


def write_feature_sets(df: DataFrame, feature_sets: dict[str, list[str]], label: str, path: str) -> str:
    """One parquet table partitioned by feature set and split; readers prune to what they need."""
    for name, features in feature_sets.items():
        (
            df.select(*[F.col(f"`{c}`") for c in features], label, "split", F.lit(name).alias("feature_set"))
            .write.mode("append").partitionBy("feature_set", "split").parquet(path)
        )
    return path


def load_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Rule catalogue: the built-in one, a JSON array file, or no rules when the file is absent."""
    if path is None:
        return spark.createDataFrame(RULES, RULE_SCHEMA)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(jvm_path):
        return spark.createDataFrame([], RULE_SCHEMA)
    return spark.read.schema(RULE_SCHEMA).option("multiLine", True).json(path)


def structure_report(
    df: DataFrame, target: str, *, expected_rows: int | None = None, expected_columns: int | None = None
) -> DataFrame:
    """Row and column counts, target presence, verdict; unexpected counts only warn."""
    n_cols, has_target = len(df.columns), target in df.columns
    rows = F.count(F.lit(1))
    error = None if has_target else f"Target column '{target}' not found"
    return df.agg(rows.alias("rows")).select(
        "rows",
        F.lit(n_cols).alias("columns"),
        F.lit(has_target).alias("target_present"),
        (F.lit(expected_rows is not None) & (F.col("rows") != F.lit(expected_rows or 0))).alias("rows_unexpected"),
        F.lit(expected_columns is not None and n_cols != expected_columns).alias("columns_unexpected"),
        F.lit(has_target).alias("success"),
        F.lit(error).cast("string").alias("error"),
    )


def footprint_mb(df: DataFrame) -> DataFrame:
    """Estimated table size: text by its bytes, every other value as 8 bytes."""
    def width(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
        return F.lit(8).cast("long")

    total = width(df.schema.fields[0])
    for f in df.schema.fields[1:]:
        total = total + width(f)
    return df.agg((F.sum(total) / F.lit(1048576.0)).alias("footprint_mb"))


def decode_packets(raw: DataFrame, column: str = "payload", out: str = "packet") -> DataFrame:
    """JSON text to a string map; text that is not one whole JSON object becomes null."""
    parsed = F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"})
    alone = F.json_array_length(F.concat(F.lit("["), F.col(column), F.lit("]"))) == 1  # null where anything else stands beside it
    opens = F.trim(column).startswith("{") & F.trim(column).endswith("}") & alone
    return raw.withColumn(out, F.when(opens, parsed))


def replay(df: DataFrame, ts_text: str, limit: int, tiebreak: str) -> DataFrame:
    """The first rows in time order; planned as a top-k, not a full sort."""
    return df.orderBy(F.col(ts_text), F.col(tiebreak)).limit(limit)
