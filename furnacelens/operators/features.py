"""Feature catalogue, ranking by five methods, and feature sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.constants import (
    DOMAIN_OTHER,
    DOMAIN_RULES,
    FEATURE_SET_SIZES,
    LEAKAGE_CATEGORY,
    LEAKAGE_COLUMNS,
    RISK_CLASSES,
    SEED,
)
from furnacelens.operators.quantiles import exact_quantiles
from furnacelens.operators.ranked import value_runs
from furnacelens.operators.selection import first_by_hash
from furnacelens.operators.vector import to_vector

SAMPLE_ROWS = 5000
MI_BINS = 10
METRICS = ["Variance", "Correlation", "Mutual_Information", "RF_Importance", "ET_Importance"]


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def remove_leakage(df: DataFrame) -> tuple[DataFrame, list[str]]:
    removed = [c for c in LEAKAGE_COLUMNS if c in df.columns]
    return df.drop(*removed), removed


def removal_report(df: DataFrame, removed: Sequence[str]) -> DataFrame:
    def category(c: str) -> str:
        return "Active Safety Rule" if c.startswith("Rule_") else LEAKAGE_CATEGORY.get(c, "State Metadata")

    return df.sparkSession.createDataFrame([(c, category(c)) for c in removed], "column string, category string")


def label_index(label: str | Column, *, unknown: int | None = None) -> Column:
    """Low..Critical as 0..3; an unknown label becomes ``unknown`` (null by default)."""
    c = F.col(label) if isinstance(label, str) else label
    pairs = [x for i, name in enumerate(RISK_CLASSES) for x in (F.lit(name), F.lit(i))]
    mapped = F.try_element_at(F.create_map(*pairs), c)
    return mapped if unknown is None else F.coalesce(mapped, F.lit(unknown))


def unknown_labels(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels that are not risk classes."""
    known = df.sparkSession.createDataFrame([(c,) for c in RISK_CLASSES], f"{label} string")
    return df.select(label).distinct().join(F.broadcast(known), label, "left_anti")


def domain_of(column: Column) -> Column:
    expr = None
    for domain, marks in DOMAIN_RULES:
        cond = reduce(lambda a, b: a | b, [column.contains(m) for m in marks])
        expr = F.when(cond, domain) if expr is None else expr.when(cond, domain)
    return expr.otherwise(DOMAIN_OTHER)


def data_type_of(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType):
        return "Boolean"
    if isinstance(field.dataType, T.StringType) or field.name in ("Shift_Type", "PPE_Compliance"):
        return "Categorical"
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integer"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return "Float"
    return "Numeric"


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and exact distinct values per column.

    Values are merged per (column, value) before they are counted, so a column with few values moves
    few rows and one with many spreads over all tasks.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("Feature_Name"), q(c).cast("string").alias("v")) for c in columns])
    merged = df.select(F.inline(pairs)).groupBy("Feature_Name", "v").agg(F.count(F.lit(1)).alias("n"))
    return merged.groupBy("Feature_Name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("Null_Count"),
        F.count("v").alias("Unique_Values"),
    )


def feature_catalogue(df: DataFrame, *, exclude: Sequence[str] = ("Timestamp", "Future_Risk_Level")) -> DataFrame:
    fields = [f for f in df.schema.fields if f.name not in exclude]
    names = df.sparkSession.createDataFrame(
        [(f.name, data_type_of(f)) for f in fields], "Feature_Name string, Data_Type string"
    ).withColumn("Domain_Area", domain_of(F.col("Feature_Name")))
    return names.join(column_profile(df, [f.name for f in fields]), "Feature_Name")


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[q(f.name) for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])


def _long_from_one_row(row_df: DataFrame, columns: Sequence[str], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), q(c).cast("double").alias(value)) for c in columns])
    return row_df.select(F.inline(pairs))


def variances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _long_from_one_row(df.agg(*[F.var_samp(q(c)).alias(c) for c in columns]), columns, "Variance")


def spearman(df: DataFrame, columns: Sequence[str], label: str, **ranking) -> DataFrame:
    """Absolute rank correlation with the label, ties at their average rank, null as 0.

    Label ranks come from the class counts; feature ranks from merged value runs. All five sums of the
    correlation are then sums over runs, so ranked rows never join back to the data.
    """
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    below, ranks = 0, []
    for k in sorted(counts):
        ranks += [F.lit(k), F.lit(below + (counts[k] + 1) / 2)]
        below += counts[k]
    rank_y = F.try_element_at(F.create_map(*ranks), F.col(label))
    runs = value_runs(
        df, {c: c for c in columns},
        {"ry": {c: rank_y for c in columns}, "ry2": {c: rank_y * rank_y for c in columns}}, **ranking,
    )
    rx = F.col("n_before") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    n = F.sum("n").cast("double")
    sx, sxx, sxy = F.sum(rx * F.col("n")), F.sum(rx * rx * F.col("n")), F.sum(rx * F.col("ry"))
    sy, syy = F.sum("ry"), F.sum("ry2")
    var_x, var_y = n * sxx - sx * sx, n * syy - sy * sy
    corr = F.try_divide(n * sxy - sx * sy, F.sqrt(var_x) * F.sqrt(var_y))
    return runs.groupBy(F.col("name").alias("feature")).agg(F.coalesce(F.abs(corr), F.lit(0.0)).alias("Correlation"))


def mutual_information(df: DataFrame, columns: Sequence[str], label: str, *, bins: int = MI_BINS) -> DataFrame:
    """Mutual information of the quantile-binned feature with the label, in nats."""
    edges = exact_quantiles(df, columns, [i / bins for i in range(1, bins)], discrete=True)

    def bin_of(c: str) -> Column:
        return reduce(lambda a, b: a + b, [(q(c) > F.lit(e)).cast("int") for e in sorted(set(edges[c]))])

    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bin")) for c in columns])
    joint = df.select(F.col(label).alias("y"), F.inline(pairs)).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # features x bins x classes rows from here on
    sums = joint.withColumns({
        "nx": F.sum("n").over(W.partitionBy("feature", "bin")), "ny": F.sum("n").over(W.partitionBy("feature", "y")),
        "nn": F.sum("n").over(W.partitionBy("feature")),
    })
    term = F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")))
    return sums.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("Mutual_Information"))


def _importances(df: DataFrame, columns: Sequence[str], label: str, out: str, *, extra: bool, trees: int, depth: int, seed: int) -> DataFrame:
    model = forest(label, extra=extra, trees=trees, depth=depth, seed=seed).fit(to_vector(df, columns))
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, f"feature string, {out} double")


def forest(label: str, *, extra: bool = False, trees: int = 50, depth: int = 8, seed: int = SEED, features: str = "features") -> RandomForestClassifier:
    """Random forest; ``extra`` is the closest Spark has to extra trees: no bootstrap, few candidate cuts."""
    if extra:
        return RandomForestClassifier(
            featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False,
            featureSubsetStrategy="sqrt", maxBins=8,
        )
    return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def rank_metrics(metrics_long: DataFrame) -> DataFrame:
    """Ranks within each metric, largest first, equal values sharing the smallest rank."""
    order = W.partitionBy("metric").orderBy(F.desc("value"))  # one row per feature and metric
    return metrics_long.withColumn("rank", F.rank().over(order))


def average_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("feature").agg(F.avg("rank").alias("Average_Rank"))


def to_metrics_long(wide: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    return wide.select("feature", F.inline(pairs))


def rank_features(
    df: DataFrame, columns: Sequence[str], label: str, ident: str, *, trees: int = 50, depth: int = 8, sample: int = SAMPLE_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """All five metrics with ranks and the average rank. Trees see the sample; the rest sees every row."""
    sampled = first_by_hash(df.select(ident, label, *[q(c) for c in columns]), sample, ident, seed=seed)
    parts = [
        variances(df, columns), spearman(df, columns, label), mutual_information(df, columns, label),
        _importances(sampled, columns, label, "RF_Importance", extra=False, trees=trees, depth=depth, seed=seed),
        _importances(sampled, columns, label, "ET_Importance", extra=True, trees=trees, depth=depth, seed=seed),
    ]
    wide = reduce(lambda a, b: a.join(b, "feature"), parts)
    ranked = rank_metrics(to_metrics_long(wide, METRICS))
    ranks = ranked.groupBy("feature").pivot("metric", METRICS).agg(F.first("rank"))
    named = ranks.select("feature", *[F.col(m).alias(f"{m}_Rank") for m in METRICS])
    return wide.join(named, "feature").join(average_ranks(ranked), "feature").orderBy("Average_Rank", "feature")


def feature_sets(averages: DataFrame, sizes: dict[str, int | None] = FEATURE_SET_SIZES) -> DataFrame:
    """(feature_set, position, feature); input has one row per feature."""
    placed = averages.withColumn("_one", F.lit(0)).withColumn(
        "position", F.row_number().over(W.partitionBy("_one").orderBy("Average_Rank", "feature"))
    )
    sets = F.array(*[F.struct(F.lit(n).alias("feature_set"), F.lit(k).cast("int").alias("_k")) for n, k in sizes.items()])
    expanded = placed.select("position", "feature", F.inline(sets))
    return expanded.filter(F.col("_k").isNull() | (F.col("position") <= F.col("_k"))).select("feature_set", "position", "feature")
