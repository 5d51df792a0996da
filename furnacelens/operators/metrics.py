"""Evaluation of scored tables: (id, label, prediction, prob_0..prob_3) in, metric tables out.

Counts are aggregated to the classes-by-classes matrix first; everything derived from it works on
that handful of rows. Rank metrics go through merged value runs (see ``ranked``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furnacelens.constants import RISK_CLASSES
from furnacelens.operators.ranked import value_runs

CLASSES = range(len(RISK_CLASSES))
PROBS = [f"prob_{k}" for k in CLASSES]


def class_name(index: Column | str) -> Column:
    c = F.col(index) if isinstance(index, str) else index
    return F.try_element_at(F.array(*[F.lit(n) for n in RISK_CLASSES]), c.cast("int") + F.lit(1))


def first_argmax(probs: list[str]) -> Column:
    """Index of the largest probability; the first one wins a tie."""
    arr = F.array(*[F.col(p) for p in probs])
    return (F.array_position(arr, F.array_max(arr)) - F.lit(1)).cast("int")


def score_columns(df: DataFrame, probs: list[str] = PROBS) -> DataFrame:
    return df.withColumns({
        "prediction": first_argmax(probs),
        "confidence": F.greatest(*[F.col(p) for p in probs]),
    }).withColumn("predicted_class", class_name("prediction"))


def confusion_long(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All cells of the matrix as rows, empty ones included. A null or unknown class stops the job."""
    spark = df.sparkSession
    stop = F.raise_error(F.lit("null or unknown class among labels or predictions")).cast("int")

    def known(c: str) -> Column:
        # inside the grouping key, where no filter the optimizer infers can get ahead of it
        return F.when(F.col(c).cast("int").isin(list(CLASSES)), F.col(c).cast("int")).otherwise(stop)

    counts = df.groupBy(known(label).alias("label"), known(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )
    grid = spark.createDataFrame([(a, b) for a in CLASSES for b in CLASSES], "label int, prediction int")
    return grid.join(counts, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per actual class, one column per predicted class."""
    cells = confusion_long(df, label, prediction)
    return cells.groupBy("label").agg(*[
        F.sum(F.when(F.col("prediction") == k, F.col("n")).otherwise(F.lit(0))).alias(f"pred_{k}") for k in CLASSES
    ])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from the long matrix; undefined ratios are 0."""
    both = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")),
    )
    sides = cells.select(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hit"), (F.col("prediction") < F.col("label")).alias("low"), F.inline(both))
    sums = sides.groupBy("class").agg(
        F.sum(F.when(F.col("a") > 0, F.col("hit")).otherwise(F.lit(0))).alias("tp"),
        F.sum("a").alias("support"), F.sum("p").alias("predicted"),
        F.sum(F.when(F.col("low"), F.col("a")).otherwise(F.lit(0))).alias("under"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    out = sums.withColumns({"precision": precision, "recall": recall})
    f1 = F.when(
        F.col("precision") + F.col("recall") > 0,
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")),
    ).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def averaged(classes: DataFrame) -> DataFrame:
    """Macro and weighted precision, recall and F1 over the classes that occur."""
    present = classes.filter((F.col("support") > 0) | (F.col("predicted") > 0))
    total = F.sum("support")
    return present.agg(*[
        e for m in ("precision", "recall", "f1") for e in (
            F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / total).alias(f"{m}_weighted"))
    ])


def accuracy_summary(cells: DataFrame) -> DataFrame:
    """Counts, accuracy, and the mean recall of the classes that occur."""
    sums = per_class(cells).agg(
        F.sum("support").alias("total"), F.sum("tp").alias("correct"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )
    return sums.select(
        "total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"),
        (F.col("correct") / F.col("total")).alias("accuracy"), "balanced_accuracy",
    )


def benchmark_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, macro F1, recall of the critical class and under-prediction rate, in one row."""
    classes = per_class(confusion_long(df, label, prediction))
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    risky = F.col("class") > 0
    return classes.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg(F.when(present, F.col("f1"))).alias("macro_f1"),
        F.max(F.when(F.col("class") == len(RISK_CLASSES) - 1, F.col("recall"))).alias("critical_recall"),
        _ratio(F.sum(F.when(risky, F.col("under"))), F.sum(F.when(risky, F.col("support")))).alias("under_prediction_rate"),
    )


def one_vs_rest_runs(df: DataFrame, label: str = "label", **ranking) -> DataFrame:
    """Per class and distinct score, descending: rows and positives, here and at higher scores."""
    cols = {str(k): f"prob_{k}" for k in CLASSES}
    positives = {str(k): (F.col(label) == k).cast("int") for k in CLASSES}
    return value_runs(df, cols, {"tp": positives}, descending=True, **ranking)


def roc_auc(df: DataFrame, label: str = "label", **ranking) -> DataFrame:
    """One-vs-rest AUC per class by rank sums, ties at their average rank; null when a side is empty."""
    runs = one_vs_rest_runs(df, label, **ranking)
    # among descending scores, rank from the bottom = N - rank from the top + 1
    mid_from_top = F.col("n_before") + (F.col("n") + F.lit(1)) / F.lit(2.0)
    sums = runs.groupBy(F.col("name").cast("int").alias("class")).agg(
        F.sum("n").cast("double").alias("rows"), F.sum("tp").alias("pos"), F.sum(mid_from_top * F.col("tp")).alias("from_top")
    )
    rank_sum = F.col("pos") * (F.col("rows") + 1) - F.col("from_top")
    neg = F.col("rows") - F.col("pos")
    auc = F.try_divide(rank_sum - F.col("pos") * (F.col("pos") + 1) / F.lit(2.0), F.col("pos") * neg)
    return sums.select("class", auc.alias("auc"))


def roc_auc_macro(df: DataFrame, label: str = "label", **ranking) -> DataFrame:
    """Macro average; 0.0 when any class is absent, as the score is then undefined."""
    per = roc_auc(df, label, **ranking)
    return per.agg(
        F.when((F.count_if(F.col("auc").isNull()) == 0) & (F.count(F.lit(1)) == len(RISK_CLASSES)), F.avg("auc"))
        .otherwise(F.lit(0.0)).alias("roc_auc_macro")
    )


def pr_curve(df: DataFrame, label: str = "label", **ranking) -> DataFrame:
    """Precision and recall at every distinct score of every class."""
    runs = one_vs_rest_runs(df, label, **ranking)
    tp, seen = F.col("tp") + F.col("tp_before"), F.col("n") + F.col("n_before")
    # class totals: one row per class
    totals = df.agg(*[F.count_if(F.col(label) == k).cast("double").alias(f"p{k}") for k in CLASSES])
    pos = totals.select(F.inline(F.array(*[F.struct(F.lit(str(k)).alias("name"), F.col(f"p{k}").alias("pos")) for k in CLASSES])))
    joined = runs.join(F.broadcast(pos), "name")
    return joined.select(
        F.col("name").cast("int").alias("class"), F.col("value").alias("threshold"),
        (tp / seen).alias("precision"), _ratio(tp, F.col("pos")).alias("recall"),
        _ratio(F.col("tp"), F.col("pos")).alias("recall_step"),
    )


def average_precision(df: DataFrame, label: str = "label", **ranking) -> DataFrame:
    curve = pr_curve(df, label, **ranking)
    return curve.groupBy("class").agg(F.sum(F.col("recall_step") * F.col("precision")).alias("average_precision"))


def _class_long(df: DataFrame, label: str) -> DataFrame:
    items = F.array(*[
        F.struct(F.lit(k).alias("class"), F.col(f"prob_{k}").alias("p"), (F.col(label) == k).cast("double").alias("y"))
        for k in CLASSES
    ])
    return df.select(F.inline(items))


def calibration(df: DataFrame, label: str = "label", bins: int = 10) -> DataFrame:
    """Mean score and share of positives per uniform, right-closed bin; empty bins are absent."""
    bin_ = F.greatest(F.lit(0), F.ceil(F.col("p") * F.lit(float(bins))) - F.lit(1)).cast("int")
    return _class_long(df, label).groupBy("class", bin_.alias("bin")).agg(
        F.avg("p").alias("mean_predicted"), F.avg("y").alias("fraction_positive"), F.count(F.lit(1)).alias("n")
    )


def probability_density(df: DataFrame, label: str = "label", bins: int = 50) -> DataFrame:
    """Binned density of each class probability on a fixed grid over [0, 1]."""
    bin_ = F.least(F.lit(bins - 1), F.floor(F.col("p") * F.lit(float(bins)))).cast("int")
    counts = _class_long(df, label).groupBy("class", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy("class"))  # at most bins rows per class
    return counts.withColumn("density", F.col("n") / total * F.lit(float(bins)))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed. Two passes, both map-side combined."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    width = ((hi - lo) / bins) or 1.0
    bin_ = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(lo)) / F.lit(width))).cast("int")
    counts = df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))


def transitions(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Kinds of error with their share of all errors, most frequent first."""
    wrong = df.filter(F.col(actual) != F.col(predicted)).groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))
    wrong = wrong.withColumn("_one", F.lit(0))  # classes x classes rows
    share = F.col("n") / F.sum("n").over(W.partitionBy("_one"))
    return wrong.withColumn("share", share).drop("_one").orderBy(F.desc("n"), actual, predicted)


def misclassified(df: DataFrame, actual: str, predicted: str, ident: str) -> DataFrame:
    """Wrong rows with their 1-based position in the full table.

    Only the id column is numbered, slice by slice; the wide rows that move are the wrong ones. They are
    written first: scoring then runs once, and its expressions stay out of the join's plan.
    """
    from furnacelens.operators.ordered import global_row_number
    from furnacelens.session import materialise

    wrong = materialise(df.filter(F.col(actual) != F.col(predicted)), "misclassified-rows")
    numbered = global_row_number(df.select(ident), ident, "Row_Number")
    return wrong.join(numbered, ident)


def metrics_report(df: DataFrame, label: str = "label", confidence: str = "confidence", **ranking) -> DataFrame:
    """The whole report in long form: section, name, value."""
    cells = confusion_long(df, label)
    classes = per_class(cells)

    def long(one: DataFrame, section: str) -> DataFrame:
        items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in one.columns])
        return one.select(F.lit(section).alias("section"), F.inline(items))

    by_class = classes.select(F.lit("class").alias("section"), F.inline(F.array(*[
        F.struct(F.concat(class_name("class"), F.lit(f" {m}")).alias("name"), F.col(m).cast("double").alias("value"))
        for m in ("precision", "recall", "f1", "support")
    ])))
    matrix = cells.select(
        F.lit("confusion").alias("section"),
        F.concat(class_name("label"), F.lit(" -> "), class_name("prediction")).alias("name"), F.col("n").cast("double").alias("value"),
    )
    parts = [
        long(accuracy_summary(cells), "overall"), long(averaged(classes), "averages"), by_class, matrix,
        long(roc_auc_macro(df, label, **ranking), "ranking"),
        long(df.agg(F.avg(confidence).alias("mean_confidence")), "confidence"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
