"""Risk classifiers with Spark ML, and the benchmark that compares them."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.constants import RISK_CLASSES, SEED
from furnacelens.operators.features import forest
from furnacelens.operators.metrics import benchmark_metrics, score_columns

# Model sizes.
LOGISTIC_ITERATIONS = 200
FOREST_SIZE = (50, 8)
BOOST_SIZE = (100, 6)
BOOST_STEP = 0.1


def logistic(label: str, iterations: int = LOGISTIC_ITERATIONS) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=label, family="multinomial", maxIter=iterations)


def boosted(label: str, iterations: int = BOOST_SIZE[0], depth: int = BOOST_SIZE[1], parallelism: int = 4) -> OneVsRest:
    """Spark boosts two classes only; one booster per class gives the four-class model."""
    booster = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=BOOST_STEP, seed=SEED)
    return OneVsRest(classifier=booster, featuresCol="features", labelCol=label, parallelism=parallelism)


def candidates(
    label: str, *, iterations: int = LOGISTIC_ITERATIONS, trees: tuple[int, int] = FOREST_SIZE, boost: tuple[int, int] = BOOST_SIZE
) -> dict:
    return {
        "Logistic Regression": logistic(label, iterations),
        "Random Forest": forest(label, trees=trees[0], depth=trees[1]),
        "Extra Trees": forest(label, extra=True, trees=trees[0], depth=trees[1]),
        "Gradient Boosting": boosted(label, *boost),
    }


def as_stages(estimator, features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator])


def class_probabilities(scored: DataFrame) -> DataFrame:
    """prob_0..prob_3 from a fitted model's output.

    One-vs-rest boosting only reports margins; its probabilities are the logistic of twice the margin,
    normalised over the classes.
    """
    if "probability" in scored.columns:
        arr = vector_to_array("probability")
        probs = {f"prob_{k}": F.coalesce(F.get(arr, k), F.lit(0.0)) for k in range(len(RISK_CLASSES))}
        return scored.withColumns(probs)
    margins = vector_to_array("rawPrediction")
    raw = [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.coalesce(F.get(margins, k), F.lit(-1e3)))) for k in range(len(RISK_CLASSES))]
    staged = scored.withColumns({f"_s{k}": r for k, r in enumerate(raw)})
    total = reduce(lambda a, b: a + b, [F.col(f"_s{k}") for k in range(len(RISK_CLASSES))])
    return staged.withColumns({f"prob_{k}": F.col(f"_s{k}") / total for k in range(len(RISK_CLASSES))}).drop(
        *[f"_s{k}" for k in range(len(RISK_CLASSES))]
    )


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probabilities, first-max prediction, class and confidence on any table, batch or stream."""
    scored = class_probabilities(model.transform(df)).drop("prediction", "rawPrediction", "probability", "features")
    return score_columns(scored)


def train_and_compare(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, models: dict) -> tuple[DataFrame, dict]:
    """Fit every candidate and report its test metrics and fit time; returns the table and the models."""
    spark = train.sparkSession
    fitted, rows = {}, []
    for name, estimator in models.items():
        started = time.perf_counter()
        fitted[name] = as_stages(estimator, features).fit(train)
        seconds = time.perf_counter() - started
        m = benchmark_metrics(score(fitted[name], test), label).first()
        rows.append((name, m["accuracy"], m["macro_f1"], m["critical_recall"], m["under_prediction_rate"], seconds))
    table = spark.createDataFrame(
        rows, "model string, accuracy double, macro_f1 double, critical_recall double, under_prediction_rate double, fit_seconds double"
    )
    return table.orderBy(F.desc("macro_f1"), "model"), fitted
