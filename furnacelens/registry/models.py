"""Model queries: training (J), scoring (K2, K3, K18), tree attribution (L) and their sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.constants import RAW_SENSORS
from furnacelens.operators import attribution as A
from furnacelens.operators import features as I
from furnacelens.operators import metrics as K
from furnacelens.operators import training as J
from furnacelens.operators.selection import first_by_hash, stratified_split
from furnacelens.plans import flow
from furnacelens.registry.base import labelled, query
from furnacelens.session import materialise, scratch_path

FEATURES = RAW_SENSORS
BOOST_QUERY_SIZE = (20, 5)  # the library default is 100 rounds of depth 6


def split_table(spark, sf):
    t = labelled(spark, sf).withColumn("label", I.label_index("Future_Risk_Level").cast("double"))
    return stratified_split(t, "Future_Risk_Level", "event_id")


def train_test(spark, sf):
    """Both splits as written tables: every training pass then reads columns, not the view behind them."""
    t = materialise(split_table(spark, sf), "split")
    return t.filter("split = 'train'"), t.filter("split = 'test'")


def fit(spark, sf, estimator):
    train, test = train_test(spark, sf)
    return J.as_stages(estimator, FEATURES).fit(train.select("label", *FEATURES)), test


def _test_metrics(name, make):
    @query(name)
    def run(spark, sf):
        model, test = fit(spark, sf, make())
        return K.benchmark_metrics(J.score(model, test))


_test_metrics("j01_logistic_regression", lambda: J.logistic("label"))
_test_metrics("j02_random_forest", lambda: I.forest("label"))
_test_metrics("j03_extra_trees", lambda: I.forest("label", extra=True))
_test_metrics("j04_gradient_boosting", lambda: J.boosted("label", *BOOST_QUERY_SIZE))


@query("j05_model_benchmark")
def j05(spark, sf):
    """Every candidate fitted and compared on the test split; small sizes, the defaults are in the library."""
    train, test = train_test(spark, sf)
    models = J.candidates("label", iterations=50, trees=(20, 6), boost=(5, 4))
    table, _fitted = J.train_and_compare(train, test, FEATURES, "label", models)
    return table


@query("j09_saved_best_model")
def j09(spark, sf):
    """The best of two candidates, saved and loaded: agreement of both on the test rows."""
    from pyspark.ml import PipelineModel

    train, test = train_test(spark, sf)
    models = {"Random Forest": I.forest("label", trees=20, depth=6), "Logistic Regression": J.logistic("label", 50)}
    table, fitted = J.train_and_compare(train, test, FEATURES, "label", models)
    best = table.first()["model"]
    path = scratch_path(spark, "model")
    fitted[best].write().save(path)
    loaded = PipelineModel.load(path)
    a = J.score(fitted[best], test).select("event_id", F.col("prediction").alias("a"))
    b = J.score(loaded, test).select("event_id", F.col("prediction").alias("b"))
    return a.join(b, "event_id").groupBy((F.col("a") == F.col("b")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def explained(spark, sf, trees=10, depth=5):
    """Test rows scored by a forest, with tree attributions, top features and actions."""
    model, test = fit(spark, sf, I.forest("label", trees=trees, depth=depth))
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    leaves = A.tree_leaves(path, spark, per_class=True)
    return flow.score_rows(test.drop("ts"), model, features=FEATURES, leaves=leaves), leaves


@query("k02_k03_table_scoring")
def k03(spark, sf):
    """One pass over the test rows: probabilities, class, confidence."""
    model, test = fit(spark, sf, I.forest("label", trees=20, depth=6))
    return J.score(model, test).select("event_id", *K.PROBS, "prediction", "predicted_class", "confidence")


@query("a11_prediction_catalogue")
def a11(spark, sf):
    scored, _leaves = explained(spark, sf)
    out = flow.prediction_catalogue(scored, ["event_id", "asset_id"], "Future_Risk_Level")
    path = scratch_path(spark, "predictions")
    out.write.parquet(path)
    return spark.read.parquet(path)


@query("k18_misclassified_rows")
def k18(spark, sf):
    scored, _leaves = explained(spark, sf)
    # numbering reads the table more than once; the scored rows are written so that scoring is not repeated
    scored = materialise(scored.select("event_id", "Future_Risk_Level", "predicted_class", "confidence", "top_text", "actions"), "scored")
    wrong = K.misclassified(scored, "Future_Risk_Level", "predicted_class", "event_id")
    return wrong.select("Row_Number", "event_id", F.col("Future_Risk_Level").alias("actual"), "predicted_class", "confidence", "top_text", "actions")


@query("l01_tree_contributions")
def l01_trees(spark, sf):
    """Per row: base value plus contributions against the forest's probability of the predicted class."""
    scored, leaves = explained(spark, sf)
    base = F.array(*[F.lit(float(v)) for v in A.expected_value(leaves)])
    total = F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    out = scored.select("event_id", "predicted_class", "confidence", (F.element_at(base, F.col("prediction") + 1) + total).alias("explained"))
    return out.withColumn("additive", F.abs(F.col("explained") - F.col("confidence")) < 1e-9)


@query("l03_global_tree_attribution")
def l03_trees(spark, sf):
    """Mean absolute contribution over a hundred sampled test rows, by class and feature."""
    model, test = fit(spark, sf, I.forest("label", trees=10, depth=5))
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    sample = first_by_hash(test, 100, "event_id").select("event_id", *FEATURES)
    scored = J.score(model, sample)
    out = A.tree_contributions(scored, FEATURES, A.tree_leaves(path, spark, per_class=True), "prediction", ["event_id", "prediction"])
    return A.global_attribution(out, "prediction")
