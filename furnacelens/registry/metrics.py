"""Evaluation queries (K) and benchmark metrics (J6-J8) on the synthetic predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.functions.scalar import r6
from furnacelens.operators import metrics as K
from furnacelens.registry.base import predictions, query, rnd, rounded

CLASSES = "(VALUES (0), (1), (2), (3)) c(class)"
_CELLS = "(SELECT a.class AS label, b.class AS prediction, (SELECT count(*) FROM pred p WHERE p.label = a.class AND p.prediction = b.class) AS n FROM (VALUES (0), (1), (2), (3)) a(class) CROSS JOIN (VALUES (0), (1), (2), (3)) b(class))"
_PER = """(SELECT class, tp, support, predicted, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0e0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall, CASE WHEN tp > 0 THEN 2e0 * tp / (support + predicted) ELSE 0e0 END AS f1
FROM (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (label = class) AS support,
  count(*) FILTER (prediction = class) AS predicted FROM pred CROSS JOIN (VALUES (0), (1), (2), (3)) c(class) GROUP BY class))"""


@query("k01_argmax_confidence", f"SELECT event_id, prediction, predicted_class, {rnd('confidence', 'confidence')} FROM pred", ["pred"])
def k01(spark, sf):
    p = predictions(spark, sf)
    return p.select("event_id", "prediction", "predicted_class", r6("confidence").alias("confidence"))


@query("k04_confusion_matrix", f"SELECT label, " + ", ".join(f"CAST(sum(CASE WHEN prediction = {k} THEN n END) AS BIGINT) AS pred_{k}" for k in range(4)) + f" FROM {_CELLS} GROUP BY label", ["pred"])
def k04(spark, sf):
    return K.confusion_matrix(predictions(spark, sf))


@query("k05_class_report", f"SELECT class, {rnd('precision', 'precision')}, {rnd('recall', 'recall')}, {rnd('f1', 'f1')}, support FROM {_PER}", ["pred"])
def k05(spark, sf):
    out = K.per_class(K.confusion_long(predictions(spark, sf)))
    return rounded(out, ["class", "support"], ["precision", "recall", "f1"])


_AVGS = [f"{m}_{k}" for m in ("precision", "recall", "f1") for k in ("macro", "weighted")]


@query("k06_averages", "SELECT " + ", ".join(f"{rnd(f'avg({m})', f'{m}_macro')}, {rnd(f'sum({m} * support) / sum(support)', f'{m}_weighted')}" for m in ("precision", "recall", "f1")) + f" FROM {_PER}", ["pred"])
def k06(spark, sf):
    return rounded(K.averaged(K.per_class(K.confusion_long(predictions(spark, sf)))), [], _AVGS)


@query("k07_accuracy", f"""SELECT count(*) AS total, count(*) FILTER (label = prediction) AS correct, count(*) FILTER (label <> prediction) AS incorrect,
  {rnd('avg(CAST(label = prediction AS DOUBLE))', 'accuracy')}, {rnd(f'(SELECT avg(recall) FROM {_PER})', 'balanced_accuracy')} FROM pred""", ["pred"])
def k07(spark, sf):
    return rounded(K.accuracy_summary(K.confusion_long(predictions(spark, sf))), ["total", "correct", "incorrect"], ["accuracy", "balanced_accuracy"])


@query("k08_class_accuracy", f"SELECT label AS class, {rnd('avg(CAST(label = prediction AS DOUBLE))', 'class_accuracy')} FROM pred GROUP BY label", ["pred"])
def k08(spark, sf):
    out = K.per_class(K.confusion_long(predictions(spark, sf)))
    return out.select("class", r6("recall").alias("class_accuracy"))


_AUC = """(SELECT class, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * 1e0 * (count(*) - sum(y))) AS auc FROM (
  SELECT class, y, rank() OVER (PARTITION BY class ORDER BY p) + (count(*) OVER (PARTITION BY class, p) - 1) / 2e0 AS rk FROM pred_long) GROUP BY class)"""


@query("k09_roc_auc", f"SELECT class, {rnd('auc', 'auc')} FROM {_AUC}", ["pred_long"])
def k09(spark, sf):
    return rounded(K.roc_auc(predictions(spark, sf)), ["class"], ["auc"])


@query("k09_roc_auc_sliced", f"SELECT class, {rnd('auc', 'auc')} FROM {_AUC}", ["pred_long"])
def k09_sliced(spark, sf):
    return rounded(K.roc_auc(predictions(spark, sf), slice_rows=700), ["class"], ["auc"])


@query("k09_roc_auc_macro", f"SELECT {rnd('avg(auc)', 'roc_auc_macro')} FROM {_AUC}", ["pred_long"])
def k09_macro(spark, sf):
    return rounded(K.roc_auc_macro(predictions(spark, sf)), [], ["roc_auc_macro"])


_CURVE = """(SELECT class, p AS threshold, tp * 1e0 / seen AS precision, tp * 1e0 / pos AS recall, step * 1e0 / pos AS recall_step FROM (
  SELECT class, p, sum(y) OVER w AS tp, sum(n) OVER w AS seen, sum(y) OVER (PARTITION BY class) AS pos, y AS step FROM (
    SELECT class, p, count(*) AS n, sum(y) AS y FROM pred_long GROUP BY ALL)
  WINDOW w AS (PARTITION BY class ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))"""


@query("k10_pr_curve", f"SELECT class, {rnd('threshold', 'threshold', 9)}, {rnd('precision', 'precision')}, {rnd('recall', 'recall')} FROM {_CURVE}", ["pred_long"])
def k10(spark, sf):
    c = K.pr_curve(predictions(spark, sf))
    return c.select("class", r6("threshold", 9).alias("threshold"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("k10_pr_curve_sliced", f"SELECT class, {rnd('threshold', 'threshold', 9)}, {rnd('precision', 'precision')}, {rnd('recall', 'recall')} FROM {_CURVE}", ["pred_long"])
def k10_sliced(spark, sf):
    c = K.pr_curve(predictions(spark, sf), slice_rows=900)
    return c.select("class", r6("threshold", 9).alias("threshold"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("k11_average_precision", f"SELECT class, {rnd('sum(recall_step * precision)', 'average_precision')} FROM {_CURVE} GROUP BY class", ["pred_long"])
def k11(spark, sf):
    return rounded(K.average_precision(predictions(spark, sf)), ["class"], ["average_precision"])


@query("k12_calibration", f"""SELECT class, CAST(greatest(0, ceil(p * 10e0) - 1) AS INTEGER) AS bin, {rnd('avg(p)', 'mean_predicted')}, {rnd('avg(y)', 'fraction_positive')}, count(*) AS n
FROM pred_long GROUP BY 1, 2""", ["pred_long"])
def k12(spark, sf):
    return rounded(K.calibration(predictions(spark, sf)), ["class", "bin", "n"], ["mean_predicted", "fraction_positive"])


@query("k13_probability_density", f"""SELECT class, bin, n, {rnd('n * 50e0 / sum(n) OVER (PARTITION BY class)', 'density')} FROM (
  SELECT class, CAST(least(49, floor(p * 50e0)) AS INTEGER) AS bin, count(*) AS n FROM pred_long GROUP BY 1, 2)""", ["pred_long"])
def k13(spark, sf):
    return rounded(K.probability_density(predictions(spark, sf)), ["class", "bin", "n"], ["density"])


def _hist(bins: int):
    @query(f"k14_confidence_histogram_{bins}", f"""SELECT bin, count(*) AS n, {rnd('min(lo) + bin * min(w)', 'bin_start')} FROM (
  SELECT lo, (hi - lo) / {bins} AS w, CAST(least({bins - 1}, floor((confidence - lo) / ((hi - lo) / {bins}))) AS INTEGER) AS bin
  FROM pred CROSS JOIN (SELECT min(confidence) AS lo, max(confidence) AS hi FROM pred)) GROUP BY bin""", ["pred"])
    def run(spark, sf):
        return rounded(K.histogram(predictions(spark, sf), "confidence", bins), ["bin", "n"], ["bin_start"])


_hist(20)
_hist(25)


@query("k15_mean_confidence", f"SELECT {rnd('avg(confidence)', 'mean_confidence')}, {rnd('avg(value)', 'mean_latency_ms')} FROM pred", ["pred"])
def k15(spark, sf):
    return predictions(spark, sf).agg(r6(F.avg("confidence")).alias("mean_confidence"), r6(F.avg("value")).alias("mean_latency_ms"))


@query("k16_class_distribution", "SELECT Future_Risk_Level, count(*) AS n FROM lab GROUP BY ALL", ["lab"])
def k16(spark, sf):
    return predictions(spark, sf).groupBy("Future_Risk_Level").agg(F.count(F.lit(1)).alias("n"))


@query("k17_error_transitions", f"""SELECT Future_Risk_Level, predicted_class, n, {rnd('n * 1e0 / sum(n) OVER ()', 'share')} FROM (
  SELECT Future_Risk_Level, predicted_class, count(*) AS n FROM pred WHERE label <> prediction GROUP BY ALL)""", ["pred"])
def k17(spark, sf):
    return rounded(K.transitions(predictions(spark, sf), "Future_Risk_Level", "predicted_class"), ["Future_Risk_Level", "predicted_class", "n"], ["share"])


_NAME = "CASE {} WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END"


@query("k19_metrics_report", f"""
SELECT section, name, {rnd('value', 'value')} FROM (
  SELECT 'confusion' AS section, {_NAME.format('label')} || ' -> ' || {_NAME.format('prediction')} AS name, n * 1e0 AS value FROM {_CELLS}
  UNION ALL SELECT 'class', {_NAME.format('class')} || ' ' || m, v FROM (UNPIVOT (SELECT class, precision, recall, f1, support * 1e0 AS support FROM {_PER}) ON precision, recall, f1, support INTO NAME m VALUE v)
  UNION ALL SELECT 'averages', m, v FROM (UNPIVOT (SELECT {', '.join(f'avg({m}) AS {m}_macro, sum({m} * support) / sum(support) AS {m}_weighted' for m in ('precision', 'recall', 'f1'))} FROM {_PER}) ON COLUMNS(*) INTO NAME m VALUE v)
  UNION ALL SELECT 'overall', m, v FROM (UNPIVOT (SELECT count(*) * 1e0 AS total, sum(CAST(label = prediction AS DOUBLE)) AS correct, sum(CAST(label <> prediction AS DOUBLE)) AS incorrect,
    avg(CAST(label = prediction AS DOUBLE)) AS accuracy, (SELECT avg(recall) FROM {_PER}) AS balanced_accuracy FROM pred) ON COLUMNS(*) INTO NAME m VALUE v)
  UNION ALL SELECT 'ranking', 'roc_auc_macro', avg(auc) FROM {_AUC}
  UNION ALL SELECT 'confidence', 'mean_confidence', avg(confidence) FROM pred)""", ["pred_long"])
def k19(spark, sf):
    return rounded(K.metrics_report(predictions(spark, sf)), ["section", "name"], ["value"])


@query("j06_accuracy_macro_f1", f"SELECT {rnd('avg(CAST(label = prediction AS DOUBLE))', 'accuracy')}, {rnd(f'(SELECT avg(f1) FROM {_PER})', 'macro_f1')} FROM pred", ["pred"])
def j06(spark, sf):
    return rounded(K.benchmark_metrics(predictions(spark, sf)), [], ["accuracy", "macro_f1"])


@query("j07_critical_recall", f"SELECT {rnd('count(*) FILTER (label = 3 AND prediction = 3) * 1e0 / count(*) FILTER (label = 3)', 'critical_recall')} FROM pred", ["pred"])
def j07(spark, sf):
    return rounded(K.benchmark_metrics(predictions(spark, sf)), [], ["critical_recall"])


@query("j08_under_prediction_rate", f"SELECT {rnd('count(*) FILTER (label > 0 AND prediction < label) * 1e0 / count(*) FILTER (label > 0)', 'under_prediction_rate')} FROM pred", ["pred"])
def j08(spark, sf):
    return rounded(K.benchmark_metrics(predictions(spark, sf)), [], ["under_prediction_rate"])
