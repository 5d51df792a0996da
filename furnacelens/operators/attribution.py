"""Attribution of predictions to features: linear and tree Shapley values, rankings, texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.catalogues import FACTOR_SUBTITLE_DEFAULT, FACTOR_TITLES, NARRATIVE_NONE, NARRATIVE_STABLE

CONTRIBUTION = "array<struct<feature:string,val:double,contribution:double>>"


# -- linear models -----------------------------------------------------------
def linear_contributions(
    df: DataFrame, features: Sequence[str], coefficients: Sequence[Sequence[float]], means: Sequence[float],
    prediction: str, out: str = "contributions",
) -> DataFrame:
    """Exact Shapley values of a linear score for the predicted class: coefficient * (x - mean)."""
    items = []
    for j, f in enumerate(features):
        weights = F.array(*[F.lit(float(row[j])) for row in coefficients])
        coef = F.element_at(weights, F.col(prediction).cast("int") + F.lit(1))
        x = F.col(f"`{f}`").cast("double")
        items.append(F.struct(
            F.lit(f).alias("feature"), x.alias("val"), (coef * (x - F.lit(float(means[j])))).alias("contribution")
        ))
    return df.withColumn(out, F.array(*items))


# -- tree models -------------------------------------------------------------
def tree_leaves(model_path: str, spark, *, per_class: bool) -> list[tuple]:
    """Leaves of a saved tree ensemble as (weight, values, [(feature, low, high, zero fraction)]).

    A saved ensemble is a node table whose size is set by trees and depth, never by the data.
    """
    nodes = spark.read.parquet(f"{model_path}/data").select("treeID", "nodeData.*").collect()
    # columns are (tree, metadata, weight), by position: their names differ between Spark releases
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{model_path}/treesMetadata").collect()}
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    total = sum(weights.values()) if per_class else 1.0
    leaves = []
    for tree_id, by_id in trees.items():
        stack = [(by_id[0], {})]
        while stack:
            node, path = stack.pop()
            if node["leftChild"] < 0:
                stats = np.asarray(node["impurityStats"], dtype=float)
                values = stats / stats.sum() if per_class else np.array([node["prediction"]])
                bounds = [(f, lo, hi, z) for f, (lo, hi, z) in path.items()]
                leaves.append((weights[tree_id] / total, values, bounds))
                continue
            feature = node["split"]["featureIndex"]
            cut = node["split"]["leftCategoriesOrThreshold"][0]
            cover = float(node["rawCount"])
            for child_id, is_left in ((node["leftChild"], True), (node["rightChild"], False)):
                child = by_id[child_id]
                lo, hi, z = path.get(feature, (-np.inf, np.inf, 1.0))
                lo, hi = (lo, min(hi, cut)) if is_left else (max(lo, cut), hi)
                share = float(child["rawCount"]) / cover
                stack.append((child, {**path, feature: (lo, hi, z * share)}))
    return leaves


def _pattern_table(zero: np.ndarray) -> np.ndarray:
    """Shapley share of each path feature for every pattern of satisfied path conditions.

    Row p of the result belongs to the pattern whose bit i says whether feature i's condition holds.
    A leaf with d distinct features is a product game, so its Shapley values are weighted elementary
    symmetric sums over the other features.
    """
    d = len(zero)
    bits = (np.arange(1 << d)[:, None] >> np.arange(d)[None, :]) & 1
    weight = np.array([_factorial(k) * _factorial(d - 1 - k) / _factorial(d) for k in range(d)])
    table = np.empty((1 << d, d))
    for i in range(d):
        poly = np.zeros((1 << d, d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j == i:
                continue
            shifted = np.zeros_like(poly)
            shifted[:, 1:] = poly[:, :-1]
            poly = poly * zero[j] + shifted * bits[:, [j]]
        table[:, i] = (bits[:, i] - zero[i]) * (poly @ weight)
    return table


def _factorial(n: int) -> float:
    return float(np.prod(np.arange(1, n + 1))) if n else 1.0


def tree_contributions(
    df: DataFrame, features: Sequence[str], leaves: list[tuple], prediction: str | None, keep: Sequence[str],
    out: str = "contributions",
) -> DataFrame:
    """Path-dependent tree Shapley values (Lundberg et al.) per row, for the predicted class.

    The leaves travel to the executors once as a broadcast; each Arrow batch is handled on its own,
    so rows stay where they are.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(leaves)
    names = list(features)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = [(w * v, b, _pattern_table(np.array([x[3] for x in b]))) for w, v, b in shared.value if b]
        for batch in batches:
            x = np.column_stack([batch.column(n).to_pandas().to_numpy(dtype=float) for n in names])
            cls = batch.column(prediction).to_pandas().to_numpy(dtype=int) if prediction else np.zeros(len(x), dtype=int)
            phi = np.zeros_like(x)
            for values, bounds, table in prepared:
                pattern = np.zeros(len(x), dtype=np.int64)
                for i, (f, lo, hi, _z) in enumerate(bounds):
                    pattern += ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << i
                share = table[pattern] * values[cls][:, None]
                phi[:, [b[0] for b in bounds]] += share
            # columns from flat arrays: an object per row and feature would outweigh the batch many times over
            which = pa.array(np.tile(np.arange(len(names), dtype=np.int32), len(x)))
            items = pa.StructArray.from_arrays(
                [pa.DictionaryArray.from_arrays(which, pa.array(names)).dictionary_decode(), pa.array(x.ravel(), from_pandas=True), pa.array(phi.ravel(), from_pandas=True)],
                names=["feature", "val", "contribution"],
            )
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names))
            carried = {k: batch.column(k) for k in keep}
            yield pa.RecordBatch.from_pydict({**carried, out: pa.ListArray.from_arrays(offsets, items)})

    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField(out, T._parse_datatype_string(CONTRIBUTION))])
    wanted = list(dict.fromkeys([*keep, *names, *([prediction] if prediction else [])]))
    return df.select(*[F.col(f"`{c}`") for c in wanted]).mapInArrow(explain, schema)


def expected_value(leaves: list[tuple]) -> np.ndarray:
    """Base value per class: every leaf weighted by the share of training rows that reach it."""
    return sum(w * v * float(np.prod([b[3] for b in bounds])) for w, v, bounds in leaves)


# -- rankings and texts ------------------------------------------------------
def top_contributions(contributions: str | Column = "contributions", n: int = 5) -> Column:
    """Largest by absolute contribution; equal ones by feature name."""
    c = F.col(contributions) if isinstance(contributions, str) else contributions
    keyed = F.transform(c, lambda x: F.struct((-F.abs(x["contribution"])).alias("k"), x["feature"].alias("n"), x.alias("x")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda x: x["x"])


def format_contributions(top: str | Column) -> Column:
    c = F.col(top) if isinstance(top, str) else top
    texts = F.transform(c, lambda x: F.format_string("%s (%+.4f)", x["feature"], x["contribution"]))
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(texts, "; ")).otherwise("N/A")


def global_attribution(df: DataFrame, prediction: str, contributions: str = "contributions") -> DataFrame:
    """Mean absolute contribution by class and feature: one aggregate that combines before the shuffle."""
    # the outer form keeps the planner from deriving a filter that repeats the whole array expression
    long = df.select(prediction, F.explode_outer(contributions).alias("_c"))
    return long.groupBy(prediction, F.col("_c.feature").alias("feature")).agg(
        F.avg(F.abs("_c.contribution")).alias("mean_abs_contribution"), F.count(F.lit(1)).alias("rows")
    )


def impact_columns(contribution: Column) -> dict[str, Column]:
    """Score points lost, bar width in percent and severity band."""
    points = F.greatest(F.lit(-20.0), F.least(F.lit(0.0), contribution * F.lit(100.0)))
    band = F.when(points <= -15, "severe").when(points <= -10, "high").when(points <= -5, "moderate").otherwise("low")
    width = F.least(F.lit(100), (F.abs(points) / F.lit(20.0) * F.lit(100.0)).cast("int"))
    return {"points_impact": points, "bar_width_pct": width, "impact_band": band}


def factor_display(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Title and subtitle per feature by broadcast left join with the nine-row dimension."""
    dim = df.sparkSession.createDataFrame([(k, *v) for k, v in FACTOR_TITLES.items()], "_f string, _t string, _s string")
    joined = df.join(F.broadcast(dim), F.col(feature) == F.col("_f"), "left")
    return joined.withColumns({
        "title": F.coalesce("_t", F.replace(F.col(feature), F.lit("_"), F.lit(" "))),
        "subtitle": F.coalesce("_s", F.lit(FACTOR_SUBTITLE_DEFAULT)),
    }).drop("_f", "_t", "_s")


def narrative(risk_class: str = "predicted_class") -> Column:
    """One sentence naming the readings behind a reduced score."""
    parts = F.array_compact(F.array(
        F.when((F.col("BF_Gas_Pressure") > 2.2) | (F.col("CO_Gas_Pressure") > 2.7), F.lit("increasing gas pressure")),
        F.when((F.col("BF_Top_Temperature") > 240) | (F.col("CO_Oven_Temperature") > 1050), F.lit("elevated furnace temperature")),
        F.when(F.col("BF_Cooling_Water_Flow") < 140, F.lit("reduced cooling water flow")),
    ))
    named = F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(NARRATIVE_NONE)
    sentence = F.concat(
        F.lit("The AI identified "), named, F.lit(" as the primary contributors to the reduction in plant health.")
    )
    return F.when(F.col(risk_class) == "Low", F.lit(NARRATIVE_STABLE)).otherwise(sentence)
