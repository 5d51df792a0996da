"""Preparation as Spark ML stages: clean -> encode -> scale -> align, one PipelineModel that holds all fitted state.

Each stage is an Estimator whose Model keeps what it learned (medians, categories, centres and spreads, column order)
as a JSON param, so ``PipelineModel.save`` writes it with the stage metadata and ``PipelineModel.load`` brings back a
model that gives the same rows, with no refit on the rows it scores. Fitting reads the table in a few aggregate passes
(exact medians by the bracketing quantile search, one grouping of distinct categories, one pass of moments or
quartiles); transforming is column expressions only, inside whole-stage code generation.

Defined cases. Numbers that are null, NaN or infinite take the fitted median of the finite values (0 when a column has
none); text null is the category "None"; boolean null is false. A category unseen in fitting sets no one-hot column.
A spread of 0 divides by 1. Align puts the fitted output columns in fitted order after the kept columns; a fitted
column missing from the input is 0, input columns that were not fitted are left out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.functions.scalar import is_finite
from furnacelens.operators.prep import fit_categories, fit_scaler, one_hot, q
from furnacelens.operators.quantiles import exact_quantiles


class _Stage(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns the stage reads", TypeConverters.toListString)
    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)
    option = Param(Params._dummy(), "option", "stage option", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(inputCols=[], state="{}", option="")

    def _fitted(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def _model(self, model_cls, state: dict):
        m = model_cls()
        return m._set(inputCols=self.getOrDefault(self.inputCols), state=json.dumps(state), option=self.getOrDefault(self.option))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "categorical"
    return "boolean" if isinstance(t, T.BooleanType) else "numeric"


class CleanModel(Model, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._fitted()
        made = {}
        for c, kind in st["kinds"].items():
            if kind == "categorical":
                made[c] = F.coalesce(q(c).cast("string"), F.lit("None"))
            elif kind == "boolean":
                made[c] = F.coalesce(q(c).cast("boolean"), F.lit(False))
            else:
                x = q(c).cast("double")
                made[c] = F.coalesce(F.when(is_finite(x), x), F.lit(float(st["medians"][c])))
        return df.withColumns(made)


class Clean(Estimator, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols: Sequence[str] = ()) -> None:
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, df: DataFrame) -> CleanModel:
        cols = self.getOrDefault(self.inputCols)
        kinds = {c: _kind(df.schema[c].dataType) for c in cols}
        numeric = [c for c, k in kinds.items() if k == "numeric"]
        finite = df.select(*[F.when(is_finite(q(c).cast("double")), q(c).cast("double")).alias(c) for c in numeric])
        medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in exact_quantiles(finite, numeric, [0.5]).items()} if numeric else {}
        return self._model(CleanModel, {"kinds": kinds, "medians": medians})


class EncodeModel(Model, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(one_hot(self._fitted()["categories"]))


class Encode(Estimator, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot columns ``<column>_<value>`` for the text columns among ``inputCols``."""

    def __init__(self, inputCols: Sequence[str] = ()) -> None:
        super().__init__()
        self._set(inputCols=list(inputCols))

    def _fit(self, df: DataFrame) -> EncodeModel:
        text = [c for c in self.getOrDefault(self.inputCols) if _kind(df.schema[c].dataType) == "categorical"]
        return self._model(EncodeModel, {"categories": fit_categories(df, text)})


class ScaleModel(Model, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (q(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in self._fitted()["scaler"].items()})


class Scale(Estimator, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns among ``inputCols`` by ``option``: standard (mean, deviation) or robust (median, IQR)."""

    def __init__(self, inputCols: Sequence[str] = (), strategy: str = "standard") -> None:
        super().__init__()
        self._set(inputCols=list(inputCols), option=strategy)

    def _fit(self, df: DataFrame) -> ScaleModel:
        numeric = [c for c in self.getOrDefault(self.inputCols) if _kind(df.schema[c].dataType) == "numeric"]
        scaler = fit_scaler(df, numeric, self.getOrDefault(self.option)) if numeric else {}
        return self._model(ScaleModel, {"scaler": {c: list(v) for c, v in scaler.items()}})


class AlignModel(Model, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self._fitted()
        kept = [q(c) for c in st["keep"]]
        out = [(q(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c) for c in st["columns"]]
        return df.select(*kept, *out)


class Align(Estimator, _Stage, DefaultParamsReadable, DefaultParamsWritable):
    """Fixes the output: ``option`` names the kept columns (comma-separated); features are one-hot, boolean, numeric."""

    def __init__(self, inputCols: Sequence[str] = (), keep: Sequence[str] = ()) -> None:
        super().__init__()
        self._set(inputCols=list(inputCols), option=",".join(keep))

    def _fit(self, df: DataFrame) -> AlignModel:
        cols = self.getOrDefault(self.inputCols)
        kinds = {c: _kind(df.schema[c].dataType) for c in cols}
        hot = list(one_hot(fit_categories(df, [c for c in cols if kinds[c] == "categorical"])))  # the names Encode made
        columns = hot + [c for c in cols if kinds[c] == "boolean"] + [c for c in cols if kinds[c] == "numeric"]
        keep = [c for c in self.getOrDefault(self.option).split(",") if c]
        return self._model(AlignModel, {"keep": keep, "columns": columns})


def preparation(columns: Sequence[str], keep: Sequence[str] = (), strategy: str = "standard"):
    """The four stages as one Pipeline."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=[Clean(columns), Encode(columns), Scale(columns, strategy), Align(columns, keep)])
