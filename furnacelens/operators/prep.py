"""Cleaning, encoding and scaling: fit once on one table, apply to any."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.constants import (
    CLEANING_CATEGORICAL,
    ENCODING_CATEGORICAL,
    NOISE_STD,
    OUTLIER_RATIO_LIMIT,
    SEED,
    SPLIT_RATIO,
)
from furnacelens.functions.scalar import gaussian, is_finite, null_if_not_finite
from furnacelens.operators.quantiles import exact_quantiles
from furnacelens.operators.vector import FeatureSchemaError

MAX_CATEGORIES = 10_000
NOT_A_FEATURE = "Timestamp"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def column_kinds(schema: T.StructType, named_categorical: Sequence[str] = ENCODING_CATEGORICAL) -> dict[str, str]:
    """boolean / categorical / numeric per column; a type of boolean wins over the name list."""
    kinds = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            kinds[f.name] = "boolean"
        elif isinstance(f.dataType, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType)) or f.name in named_categorical:
            kinds[f.name] = "categorical"
        else:
            kinds[f.name] = "numeric"
    return kinds


def cleaning_kinds(schema: T.StructType) -> dict[str, str]:
    """The cleaning rules test the name list before the boolean type."""
    kinds = column_kinds(schema, CLEANING_CATEGORICAL)
    return {n: ("categorical" if n in CLEANING_CATEGORICAL else k) for n, k in kinds.items()}


def infinities_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: null_if_not_finite(c) for c in floats}) if floats else df


def null_profile(df: DataFrame) -> DataFrame:
    """(column, null_count) from one pass; infinities and NaN count as null."""
    clean = infinities_to_null(df)
    one = clean.agg(*[F.count_if(q(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), q(c).alias("null_count")) for c in df.columns])
    return one.select(F.inline(pairs))


@dataclass
class CleaningModel:
    kinds: dict[str, str]
    medians: dict[str, float] = field(default_factory=dict)
    null_counts: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)

    def filled(self, df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
        clean = {}
        for c in columns:
            kind = self.kinds.get(c, "numeric")
            if kind == "categorical":
                clean[c] = F.coalesce(q(c).cast("string"), F.lit("None"))
            elif kind == "boolean":
                clean[c] = F.coalesce(q(c), F.lit(False))
            else:
                fill = F.lit(self.medians.get(c, 0.0))
                if self.null_counts.get(c) == 0 and isinstance(df.schema[c].dataType, T.IntegralType):
                    fill = fill.cast(df.schema[c].dataType)  # a whole-number column without gaps stays one
                clean[c] = F.coalesce(F.when(is_finite(q(c).cast("double")), q(c)), fill)
        return clean

    def transform(self, df: DataFrame) -> DataFrame:
        """Fill with the fitted values; nothing is refitted on the new rows."""
        kept = [c for c in df.columns if c not in self.dropped]
        return df.select(*[e.alias(c) for c, e in self.filled(df, kept).items()])

    def report(self, df: DataFrame) -> DataFrame:
        rows = []
        for c, n in self.null_counts.items():
            if c in self.dropped:
                how = "constant column dropped"
            elif n == 0:
                how = "no missing values"
            else:
                how = {"categorical": "filled with None", "boolean": "filled with false"}.get(self.kinds[c], "filled with column median")
            rows.append((c, n, how))
        return df.sparkSession.createDataFrame(rows, "column string, null_count long, strategy string")


def fit_cleaning(df: DataFrame, *, drop_constant: bool = True, exact_rows: int | None = None) -> CleaningModel:
    """Null counts and extremes in one pass, exact medians in another."""
    model = CleaningModel(cleaning_kinds(df.schema))
    numeric = [c for c, k in model.kinds.items() if k == "numeric"]
    finite = {c: F.when(is_finite(q(c).cast("double")), q(c)) for c in numeric}
    probe = {c: finite.get(c, q(c)) for c in df.columns}
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(e.isNull()).alias(f"n{i}") for i, e in enumerate(probe.values())],
        *[F.min(e).alias(f"lo{i}") for i, e in enumerate(probe.values())],
        *[F.max(e).alias(f"hi{i}") for i, e in enumerate(probe.values())],
    ).first()
    kw = {} if exact_rows is None else {"exact_rows": exact_rows}
    if numeric:
        clean = df.select(*[finite[c].cast("double").alias(c) for c in numeric])
        model.medians = {c: (v[0] if v[0] is not None else 0.0) for c, v in exact_quantiles(clean, numeric, [0.5], **kw).items()}
    defaults = {"categorical": "None", "boolean": False}
    for i, c in enumerate(probe):
        nulls, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        model.null_counts[c] = nulls
        fill = defaults.get(model.kinds[c], model.medians.get(c, 0.0))
        seen = {v for v in (lo, hi) if v is not None} | ({fill} if nulls else set())
        if drop_constant and row["_rows"] > 1 and len(seen) <= 1 and c != NOT_A_FEATURE:
            model.dropped.append(c)
    return model


# -- encoding ----------------------------------------------------------------
def fit_categories(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column: each value becomes an output column, so the list must be short."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v")) for c in columns])
    found = df.select(F.inline(pairs)).filter("v IS NOT NULL").distinct()
    rows = found.limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} category values; these columns cannot be one-hot encoded")
    return {c: sorted(r["v"] for r in rows if r["c"] == c) for c in columns}


def one_hot(categories: dict[str, list[str]]) -> dict[str, Column]:
    return {
        f"{c}_{v}": F.coalesce((q(c).cast("string") == F.lit(v)).cast("double"), F.lit(0.0))
        for c, values in categories.items() for v in values
    }


# -- scaling -----------------------------------------------------------------
def outlier_ratio(df: DataFrame, columns: Sequence[str], quartiles: dict[str, Sequence[float]] | None = None) -> float:
    """Share of cells outside 1.5 interquartile ranges, over all numeric cells."""
    quartiles = quartiles or exact_quantiles(df, columns, [0.25, 0.75])
    hits = None
    for c in columns:
        lo, hi = quartiles[c][0], quartiles[c][-1]
        if lo is None:
            continue
        span = 1.5 * (hi - lo)
        x = q(c).cast("double")
        hit = F.when((x < F.lit(lo - span)) | (x > F.lit(hi + span)), F.lit(1)).otherwise(F.lit(0))
        hits = hit if hits is None else hits + hit
    if hits is None:
        return 0.0
    row = df.agg(F.sum(hits).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return float(row["h"] or 0) / (row["n"] * len(columns)) if row["n"] else 0.0


def choose_strategy(ratio: float, limit: float = OUTLIER_RATIO_LIMIT) -> str:
    return "robust" if ratio > limit else "standard"


def fit_scaler(df: DataFrame, columns: Sequence[str], strategy: str, quartiles: dict | None = None) -> dict[str, tuple[float, float]]:
    """(centre, scale) per column; a scale of 0 divides by 1."""
    if strategy == "robust":
        quartiles = quartiles or exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        fitted = {c: (v[1], v[2] - v[0]) for c, v in quartiles.items()}
    elif strategy == "standard":
        row = df.agg(*[e for i, c in enumerate(columns) for e in (
            F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}"))]).first()
        fitted = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}
    else:
        raise ValueError(f"unknown scaling strategy {strategy!r}")
    return {c: (m or 0.0, s if s else 1.0) for c, (m, s) in fitted.items()}


def scale(scaler: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (q(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}


# -- fitted preprocessing ----------------------------------------------------
@dataclass
class PrepModel:
    categorical: list[str]
    boolean: list[str]
    numeric: list[str]
    categories: dict[str, list[str]]
    strategy: str
    scaler: dict[str, tuple[float, float]]
    outlier_ratio: float
    medians: dict[str, float] = field(default_factory=dict)

    @property
    def output_columns(self) -> list[str]:
        return [*one_hot(self.categories), *self.boolean, *self.numeric]

    def check(self, columns: Sequence[str]) -> None:
        expected = [*self.categorical, *self.boolean, *self.numeric]
        missing = [c for c in expected if c not in columns]
        unexpected = [c for c in columns if c not in expected and c != NOT_A_FEATURE]
        if missing:
            raise FeatureSchemaError(
                f"missing columns: {missing}; unexpected columns: {unexpected}", missing, unexpected
            )

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        self.check([c for c in df.columns if c not in keep])
        flags = {c: q(c).cast("int") for c in self.boolean}
        made = {**one_hot(self.categories), **flags, **scale(self.scaler)}
        return df.select(*[q(k) for k in keep], *[e.alias(n) for n, e in made.items()])

    def save(self, df_session, path: str) -> str:
        """Fitted state and metadata as one JSON row in a Spark-written table."""
        meta = {**asdict(self), "split_ratio": SPLIT_RATIO}
        df_session.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(path)
        return path

    @classmethod
    def load(cls, spark, path: str) -> PrepModel:
        meta = json.loads(spark.read.text(path).first()["value"])
        meta.pop("split_ratio")
        meta["scaler"] = {c: tuple(v) for c, v in meta["scaler"].items()}
        return cls(**meta)


def fit_prep(df: DataFrame, *, exclude: Sequence[str] = (), strategy: str | None = None) -> PrepModel:
    """Fit encoders and scaler; pass the training split, or the whole table for fit-on-all."""
    cols = [c for c in df.columns if c != NOT_A_FEATURE and c not in exclude]
    kinds = column_kinds(df.select(*[q(c) for c in cols]).schema)
    by_kind = {k: [c for c in cols if kinds[c] == k] for k in ("categorical", "boolean", "numeric")}
    numeric = by_kind["numeric"]
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}
    ratio = outlier_ratio(df, numeric, quartiles) if numeric else 0.0
    chosen = strategy or choose_strategy(ratio)
    scaler = fit_scaler(df, numeric, chosen, quartiles) if numeric else {}
    return PrepModel(
        by_kind["categorical"], by_kind["boolean"], numeric, fit_categories(df, by_kind["categorical"]), chosen, scaler,
        ratio, {c: v[1] for c, v in quartiles.items()},
    )


def add_training_noise(
    df: DataFrame, columns: Sequence[str], ident: str, *, split: str = "split", std: float = NOISE_STD, seed: int = SEED
) -> DataFrame:
    """Gaussian noise on the numeric columns of train and valid rows; test rows stay untouched."""
    noisy = F.col(split).isin("train", "valid")
    return df.withColumns({
        c: F.when(noisy, q(c) + F.lit(std) * gaussian(ident, f"{seed}/{c}")).otherwise(q(c)) for c in columns
    })
