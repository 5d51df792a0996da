"""Model-ready feature vectors: precedence, encodings, defaults, strict checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.constants import BOOLEAN_DEFAULTS, CATEGORY_DOMAINS
from furnacelens.functions.scalar import is_finite


class FeatureSchemaError(ValueError):
    """Feature columns do not match what was asked for."""

    def __init__(self, message: str, missing: Sequence[str] = (), unexpected: Sequence[str] = ()):
        super().__init__(message)
        self.missing, self.unexpected = list(missing), list(unexpected)


def merge_blocks(packet: Sequence[str], rolling: Sequence[str], derived: Sequence[str]) -> list[str]:
    """Column order of the merged row; a later block wins where names repeat."""
    return list(dict.fromkeys([*packet, *rolling, *derived]))


def feature_column(
    df: DataFrame, feature: str, categories: Sequence[str] = tuple(CATEGORY_DOMAINS),
    booleans: Sequence[str] = tuple(BOOLEAN_DEFAULTS),
) -> Column:
    types = dict(df.dtypes)
    if feature in types:
        return F.col(f"`{feature}`").cast("double")
    for base in categories:
        if feature.startswith(f"{base}_"):
            if base not in types:
                return F.lit(0.0)
            wanted = feature[len(base) + 1:]
            return F.coalesce((F.col(base) == wanted).cast("double"), F.lit(0.0))
    for base in booleans:
        if feature.startswith(f"{base}_"):
            if base not in types or feature[len(base) + 1:] not in ("True", "False"):
                return F.lit(0.0)
            wanted = feature.endswith("_True")
            return F.coalesce((F.col(base) == F.lit(wanted)).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def assemble_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly these features, in this order, as doubles."""
    if len(set(features)) != len(features):
        raise FeatureSchemaError("feature names repeat")
    return df.select(*keep, *[feature_column(df, f).alias(f) for f in features])


def check_features(df: DataFrame, features: Sequence[str], *, mode: str = "fail") -> DataFrame:
    """Names, order and types are checked on the plan; null, NaN and infinity on the rows.

    ``mode='fail'`` stops the job at the first bad row, ``mode='tag'`` adds ``bad_feature``.
    """
    have = [c for c in df.columns if c in set(features)]
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise FeatureSchemaError(f"missing features: {missing}", missing)
    if have != list(features):
        raise FeatureSchemaError("features are out of order")
    wrong = [f for f in features if dict(df.dtypes)[f] != "double"]
    if wrong:
        raise FeatureSchemaError(f"features that are not double: {wrong}", wrong)
    first_bad = F.coalesce(*[F.when(~is_finite(f), F.lit(f)) for f in features])
    if mode == "tag":
        return df.withColumn("bad_feature", first_bad)
    stop = F.raise_error(F.concat(F.lit("not a finite number in feature: "), first_bad))
    # a filter, unlike a column, stays when columns are pruned
    return df.filter(F.when(first_bad.isNotNull(), stop.cast("boolean")).otherwise(F.lit(True)))


def to_vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(f"`{f}`") for f in features])))


def schema_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(position, feature) as a table."""
    rows = [(i + 1, f) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "position int, feature string")
