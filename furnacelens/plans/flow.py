"""End-to-end plans: packets to scored, explained and recommended rows; training from a labelled table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furnacelens.operators import attribution as A
from furnacelens.operators import rules as R
from furnacelens.operators.indices import risk_indices
from furnacelens.operators.normalize import attach_safety_index, normalised_fields
from furnacelens.operators.rolling import rolling_stats
from furnacelens.operators.training import score
from furnacelens.operators.validate import check_fields, order_verdict
from furnacelens.sources.files import decode_packets


def validated_packets(raw: DataFrame, *, keep: Sequence[str] = (), fields: Sequence[str] | None = None, **order) -> DataFrame:
    """Decode, check and normalise before the first shuffle, then settle the order.

    JSON text and the decoded map stay on the map side; only typed columns are shuffled. ``fields`` names the
    normalised fields the caller reads, all when None: a hot asset's rows are written once, so unread ones would be too.
    """
    checked = check_fields(decode_packets(raw))
    flags = ["_readable", "_has_ts", "_complete", "_numeric"]
    typed = checked.select(
        "asset_id", "arrival_seq", *keep, F.date_trunc("second", "ts").alias("ts"), *flags,
        *[c.alias(n) for n, c in normalised_fields().items() if fields is None or n in fields],
    )
    return order_verdict(typed, **order)


def packet_indices(raw: DataFrame, *, order: dict | None = None, window: dict | None = None) -> DataFrame:
    """Accepted packets with all risk indices."""
    accepted = validated_packets(raw, **(order or {})).filter("is_valid").drop("reason", "is_valid")
    return risk_indices(attach_safety_index(accepted), safety="Safety_Index", **(window or {}))


def enriched(packets: DataFrame, *, window: dict | None = None, stats: Sequence[str] = ("avg", "std", "grad")) -> DataFrame:
    """Packet, rolling block and indices in one row: what the model sees."""
    rolled = rolling_stats(packets, stats=list(stats), **(window or {}))
    return risk_indices(rolled, lead=True, **(window or {}))


def score_rows(
    df: DataFrame, model: PipelineModel, *, features: Sequence[str], leaves: list | None = None, top: int = 5
) -> DataFrame:
    """Score, explain and recommend over a whole table in one pass."""
    out = score(model, df)
    if leaves is not None:
        carried = [c for c in out.columns if c not in ("features", "rawPrediction", "probability")]
        out = A.tree_contributions(out, features, leaves, "prediction", carried)
        out = out.withColumn("top_features", A.top_contributions(n=top)).withColumn("top_text", A.format_contributions("top_features"))
    return R.actions(R.recommend(out))


def prediction_catalogue(scored: DataFrame, ident: Sequence[str], actual: str) -> DataFrame:
    """One row per input with actual, predicted, confidence, verdict, five features and three actions."""
    def nth(i: int):
        return F.coalesce(
            F.format_string("%s (%+.4f)", F.try_element_at("top_features", F.lit(i))["feature"],
                            F.try_element_at("top_features", F.lit(i))["contribution"]), F.lit("")
        )

    return scored.select(
        *ident, F.col(actual).alias("actual"), F.col("predicted_class").alias("predicted"), "confidence",
        (F.col(actual) == F.col("predicted_class")).alias("correct"),
        *[nth(i).alias(f"feature_{i}") for i in range(1, 6)], "action_1", "action_2", "action_3",
    )
