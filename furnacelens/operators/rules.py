"""Safety rules and recommendations: flags, fallback predicates, catalogue lookup, actions, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furnacelens.catalogues import RULE_FIELDS
from furnacelens.constants import FLAG_TOKENS, RULE_FLAG_COLUMNS, SENSOR_LIMITS
from furnacelens.sources.files import load_rules

# Fallback limits and the text used when nothing is triggered.
FALLBACK_LIMITS = {"R004": 3.0, "R011": 3.0, "R016": 0.5}
ROUTINE_ACTION = "Routine Monitoring"
NUMERIC_START = r"(?i)^\s*[-+]?(\d|\.|inf|nan)"
OUTPUT_FIELDS = {
    "rule_id": "rule_id", "rule_name": "rule_name", "process_area": "process_area",
    "hazard_category": "hazard_category", "compound_risk_reason": "description", "risk_level": "severity",
    "recommended_action": "recommended_action",
}


def has_rule_flags(df: DataFrame) -> bool:
    """Flag mode applies as soon as any rule flag column is present."""
    return any(c in df.columns for c in RULE_FLAG_COLUMNS)


def is_triggered(value: Column, numeric: bool = False) -> Column:
    """At least 0.5 as a number, else one of the yes words. Words are told from numbers by a pattern
    first: a failed text-to-number cast is many times dearer than a match."""
    if numeric:
        number = value.cast("double")
        return F.coalesce((number >= 0.5) & ~F.isnan(number), F.lit(False))
    text = value.cast("string")
    number = F.when(text.rlike(NUMERIC_START), text.try_cast("double"))
    by_number = (number >= 0.5) & ~F.isnan(number)
    return F.coalesce(F.when(number.isNotNull(), by_number).otherwise(F.lower(F.trim(text)).isin(*FLAG_TOKENS)), F.lit(False))


def flag_rule_ids(df: DataFrame) -> Column:
    """Array of triggered rule ids from the flag columns, in catalogue order."""
    present = [c for c in RULE_FLAG_COLUMNS if c in df.columns]
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return F.array_compact(F.array(*[
        F.when(is_triggered(F.col(c), c in numeric), F.lit(c[len("Rule_"):])) for c in present
    ]))


def fallback_predicates() -> dict[str, Column]:
    def reading(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    return {
        "R004": (reading("BF_CO") >= FALLBACK_LIMITS["R004"]) & (reading("Worker_Count") > 0),
        "R011": (reading("CO_CO") >= FALLBACK_LIMITS["R011"]) & F.coalesce(F.col("Maintenance_Active"), F.lit(False)),
        "R016": reading("CO_NH3") >= FALLBACK_LIMITS["R016"],
    }


def fallback_rule_ids() -> Column:
    return F.array_compact(F.array(*[F.when(p, F.lit(r)) for r, p in fallback_predicates().items()]))


def triggered_rule_ids(df: DataFrame) -> Column:
    return flag_rule_ids(df) if has_rule_flags(df) else fallback_rule_ids()


def _catalogue_map(rules: DataFrame) -> Column:
    """The catalogue as one map literal: it has 20 rows by definition, so it needs no join."""
    pairs = []
    for r in rules.orderBy("rule_id").collect():
        fields = F.struct(*[F.lit(r[src]).alias(dst) for src, dst in OUTPUT_FIELDS.items()])
        pairs += [F.lit(r["rule_id"]), fields]
    return F.create_map(*pairs)


def recommend(df: DataFrame, rules: DataFrame | None = None, out: str = "recommendations") -> DataFrame:
    """Array of triggered rules with their texts, in catalogue order. Row-local: no shuffle."""
    rules = rules if rules is not None else load_rules(df.sparkSession)
    catalogue = _catalogue_map(rules)
    known = F.transform(triggered_rule_ids(df), lambda r: F.try_element_at(catalogue, r))
    return df.withColumn(out, F.array_compact(known))


def triggered_long(df: DataFrame, keep: list[str], rules: DataFrame | None = None) -> DataFrame:
    """One row per reading and triggered rule, enriched by a broadcast join with the 20-row catalogue."""
    rules = rules if rules is not None else load_rules(df.sparkSession)
    fired = df.select(*keep, F.explode(triggered_rule_ids(df)).alias("rule_id"))
    return fired.join(F.broadcast(rules.select(*RULE_FIELDS)), "rule_id")


def actions(df: DataFrame, recommendations: str = "recommendations") -> DataFrame:
    """Distinct actions in order: the first three as columns, all of them joined."""
    texts = F.transform(recommendations, lambda r: r["recommended_action"])
    distinct = F.array_distinct(F.filter(texts, lambda t: t.isNotNull() & (t != "")))
    with_list = df.withColumn("_actions", distinct)

    def nth(i: int, default: str) -> Column:
        return F.coalesce(F.try_element_at("_actions", F.lit(i)), F.lit(default))

    joined = F.when(F.size("_actions") > 0, F.array_join("_actions", "; ")).otherwise(F.lit(ROUTINE_ACTION))
    return with_list.withColumns({
        "action_1": nth(1, ROUTINE_ACTION), "action_2": nth(2, ""), "action_3": nth(3, ""), "actions": joined,
    }).drop("_actions")


def top_recommendations(df: DataFrame, n: int = 3, recommendations: str = "recommendations", out: str = "headline") -> DataFrame:
    """The first n recommendations as ``[PRIORITY]: action`` lines."""
    lines = F.transform(
        F.slice(recommendations, 1, n),
        lambda r: F.concat(F.lit("["), F.upper(F.trim(r["severity"])), F.lit("]: "), F.trim(r["recommended_action"])),
    )
    return df.withColumn(out, lines)


def limit_breaches(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per reading and sensor above its warning limit, with the level reached."""
    levels = [
        F.when(F.col(s) >= F.lit(high), F.struct(F.lit(s).alias("sensor"), F.lit("max").alias("level"), F.col(s).alias("reading")))
        .when(F.col(s) >= F.lit(warn), F.struct(F.lit(s).alias("sensor"), F.lit("warn").alias("level"), F.col(s).alias("reading")))
        for s, (warn, high) in SENSOR_LIMITS.items() if s in df.columns
    ]
    exploded = df.select(*keep, F.explode(F.array_compact(F.array(*levels))).alias("_b"))
    return exploded.select(*keep, "_b.sensor", "_b.level", "_b.reading")
