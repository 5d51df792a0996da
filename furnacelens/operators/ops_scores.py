"""Operational scores shown to plant staff; separate from the risk indices of similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furnacelens.catalogues import CLASS_TEXTS, SUGGESTIONS, SUMMARY_TEXTS
from furnacelens.functions.scalar import excess, trunc_score, truthy_or

# ---------------------------------------------------------------------------
# Defaults for missing readings, and (good, fair) cut-points with their words.
# ---------------------------------------------------------------------------
READING_DEFAULTS = {
    "BF_CO": 1.2, "BF_Top_Temperature": 200.0, "BF_Cooling_Water_Flow": 150.0,
    "BF_Cooling_Water_Temperature": 35.0, "BF_Gas_Pressure": 2.0, "BF_Blower_Vibration": 1.5,
    "CO_CO": 1.1, "CO_NH3": 0.1, "CO_Gas_Pressure": 2.5, "CO_Oven_Temperature": 1000.0,
    "CO_Pusher_Vibration": 1.5, "Worker_Count": 5.0,
}
STATUS_BANDS = {
    "ops_bf_health": (80, 50, "GOOD", "FAIR", "CRITICAL"),
    "ops_co_health": (80, 50, "GOOD", "FAIR", "CRITICAL"),
    "ops_environment": (80, 60, "GOOD", "FAIR", "POOR"),
    "ops_compliance": (90, 70, "EXCELLENT", "GOOD", "VIOLATION"),
    "ops_energy": (80, 60, "GOOD", "FAIR", "POOR"),
    "ops_equipment": (80, 50, "GOOD", "FAIR", "POOR"),
    "ops_stability": (80, 50, "GOOD", "FAIR", "UNSTABLE"),
    "ops_emission": (85, 60, "GOOD", "FAIR", "POOR"),
}


def reading(name: str) -> Column:
    return truthy_or(name, READING_DEFAULTS[name])


def health_score(risk_class: str = "predicted_class", confidence: str = "confidence") -> Column:
    """Class base minus a share of the missing confidence, truncated, within 5..100."""
    doubt = F.lit(1.0) - F.col(confidence)
    score = None
    for name, (base, slope, *_rest) in CLASS_TEXTS.items():
        term = F.lit(base) - doubt * F.lit(slope)
        cond = F.col(risk_class) == name
        score = F.when(cond, term) if score is None else score.when(cond, term)
    low_base, low_slope = CLASS_TEXTS["Low"][:2]
    return trunc_score(score.otherwise(F.lit(low_base) - doubt * F.lit(low_slope)), 5, 100)


def _penalty(start: float | Column, *terms: Column, low: int = 10, high: int = 100) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    base = F.lit(float(start)) if isinstance(start, (int, float)) else start
    return trunc_score(base - total, low, high)


def plant_scores() -> dict[str, Column]:
    bf_co, co_co, nh3 = reading("BF_CO"), reading("CO_CO"), reading("CO_NH3")
    top, oven = reading("BF_Top_Temperature"), reading("CO_Oven_Temperature")
    flow, water = reading("BF_Cooling_Water_Flow"), reading("BF_Cooling_Water_Temperature")
    bf_press, co_press = reading("BF_Gas_Pressure"), reading("CO_Gas_Pressure")
    blower, pusher = reading("BF_Blower_Vibration"), reading("CO_Pusher_Vibration")
    short_flow = F.greatest(F.lit(0.0), F.lit(150.0) - flow)
    return {
        "ops_bf_health": _penalty(100, short_flow * 0.3, excess(top, 250) * 0.15, excess(bf_co, 2.5) * 8.0),
        "ops_co_health": _penalty(100, excess(co_co, 2.0) * 10.0, excess(nh3, 0.3) * 30.0, excess(pusher, 2.0) * 8.0),
        "ops_thermal_balance": _penalty(100, excess(top, 250) * 0.15, excess(oven, 1100) * 0.1, excess(water, 45) * 0.8),
        "ops_gas_pressure": _penalty(100, excess(bf_press, 2.5) * 12.0, excess(co_press, 3.0) * 10.0, excess(bf_co, 2.0) * 5.0),
        "ops_stability": _penalty(100, excess(blower, 2.0) * 15.0, excess(pusher, 2.0) * 12.0),
        "ops_safety": _penalty(
            F.when(F.col("PPE_Compliance"), F.lit(100.0)).otherwise(F.lit(60.0)),
            excess(bf_co, 2.5) * 8.0, excess(co_co, 2.5) * 8.0,
        ),
        "ops_equipment": _penalty(100, blower * 7.0, pusher * 7.0),
        "ops_energy": trunc_score(F.lit(85.0) + (flow - 150.0) * 0.1 - excess(top, 250) * 0.05, 50, 99),
        "ops_environment": _penalty(100, bf_co * 6.0, co_co * 6.0),
        "ops_emission": _penalty(100, excess(bf_co, 1.0) * 15.0, excess(co_co, 1.0) * 15.0),
        "ops_compliance": F.when(F.col("PPE_Compliance") & F.col("Gas_Test_Completed"), F.lit(100))
        .when(F.col("PPE_Compliance"), F.lit(75)).otherwise(F.lit(50)),
    }


def status_texts() -> dict[str, Column]:
    bf_co, co_co = reading("BF_CO"), reading("CO_CO")
    return {
        "maintenance_status": F.when(F.col("Maintenance_Active"), "SCHEDULED ACTIVE").otherwise("ON SCHEDULE"),
        "emission_level": F.when((bf_co > 4.0) | (co_co > 4.0), "HIGH (ALERT)")
        .when((bf_co > 2.0) | (co_co > 2.0), "MODERATE").otherwise("LOW (SAFE)"),
    }


def add_plant_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({**plant_scores(), **status_texts()})


def status_bands(df: DataFrame) -> DataFrame:
    """``<score>_band`` for every score present, each with its own cut-points."""
    bands = {}
    for score, (good, fair, high, mid, low) in STATUS_BANDS.items():
        if score in df.columns:
            bands[f"{score}_band"] = F.when(F.col(score) >= good, high).when(F.col(score) >= fair, mid).otherwise(low)
    return df.withColumns(bands)


def class_texts(df: DataFrame, risk_class: str = "predicted_class") -> DataFrame:
    """Badge, banners and description by class through the four-row text dimension; unknown reads as Low."""
    rows = [(k, *v[2:]) for k, v in CLASS_TEXTS.items()]
    dim = df.sparkSession.createDataFrame(
        rows, "_class string, badge string, badge_text string, explanation string, action string, description string"
    )
    known = F.when(F.col(risk_class).isin(*CLASS_TEXTS), F.col(risk_class)).otherwise("Low")
    return df.join(F.broadcast(dim), known == F.col("_class")).drop("_class").withColumn("summary", summary_text(risk_class))


def summary_text(risk_class: str = "predicted_class") -> Column:
    c = F.col(risk_class)
    return (
        F.when(c == "Medium", F.format_string(SUMMARY_TEXTS["Medium"], reading("BF_CO")))
        .when(c == "High", F.format_string(SUMMARY_TEXTS["High"], reading("BF_Cooling_Water_Flow")))
        .when(c == "Critical", F.format_string(SUMMARY_TEXTS["Critical"], reading("BF_Gas_Pressure")))
        .otherwise(SUMMARY_TEXTS["Low"])
    )


def suggestion_cards(df: DataFrame, keep: list[str]) -> DataFrame:
    """Every row with the five standing suggestions; the list is fixed, so it is a literal, not a join."""
    cards = F.array(*[
        F.struct(F.lit(n).alias("card"), F.lit(t).alias("title"), F.lit(x).alias("text"), F.lit(p).alias("priority"), F.lit(i).alias("impact"))
        for n, t, x, p, i in SUGGESTIONS
    ])
    return df.select(*keep, F.inline(cards))
