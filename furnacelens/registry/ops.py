"""Operational scores (O), attribution texts (L) and safety rules (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from furnacelens.catalogues import CLASS_TEXTS, FACTOR_TITLES, RULES, SCENARIOS, SUGGESTIONS, SUMMARY_TEXTS
from furnacelens.constants import SENSOR_LIMITS
from furnacelens.functions.scalar import r6
from furnacelens.operators import attribution as A
from furnacelens.operators import ops_scores as O
from furnacelens.operators import rules as R
from furnacelens.operators.augment import scenario_table
from furnacelens.registry.base import d, labelled, predictions, query, rnd, telemetry
from furnacelens.registry.rolling import SCORE_SQL


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("o01_health_score", f"SELECT event_id, {SCORE_SQL} AS health_score FROM pred", ["pred"])
def o01(spark, sf):
    return predictions(spark, sf).select("event_id", O.health_score().alias("health_score"))


def _blank(c: str) -> str:
    """Readings with gaps and zeros, so that the default-on-zero read is exercised."""
    return f"CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 0e0 ELSE {c} END"


def gappy(spark, sf):
    return telemetry(spark, sf).withColumns({
        c: F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, F.lit(0.0)).otherwise(F.col(c))
        for c in O.READING_DEFAULTS
    })


GAPPY = "(SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR {c} = 0 THEN {d(v)} ELSE {c} END AS {c}" for c, v in O.READING_DEFAULTS.items()
) + ") FROM tel)"


def _score_sql(expr: str, low: int = 10, high: int = 100) -> str:
    return f"greatest({low}, least({high}, CAST(trunc({expr}) AS INTEGER)))"


def _over(c: str, limit: float) -> str:
    return f"greatest(0e0, {c} - {d(limit)})"


_FLOW, _TOP = "BF_Cooling_Water_Flow", "BF_Top_Temperature"
_SCORES = {
    "ops_bf_health": _score_sql(f"100e0 - (greatest(0e0, 150e0 - {_FLOW}) * 0.3e0 + {_over(_TOP, 250)} * 0.15e0 + {_over('BF_CO', 2.5)} * 8e0)"),
    "ops_co_health": _score_sql(f"100e0 - ({_over('CO_CO', 2.0)} * 10e0 + {_over('CO_NH3', 0.3)} * 30e0 + {_over('CO_Pusher_Vibration', 2.0)} * 8e0)"),
    "ops_thermal_balance": _score_sql(f"100e0 - ({_over(_TOP, 250)} * 0.15e0 + {_over('CO_Oven_Temperature', 1100)} * 0.1e0 + {_over('BF_Cooling_Water_Temperature', 45)} * 0.8e0)"),
    "ops_gas_pressure": _score_sql(f"100e0 - ({_over('BF_Gas_Pressure', 2.5)} * 12e0 + {_over('CO_Gas_Pressure', 3.0)} * 10e0 + {_over('BF_CO', 2.0)} * 5e0)"),
    "ops_stability": _score_sql(f"100e0 - ({_over('BF_Blower_Vibration', 2.0)} * 15e0 + {_over('CO_Pusher_Vibration', 2.0)} * 12e0)"),
    "ops_safety": _score_sql(f"CASE WHEN PPE_Compliance THEN 100e0 ELSE 60e0 END - ({_over('BF_CO', 2.5)} * 8e0 + {_over('CO_CO', 2.5)} * 8e0)"),
    "ops_equipment": _score_sql("100e0 - (BF_Blower_Vibration * 7e0 + CO_Pusher_Vibration * 7e0)"),
    "ops_energy": _score_sql(f"85e0 + ({_FLOW} - 150e0) * 0.1e0 - {_over(_TOP, 250)} * 0.05e0", 50, 99),
    "ops_environment": _score_sql("100e0 - (BF_CO * 6e0 + CO_CO * 6e0)"),
    "ops_emission": _score_sql(f"100e0 - ({_over('BF_CO', 1.0)} * 15e0 + {_over('CO_CO', 1.0)} * 15e0)"),
    "ops_compliance": "CASE WHEN PPE_Compliance AND Gas_Test_Completed THEN 100 WHEN PPE_Compliance THEN 75 ELSE 50 END",
}


def _scores(name, columns):
    sql = f"SELECT event_id, {', '.join(f'{_SCORES[c]} AS {c}' for c in columns)} FROM {GAPPY}"

    @query(name, sql)
    def run(spark, sf):
        made = O.plant_scores()
        return gappy(spark, sf).select("event_id", *[made[c].alias(c) for c in columns])


_scores("o02_furnace_health", ["ops_bf_health", "ops_co_health"])
_scores("o03_process_scores", ["ops_thermal_balance", "ops_gas_pressure", "ops_stability", "ops_safety", "ops_equipment"])
_scores("o04_energy_efficiency", ["ops_energy"])
_scores("o06_environment_emission", ["ops_environment", "ops_emission"])


@query("o05_status_compliance", f"""
SELECT event_id, CASE WHEN Maintenance_Active THEN 'SCHEDULED ACTIVE' ELSE 'ON SCHEDULE' END AS maintenance_status,
  CASE WHEN BF_CO > 4 OR CO_CO > 4 THEN 'HIGH (ALERT)' WHEN BF_CO > 2 OR CO_CO > 2 THEN 'MODERATE' ELSE 'LOW (SAFE)' END AS emission_level,
  {_SCORES['ops_compliance']} AS ops_compliance FROM {GAPPY}""")
def o05(spark, sf):
    made = {**O.status_texts(), "ops_compliance": O.plant_scores()["ops_compliance"]}
    return gappy(spark, sf).select("event_id", *[e.alias(n) for n, e in made.items()])


@query("o07_status_bands", "SELECT " + ", ".join(
    f"CASE WHEN {c} >= {b[0]} THEN '{b[2]}' WHEN {c} >= {b[1]} THEN '{b[3]}' ELSE '{b[4]}' END AS {c}_band" for c, b in O.STATUS_BANDS.items()
) + ", count(*) AS n FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _SCORES.items()) + f" FROM {GAPPY}) GROUP BY ALL")
def o07(spark, sf):
    banded = O.status_bands(O.add_plant_scores(gappy(spark, sf)))
    return banded.groupBy(*[f"{c}_band" for c in O.STATUS_BANDS]).agg(F.count(F.lit(1)).alias("n"))


def _summary_case() -> str:
    return (
        f"CASE predicted_class WHEN 'Low' THEN {text(SUMMARY_TEXTS['Low'])} "
        f"WHEN 'Medium' THEN printf({text(SUMMARY_TEXTS['Medium'])}, BF_CO + 3.17e-5) WHEN 'High' THEN printf({text(SUMMARY_TEXTS['High'])}, {_FLOW} + 3.17e-5) "
        f"ELSE printf({text(SUMMARY_TEXTS['Critical'])}, BF_Gas_Pressure + 3.17e-5) END"
    )


@query("o08_class_texts", "SELECT event_id, badge, badge_text, explanation, action, description, "
       f"{_summary_case()} AS summary FROM pred JOIN (VALUES " + ", ".join(
           f"({', '.join([text(k), *map(text, v[2:])])})" for k, v in CLASS_TEXTS.items()
       ) + ") t(predicted_class, badge, badge_text, explanation, action, description) USING (predicted_class)", ["pred"])
def o08(spark, sf):
    # readings are shifted off the rounding boundaries of the printed digits, here and in the SQL
    shifted = predictions(spark, sf).withColumns({c: F.col(c) + F.lit(3.17e-5) for c in ("BF_CO", _FLOW, "BF_Gas_Pressure")})
    out = O.class_texts(shifted)
    return out.select("event_id", "badge", "badge_text", "explanation", "action", "description", "summary")


@query("o09_suggestion_cards", f"""
SELECT asset_id, card, title, text, priority, impact, {SCORE_SQL.replace('predicted_class', 'cls').replace('confidence', 'conf')} AS worst_score
FROM (SELECT asset_id, arg_min(predicted_class, event_id) AS cls, arg_min(confidence, event_id) AS conf FROM pred GROUP BY asset_id)
CROSS JOIN (VALUES {', '.join(f"({n}, {text(t)}, {text(x)}, '{p}', '{i}')" for n, t, x, p, i in SUGGESTIONS)}) v(card, title, text, priority, impact)""", ["pred"])
def o09(spark, sf):
    """The cards next to the score of each asset's first reading."""
    first = F.min_by(F.struct("predicted_class", "confidence"), "event_id").alias("f")
    per = predictions(spark, sf).groupBy("asset_id").agg(first).select("asset_id", "f.*")
    return O.suggestion_cards(per.withColumn("worst_score", O.health_score()), ["asset_id", "worst_score"])


@query("o11_scenario_lookup", f"""
SELECT scenario, name, expected, description, n FROM (
  SELECT CASE Future_Risk_Level WHEN 'Low' THEN 'Normal Operation' WHEN 'Medium' THEN 'Gas Pressure Rise' WHEN 'High' THEN 'Cooling System Failure'
    ELSE 'Compound Hazard' END AS name, count(*) AS n FROM lab GROUP BY 1)
JOIN (VALUES {', '.join('(' + ', '.join(map(text, s)) + ')' for s in SCENARIOS)}) v(scenario, name, expected, description) USING (name)""", ["lab"])
def o11(spark, sf):
    """Scenario metadata looked up by the name that matches each risk class."""
    c = F.col("Future_Risk_Level")
    name = F.when(c == "Low", "Normal Operation").when(c == "Medium", "Gas Pressure Rise").when(c == "High", "Cooling System Failure").otherwise("Compound Hazard")
    counts = labelled(spark, sf).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(scenario_table(spark)), "name").select("scenario", "name", "expected", "description", "n")


# -- attribution -------------------------------------------------------------
L_FEATURES = ["CO_CO", "BF_CO", "BF_H2", "CO_NH3", "BF_Top_Temperature", "CO_Oven_Temperature", "BF_Cooling_Water_Flow", "Ambient_Temp"]
L_COEF = [[((k + 2) * (j + 3) % 7 - 3) / 50.0 for j in range(len(L_FEATURES))] for k in range(4)]
L_MEAN = [5.0, 50.0, 3.0, 4.0, 220.0, 1050.0, 140.0, 24.0]


def linear(spark, sf):
    return A.linear_contributions(predictions(spark, sf), L_FEATURES, L_COEF, L_MEAN, "prediction")


def _coef_case(j: int) -> str:
    return "CASE prediction " + " ".join(f"WHEN {k} THEN {d(L_COEF[k][j])}" for k in range(4)) + " END"


L_LONG = "(" + " UNION ALL ".join(
    f"SELECT event_id, prediction, '{f}' AS feature, {f} AS val, {_coef_case(j)} * ({f} - {d(L_MEAN[j])}) AS c FROM pred" for j, f in enumerate(L_FEATURES)
) + ")"
L_TOP = f"(SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(c) DESC, feature) AS rk FROM {L_LONG})"


@query("l01_linear_contributions", f"SELECT event_id, feature, {rnd('c', 'contribution')} FROM {L_LONG}", ["pred"])
def l01(spark, sf):
    return linear(spark, sf).select("event_id", F.inline_outer("contributions")).select("event_id", "feature", r6("contribution").alias("contribution"))


@query("l02_top_contributions", f"SELECT event_id, feature, CAST(rk - 1 AS INTEGER) AS place, {rnd('c', 'contribution')} FROM {L_TOP} WHERE rk <= 5", ["pred"])
def l02(spark, sf):
    top = linear(spark, sf).select("event_id", F.posexplode(A.top_contributions()).alias("place", "x"))
    return top.select("event_id", "place", F.col("x.feature").alias("feature"), r6(F.col("x.contribution")).alias("contribution"))


@query("l03_global_attribution", f"SELECT prediction, feature, {rnd('avg(abs(c))', 'mean_abs_contribution')}, count(*) AS rows FROM {L_LONG} GROUP BY ALL", ["pred"])
def l03(spark, sf):
    out = A.global_attribution(linear(spark, sf), "prediction")
    return out.select("prediction", "feature", r6("mean_abs_contribution").alias("mean_abs_contribution"), "rows")


@query("l04_contribution_text", f"""
SELECT event_id, string_agg(feature || ' (' || CASE WHEN c < 0 THEN '-' ELSE '+' END || printf('%.4f', abs(c) + 3.17e-8) || ')', '; ' ORDER BY rk) AS top_text
FROM {L_TOP} WHERE rk <= 5 GROUP BY event_id""", ["pred"])
def l04(spark, sf):
    nudged = F.transform(A.top_contributions(), lambda x: F.struct(
        x["feature"].alias("feature"), (x["contribution"] + F.signum(x["contribution"]) * F.lit(3.17e-8)).alias("contribution")))
    return linear(spark, sf).select("event_id", A.format_contributions(nudged).alias("top_text"))


@query("l05_points_impact", f"""
SELECT event_id, feature, {rnd('pts', 'points_impact')}, least(100, CAST(trunc(abs(pts) / 20e0 * 100e0) AS INTEGER)) AS bar_width_pct,
  CASE WHEN pts <= -15 THEN 'severe' WHEN pts <= -10 THEN 'high' WHEN pts <= -5 THEN 'moderate' ELSE 'low' END AS impact_band
FROM (SELECT *, greatest(-20e0, least(0e0, c * 100e0)) AS pts FROM {L_LONG})""", ["pred"])
def l05(spark, sf):
    long = linear(spark, sf).select("event_id", F.inline_outer("contributions"))
    made = A.impact_columns(F.col("contribution"))
    return long.select("event_id", "feature", r6(made["points_impact"]).alias("points_impact"), made["bar_width_pct"].alias("bar_width_pct"), made["impact_band"].alias("impact_band"))


@query("l06_factor_titles", f"""
SELECT event_id, feature, coalesce(t, replace(feature, '_', ' ')) AS title, coalesce(s, 'Feature variance index') AS subtitle
FROM {L_TOP} LEFT JOIN (VALUES {', '.join(f"('{k}', '{t}', '{s}')" for k, (t, s) in FACTOR_TITLES.items())}) v(feature, t, s) USING (feature)
WHERE rk <= 5""", ["pred"])
def l06(spark, sf):
    top = linear(spark, sf).select("event_id", F.explode(A.top_contributions()).alias("x")).select("event_id", "x.feature")
    return A.factor_display(top)


@query("l07_narrative", """
SELECT event_id, CASE WHEN predicted_class = 'Low' THEN 'The AI identified all process parameters, including temperatures, pressures, and flow rates, running well within optimal baselines.'
  ELSE 'The AI identified ' || CASE WHEN list <> '' THEN list ELSE 'slight parameter fluctuations' END || ' as the primary contributors to the reduction in plant health.' END AS narrative
FROM (SELECT *, concat_ws(', ', CASE WHEN BF_Gas_Pressure > 2.2e0 OR CO_Gas_Pressure > 2.7e0 THEN 'increasing gas pressure' END,
  CASE WHEN BF_Top_Temperature > 240 OR CO_Oven_Temperature > 1050 THEN 'elevated furnace temperature' END,
  CASE WHEN BF_Cooling_Water_Flow < 140 THEN 'reduced cooling water flow' END) AS list FROM pred)""", ["pred"])
def l07(spark, sf):
    return predictions(spark, sf).select("event_id", A.narrative().alias("narrative"))


# -- rules -------------------------------------------------------------------
def flagged(spark, sf):
    """Rule flags of mixed spelling: numbers, words, blanks, nulls."""
    e = F.col("event_id")
    return telemetry(spark, sf).select("event_id", *[
        F.when(e % (i + 2) == 0, F.when(e % 3 == 0, "1").when(e % 3 == 1, " Yes ").otherwise("0.7"))
        .when(e % (i + 3) == 0, "0.2").when(e % 5 == 0, None).otherwise("no").alias(f"Rule_R{i:03d}")
        for i in range(1, 21)
    ])


def _fired(i: int) -> str:
    return f"event_id % {i + 2} = 0"


@query("m01_flag_mode", "SELECT event_id, 20 AS flag_columns, true AS flag_mode, false AS plain_mode FROM tel")
def m01(spark, sf):
    flags, plain = flagged(spark, sf), telemetry(spark, sf)
    n = sum(c.startswith("Rule_R") for c in flags.columns)
    return flags.select("event_id", F.lit(n).alias("flag_columns"), F.lit(R.has_rule_flags(flags)).alias("flag_mode"), F.lit(R.has_rule_flags(plain)).alias("plain_mode"))


@query("m02_triggered_flags", "SELECT event_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_fired(i)} THEN 'R{i:03d}' END" for i in range(1, 21)) + ") AS rules FROM tel")
def m02(spark, sf):
    f = flagged(spark, sf)
    return f.select("event_id", F.array_join(R.flag_rule_ids(f), ",").alias("rules"))


RULES_SQL = "(VALUES " + ", ".join("(" + ", ".join(text(x) for x in r) + ")" for r in RULES) + ") r(rule_id, rule_name, process_area, hazard_category, c1, c2, c3, reason, risk_level, action)"


@query("m03_rule_lookup", "SELECT event_id, string_agg(action, ' | ' ORDER BY rule_id) AS actions, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT event_id, 'R{i:03d}' AS rule_id FROM tel WHERE {_fired(i)}" for i in range(1, 21)) + f") JOIN {RULES_SQL} USING (rule_id) GROUP BY event_id")
def m03(spark, sf):
    f = R.recommend(flagged(spark, sf)).filter(F.size("recommendations") > 0)
    texts = F.transform("recommendations", lambda r: r["recommended_action"])
    return f.select("event_id", F.array_join(texts, " | ").alias("actions"), F.size("recommendations").cast("long").alias("n"))


_FALLBACK = {"R004": "BF_CO >= 3 AND Worker_Count > 0", "R011": "CO_CO >= 3 AND Maintenance_Active", "R016": "CO_NH3 >= 0.5e0"}


def _fallback(name, rule):
    @query(name, f"SELECT event_id, {_FALLBACK[rule]} AS fired FROM tel")
    def run(spark, sf):
        return telemetry(spark, sf).select("event_id", R.fallback_predicates()[rule].alias("fired"))


_fallback("m04_worker_gas_exposure", "R004")
_fallback("m05_gas_leak_in_maintenance", "R011")
_fallback("m06_ammonia_leak", "R016")
_ACT = {r[0]: r[9] for r in RULES}
_SEV = {r[0]: r[8] for r in RULES}
_FIRED_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {text('{0}')} END".format(r) for r, c in _FALLBACK.items()) + "], lambda x: x IS NOT NULL)"
_ACT_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {text(_ACT[r])} END" for r, c in _FALLBACK.items()) + "], lambda x: x IS NOT NULL)"


@query("m07_distinct_actions", f"""
SELECT event_id, coalesce(a[1], 'Routine Monitoring') AS action_1, coalesce(a[2], '') AS action_2, coalesce(a[3], '') AS action_3,
  CASE WHEN len(a) > 0 THEN array_to_string(a, '; ') ELSE 'Routine Monitoring' END AS actions FROM (SELECT event_id, {_ACT_LIST} AS a FROM tel)""")
def m07(spark, sf):
    out = R.actions(R.recommend(telemetry(spark, sf)))
    return out.select("event_id", "action_1", "action_2", "action_3", "actions")


_HEAD = "list_filter([" + ", ".join(
    f"CASE WHEN event_id % {i + 2} = 0 THEN {text('[' + r[8].upper() + ']: ' + r[9])} END" for i, r in enumerate(RULES, 1)) + "], lambda x: x IS NOT NULL)"


@query("m08_top_recommendations", f"SELECT event_id, array_to_string(({_HEAD})[1:3], ' / ') AS headline FROM tel")
def m08(spark, sf):
    out = R.top_recommendations(R.recommend(flagged(spark, sf)))
    return out.select("event_id", F.array_join("headline", " / ").alias("headline"))


@query("m09_rule_profile", "SELECT risk_level, process_area, hazard_category, count(*) AS n, count(DISTINCT event_id) AS readings FROM (" + " UNION ALL ".join(
    f"SELECT event_id, '{r}' AS rule_id FROM tel WHERE {c}" for r, c in _FALLBACK.items()) + f") JOIN {RULES_SQL} USING (rule_id) GROUP BY ALL")
def m09(spark, sf):
    fired = R.triggered_long(telemetry(spark, sf), ["event_id"])
    return fired.groupBy("risk_level", "process_area", "hazard_category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("readings"))


@query("m10_limit_breaches", " UNION ALL ".join(
    f"SELECT '{s}' AS sensor, CASE WHEN {s} >= {d(hi)} THEN 'max' ELSE 'warn' END AS level, count(*) AS n, {rnd(f'max({s})', 'highest')} FROM tel WHERE {s} >= {d(lo)} GROUP BY 2"
    for s, (lo, hi) in SENSOR_LIMITS.items()))
def m10(spark, sf):
    out = R.limit_breaches(telemetry(spark, sf), ["event_id"])
    return out.groupBy("sensor", "level").agg(F.count(F.lit(1)).alias("n"), r6(F.max("reading")).alias("highest"))
