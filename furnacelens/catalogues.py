"""Dimension data: safety rules, class texts, factor titles, suggestion cards, scenarios."""

# ---------------------------------------------------------------------------
# Texts and specifications that results must carry verbatim.
# ---------------------------------------------------------------------------

RULE_FIELDS = [
    "rule_id", "rule_name", "process_area", "hazard_category", "condition_1", "condition_2",
    "condition_3", "compound_risk_reason", "risk_level", "recommended_action",
]
RULES = [
    ("R001", "CO Leak During Maintenance", "Blast Furnace", "Toxic Gas",
     "BF_CO Increasing", "BF_Gas_Pressure Increasing", "Maintenance Active = TRUE",
     "Workers performing maintenance may be exposed to CO gas", "Critical",
     "Stop maintenance, isolate gas source and evacuate personnel"),
    ("R002", "Furnace Cooling Failure", "Blast Furnace", "Steam Explosion",
     "Cooling Water Flow Decreasing", "Furnace Temperature Increasing", "Furnace Running = TRUE",
     "Insufficient cooling may damage furnace and generate steam explosion", "Critical",
     "Reduce blast and inspect cooling circuit immediately"),
    ("R003", "Hot Work Near Gas Leak", "Blast Furnace", "Fire / Explosion",
     "BF_CO Increasing", "BF_H2 Increasing", "Hot Work Permit = TRUE",
     "Ignition source present near combustible gases", "Critical",
     "Stop hot work and isolate gas source"),
    ("R004", "Worker Gas Exposure", "Blast Furnace", "Toxic Exposure",
     "BF_CO Above Warning", "BF_CO Increasing", "Worker In Hazard Zone = TRUE",
     "Worker directly exposed to increasing CO concentration", "High",
     "Evacuate workers and use breathing apparatus"),
    ("R005", "Furnace Overpressure", "Blast Furnace", "Explosion",
     "Top Pressure Increasing", "Burden Level High", "Charging Active = TRUE",
     "Excess furnace pressure during charging operation", "High",
     "Reduce pressure and inspect charging system"),
    ("R006", "PCI Line Instability", "Blast Furnace", "Fire",
     "Coal Injection Pressure Increasing", "Coal Flow Fluctuating", "Furnace Running = TRUE",
     "Coal accumulation may ignite inside PCI line", "Medium",
     "Inspect PCI pipeline and stabilize coal flow"),
    ("R007", "Blower Failure", "Blast Furnace", "Process Instability",
     "Blower Vibration Increasing", "Motor Current Increasing", "Furnace Running = TRUE",
     "Air supply becoming unstable", "Medium",
     "Inspect blower bearings and motor"),
    ("R008", "Cast House Burn Hazard", "Blast Furnace", "Thermal Hazard",
     "Hot Metal Temperature High", "Thermal Camera Hotspot Detected", "Worker Nearby = TRUE",
     "Worker exposed to molten metal splash risk", "High",
     "Restrict access and enforce PPE"),
    ("R009", "Gas Cleaning Failure", "Blast Furnace", "Toxic Gas",
     "CO Increasing", "Filter Differential Pressure Increasing", "Furnace Running = TRUE",
     "Gas cleaning efficiency decreasing", "High",
     "Inspect gas cleaning filters"),
    ("R010", "Tuyere Burn-through", "Blast Furnace", "Thermal Failure",
     "Tuyere Temperature High", "Cooling Water Flow Low", "Furnace Running = TRUE",
     "Local overheating at tuyere may damage furnace", "Critical",
     "Reduce blast and inspect tuyere immediately"),
    ("R011", "Coke Oven Gas Leak", "Coke Oven", "Toxic Gas",
     "CO Increasing", "Gas Collector Pressure Increasing", "Maintenance Active = TRUE",
     "Gas leakage while maintenance is in progress", "Critical",
     "Stop maintenance and isolate gas collector"),
    ("R012", "Hot Work Near Coke Oven Gas", "Coke Oven", "Explosion",
     "CH4 Increasing", "CO Increasing", "Hot Work Permit = TRUE",
     "Combustible gas present near ignition source", "Critical",
     "Suspend hot work immediately"),
    ("R013", "Coke Oven Overheating", "Coke Oven", "Fire",
     "Oven Temperature Increasing", "Flue Temperature Increasing", "Oven Operating = TRUE",
     "Excessive oven temperature may damage refractory", "High",
     "Reduce heating and inspect combustion system"),
    ("R014", "Quenching Failure", "Coke Oven", "Thermal Hazard",
     "Quenching Water Flow Low", "Steam Temperature Increasing", "Quenching Active = TRUE",
     "Inadequate quenching leading to excessive steam", "High",
     "Inspect quenching water system"),
    ("R015", "Pusher Machine Failure", "Coke Oven", "Mechanical Failure",
     "Motor Current Increasing", "Vibration Increasing", "Pushing Operation = TRUE",
     "Mechanical failure during coke pushing", "Medium",
     "Stop pusher and inspect drive mechanism"),
    ("R016", "NH3 Leak During Operation", "Coke Oven", "Toxic Exposure",
     "NH3 Concentration Increasing", "Gas Pressure Increasing", "Worker Nearby = TRUE",
     "Workers exposed to ammonia leak", "High",
     "Evacuate workers and isolate leak"),
    ("R017", "Benzol Vapor Ignition", "Coke Oven", "Fire",
     "VOC Increasing", "Gas Pressure Increasing", "Hot Work Permit = TRUE",
     "Flammable vapour with ignition source", "Critical",
     "Stop hot work and ventilate area"),
    ("R018", "Unauthorized Entry", "Coke Oven", "Worker Safety",
     "Worker Detected", "Hazard Zone Occupied", "Permit Not Available",
     "Unauthorized personnel inside hazardous area", "High",
     "Remove personnel and verify permit"),
    ("R019", "Night Shift Maintenance Risk", "Blast Furnace", "Operational Risk",
     "BF_CO Increasing", "Cooling Water Flow Decreasing", "Night Shift + Maintenance Active",
     "Reduced supervision during hazardous condition", "High",
     "Increase supervision and suspend maintenance"),
    ("R020", "Compound Gas Exposure Event", "Coke Oven", "Explosion",
     "CO Increasing", "CH4 Increasing", "Worker Present + Gas Test Not Completed",
     "Multiple hazardous gases with personnel exposure", "Critical",
     "Evacuate area, isolate gas and perform emergency response"),
]

# class -> (score base, score slope, badge, badge text, explanation banner, action banner, description)
CLASS_TEXTS = {
    "Low": (
        100.0, 20.0, "SAFE OPERATION", "AI PREDICTS SAFE OPERATING CONDITION",
        "Overall operational stability is high and all safety protocols are active.",
        "No immediate action required. Plant is operating safely.",
        "System is stable and operating efficiently. All parameters are well within normal operating "
        "thresholds with zero safety violations."),
    "Medium": (
        70.0, 20.0, "MEDIUM RISK WARNING", "THERMAL / PRESSURE FLUCTUATION DETECTED",
        "Operational parameters require operator attention to stabilize thermal gradient.",
        "Operator action required: Adjust cooling flow and throttle pressure valve.",
        "System is stable but showing signs of potential risk. Continuous monitoring and timely action "
        "recommended."),
    "High": (
        45.0, 25.0, "HIGH RISK ELEVATED", "RAPID HAZARD EXCURSION DETECTED",
        "HIGH RISK: Initiate emergency cooling and pressure relief procedures immediately.",
        "IMMEDIATE ACTION REQUIRED: Activate auxiliary cooling and evacuate Sector B.",
        "Safety hazard thresholds exceeded. Elevated temperatures or gas leaks detected. Operator "
        "intervention required immediately."),
    "Critical": (
        20.0, 15.0, "CRITICAL EMERGENCY ALERT", "HAZARDOUS BREACH & SAFETY TRIP ACTIVE",
        "CRITICAL ALERT: Execute total plant emergency shutdown and site evacuation.",
        "CRITICAL HAZARD: Emergency trip active. Full site evacuation in progress.",
        "Critical hazard. Automated emergency shutdown valve sequences have been initiated. Evacuate "
        "sector floor immediately."),
}

# class -> one-line summary with printf slots (filled by summary_text)
SUMMARY_TEXTS = {
    "Low": "All telemetry indicators are operating within baseline limits. Plant compliance is 100% "
           "and safety systems report optimal status.",
    "Medium": "Moderate risk detected due to rising gas levels (CO: %.2f%%) or thermal imbalances. "
              "Operations remain functional.",
    "High": "High risk alerts: cooling flow reduced (%.1f L/min) and blast temperature elevated. "
            "Response teams notified.",
    "Critical": "Compound safety violations. Gas pressure (%.2f bar) and vibrations are at critical "
                "peaks. Emergency trip active.",
}

# feature -> (title, subtitle)
FACTOR_TITLES = {
    "BF_Gas_Pressure": ("Gas Pressure Fluctuation", "Increasing pressure beyond normal range"),
    "BF_Top_Temperature": ("Furnace Temperature", "Approaching upper operational limit"),
    "BF_Cooling_Water_Flow": ("Cooling Water Flow", "Flow rate below optimal level"),
    "BF_CO": ("CO Concentration", "Rising CO level in top gas"),
    "BF_Blower_Vibration": ("Equipment Vibration", "Slight increase in vibration intensity"),
    "CO_CO": ("CO Concentration", "Rising CO level in top gas"),
    "CO_Gas_Pressure": ("Gas Pressure Fluctuation", "Increasing pressure beyond normal range"),
    "CO_Oven_Temperature": ("Furnace Temperature", "Approaching upper operational limit"),
    "CO_Pusher_Vibration": ("Equipment Vibration", "Slight increase in vibration intensity"),
}
FACTOR_SUBTITLE_DEFAULT = "Feature variance index"

# (card, title, text, priority, impact)
SUGGESTIONS = [
    (1, "Optimize Gas Pressure", "Reduce gas pressure to within optimal range (1.5 - 2.0 bar)", "HIGH", "HIGH"),
    (2, "Improve Cooling Water Flow", "Increase cooling water flow rate to 150 - 180 L/min", "HIGH", "HIGH"),
    (3, "Monitor Temperature Closely", "Maintain furnace temperature below upper limit (≤ 1200 °C)", "MEDIUM", "MEDIUM"),
    (4, "Regular Equipment Inspection", "Check critical equipment for wear and vibration issues", "MEDIUM", "MEDIUM"),
    (5, "Maintain CO Levels", "Ensure CO concentration remains below 2.5% in top gas", "LOW", "LOW"),
]

NARRATIVE_STABLE = (
    "The AI identified all process parameters, including temperatures, pressures, and flow rates, "
    "running well within optimal baselines."
)
NARRATIVE_NONE = "slight parameter fluctuations"

# (id, name, expected risk, description)
SCENARIOS = [
    ("s1", "Normal Operation", "Low Risk",
     "All process variables remain within safe operating limits."),
    ("s2", "Gas Pressure Rise", "Medium Risk",
     "Blast Furnace gas pressure gradually increases above the recommended range."),
    ("s3", "Cooling System Failure", "High Risk",
     "Cooling water flow decreases while furnace temperature increases."),
    ("s4", "Compound Hazard", "Critical Risk",
     "Simultaneous pressure rise, cooling decrease, temp surge, and gas leak."),
    ("s5", "Maintenance Mode", "Low/Medium Risk",
     "Plant is operating under scheduled maintenance with reduced production."),
    ("s6", "Equipment Wear", "Medium Risk",
     "Blower vibration gradually increases over time indicating mechanical wear."),
    ("s7", "Emergency Shutdown", "Critical Risk",
     "Critical alarms trigger controlled safety shutdown procedures."),
]

# scenario -> ordered segments (risk class, rows)
SCENARIO_SEGMENTS = {
    "s1": [("Low", 50)],
    "s2": [("Low", 15), ("Medium", 35)],
    "s3": [("Low", 15), ("High", 35)],
    "s4": [("Low", 10), ("Medium", 10), ("High", 10), ("Critical", 20)],
    "s5": [("Low", 50)],
    "s6": [("Low", 50)],
    "s7": [("Critical", 10), ("Critical", 40)],
}

# scenario -> (first ramp row, ramp length)
SCENARIO_RAMP_ROWS = {"s2": (15, 35), "s3": (15, 35), "s4": (10, 40), "s6": (0, 50), "s7": (10, 40)}

# scenario -> {sensor: (start, change over the ramp)}
SCENARIO_RAMPS = {
    "s2": {"BF_Gas_Pressure": (2.0, 2.2), "CO_Gas_Pressure": (2.2, 2.0), "BF_CO": (1.2, 1.5), "CO_CO": (1.0, 1.6)},
    "s3": {"BF_Cooling_Water_Flow": (150.0, -70.0), "BF_Top_Temperature": (200.0, 110.0),
           "BF_Cooling_Water_Temperature": (35.0, 20.0)},
    "s4": {"BF_Gas_Pressure": (2.0, 2.8), "BF_Cooling_Water_Flow": (150.0, -95.0),
           "BF_Top_Temperature": (200.0, 180.0), "BF_CO": (1.2, 3.6), "CO_CO": (1.0, 3.2),
           "BF_Blower_Vibration": (1.5, 3.0)},
    "s6": {"BF_Blower_Vibration": (1.2, 2.4), "CO_Pusher_Vibration": (1.4, 2.0),
           "BF_Blower_Current": (3000.0, 1500.0)},
    "s7": {"BF_Top_Temperature": (250.0, -160.0), "CO_Oven_Temperature": (1000.0, -400.0)},
}

# scenario -> sensors that decay from their value on the first ramp row
SCENARIO_DECAYS = {"s7": ["BF_Blast_Flow", "BF_Blower_Current"]}

# scenario -> constants on the ramp rows (all rows where there is no ramp)
SCENARIO_OVERRIDES = {
    "s5": {"Maintenance_Active": True, "Permit_Type": "Hot Work", "PPE_Compliance": True,
           "Worker_Count": 6.0, "Gas_Test_Completed": True, "BF_CO": 1.8, "CO_CO": 1.6},
    "s7": {"CO_Pusher_Current": 0.0, "Worker_Count": 0.0},
}
SCENARIO_START = "2026-10-01 09:00:00"
