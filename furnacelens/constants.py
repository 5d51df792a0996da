"""Domain constants: sensors, bounds, defaults, domains, thresholds, labels."""

# ---------------------------------------------------------------------------
# Fixed values. These must stay exactly as they are for results to agree.
# ---------------------------------------------------------------------------

# Sensors that feed the rolling statistics, in their canonical order.
PHYSICAL_SENSORS = [
    "BF_Blast_Flow", "BF_Top_Temperature", "CO_Gas_Pressure", "CO_CO", "BF_H2", "CO_NH3",
    "BF_Blower_Current", "BF_Blower_Vibration", "BF_Burden_Level", "BF_Cooling_Water_Flow",
    "BF_Cooling_Water_Temperature", "BF_Top_Pressure", "CO_Oven_Temperature", "CO_Flue_Temperature",
    "CO_Pusher_Current", "CO_Pusher_Vibration", "CO_Quenching_Water_Flow", "CO_Steam_Temperature",
]

# All raw sensors a packet must carry.
RAW_SENSORS = PHYSICAL_SENSORS + ["Ambient_Temp", "Worker_Count", "BF_CO", "BF_Gas_Pressure"]

# Physical bounds (low, high) and operational default per sensor.
SENSOR_BOUNDS = {
    "BF_Blast_Flow": (0.0, 5000.0),
    "BF_Top_Temperature": (0.0, 1000.0),
    "CO_Gas_Pressure": (0.0, 50.0),
    "CO_CO": (0.0, 100.0),
    "BF_H2": (0.0, 20.0),
    "CO_NH3": (0.0, 10.0),
    "BF_Blower_Current": (0.0, 10000.0),
    "BF_Blower_Vibration": (0.0, 20.0),
    "BF_Burden_Level": (0.0, 10.0),
    "BF_Cooling_Water_Flow": (0.0, 1000.0),
    "BF_Cooling_Water_Temperature": (0.0, 100.0),
    "BF_Top_Pressure": (0.0, 10.0),
    "CO_Oven_Temperature": (0.0, 2000.0),
    "CO_Flue_Temperature": (0.0, 2000.0),
    "CO_Pusher_Current": (0.0, 1000.0),
    "CO_Pusher_Vibration": (0.0, 20.0),
    "CO_Quenching_Water_Flow": (0.0, 1000.0),
    "CO_Steam_Temperature": (0.0, 500.0),
    "Ambient_Temp": (-40.0, 60.0),
    "Worker_Count": (0.0, 100.0),
    "BF_CO": (0.0, 100.0),
    "BF_Gas_Pressure": (0.0, 50.0),
}
SENSOR_DEFAULTS = {
    "BF_Blast_Flow": 1500.0,
    "BF_Top_Temperature": 200.0,
    "CO_Gas_Pressure": 2.5,
    "CO_CO": 1.5,
    "BF_H2": 1.5,
    "CO_NH3": 0.1,
    "BF_Blower_Current": 3000.0,
    "BF_Blower_Vibration": 1.5,
    "BF_Burden_Level": 2.0,
    "BF_Cooling_Water_Flow": 150.0,
    "BF_Cooling_Water_Temperature": 35.0,
    "BF_Top_Pressure": 1.5,
    "CO_Oven_Temperature": 1000.0,
    "CO_Flue_Temperature": 1150.0,
    "CO_Pusher_Current": 150.0,
    "CO_Pusher_Vibration": 1.5,
    "CO_Quenching_Water_Flow": 100.0,
    "CO_Steam_Temperature": 250.0,
    "Ambient_Temp": 25.0,
    "Worker_Count": 5.0,
    "BF_CO": 15.0,
    "BF_Gas_Pressure": 2.0,
}

# Allowed categories; the default is given separately.
CATEGORY_DOMAINS = {
    "Shift_Type": ["Morning", "Afternoon", "Night"],
    "Permit_Type": ["None", "Hot Work", "Confined Space", "General"],
    "CCTV_Event": ["Normal", "Worker No PPE"],
}
CATEGORY_DEFAULTS = {"Shift_Type": "Morning", "Permit_Type": "None", "CCTV_Event": "Normal"}
BOOLEAN_DEFAULTS = {"PPE_Compliance": True, "Maintenance_Active": False, "Gas_Test_Completed": True}
TRUE_TOKENS = ["true", "yes", "1", "t", "y"]
FALSE_TOKENS = ["false", "no", "0", "f", "n"]
FLAG_TOKENS = ["true", "1", "1.0", "yes"]

ROLLING_WINDOWS = [5, 15, 30]
BUFFER_ROWS = 30
SAFETY_LAG_ROWS = 5
DEFAULT_SAFETY_INDEX = 100.0

RISK_CLASSES = ["Low", "Medium", "High", "Critical"]

# Sensor limit table: sensor -> (warn, max).
SENSOR_LIMITS = {
    "BF_Blast_Flow": (2200.0, 3000.0),
    "BF_Top_Temperature": (160.0, 250.0),
    "CO_Gas_Pressure": (3.5, 5.0),
    "CO_CO": (3.0, 5.0),
    "BF_H2": (4.0, 5.5),
    "CO_NH3": (0.5, 1.0),
}

# Columns that leak the target, and why.
RULE_FLAG_COLUMNS = [f"Rule_R{i:03d}" for i in range(1, 21)]
LEAKAGE_COLUMNS = [
    "Safety_Index", "Compound_Risk_Score", "Future_Risk_Level", "Event_ID",
    "Cumulative_Risk_5", "Cumulative_Risk_15", "Cumulative_Risk_30",
    "Minutes_To_Incident", "Event_Phase",
    "BF_State_ID", "BF_State_Name", "BF_State_Risk",
    "CO_State_ID", "CO_State_Name", "CO_State_Risk",
] + RULE_FLAG_COLUMNS
LEAKAGE_CATEGORY = {
    "Future_Risk_Level": "Target",
    "Safety_Index": "Direct Class Boundary",
    "Compound_Risk_Score": "Derived Target",
    "Event_ID": "High Cardinality Metadata",
}

# Column names treated as categorical whatever their physical type.
CLEANING_CATEGORICAL = [
    "Shift_Type", "PPE_Compliance", "Permit_Type", "CCTV_Event", "Event_Phase", "Event_ID",
]
ENCODING_CATEGORICAL = CLEANING_CATEGORICAL + [
    "BF_State_ID", "BF_State_Name", "CO_State_ID", "CO_State_Name",
]

# Substrings that mark a numeric column as derived, and context columns left out.
DERIVED_MARKERS = ["_roll_", "_Index", "_Score", "_Indicator", "_Quality"]
CONTEXT_COLUMNS = ["Worker_Count", "Ambient_Temp"]

# Feature domains: first rule with a matching substring wins.
DOMAIN_RULES = [
    ("Rolling Features", ["roll_avg", "roll_grad", "Cumulative_Risk"]),
    ("Engineered Features", ["Risk_Index", "Stability_Index", "Lead_Indicator", "Window", "Event_"]),
    ("Blast Furnace", ["BF_"]),
    ("Coke Oven", ["CO_"]),
    ("Worker", ["Worker", "PPE"]),
    ("Maintenance", ["Maintenance", "Permit", "Gas_Test"]),
    ("Environment", ["Ambient"]),
]
DOMAIN_OTHER = "General Context"

FEATURE_SET_SIZES = {"FeatureSet_A": None, "FeatureSet_B": 80, "FeatureSet_C": 45}
SPLIT_RATIO = {"train": 0.70, "valid": 0.15, "test": 0.15}
OUTLIER_RATIO_LIMIT = 0.01
NOISE_STD = 0.05
SEED = 42

# Stream health limits.
STALL_SECONDS = 10.0
LATENCY_LIMITS_MS = {"warning": 50.0, "critical": 200.0}
LOSS_LIMITS_PCT = {"warning": 2.0, "critical": 10.0}
EMA_ALPHA = 0.1
