"""Column names, thresholds and dimension tables used across the package."""

from __future__ import annotations

# --------------------------------------------------------------------------
# Frame layout (fixed values: column names and order of the telemetry record)
# --------------------------------------------------------------------------
SETTINGS = tuple(f"setting_{i}" for i in range(1, 4))
SENSORS = tuple(f"sensor_{i}" for i in range(1, 22))
RAW_COLUMNS = ("engine_id", "cycle") + SETTINGS + SENSORS
SUBSETS = ("FD001", "FD002", "FD003", "FD004")
SUBSET_REGIMES = {"FD001": 1, "FD002": 6, "FD003": 1, "FD004": 6}

FRAME = ("subset", "split")
UNIT = ("subset", "split", "engine_id")

# --------------------------------------------------------------------------
# Numeric settings (fixed values)
# --------------------------------------------------------------------------
RUL_CAP = 125
ROLLING_WINDOW = 5
CONSTANT_VARIANCE = 1e-10
NEAR_CONSTANT_VARIANCE = 1e-3
ACTIVE_VARIANCE = 1e-5
USEFUL_CORRELATION = 0.10
PCT_CHANGE_FLOOR = 1e-9
STD_FLOOR = 1e-6

HEALTHY_RUL = 100.0
MIN_HEALTHY_ROWS = 50
EARLY_CYCLES = 30
ANOMALY_THRESHOLD = 60.0

FOREST_TREES = 150
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.08
SEED = 42

FOREST_RUL = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2}
BOOSTED_RUL = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8}

# Lower score bound of each stage, best stage first (fixed values).
HEALTH_STAGES = (
    (75.0, "HEALTHY"),
    (45.0, "MONITOR"),
    (20.0, "MAINTENANCE REQUIRED"),
    (0.0, "CRITICAL"),
)
ANOMALY_SEVERITIES = (
    (80.0, "Severe Anomaly"),
    (65.0, "Moderate Anomaly"),
    (45.0, "Mild Drift"),
    (0.0, "Nominal"),
)
# |z| bound, severity text, contribution text (fixed values).
DEVIATION_LEVELS = (
    (3.0, "Critical deviation", "High contribution"),
    (2.0, "High deviation", "High contribution"),
    (1.0, "Moderate deviation", "Medium contribution"),
    (0.0, "Low deviation", "Low contribution"),
)
NOMINAL_TEXT = "All sensors within nominal range"

# Decision thresholds per status (fixed values).
DECISION = {
    "critical_rul": 20.0,
    "critical_anomaly": 80.0,
    "maintenance_rul": 45.0,
    "maintenance_anomaly": 65.0,
    "monitor_rul": 75.0,
    "monitor_anomaly": 45.0,
}
MAINTENANCE_WINDOW = 15
MONITOR_WINDOW = 30
STATUSES = ("HEALTHY", "MONITOR", "MAINTENANCE REQUIRED", "CRITICAL")

# --------------------------------------------------------------------------
# Sensor dimension (fixed values): name, component, system
# --------------------------------------------------------------------------
SENSOR_DIM = (
    ("sensor_1", "T2 (Total Fan Inlet Temp)", "Fan & Inlet Cowl", "Air Intake"),
    ("sensor_2", "T24 (LPC Outlet Temp)", "Low-Pressure Compressor (LPC)", "Compression"),
    ("sensor_3", "T30 (HPC Outlet Temp)", "High-Pressure Compressor (HPC)", "Compression"),
    ("sensor_4", "T48 (LPT Outlet Temp)", "Low-Pressure Turbine (LPT)", "Turbine Gas Path"),
    ("sensor_5", "P2 (Fan Inlet Pressure)", "Fan & Inlet Cowl", "Air Intake"),
    ("sensor_6", "P15 (Bypass Duct Pressure)", "Bypass Duct & Fan Exit", "Secondary Flow"),
    ("sensor_7", "P30 (HPC Outlet Total Pressure)", "High-Pressure Compressor (HPC)", "Compression"),
    ("sensor_8", "Nf (Physical Fan Speed)", "Fan Rotor & Low-Pressure Shaft", "Rotary Mechanics"),
    ("sensor_9", "Nc (Physical Core Speed)", "High-Pressure Core Spool", "Rotary Mechanics"),
    ("sensor_10", "epr (Engine Pressure Ratio)", "Turbine Expansion & Exhaust Nozzle", "Gas Expansion"),
    ("sensor_11", "T50 (HPT Outlet Temp)", "High-Pressure Turbine (HPT)", "Turbine Gas Path"),
    ("sensor_12", "Ps30 (HPC Static Pressure)", "Diffuser & Combustor Inlet", "Combustion"),
    ("sensor_13", "Phi (Corrected Fan Speed)", "Fan Governor & FADEC", "Control & Speed"),
    ("sensor_14", "NRc (Corrected Core Speed)", "Core High-Pressure Governor", "Control & Speed"),
    ("sensor_15", "BPR (Bypass Ratio)", "Bypass Splitter & Fan Aero", "Aerodynamics"),
    ("sensor_16", "farB (Burner Fuel-Air Ratio)", "Fuel Nozzles & Combustor Liner", "Fuel / Combustion"),
    ("sensor_17", "htBleed (Bleed Enthalpy)", "Customer Bleed & Anti-Ice System", "Thermal & Bleed"),
    ("sensor_18", "Nf_dmd (Demanded Fan Speed)", "FADEC Thrust Command", "Avionics / FADEC"),
    ("sensor_19", "PCNfR_dmd (Demanded Corr. Fan Speed)", "FADEC Control Unit", "Avionics / FADEC"),
    ("sensor_20", "W31 (HPT Coolant Bleed Flow)", "HPT Vane Cooling Gas Path", "Cooling"),
    ("sensor_21", "W32 (LPT Coolant Bleed Flow)", "LPT Blade Cooling Bleed", "Cooling"),
)

# Ordered tag -> subsystem list; the first tag found in a text wins (fixed values).
SUBSYSTEM_TAGS = (
    ("sensor_1", "Air Intake"),
    ("sensor_2", "Compressor"),
    ("sensor_3", "Compressor"),
    ("sensor_4", "Turbine"),
    ("sensor_5", "Air Intake"),
    ("sensor_6", "Secondary Flow"),
    ("sensor_7", "Compressor"),
    ("sensor_8", "Mechanical"),
    ("sensor_9", "Mechanical"),
    ("sensor_10", "Turbine"),
    ("sensor_11", "Turbine"),
    ("sensor_12", "Combustion"),
    ("sensor_13", "Control & Speed"),
    ("sensor_14", "Control & Speed"),
    ("sensor_15", "Aerodynamics"),
    ("sensor_16", "Combustion"),
    ("sensor_17", "Thermal"),
    ("sensor_18", "Control & Speed"),
    ("sensor_19", "Control & Speed"),
    ("sensor_20", "Cooling"),
    ("sensor_21", "Cooling"),
    ("T2", "Air Intake"),
    ("T24", "Compressor"),
    ("T30", "Compressor"),
    ("T48", "Turbine"),
    ("P2", "Air Intake"),
    ("P15", "Secondary Flow"),
    ("P30", "Compressor"),
    ("Nf", "Mechanical"),
    ("Nc", "Mechanical"),
    ("epr", "Turbine"),
    ("T50", "Turbine"),
    ("Ps30", "Combustion"),
    ("Phi", "Control & Speed"),
    ("NRc", "Control & Speed"),
    ("BPR", "Aerodynamics"),
    ("farB", "Combustion"),
    ("htBleed", "Thermal"),
    ("Nf_dmd", "Control & Speed"),
    ("PCNfR_dmd", "Control & Speed"),
    ("W31", "Cooling"),
    ("W32", "Cooling"),
)
DEFAULT_SUBSYSTEM = "Compressor"
DEFAULT_FAULT = "HPC Pressure Deviation"

# Maintenance protocols (fixed values):
# subsystem, task code, title, labour hours, grounding risk, window in days
PROTOCOLS = (
    ("Compressor", "TASK-72-30-01", "HPC borescope inspection & stage-1/2 blade wash", 12.0, "high", 7),
    ("Turbine", "TASK-72-50-04", "HPT shroud tile inspection & NGV thermal check", 18.0, "high", 5),
    ("Thermal", "TASK-75-21-00", "Bleed valve actuator test & duct insulation audit", 6.0, "medium", 14),
    ("Combustion", "TASK-72-40-02", "Combustor fuel nozzle flow test & liner inspection", 14.0, "high", 7),
    ("Mechanical", "TASK-72-00-11", "Main bearing oil chip detector & vibration audit", 8.0, "medium", 10),
    ("Cooling", "TASK-75-30-01", "Turbine cooling air circuit flow check & valve overhaul", 10.0, "medium", 10),
    ("Air Intake", "TASK-71-11-01", "Inlet cowl lip anti-ice & fan acoustic panel audit", 4.0, "low", 21),
    ("Secondary Flow", "TASK-75-10-00", "Bypass duct seal inspection & pressure tap calibration", 5.0, "low", 21),
    ("Control & Speed", "TASK-73-20-00", "FADEC sensor harness continuity & speed sensor test", 4.0, "low", 21),
    ("Aerodynamics", "TASK-72-21-00", "Fan blade variable pitch mechanism & acoustic liner check", 8.0, "medium", 14),
    ("Unclassified", "TASK-70-00-00", "General line inspection & telemetry re-calibration", 4.0, "low", 14),
)

# Cost assumptions (fixed values)
PLANNED_SHOP_VISIT = 150000.0
UNPLANNED_REMOVAL = 450000.0
GROUNDED_PER_DAY = 85000.0
GROUNDED_DAYS = 2.5
SECONDARY_DAMAGE_PROBABILITY = 0.35
SECONDARY_DAMAGE_COST = 220000.0
CANCELLATION_COST = 40000.0
LABOUR_RATE = 185.0
CYCLES_PER_DAY = 2.0

# Safety matrix (fixed values)
SEVERITY_LEVELS = ("Negligible", "Minor", "Major", "Hazardous", "Catastrophic")
LIKELIHOOD_LEVELS = ("Improbable", "Remote", "Occasional", "Probable", "Frequent")
LIKELIHOOD_BOUNDS = ((0.60, "Frequent"), (0.30, "Probable"), (0.10, "Occasional"), (0.02, "Remote"))
RISK_BANDS = (
    (15, "CRITICAL", "Unacceptable — ground until rectified"),
    (9, "HIGH", "Rectify before next departure"),
    (5, "MEDIUM", "Schedule within current maintenance window"),
    (0, "LOW", "Routine surveillance under maintenance program"),
)

# Interval settings (fixed values)
RUL_BIN_EDGES = (20.0, 40.0, 70.0, 100.0)
ALPHAS = (0.5, 0.4, 0.3, 0.2, 0.1, 0.05)
FALLBACK_OFFSET = 15.0

# Fleet-risk settings (fixed values)
HORIZON_DAYS = (3, 7, 14, 30, 60)
N_SIMULATIONS = 4000
COMMON_SHOCK = 0.25
SHOP_CAPACITY = 6

# Fault library (fixed values): fault, label, onset, ramp cycles, sensor weights
FAULTS = (
    ("hpc_fouling", "HP Compressor Fouling", "ramp", 25,
     {"sensor_3": 1.8, "sensor_12": -1.6, "sensor_11": 1.5, "sensor_9": 1.4,
      "sensor_13": 1.3, "sensor_7": -1.1, "sensor_17": 1.0}),
    ("hpt_blade_damage", "HPT Blade Deterioration", "ramp", 18,
     {"sensor_11": 2.2, "sensor_20": -1.5, "sensor_21": -1.4, "sensor_13": 1.4,
      "sensor_3": 1.0, "sensor_17": 1.3}),
    ("bird_strike", "Bird Strike / Fan FOD", "step", 1,
     {"sensor_8": 2.6, "sensor_14": 2.5, "sensor_15": -2.2, "sensor_6": -1.9,
      "sensor_2": 1.7, "sensor_13": 1.5}),
    ("bleed_leak", "Bleed Air Duct Leak", "ramp", 12,
     {"sensor_17": 2.0, "sensor_7": -1.3, "sensor_13": 1.2, "sensor_2": -0.9}),
    ("sensor_drift", "Sensor Calibration Drift (Nuisance)", "ramp", 30,
     {"sensor_3": 2.4}),
)

# --------------------------------------------------------------------------
# Advisory texts (fixed values)
# --------------------------------------------------------------------------
DISCLAIMER = (
    "NOTICE: This predictive health assessment and maintenance recommendation system is a research "
    "decision-support prototype developed for C-MAPSS turbofan data. It does not replace or supersede "
    "certified FAA/EASA airworthiness directives, engine shop manuals (ESM), or approved airline standard "
    "operating procedures."
)
RECOMMENDATIONS = {
    "CRITICAL": "CRITICAL: Immediate Engine Grounding & Depot-Level Overhaul Required",
    "MAINTENANCE REQUIRED": "MAINTENANCE REQUIRED: Schedule Priority Borescope & Component Inspection",
    "MONITOR": "MONITOR: Approved for Service with Heightened Telemetry & Vibration Sampling",
    "HEALTHY": "HEALTHY: Continue Normal Flight Operations & Scheduled Line Service",
}
SIMPLE_ACTIONS = (
    (25.0, 80.0, "CRITICAL: Immediate Maintenance & Grounding Required"),
    (50.0, 65.0, "URGENT: Schedule Inspection & Maintenance"),
    (80.0, 45.0, "MONITOR: Heightened Telemetry & Vibration Monitoring"),
)
SIMPLE_ACTION_DEFAULT = "OPERATIONAL: Normal Operating Parameters"

# Keywords looked for in the component and system names -> action text, in output order.
ACTION_ITEMS = (
    (("high-pressure compressor", "compression", "hpc"),
     "Perform borescope inspection on HPC stages 5-9 for blade tip erosion, fouling, and clearance loss."),
    (("high-pressure turbine", "hpt", "cooling"),
     "Conduct optical borescope inspection of HPT 1st-stage nozzle guide vanes and blade thermal barrier coating (TBC)."),
    (("low-pressure turbine", "lpt"),
     "Inspect LPT rotor stages and exhaust gas temperature (EGT/T48) thermocouple harnesses."),
    (("fan", "air intake"),
     "Inspect titanium fan blade leading edges for foreign object damage (FOD) and perform shaft balance check."),
    (("combustor", "combustion", "fuel"),
     "Inspect fuel flow metering valve, burner nozzles, and combustor liner for hot streaks."),
    (("bleed", "thermal"),
     "Check high-pressure bleed air valve operation and pre-cooler ducting for seal leakage."),
)
ACTION_DEFAULT = "Execute general propulsion system diagnostic routine and check sensor calibration logs."
ACTION_HEALTHY = "Perform standard pre-flight walkaround and routine flight data recorder (FDR) telemetry logging."
ACTION_GROUNDING = "IMMEDIATE GROUNDING: Remove engine from wing / transfer to overhaul test cell."

# Decision reasons: {rul} and {anomaly} are one-decimal numbers, {sensors} the optional clause.
REASONS = {
    "unknown": "UNKNOWN BEHAVIOUR: Telemetry differs significantly from learned patterns (Anomaly Score: {anomaly}/100) "
               "while RUL model predicts {rul} cycles. Human inspection recommended{sensors}.",
    "disagreement": "MODEL DISAGREEMENT: Current telemetry is inconsistent with the RUL model's expected behavior "
                    "(RUL: {rul} cycles vs Anomaly: {anomaly}/100). Human inspection recommended{sensors}.",
    "critical_both": "CRITICAL: Imminent end-of-life (RUL: {rul} cycles) combined with severe multi-sensor anomaly "
                     "(Score: {anomaly}/100){sensors}.",
    "critical_rul": "CRITICAL: Exhausted remaining operational life (RUL: {rul} cycles < 20 cycle threshold){sensors}.",
    "critical_anomaly": "CRITICAL: Severe telemetry anomaly detected (Score: {anomaly}/100 >= 80) indicating acute "
                        "sub-system fault{sensors}.",
    "maintenance_both": "MAINTENANCE REQUIRED: Low remaining life (RUL: {rul} cycles) with significant sensor "
                        "abnormality (Score: {anomaly}/100){sensors}.",
    "maintenance_rul": "MAINTENANCE REQUIRED: Approaching maintenance threshold (RUL: {rul} cycles < 45 cycle "
                       "limit){sensors}.",
    "maintenance_anomaly": "MAINTENANCE REQUIRED: Elevated anomaly score ({anomaly}/100 >= 65) indicating active "
                           "degradation{sensors}.",
    "monitor_anomaly": "MONITOR: Mild telemetry drift detected (Score: {anomaly}/100) with RUL at {rul} cycles{sensors}.",
    "monitor_rul": "MONITOR: Mid-life operational regime (RUL: {rul} cycles < 75 cycles); telemetry currently nominal.",
    "healthy": "HEALTHY: High remaining useful life (RUL: {rul} cycles >= 75) with nominal baseline telemetry "
               "(Score: {anomaly}/100).",
}
SENSOR_CLAUSE = " | Sensor deviations: "
