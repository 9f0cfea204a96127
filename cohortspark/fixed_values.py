"""They must equal the published analysis for results to agree."""

# Laboratory items used as predictors, and the longer outcome list.
LAB_ITEMS = [
    "hb", "platelet", "wbc", "aptt", "ptinr", "glucose", "bun", "albumin",
    "ast", "alt", "creatinine", "sodium", "potassium",
]
OUTCOME_LAB_ITEMS = [
    "hb", "platelet", "wbc", "aptt", "ptinr", "glucose", "troponin_i", "bun",
    "albumin", "ast", "alt", "creatinine", "sodium", "potassium",
]

# Windows on the minute clock.
MINUTES_PER_HOUR = 60.0
MINUTES_PER_DAY = 1440.0
LOOKBACK_DAYS = 180
LOOKAHEAD_DAYS = 30
PEAK_DAYS = 7
BASELINE_DAYS = 90
DEATH_DAYS = 90
REOPERATION_DAYS = 30
VENTILATION_HOURS = 24.0

# Operations per subject, by exact count.
COUNT_EDGES = [2, 3, 4, 5]
COUNT_LABELS = [
    "1 operation", "2 operations", "3 operations", "4 operations", "5+ operations",
]

# Days between operations, half open, first class takes negatives.
GAP_EDGES = [1, 7, 30, 90, 180, 365]
GAP_LABELS = [
    "Same day (< 1 day)", "1-7 days", "7-30 days", "30-90 days",
    "90-180 days", "180-365 days", "> 365 days",
]

# Quantiles reported for gaps and for columns.
GAP_QUANTILES = {
    "median_days": 0.5, "p01": 0.01, "p05": 0.05, "p10": 0.10, "p25": 0.25,
    "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99,
}
COLUMN_QUANTILES = {
    "p1": 0.01, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75,
    "p90": 0.90, "p99": 0.99,
}

# Plausible ranges (low, high), both kept.
LOOSE_RANGES = {"height": (100, 220), "weight": (30, 200), "bmi": (10, 60)}
FLAG_RANGES = {"height": (130, 220), "weight": (35, 250)}
RAW_BMI_MIN_HEIGHT = 10

# Filtration rate formula (male, female).
EGFR_SCALE = 142.0
EGFR_KAPPA = (0.9, 0.7)
EGFR_ALPHA = (-0.302, -0.241)
EGFR_SEX = (1.0, 1.012)
EGFR_MAX_POWER = -1.200
EGFR_AGE_BASE = 0.9938

# Kidney stage cut-offs, stage 1 first; below the last is stage 6.
CKD_CUTS = [90, 60, 45, 30, 15]

# Kidney injury and heart injury limits.
AKI_DELTA = 0.3
AKI_RATIOS = (1.5, 2.0, 3.0)
AKI_PEAK = 4.0
TROPONIN_LIMIT = 0.04

# Nested feature sets in ladder order.
DEMOGRAPHICS = ["age", "sex", "bmi"]
CLINICAL = ["age", "sex", "bmi", "asa", "emop", "andur"]
LABORATORIES = ["age"] + ["preop_" + item for item in LAB_ITEMS]
FULL = CLINICAL + ["height_flag", "weight_flag"] + ["preop_" + item for item in LAB_ITEMS]
FEATURE_SETS = {
    "Demographics": DEMOGRAPHICS,
    "Clinical Severity": CLINICAL,
    "Laboratories": LABORATORIES,
    "Full Model": FULL,
}
COMPOSITE_EXTRA = ["baseline_egfr"]

# Boosted tree settings, single predictor run and full run.
TREES_SINGLE = {"trees": 100, "depth": 6}
TREES_FULL = {
    "trees": 800, "depth": 6, "rate": 0.05, "min_rows": 10, "min_gain": 0.0,
    "row_sample": 0.8, "column_share": 0.8,
}
PENALTY = 0.01
MIXTURE = 1.0
FOLDS = 5
CI_Z = 1.96
P_FLOOR = 2e-16

# Operating points.
FIXED_THRESHOLD = 0.05
THRESHOLD_GRID = (1, 99)
POSITIVE_QUANTILE = 0.20

# Display labels of predictors.
VARIABLE_LABELS = {
    "age": "Age (years)",
    "sex": "Sex (1=Male)",
    "height": "Height (cm)",
    "weight": "Weight (kg)",
    "bmi": "BMI (kg/m²)",
    "emop": "Emergency operation (1=Yes)",
    "andur": "Anesthesia duration (min)",
    "preop_hb": "Preop Hemoglobin (g/dL)",
    "preop_platelet": "Preop Platelets (10^3/µL)",
    "preop_wbc": "Preop WBC (10^3/µL)",
    "preop_aptt": "Preop aPTT (s)",
    "preop_ptinr": "Preop PT-INR",
    "preop_glucose": "Preop Glucose (mg/dL)",
    "preop_bun": "Preop BUN (mg/dL)",
    "preop_albumin": "Preop Albumin (g/dL)",
    "preop_ast": "Preop AST (U/L)",
    "preop_alt": "Preop ALT (U/L)",
    "preop_creatinine": "Preop Creatinine (mg/dL)",
    "preop_sodium": "Preop Sodium (mmol/L)",
    "preop_potassium": "Preop Potassium (mmol/L)",
}
