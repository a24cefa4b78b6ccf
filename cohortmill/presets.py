"""Fixed values for intensive-care stays: column names, bounds, names, labels."""

from __future__ import annotations

from cohortmill.config import Bound, Features, Outcome, Preset, Roles

# Plausibility intervals of the periodic vital signs.
VITAL_BOUNDS = (
    Bound("heartrate", 20.0, 250.0),
    Bound("sao2", 50.0, 100.0),
    Bound("respiration", 4.0, 70.0),
    Bound("temperature", 28.0, 43.0),
    Bound("systemicsystolic", 30.0, 300.0),
    Bound("systemicdiastolic", 10.0, 200.0),
    Bound("systemicmean", 20.0, 250.0),
)

# Plausibility intervals of laboratory results. Names that are
# absent here have no bounds and are never masked.
LAB_BOUNDS = (
    Bound("bedside glucose", 10.0, 1500.0),
    Bound("glucose", 10.0, 1500.0),
    Bound("potassium", 1.0, 10.0),
    Bound("sodium", 100.0, 180.0),
    Bound("chloride", 60.0, 150.0),
    Bound("creatinine", 0.1, 30.0),
    Bound("BUN", 1.0, 250.0),
    Bound("Hgb", 2.0, 25.0),
    Bound("Hct", 5.0, 75.0),
    Bound("WBC x 1000", 0.1, 200.0),
    Bound("platelets x 1000", 1.0, 2000.0),
)

# Laboratory names that become features, with the feature prefix.
LABS = (
    ("creatinine", "creatinine"),
    ("BUN", "bun"),
    ("sodium", "sodium"),
    ("potassium", "potassium"),
    ("glucose", "glucose"),
    ("Hgb", "hgb"),
    ("Hct", "hct"),
    ("WBC x 1000", "wbc"),
    ("platelets x 1000", "platelets"),
    ("bicarbonate", "bicarbonate"),
    ("chloride", "chloride"),
    ("calcium", "calcium"),
    ("magnesium", "magnesium"),
    ("lactate", "lactate"),
    ("pH", "ph"),
)

VITALS = tuple(b.name for b in VITAL_BOUNDS)

# Laboratory prefixes counted as specialised tests.
SPECIAL_LABS = ("lactate", "ph", "magnesium")

# Parts of column names that give the outcome away.
LEAKAGE_PARTS = (
    "dischargeoffset", "dischargestatus", "dischargelocation",
    "dischargeweight", "dischargetime", "dischargeyear",
)

# The audited columns that may never be features, and the keys.
LEAKAGE_COLUMNS = (
    ("hospitaldischargestatus", "is the outcome itself"),
    ("unitdischargestatus", "nearly the outcome"),
    ("hospitaldischargeoffset", "time known only at the end"),
    ("hospitaldischargelocation", "recorded after the outcome"),
    ("unitdischargeoffset", "time known only at the end"),
    ("unitdischargelocation", "recorded after the outcome"),
    ("dischargeweight", "recorded after the outcome"),
)

# Words that mark a clean quality flag.
CLEAN_WORDS = ("no_warnings", "pass", "ok", "clean", "valid", "no_warning")

# Display names of features.
EXACT_LABELS = {
    "age_numeric": "Age (years)",
    "age_gt89": "Age > 89 flag",
    "admissionheight": "Admission Height (cm)",
    "admissionweight": "Admission Weight (kg)",
    "lab_measurement_count": "Total Lab Measurements",
    "vital_measurement_count": "Total Vital Measurements",
    "available_lab_count": "Available Lab Types Count",
    "available_vital_count": "Available Vital Types Count",
    "missing_feature_count": "Missing Feature Count",
}
CATEGORY_LABELS = {
    "ethnicity": "Ethnicity", "unitadmitsource": "Admit Source",
    "unittype": "Unit", "gender": "Gender",
}
MEASURE_LABELS = {
    "bun": "BUN", "wbc": "WBC", "hct": "Hematocrit", "hgb": "Hemoglobin", "ph": "Arterial pH",
    "sao2": "SaO2", "spo2": "SpO2", "heartrate": "Heart Rate", "respiration": "Respiration Rate",
    "temperature": "Temperature", "systemicmean": "Mean Arterial Pressure",
    "systemicsystolic": "Systolic BP", "systemicdiastolic": "Diastolic BP",
    "creatinine": "Creatinine", "potassium": "Potassium", "sodium": "Sodium", "glucose": "Glucose",
    "lactate": "Lactate", "platelets": "Platelets", "bicarbonate": "Bicarbonate",
    "calcium": "Calcium", "chloride": "Chloride", "magnesium": "Magnesium",
}
STATISTIC_LABELS = {
    "mean": "Mean", "min": "Min", "max": "Max", "std": "Std Dev", "first": "First", "last": "Last",
    "count": "Count", "delta": "Delta (24h)", "measured": "Measured Flag",
}

# Interpretability ratings and weights of the model scorecard.
INTERPRETABILITY = {"logistic": 1.00, "forest": 0.80, "boosted": 0.85}
INTERPRETABILITY_DEFAULT = 0.75
SCORE_WEIGHTS = {"discrimination": 0.35, "calibration": 0.35, "interpretability": 0.15, "stability": 0.15}

# Hyper-parameter grids of the three model families.
LOGISTIC_GRID = (0.001, 0.01, 0.05, 0.1, 0.5, 1.0, 10.0)
FOREST_GRID = (
    {"trees": 100, "depth": 4, "min_split": 5},
    {"trees": 200, "depth": 4, "min_split": 5},
    {"trees": 200, "depth": 6, "min_split": 5},
    {"trees": 200, "depth": 6, "min_split": 10},
    {"trees": 300, "depth": 6, "min_split": 5},
    {"trees": 200, "depth": 8, "min_split": 5},
    {"trees": 200, "depth": None, "min_split": 10},
)
BOOSTED_GRID = (
    {"trees": 100, "depth": 3, "rate": 0.03, "rows": 0.8, "columns": 0.8},
    {"trees": 150, "depth": 3, "rate": 0.05, "rows": 0.8, "columns": 0.8},
    {"trees": 150, "depth": 4, "rate": 0.05, "rows": 0.8, "columns": 0.8},
    {"trees": 200, "depth": 4, "rate": 0.03, "rows": 0.8, "columns": 0.8},
    {"trees": 150, "depth": 4, "rate": 0.05, "rows": 1.0, "columns": 1.0},
    {"trees": 150, "depth": 5, "rate": 0.05, "rows": 0.8, "columns": 0.8},
    {"trees": 100, "depth": 4, "rate": 0.1, "rows": 0.8, "columns": 0.8},
)

# Candidate quantiles of the accept thresholds.
SPREAD_QUANTILES = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90)
QUALITY_QUANTILES = (0.10, 0.15, 0.20, 0.25, 0.30, 0.40, 0.50)

ICU = Preset(
    roles=Roles(
        entity="patientunitstayid",
        encounter="patienthealthsystemstayid",
        person="uniquepid",
        outcome=Outcome("hospitaldischargestatus", "Alive", "Expired", "hospital_mortality"),
        age="age",
        visit="unitvisitnumber",
        duration="unitdischargeoffset",
        interim_status="unitdischargestatus",
        long_name="labname",
        long_value="labresult",
        long_offset="labresultoffset",
        long_order="labid",
        wide_offset="observationoffset",
        admit_offset="hospitaladmitoffset",
    ),
    features=Features(
        admission=("age_numeric", "age_gt89", "gender", "ethnicity", "admissionheight",
                   "admissionweight", "unittype", "unitadmitsource"),
        unknown_filled=("gender", "ethnicity", "unitadmitsource"),
        wide=VITALS,
        long=LABS,
        identifiers=("patientunitstayid", "patienthealthsystemstayid"),
        target="hospital_mortality",
    ),
    wide_bounds=VITAL_BOUNDS,
    long_bounds=LAB_BOUNDS,
    required={
        "patient": ("patientunitstayid", "age", "gender", "hospitaldischargestatus"),
        "lab": ("patientunitstayid", "labresultoffset", "labname", "labresult"),
        "vitalPeriodic": ("patientunitstayid", "observationoffset"),
    },
    demographics=("age", "gender", "ethnicity"),
)
