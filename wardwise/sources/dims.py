"""Small dimension tables built from literals (S3).

All of these have a fixed, known row count, so broadcasting them is always
safe (their size never grows with the fact tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions.calendar import rule_date

# --------------------------------------------------------------------------
# These must equal the reference's scoring constants exactly.
# --------------------------------------------------------------------------
# Diagnosis weights of the ALC risk score, in the order the form lists them.
DIAGNOSIS_RISK = {
    "Dementia": 0.25, "Stroke": 0.20, "Hip Fracture": 0.18,
    "Sepsis": 0.06, "COPD": 0.05, "CHF": 0.04,
    "Pneumonia": 0.03, "UTI": 0.02, "Elective Surgery": 0.01, "Other": 0.0,
}
# Diagnosis weights of the ALC label formula (three non-zero weights).
LABEL_DIAGNOSIS_RISK = {"Dementia": 0.25, "Stroke": 0.20, "Hip Fracture": 0.18}
# Hospitals: base daily visits and type.
HOSPITALS = [
    ("Sunnybrook HSC", 320, "Academic"),
    ("Unity Health (St. Michaels)", 290, "Academic"),
    ("North York General", 210, "Community"),
    ("Scarborough Health Network", 240, "Community"),
    ("Humber River Health", 195, "Community"),
    ("Trillium Health Partners", 260, "Community"),
]
# Day-of-week visit factors (Monday first) and month factors (January first).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
DOW_EFFECT = [1.12, 1.05, 1.00, 1.00, 1.08, 0.92, 0.85]
MONTH_EFFECT = [1.22, 1.20, 1.05, 1.00, 0.98, 0.92, 0.90, 0.91, 0.97, 1.02, 1.08, 1.20]
MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
HOLIDAY_FACTOR = 1.30
SURGE_MULTIPLIER = 1.25
# Expected-volume factors: mid-points of the generator's random ranges.
WINTER_FACTOR, SUMMER_FACTOR, HOLIDAY_VOLUME_FACTOR = 1.225, 0.915, 1.325
ANNUAL_GROWTH, GROWTH_BASE_YEAR, VOLUME_FLOOR = 1.03, 2022, 50
# The statutory holidays of a year, window -1..+1 day: New Year, Family Day, Good Friday, Victoria Day,
# Canada Day, Civic Holiday, Labour Day, Thanksgiving, Christmas (a Sunday's is kept on the Monday), Boxing Day.
HOLIDAY_RULES = ["01-01", ("nth", 2, 0, 3), ("easter", -2), ("before", 5, 25, 0), "07-01",
                 ("nth", 8, 0, 1), ("nth", 9, 0, 1), ("nth", 10, 0, 2), ("shifted", 12, 25), "12-26"]
HOLIDAY_MONTH_DAYS = ["01-01", "07-01", "12-25", "12-26"]  # month-days that are fixed
HOLIDAY_WINDOW = (-1, 1)
# Tier cut-offs and texts.
ALC_TIERS = [  # (min pct, level, colour, recommendation)
    (60.0, "HIGH", "red",
     "Initiate discharge planning at admission. Refer to social work and LTC placement team immediately."),
    (35.0, "MEDIUM", "orange",
     "Flag for social work review within 48 hours. Assess home care and CCAC eligibility."),
    (None, "LOW", "green",
     "Standard discharge pathway. Reassess if length of stay exceeds 7 days."),
]
SURGE_TIERS = [  # (min score, level, recommendation)
    (0.8, "HIGH", "Activate surge protocol. Consider ambulance diversion and call in additional staff."),
    (0.5, "MEDIUM", "Alert charge nurse. Pre-position additional staff and open overflow areas."),
    (None, "LOW", "Normal operations. Monitor hourly volumes."),
]
# ALC risk score: intercept, then (name, input, weight) in the order the terms are
# summed. "age_over_18" is age - 18; the diagnosis weight comes from a table above.
ALC_INTERCEPT, AGE_OFFSET = 0.02, 18
ALC_TERMS = [
    ("Age", "age_over_18", 0.008),
    ("Diagnosis", "diagnosis", None),
    ("Lives Alone", "lives_alone", 0.10),
    ("Cognitive Impairment", "cognitive_impairment", 0.15),
    ("Has Caregiver", "has_caregiver", -0.12),
    ("Charlson Index", "charlson_index", 0.008),
    ("Functional Score", "functional_score", -0.001),
    ("Length of Stay", "los_days", 0.010),
    ("Prior Admissions", "prior_admissions", 0.03),
]
# The eight named factors of the score's explanation ("no_caregiver" = 1 - has_caregiver).
ALC_FACTORS = [
    ("Age", "age_over_18", 0.008),
    ("Diagnosis", "diagnosis", None),
    ("Lives Alone", "lives_alone", 0.10),
    ("Cognitive Impairment", "cognitive_impairment", 0.15),
    ("No Caregiver", "no_caregiver", 0.12),
    ("Charlson Index", "charlson_index", 0.008),
    ("Length of Stay", "los_days", 0.010),
    ("Prior Admissions", "prior_admissions", 0.03),
]
ALC_FACTOR_NAMES = [name for name, _, _ in ALC_FACTORS]
TOP_FACTORS = 5
ALC_LABEL_CUTOFF, PREDICT_CUTOFF = 0.45, 0.5  # label: prob > 0.45; class: prob > 0.5
# Forecast horizon tier: surge-day count > 10 HIGH, > 4 MEDIUM, else LOW.
HORIZON_HIGH, HORIZON_MEDIUM = 10, 4
# Anomaly type rules, first match wins; a rule fires when any metric exceeds its cut-off.
ANOMALY_TYPES = ["Normal", "Opioid Over-Prescriber", "High-Risk Combinations", "Volume Outlier", "Other Anomaly"]
OPIOID_RATE_CUT, OPIOID_MME_CUT = 35, 120
COMBO_CUT, POLYPHARMACY_CUT = 15, 40
PATIENTS_CUT, RX_PER_PATIENT_CUT = 250, 7
CONTAMINATION, FOREST_TREES, FOREST_SAMPLES = 0.04, 300, 256
# Plausible metric ranges (clip bounds).
CLIP_RANGES = {"opioid_rate_pct": (0, 100), "avg_opioid_mme": (0, 500), "benzo_opioid_combo_pct": (0, 100),
               "polypharmacy_pct": (0, 100), "patients_per_month": (1, 800), "avg_rx_per_patient": (1, 20)}
# Colour bands: value > first cut-off red, > second orange, else green.
BANDS = {"alc_rate_hospital": (20, 15), "alc_rate_diagnosis": (25, 15), "beds_blocked": (15, 10),
         "rx_rate_hospital": (5, 3)}
WINTER_MONTHS, SUMMER_MONTHS = [12, 1, 2], [6, 7, 8]
BUSY_WEEKDAYS, QUIET_WEEKDAYS = [0, 4], [5, 6]  # Monday and Friday; Saturday and Sunday
# Boosted trees: rounds, depth, learning rate, row and column subsample; hold-out share.
GBT_ROUNDS, GBT_DEPTH, GBT_RATE, GBT_SUBSAMPLE, GBT_COLSAMPLE = 300, 5, 0.05, 0.8, 0.8
TEST_FRACTION = 0.2
CENSUS_SIZE, AUDIT_SIZE, LOOKUP_SIZE, HISTORY_TAIL, FORECAST_DAYS = 400, 20, 50, 90, 30
AGE_BINS, SCORE_BINS = 30, 50
REGION_NAME, PROVINCE_NAME = "Greater Toronto Area", "Ontario, Canada"
# --------------------------------------------------------------------------


def hospital_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOSPITALS, "hospital string, base int, type string")


def dow_dim(spark: SparkSession) -> DataFrame:
    """Weekday dimension, Monday = 0, with full and short names and factor."""
    rows = [(i, DAY_NAMES[i], DAY_ABBR[i], DOW_EFFECT[i]) for i in range(7)]
    return spark.createDataFrame(rows, "weekday int, day_name string, day_abbr string, dow_factor double")


def month_dim(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, MONTH_ABBR[i], MONTH_EFFECT[i]) for i in range(12)]
    return spark.createDataFrame(rows, "month int, month_abbr string, month_factor double")


def diagnosis_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIAGNOSIS_RISK.items()), "diagnosis string, diag_weight double")


def holidays_on(spark: SparkSession, dates: list, name: str = "statutory") -> DataFrame:
    """Holiday table from given dates (``datetime.date`` or ISO text), for holidays that move."""
    rows = [(name, str(d)) for d in dates]
    return (spark.createDataFrame(rows, "holiday string, d string")
            .select("holiday", F.to_date("d").alias("ds"), F.lit(HOLIDAY_WINDOW[0]).alias("lower_window"),
                    F.lit(HOLIDAY_WINDOW[1]).alias("upper_window")))


def holidays(spark: SparkSession, first_year: int, last_year: int, rules: list | None = None) -> DataFrame:
    """Holiday table (holiday, ds, lower_window, upper_window) of rules (the fixed month-days) for a year range."""
    days = [F.expr(rule_date(r, "CAST(id AS INT)")) for r in (HOLIDAY_MONTH_DAYS if rules is None else rules)]
    return (spark.range(first_year, last_year + 1).select(F.explode(F.array_distinct(F.array(*days))).alias("day"))
            .select(F.lit("statutory").alias("holiday"), F.col("day").alias("ds"),
                    F.lit(HOLIDAY_WINDOW[0]).alias("lower_window"),
                    F.lit(HOLIDAY_WINDOW[1]).alias("upper_window")))
