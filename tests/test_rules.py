"""Golden values of the rule operators (D1-D11, X9, P8) from the reference's own examples."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardwise.functions.columns import clip, pct_text
from wardwise.functions.rules import (alc_factors, alc_risk_score, alc_tier, predicted_visits, surge_risk_score,
                                      top_factors)
from wardwise.plans.rx import classify_anomaly
from wardwise.sources import dims


def grid(spark):
    h = dims.hospital_dim(spark)
    g = (h.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
         .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
         .withColumn("is_holiday", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    return surge_risk_score(predicted_visits(g))


def test_surge_grid_counts(spark):
    g = grid(spark)
    tiers = {r["risk_level"]: r["count"] for r in g.groupBy("risk_level").count().collect()}
    assert tiers == {"HIGH": 474, "MEDIUM": 102, "LOW": 432}
    assert g.filter("surge_flag").count() == 414
    assert g.filter("risk_level = 'HIGH' AND NOT surge_flag").count() == 60


def test_surge_form_example(spark):
    g = grid(spark).filter("hospital = 'Scarborough Health Network' AND weekday = 0 AND month = 1 "
                           "AND is_holiday = 0")
    r = g.select("predicted_visits", "surge_threshold", "surge_risk_score", "risk_level",
                 pct_text("capacity_pct").alias("cap")).first()
    assert (r.predicted_visits, r.surge_threshold, r.surge_risk_score, r.risk_level, r.cap) == \
        (327, 300, 1.0, "HIGH", "136.2%")


def test_thresholds(spark):
    h = predicted_visits(grid(spark)).select("hospital", "surge_threshold").distinct()
    got = {r.hospital: r.surge_threshold for r in h.collect()}
    assert [got[n] for n, *_ in dims.HOSPITALS] == [400, 362, 262, 300, 243, 325]


def test_alc_form_example(spark):
    p = spark.createDataFrame([(78, "Dementia", 14, 1, 0, 1, 4, 35.0, 2, "Sunnybrook HSC")],
                              "age int, diagnosis string, los_days int, lives_alone int, has_caregiver int, "
                              "cognitive_impairment int, charlson_index int, functional_score double, "
                              "prior_admissions int, hospital string")
    r = top_factors(alc_factors(alc_tier(alc_risk_score(p)))).first()
    assert r.alc_risk_raw == pytest.approx(1.197)
    assert r.alc_risk_score == 1.0 and r.risk_level == "HIGH" and r.risk_colour == "red"
    top = [(f.factor, f.contribution) for f in r.top_factors]
    assert top == [("Age", 0.48), ("Diagnosis", 0.25), ("Cognitive Impairment", 0.15),
                   ("Length of Stay", 0.14), ("No Caregiver", 0.12)]


# The printed audit columns of the reference's 20-row audit list with their printed type.
AUDIT_ROWS = [
    (58.7, 157.9, 4.76, 91, "Opioid Over-Prescriber"), (40.93, 187.9, 5.21, 121, "Opioid Over-Prescriber"),
    (59.7, 95.5, 3.57, 162, "Opioid Over-Prescriber"), (29.86, 252.1, 7.03, 48, "Opioid Over-Prescriber"),
    (47.13, 251.2, 4.53, 121, "Opioid Over-Prescriber"), (56.03, 136.1, 1.97, 123, "Opioid Over-Prescriber"),
    (52.04, 126.1, 1.38, 131, "Opioid Over-Prescriber"), (33.55, 169.2, 1.04, 114, "Opioid Over-Prescriber"),
    (37.89, 178.2, 5.2, 128, "Opioid Over-Prescriber"), (29.69, 154.4, 4.89, 88, "Opioid Over-Prescriber"),
    (32.55, 258.3, 3.88, 51, "Opioid Over-Prescriber"), (34.94, 131.0, 3.81, 142, "Opioid Over-Prescriber"),
    (6.61, 30.2, 24.95, 148, "High-Risk Combinations"), (56.3, 112.4, 0.0, 143, "Opioid Over-Prescriber"),
    (44.6, 140.0, 4.48, 110, "Opioid Over-Prescriber"), (46.62, 64.1, 3.84, 143, "Opioid Over-Prescriber"),
    (6.7, 54.2, 29.81, 96, "High-Risk Combinations"), (63.2, 99.3, 3.36, 164, "Opioid Over-Prescriber"),
    (37.93, 187.9, 2.65, 111, "Opioid Over-Prescriber"), (15.04, 52.1, 5.75, 426, "Volume Outlier"),
]


def test_anomaly_type_reproduces_audit_list(spark):
    df = spark.createDataFrame(
        [(1, a, b, c, float(d), None, None, t) for a, b, c, d, t in AUDIT_ROWS],
        "is_anomaly int, opioid_rate_pct double, avg_opioid_mme double, benzo_opioid_combo_pct double, "
        "patients_per_month double, polypharmacy_pct double, avg_rx_per_patient double, expected string")
    out = df.select(classify_anomaly().alias("t"), "expected").collect()
    assert all(r.t == r.expected for r in out)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=5000, allow_nan=False), min_size=1, max_size=30))
def test_pct_text_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.t for r in df.select(pct_text("x").alias("t")).collect()]
    assert got == [f"{v:.1f}%" for v in values]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(min_value=-1e6, max_value=1e6, allow_nan=False)), max_size=20))
def test_clip_bounds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.c for r in df.select(clip("x", 0.0, 1.0).alias("c")).collect()]
    for v, c in zip(values, got):
        assert (c is None) if v is None else c == min(1.0, max(0.0, v))


def test_alc_score_monotone_in_age(spark):
    rows = [(a, "Stroke", 5, 0, 1, 0, 2, 50.0, 1) for a in range(18, 111)]
    df = spark.createDataFrame(rows, "age int, diagnosis string, los_days int, lives_alone int, has_caregiver int, "
                                     "cognitive_impairment int, charlson_index int, functional_score double, "
                                     "prior_admissions int")
    s = [r.alc_risk_score for r in alc_risk_score(df).orderBy("age").collect()]
    assert all(b >= a for a, b in zip(s, s[1:]))
