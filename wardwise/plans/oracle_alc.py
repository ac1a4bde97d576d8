"""DuckDB oracle SQL for the ALC queries (same results as plans/alc.py)."""

from __future__ import annotations

from wardwise.plans.oracle_surge import w

ADM = """
a0 AS (
  SELECT o.o_orderkey AS patient_id, r.r_name AS hospital,
    18 + (o.o_orderkey * 13 + o.o_custkey * 7) % 82 AS age,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CASE (o.o_orderkey * 3 + o.o_custkey) % 10 WHEN 0 THEN 'Hip Fracture' WHEN 1 THEN 'Stroke'
      WHEN 2 THEN 'Dementia' WHEN 3 THEN 'COPD' WHEN 4 THEN 'CHF' WHEN 5 THEN 'Pneumonia'
      WHEN 6 THEN 'UTI' WHEN 7 THEN 'Sepsis' WHEN 8 THEN 'Elective Surgery' ELSE 'Other' END AS diagnosis,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS lives_alone,
    CASE WHEN (o.o_orderkey * 5 + o.o_custkey) % 7 < 3 THEN 1 ELSE 0 END AS has_caregiver,
    CASE WHEN (o.o_orderkey + o.o_custkey * 11) % 5 < 2 THEN 1 ELSE 0 END AS cognitive_impairment,
    CASE WHEN (o.o_orderkey * 17) % 11 < 6 THEN 1 ELSE 0 END AS ambulatory_pre_admit,
    (o.o_orderkey * 19 + o.o_custkey) % 12 AS charlson_index,
    ((o.o_orderkey * 37) % 1001) / 10e0 AS functional_score,
    1 + (o.o_orderkey * 23) % 29 AS los_days,
    (o.o_orderkey * 29 + o.o_custkey) % 6 AS prior_admissions,
    (o.o_orderkey * 41) % 5 AS ed_visits_6m,
    ((o.o_orderkey * 53 + o.o_custkey * 3) % 161 - 80) / 1000e0 AS noise
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey),
adm AS (
  SELECT a0.*, 0.02e0 + 0.008e0 * (age - 18)
    + CASE diagnosis WHEN 'Dementia' THEN 0.25e0 WHEN 'Stroke' THEN 0.20e0 WHEN 'Hip Fracture' THEN 0.18e0 ELSE 0e0 END
    + 0.10e0 * lives_alone + 0.15e0 * cognitive_impairment - 0.12e0 * has_caregiver
    + 0.008e0 * charlson_index - 0.001e0 * functional_score
    + 0.010e0 * los_days + 0.03e0 * prior_admissions + noise AS alc_prob_raw
  FROM a0),
lab AS (
  SELECT adm.*, greatest(0e0, least(1e0, alc_prob_raw)) AS alc_prob,
         CAST(greatest(0e0, least(1e0, alc_prob_raw)) > 0.45e0 AS INTEGER) AS alc_flag
  FROM adm)"""

DIAG = ("CASE diagnosis WHEN 'Dementia' THEN 0.25e0 WHEN 'Stroke' THEN 0.20e0 WHEN 'Hip Fracture' THEN 0.18e0 "
        "WHEN 'Sepsis' THEN 0.06e0 WHEN 'COPD' THEN 0.05e0 WHEN 'CHF' THEN 0.04e0 WHEN 'Pneumonia' THEN 0.03e0 "
        "WHEN 'UTI' THEN 0.02e0 WHEN 'Elective Surgery' THEN 0.01e0 WHEN 'Other' THEN 0.0e0 END")

RISK = f"""
sc0 AS (
  SELECT lab.*, 0.02e0 + 0.008e0 * (age - 18) + ({DIAG})
    + 0.10e0 * lives_alone + 0.15e0 * cognitive_impairment - 0.12e0 * has_caregiver
    + 0.008e0 * charlson_index - 0.001e0 * functional_score + 0.010e0 * los_days
    + 0.03e0 * prior_admissions AS alc_risk_raw
  FROM lab),
sc AS (
  SELECT sc0.*, greatest(0e0, least(1e0, alc_risk_raw)) AS alc_risk_score,
         greatest(0e0, least(1e0, alc_risk_raw)) * 100e0 AS alc_risk_pct,
         CAST(greatest(0e0, least(1e0, alc_risk_raw)) > 0.5e0 AS INTEGER) AS predicted
  FROM sc0)"""

FACTORS = f"""
fx AS (
  SELECT patient_id, 0 AS pos, 'Age' AS factor, round_even(0.008e0 * (age - 18), 3) AS contribution FROM adm
  UNION ALL SELECT patient_id, 1, 'Diagnosis', round_even({DIAG}, 3) FROM adm
  UNION ALL SELECT patient_id, 2, 'Lives Alone', round_even(0.10e0 * lives_alone, 3) FROM adm
  UNION ALL SELECT patient_id, 3, 'Cognitive Impairment', round_even(0.15e0 * cognitive_impairment, 3) FROM adm
  UNION ALL SELECT patient_id, 4, 'No Caregiver', round_even(0.12e0 * (1 - has_caregiver), 3) FROM adm
  UNION ALL SELECT patient_id, 5, 'Charlson Index', round_even(0.008e0 * charlson_index, 3) FROM adm
  UNION ALL SELECT patient_id, 6, 'Length of Stay', round_even(0.010e0 * los_days, 3) FROM adm
  UNION ALL SELECT patient_id, 7, 'Prior Admissions', round_even(0.03e0 * prior_admissions, 3) FROM adm)"""

TERMS = [
    ("Age", "0.008e0 * (age - 18)"), ("Diagnosis", f"({DIAG})"),
    ("Lives Alone", "0.10e0 * lives_alone"), ("Cognitive Impairment", "0.15e0 * cognitive_impairment"),
    ("Has Caregiver", "-0.12e0 * has_caregiver"), ("Charlson Index", "0.008e0 * charlson_index"),
    ("Functional Score", "-0.001e0 * functional_score"), ("Length of Stay", "0.010e0 * los_days"),
    ("Prior Admissions", "0.03e0 * prior_admissions"),
]

_terms = ",\n".join(f"  CAST({expr} AS DOUBLE) AS t{i}" for i, (_, expr) in enumerate(TERMS))
_means = ", ".join(f"avg(t{i}) AS m{i}" for i in range(len(TERMS)))
_long = "\n  UNION ALL ".join(
    f"SELECT '{name}' AS feature, avg(abs(t{i} - m{i})) AS v FROM tt, mm" for i, (name, _) in enumerate(TERMS))
ATTR = f"""
tt AS (SELECT
{_terms}
  FROM adm),
mm AS (SELECT {_means} FROM tt),
la AS (
  {_long})"""

CUM = """
vc AS (SELECT alc_risk_score AS score, CAST(sum(alc_flag) AS BIGINT) AS pos,
              CAST(sum(1 - alc_flag) AS BIGINT) AS neg FROM sc GROUP BY alc_risk_score),
dc AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
              sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all FROM vc)"""

_rule_checks = [
    ("age", "age BETWEEN 18 AND 110"), ("los_days", "los_days BETWEEN 1 AND 120"),
    ("charlson_index", "charlson_index BETWEEN 0 AND 11"), ("functional_score", "functional_score BETWEEN 0 AND 100"),
    ("prior_admissions", "prior_admissions BETWEEN 0 AND 10"),
    ("diagnosis", "diagnosis IN ('Dementia', 'Stroke', 'Hip Fracture', 'Sepsis', 'COPD', 'CHF', 'Pneumonia', "
                  "'UTI', 'Elective Surgery', 'Other')"),
    ("hospital", "hospital IN (SELECT r_name FROM region)"),
]
_viol = "\n  UNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({c}, false)) AS n_rows FROM desk"
    for n, c in _rule_checks)
_all_ok = " AND ".join(f"coalesce({c}, false)" for _, c in _rule_checks)


INTAKE = """
desk AS (
  SELECT patient_id,
    CASE WHEN patient_id % 97 = 0 THEN age - 60 ELSE age END AS age,
    CASE WHEN patient_id % 89 = 0 THEN los_days + 120 ELSE los_days END AS los_days,
    CASE WHEN patient_id % 83 = 0 THEN charlson_index + 12 ELSE charlson_index END AS charlson_index,
    CASE WHEN patient_id % 79 = 0 THEN -functional_score - 1e0 ELSE functional_score END AS functional_score,
    CASE WHEN patient_id % 73 = 0 THEN NULL ELSE prior_admissions END AS prior_admissions,
    CASE WHEN patient_id % 71 = 0 THEN 'Unlisted' ELSE diagnosis END AS diagnosis,
    CASE WHEN patient_id % 67 = 0 THEN 'ELSEWHERE' ELSE hospital END AS hospital
  FROM adm)"""


def _class_rows() -> str:
    parts = []
    for cls in (0, 1):
        parts.append(f"""SELECT {cls} AS class,
    count(*) FILTER (WHERE alc_flag = {cls} AND predicted = {cls}) AS tp,
    count(*) FILTER (WHERE predicted = {cls}) AS pp,
    count(*) FILTER (WHERE alc_flag = {cls}) AS support FROM sc""")
    return "\n  UNION ALL ".join(parts)


ORACLE = {
    "validate_admissions": w(ADM, INTAKE) + f"""
SELECT rule, n_rows FROM (
  {_viol}) v WHERE n_rows > 0
UNION ALL
SELECT 'valid' AS rule, count(*) AS n_rows FROM desk WHERE {_all_ok}""",

    "profile_admissions": w(ADM) + """
SELECT count(*) AS n_patients, CAST(sum(alc_flag) AS BIGINT) AS n_alc, round(avg(alc_flag) * 100e0, 6) AS alc_rate_pct,
       round(avg(age), 6) AS avg_age, round(avg(los_days), 6) AS avg_los, count(DISTINCT hospital) AS n_sites
FROM lab""",

    "alc_label": w(ADM) + "\nSELECT patient_id, round(alc_prob, 6) AS alc_prob, alc_flag FROM lab",

    "alc_risk_score": w(ADM, RISK) + """
SELECT patient_id, round(alc_risk_raw, 6) AS alc_risk_raw, round(round_even(alc_risk_score, 4), 6) AS alc_risk_score,
       printf('%.1f', alc_risk_pct) || '%' AS alc_risk_pct
FROM sc""",

    "alc_tier_counts": w(ADM, RISK) + """
SELECT CASE WHEN alc_risk_pct >= 60 THEN 'HIGH' WHEN alc_risk_pct >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN alc_risk_pct >= 60 THEN 'red' WHEN alc_risk_pct >= 35 THEN 'orange' ELSE 'green' END AS risk_colour,
       CASE WHEN alc_risk_pct >= 60
            THEN 'Initiate discharge planning at admission. Refer to social work and LTC placement team immediately.'
            WHEN alc_risk_pct >= 35
            THEN 'Flag for social work review within 48 hours. Assess home care and CCAC eligibility.'
            ELSE 'Standard discharge pathway. Reassess if length of stay exceeds 7 days.' END AS recommendation,
       count(*) AS n_patients
FROM sc GROUP BY 1, 2, 3""",

    "alc_top_factors": w(ADM, FACTORS) + """
SELECT patient_id, rk AS rank, factor, round(contribution, 6) AS contribution FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY contribution DESC, pos) AS INTEGER) AS rk
  FROM fx) x WHERE rk <= 5""",

    "alc_report_fields": w(ADM, RISK, FACTORS) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY contribution DESC, pos) AS rk FROM fx)
SELECT sc.patient_id, age, diagnosis, lives_alone = 1 AS lives_alone,
       round(round_even(alc_risk_score, 4), 6) AS alc_risk_score, printf('%.1f', alc_risk_pct) || '%' AS alc_risk_pct,
       CASE WHEN alc_risk_pct >= 60 THEN 'HIGH' WHEN alc_risk_pct >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       CASE WHEN alc_risk_pct >= 60
            THEN 'Initiate discharge planning at admission. Refer to social work and LTC placement team immediately.'
            WHEN alc_risk_pct >= 35
            THEN 'Flag for social work review within 48 hours. Assess home care and CCAC eligibility.'
            ELSE 'Standard discharge pathway. Reassess if length of stay exceeds 7 days.' END AS recommendation,
       r.factor AS first_factor, round(r.contribution, 6) AS first_contribution, CAST(5 AS INTEGER) AS n_factors
FROM sc JOIN r ON sc.patient_id = r.patient_id AND r.rk = 1""",

    "alc_rate_age": w(ADM) + """
SELECT age_from, lives_alone, has_caregiver, cognitive_impairment, round(rate, 6) AS alc_rate_pct,
       CASE WHEN rate > 20 THEN 'red' WHEN rate > 15 THEN 'orange' ELSE 'green' END AS band
FROM (SELECT CAST(floor(age / 10e0) * 10 AS INTEGER) AS age_from, lives_alone, has_caregiver,
             cognitive_impairment, avg(alc_flag) * 100e0 AS rate FROM lab GROUP BY 1, 2, 3, 4) g""",

    "split_members": w(ADM) + """,
u AS (SELECT patient_id, alc_flag,
             row_number() OVER (PARTITION BY alc_flag ORDER BY substr(md5('42|' || patient_id), 1, 13), patient_id) AS rk,
             ceil(count(*) OVER (PARTITION BY alc_flag) * 0.2e0) AS k FROM lab)
SELECT patient_id, alc_flag, rk <= k AS is_test FROM u""",

    "census_sample": w(ADM) + """,
c AS (SELECT * FROM lab ORDER BY substr(md5('42|' || patient_id), 1, 13), patient_id LIMIT 400),
g AS (SELECT hospital, count(*) AS total_patients, CAST(sum(alc_flag) AS BIGINT) AS alc_patients FROM c GROUP BY hospital)
SELECT hospital, total_patients, alc_patients, round_even(alc_patients / total_patients * 100e0, 1) AS alc_rate_pct,
       CASE WHEN alc_patients > 15 THEN 'red' WHEN alc_patients > 10 THEN 'orange' ELSE 'green' END AS band
FROM g""",

    "alc_rate_hospital": w(ADM) + """
SELECT hospital, round(rate, 6) AS alc_rate_pct,
       CASE WHEN rate > 20 THEN 'red' WHEN rate > 15 THEN 'orange' ELSE 'green' END AS band
FROM (SELECT hospital, avg(alc_flag) * 100e0 AS rate FROM lab GROUP BY hospital) g""",

    "alc_rate_diagnosis": w(ADM) + """
SELECT diagnosis, round(rate, 6) AS alc_rate_pct,
       CASE WHEN rate > 25 THEN 'red' WHEN rate > 15 THEN 'orange' ELSE 'green' END AS band
FROM (SELECT diagnosis, avg(alc_flag) * 100e0 AS rate FROM lab GROUP BY diagnosis) g""",

    "beds_blocked": w(ADM) + """
SELECT hospital, total_patients, alc_patients, round_even(alc_patients / total_patients * 100e0, 1) AS alc_rate_pct,
       CASE WHEN alc_patients > 15 THEN 'red' WHEN alc_patients > 10 THEN 'orange' ELSE 'green' END AS band
FROM (SELECT hospital, count(*) AS total_patients, CAST(sum(alc_flag) AS BIGINT) AS alc_patients
      FROM lab GROUP BY hospital) g""",

    "age_histogram": w(ADM) + """,
rng AS (SELECT alc_flag AS class, min(age) * 1e0 AS mn, max(age) * 1e0 AS mx FROM lab GROUP BY alc_flag),
bb AS (SELECT rng.class, mn, mx,
              CASE WHEN mx - mn > 0 THEN CAST(least(floor((age - mn) * 30 / (mx - mn)), 29) AS INTEGER) ELSE 0 END
                AS bin
       FROM lab JOIN rng ON lab.alc_flag = rng.class)
SELECT class, bin, round(mn + (mx - mn) * bin / 30, 6) AS lo, round(mn + (mx - mn) * (bin + 1) / 30, 6) AS hi,
       count(*) AS n
FROM bb GROUP BY class, bin, mn, mx""",

    "alc_imbalance": w(ADM) + """
SELECT round(count(*) FILTER (WHERE alc_flag = 0) * 1e0 / count(*) FILTER (WHERE alc_flag = 1), 6) AS scale_pos_weight,
       count(*) FILTER (WHERE alc_flag = 0) AS n_neg, count(*) FILTER (WHERE alc_flag = 1) AS n_pos
FROM lab""",

    "label_encode": w(ADM) + """
SELECT patient_id, CAST(dense_rank() OVER (ORDER BY sex) - 1 AS INTEGER) AS sex_enc,
       CAST(dense_rank() OVER (ORDER BY diagnosis) - 1 AS INTEGER) AS diagnosis_enc,
       CAST(dense_rank() OVER (ORDER BY hospital) - 1 AS INTEGER) AS hospital_enc
FROM adm""",

    "roc_auc": w(ADM, RISK, CUM) + """
SELECT round(sum(pos * (n_all - fp + neg * 0.5e0)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM dc""",

    "average_precision": w(ADM, RISK, CUM) + """
SELECT round(sum(pos * 1e0 / p_all * (tp * 1e0 / (tp + fp))), 6) AS average_precision FROM dc""",

    "roc_curve": w(ADM, RISK, CUM) + """
SELECT round(score, 6) AS threshold, round(fp * 1e0 / n_all, 6) AS fpr, round(tp * 1e0 / p_all, 6) AS tpr FROM dc""",

    "confusion_matrix": w(ADM, RISK) + """
SELECT alc_flag AS actual, predicted, count(*) AS n FROM sc GROUP BY 1, 2""",

    "class_report": w(ADM, RISK) + f""",
cr AS (
  {_class_rows()})
SELECT class,
       round(CASE WHEN pp > 0 THEN tp * 1e0 / pp ELSE 0e0 END, 6) AS precision,
       round(CASE WHEN support > 0 THEN tp * 1e0 / support ELSE 0e0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2e0 * (tp * 1e0 / pp) * (tp * 1e0 / support)
                                   / ((tp * 1e0 / pp) + (tp * 1e0 / support)) ELSE 0e0 END, 6) AS f1,
       support
FROM cr""",

    "stratified_split": w(ADM) + """,
cs AS (SELECT alc_flag, count(*) AS n, CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS k FROM lab GROUP BY alc_flag)
SELECT alc_flag, true AS is_test, k AS n FROM cs
UNION ALL
SELECT alc_flag, false AS is_test, n - k AS n FROM cs WHERE n > k""",

    "linear_attribution": w(ADM, ATTR) + """
SELECT feature, round(v, 6) AS mean_abs_attribution,
       CAST(row_number() OVER (ORDER BY v DESC, feature) AS INTEGER) AS rank
FROM la""",
}
