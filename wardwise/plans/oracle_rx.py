"""DuckDB oracle SQL for the prescriber queries (same results as plans/rx.py)."""

from __future__ import annotations

from wardwise.plans.oracle_surge import w

PRESC = """
m AS (
  SELECT o.o_custkey AS prescriber_id, count(*) AS n_rx, count(DISTINCT o.o_orderkey) AS n_patients,
    count(*) * 1e0 / count(DISTINCT o.o_orderkey) AS avg_rx_per_patient,
    avg(CASE WHEN l.l_discount >= 0.095e0 THEN 100e0 ELSE 0e0 END) AS opioid_rate_pct,
    avg(l.l_quantity) * 1.8e0 AS avg_opioid_mme,
    avg(CASE WHEN l.l_tax >= 0.075e0 AND l.l_discount >= 0.075e0 THEN 100e0 ELSE 0e0 END) AS benzo_opioid_combo_pct,
    avg(CASE WHEN l.l_quantity >= 41e0 THEN 100e0 ELSE 0e0 END) AS polypharmacy_pct,
    avg(l.l_tax) * 350e0 AS avg_days_supply,
    avg(CASE WHEN l.l_returnflag = 'A' THEN 100e0 ELSE 0e0 END) AS refill_rate_pct,
    avg(CASE WHEN l.l_quantity >= 45e0 AND l.l_discount >= 0.05e0 THEN 100e0 ELSE 0e0 END) AS high_dose_opioid_pct,
    avg(CASE WHEN l.l_linestatus = 'O' THEN 100e0 ELSE 0e0 END) AS generic_prescribe_pct
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey),
pr AS (
  SELECT m.prescriber_id, c.c_mktsegment AS specialty, r.r_name AS hospital, n_rx, n_patients,
    avg_rx_per_patient * (CASE WHEN m.prescriber_id % 75 = 57 THEN 2.2e0 ELSE 1e0 END) AS avg_rx_per_patient,
    opioid_rate_pct * (CASE WHEN m.prescriber_id % 75 = 7 THEN 3.2e0 ELSE 1e0 END) AS opioid_rate_pct,
    avg_opioid_mme * (CASE WHEN m.prescriber_id % 75 = 7 THEN 2.8e0 ELSE 1e0 END) AS avg_opioid_mme,
    benzo_opioid_combo_pct * (CASE WHEN m.prescriber_id % 75 = 32 THEN 5.5e0 ELSE 1e0 END) AS benzo_opioid_combo_pct,
    polypharmacy_pct * (CASE WHEN m.prescriber_id % 75 = 32 THEN 2.2e0 ELSE 1e0 END) AS polypharmacy_pct,
    avg_days_supply, refill_rate_pct,
    high_dose_opioid_pct * (CASE WHEN m.prescriber_id % 75 = 7 THEN 2.5e0 ELSE 1e0 END) AS high_dose_opioid_pct,
    generic_prescribe_pct,
    n_patients * 12e0 * (CASE WHEN m.prescriber_id % 75 = 57 THEN 3.2e0 ELSE 1e0 END) AS patients_per_month,
    CASE WHEN m.prescriber_id % 75 IN (7, 32, 57) THEN 1 ELSE 0 END AS true_anomaly
  FROM m JOIN customer c ON m.prescriber_id = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

METRICS = ["avg_rx_per_patient", "opioid_rate_pct", "avg_opioid_mme", "benzo_opioid_combo_pct",
           "polypharmacy_pct", "avg_days_supply", "refill_rate_pct", "high_dose_opioid_pct",
           "generic_prescribe_pct", "patients_per_month"]

_stats = ", ".join(f"avg({m}) AS mu_{m}, stddev_pop({m}) AS sd_{m}" for m in METRICS)
_z = ",\n    ".join(f"CASE WHEN sd_{m} > 0 THEN ({m} - mu_{m}) / sd_{m} ELSE 0e0 END AS {m}_z" for m in METRICS)
_gstats = ", ".join(f"avg({m}) AS gmu_{m}, stddev_pop({m}) AS gsd_{m}" for m in METRICS)
_gz = ",\n    ".join(f"round(CASE WHEN gsd_{m} > 0 THEN ({m} - gmu_{m}) / gsd_{m} ELSE 0e0 END, 6) AS {m}_z"
                     for m in METRICS)
_absmax = ", ".join(f"abs({m}_z)" for m in METRICS)

PEER = f"""
st AS (SELECT specialty, {_stats} FROM pr GROUP BY specialty),
pz AS (SELECT pr.*,
    {_z}
  FROM pr JOIN st ON pr.specialty = st.specialty),
ps AS (SELECT *, greatest({_absmax}) AS anomaly_score FROM pz),
cut AS (SELECT quantile_cont(anomaly_score, 0.96) AS c FROM ps),
fl AS (
  SELECT ps.*, CAST(anomaly_score > cut.c AS INTEGER) AS is_anomaly,
    CASE WHEN anomaly_score <= cut.c THEN 'Normal'
         WHEN opioid_rate_pct > 35 OR avg_opioid_mme > 120 THEN 'Opioid Over-Prescriber'
         WHEN benzo_opioid_combo_pct > 15 OR polypharmacy_pct > 40 THEN 'High-Risk Combinations'
         WHEN patients_per_month > 250 OR avg_rx_per_patient > 7 THEN 'Volume Outlier'
         ELSE 'Other Anomaly' END AS anomaly_type
  FROM ps, cut)"""

# Samples by geometric skips, growth as a recursion over levels, then a walk of every row down every tree.
_TREES, _PSI, _HEIGHT, _SEED = 300, 256, 8, 42


def _u(*parts: str) -> str:
    return f"((CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 13) AS BIGINT) + 1e0) / 4503599627370496e0)"


_xs = ", ".join(f"floor({m}_z * 1e6 + 0.5e0)" for m in METRICS)
_lo, _hi = (", ".join(f"{agg}(x[{i + 1}]) OVER n" for i in range(len(METRICS))) for agg in ("min", "max"))
FOREST = f"""
fg AS (SELECT {_gstats}, count(*) AS total FROM pr),
fz AS (SELECT prescriber_id, total, {", ".join(f"CASE WHEN gsd_{m} > 0 THEN ({m} - gmu_{m}) / gsd_{m} ELSE 0e0 END AS {m}_z" for m in METRICS)}
  FROM pr, fg),
fx AS (SELECT prescriber_id AS k, total, least({_PSI}, total) AS psi, [{_xs}] AS x FROM fz),
skips AS (
  SELECT k, j, CASE WHEN 3e0 * psi >= total THEN 1
               ELSE 1 + CAST(least(floor(ln({_u(f"'{_SEED + 1}'", "k", "j")}) / ln(1 - 3e0 * psi / total)), {_TREES}) AS BIGINT) END AS s
  FROM fx, (SELECT unnest(range({_TREES})) AS j)),
joined AS (SELECT k, CAST(sum(s) OVER (PARTITION BY k ORDER BY j) - 1 AS BIGINT) AS tree FROM skips),
drawn AS (
  SELECT k, tree, row_number() OVER (PARTITION BY tree ORDER BY {_u(f"'{_SEED + 2}'", "k", "tree")}, k) AS nth
  FROM joined WHERE tree < {_TREES}),
grown AS (
  SELECT tree, k, x, CAST(1 AS BIGINT) AS node, 0 AS depth FROM drawn JOIN fx USING (k) WHERE nth <= psi
  UNION ALL
  SELECT tree, k, x, 2 * node + CASE WHEN x[f + 1] >= t THEN 1 ELSE 0 END, depth + 1
  FROM (SELECT *, lo[f + 1] + {_u(f"'{_SEED}'", "tree", "node", "'1'")} * (hi[f + 1] - lo[f + 1]) AS t
        FROM (SELECT *, varying[CAST(least(floor({_u(f"'{_SEED}'", "tree", "node", "'0'")} * len(varying)), len(varying) - 1) AS INTEGER) + 1] AS f
              FROM (SELECT *, list_filter(range({len(METRICS)}), lambda i: hi[i + 1] > lo[i + 1]) AS varying
                    FROM (SELECT *, [{_lo}] AS lo, [{_hi}] AS hi, count(*) OVER n AS size FROM grown
                          WINDOW n AS (PARTITION BY tree, node))
                    WHERE size > 1 AND depth < {_HEIGHT}) WHERE len(varying) > 0))),
sized AS (SELECT tree, node, depth, count(*) AS size, {", ".join(f"min(x[{i + 1}]) AS l{i}, max(x[{i + 1}]) AS h{i}" for i in range(len(METRICS)))}
  FROM grown GROUP BY tree, node, depth),
nodes AS (
  SELECT tree, node, size, f, lo[f + 1] + {_u(f"'{_SEED}'", "tree", "node", "'1'")} * (hi[f + 1] - lo[f + 1]) AS t
  FROM (SELECT *, CASE WHEN size > 1 AND depth < {_HEIGHT} AND len(varying) > 0 THEN
                  varying[CAST(least(floor({_u(f"'{_SEED}'", "tree", "node", "'0'")} * len(varying)), len(varying) - 1) AS INTEGER) + 1] END AS f
        FROM (SELECT *, list_filter(range({len(METRICS)}), lambda i: hi[i + 1] > lo[i + 1]) AS varying
              FROM (SELECT tree, node, depth, size, [{", ".join(f"l{i}" for i in range(len(METRICS)))}] AS lo,
                           [{", ".join(f"h{i}" for i in range(len(METRICS)))}] AS hi FROM sized)))),
walks AS (
  SELECT k, x, tree, CAST(1 AS BIGINT) AS node, 0 AS depth FROM fx, (SELECT DISTINCT tree FROM nodes)
  UNION ALL
  SELECT k, x, tree, 2 * node + CASE WHEN x[f + 1] >= t THEN 1 ELSE 0 END, depth + 1
  FROM walks JOIN nodes USING (tree, node) WHERE f IS NOT NULL),
lengths AS (
  SELECT k, avg(depth + CASE WHEN size > 2 THEN 2e0 * (ln(size - 1e0) + 0.5772156649015329e0) - 2e0 * (size - 1e0) / size
                             WHEN size = 2 THEN 1e0 ELSE 0e0 END) AS h
  FROM walks JOIN nodes USING (tree, node) WHERE f IS NULL GROUP BY k),
fs AS (
  SELECT pr.*, pow(2e0, -h / (2e0 * (ln(psi - 1e0) + 0.5772156649015329e0) - 2e0 * (psi - 1e0) / psi)) AS anomaly_score
  FROM pr JOIN lengths ON k = prescriber_id JOIN fx USING (k)),
fcut AS (SELECT quantile_cont(anomaly_score, 0.96) AS c FROM fs),
ff AS (
  SELECT fs.*, CAST(anomaly_score > fcut.c AS INTEGER) AS is_anomaly,
    CASE WHEN anomaly_score <= fcut.c THEN 'Normal'
         WHEN opioid_rate_pct > 35 OR avg_opioid_mme > 120 THEN 'Opioid Over-Prescriber'
         WHEN benzo_opioid_combo_pct > 15 OR polypharmacy_pct > 40 THEN 'High-Risk Combinations'
         WHEN patients_per_month > 250 OR avg_rx_per_patient > 7 THEN 'Volume Outlier'
         ELSE 'Other Anomaly' END AS anomaly_type
  FROM fs, fcut)"""

# Eigenvectors of the correlation matrix by squaring it until one direction is left, then once more without that one.
_K = len(METRICS)
_cm = ",\n  ".join("[" + ", ".join("1e0" if a == b else f"corr({a}, {b})" for b in METRICS) + "]" for a in METRICS)


def _component(j: int, matrix: str) -> str:
    return f"""
p{j} AS (
  SELECT 0 AS step, m FROM {matrix}
  UNION ALL
  SELECT step + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / list_sum(list_transform(m, lambda c: list_dot_product(c, c)))))
  FROM p{j} WHERE step < 40),
l{j} AS (SELECT list_extract(m, list_position(list_transform(m, lambda a: list_dot_product(a, a)), list_max(list_transform(m, lambda a: list_dot_product(a, a))))) AS u
  FROM p{j} WHERE step = 40),
v{j} AS (
  SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))
    * sign(list_extract(u, list_position(list_transform(u, lambda x: abs(x)), list_max(list_transform(u, lambda x: abs(x))))))) AS v FROM l{j}),
e{j} AS (SELECT v, m, list_dot_product(v, list_transform(m, lambda a: list_dot_product(a, v))) AS value FROM v{j}, {matrix}),
c{j + 1} AS (
  SELECT list_transform(range(1, {_K + 1}), lambda i: list_transform(range(1, {_K + 1}), lambda k: m[i][k] - value * v[i] * v[k])) AS m FROM e{j})"""


_zl = ", ".join(f"({m} - gmu_{m}) / gsd_{m}" for m in METRICS)
PCA = f"""
c1 AS (SELECT [{_cm}] AS m FROM pr),{_component(1, "c1")},{_component(2, "c2")},
gs AS (SELECT {_gstats} FROM pr)"""

_pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
_corr = "\nUNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM pr"
                            for a, b in _pairs)



def _wr(*ctes: str) -> str:
    return w(*ctes).replace("WITH", "WITH RECURSIVE", 1)


PROFILE = ["opioid_rate_pct", "avg_opioid_mme", "benzo_opioid_combo_pct", "polypharmacy_pct",
           "patients_per_month", "refill_rate_pct"]

ORACLE = {
    "prescriber_lookup": w(PRESC) + """
SELECT prescriber_id, specialty, hospital, round(opioid_rate_pct, 6) AS opioid_rate_pct,
       round(avg_opioid_mme, 6) AS avg_opioid_mme, round(patients_per_month, 6) AS patients_per_month
FROM pr WHERE specialty IN ('BUILDING', 'MACHINERY') AND hospital IN ('AMERICA', 'ASIA')
ORDER BY prescriber_id LIMIT 50""",

    "rx_specialty_profile": w(PRESC) + "\nSELECT specialty, "
    + ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in PROFILE)
    + ", count(*) AS n_prescribers FROM pr GROUP BY specialty",

    "clip_metrics": w(PRESC) + """
SELECT prescriber_id,
  round(greatest(0e0, least(100e0, opioid_rate_pct)), 6) AS opioid_rate_pct,
  round(greatest(0e0, least(500e0, avg_opioid_mme)), 6) AS avg_opioid_mme,
  round(greatest(0e0, least(100e0, benzo_opioid_combo_pct)), 6) AS benzo_opioid_combo_pct,
  round(greatest(0e0, least(100e0, polypharmacy_pct)), 6) AS polypharmacy_pct,
  round(greatest(1e0, least(800e0, patients_per_month)), 6) AS patients_per_month,
  round(greatest(1e0, least(20e0, avg_rx_per_patient)), 6) AS avg_rx_per_patient
FROM pr""",

    "clip_stretched": w(PRESC) + """
SELECT prescriber_id,
  round(greatest(0e0, least(100e0, (opioid_rate_pct - 30e0) * 4e0 + 30e0)), 6) AS opioid_rate_pct,
  round(greatest(0e0, least(500e0, (avg_opioid_mme - 30e0) * 4e0 + 30e0)), 6) AS avg_opioid_mme,
  round(greatest(0e0, least(100e0, (benzo_opioid_combo_pct - 30e0) * 4e0 + 30e0)), 6) AS benzo_opioid_combo_pct,
  round(greatest(0e0, least(100e0, (polypharmacy_pct - 30e0) * 4e0 + 30e0)), 6) AS polypharmacy_pct,
  round(greatest(1e0, least(800e0, (patients_per_month - 30e0) * 4e0 + 30e0)), 6) AS patients_per_month,
  round(greatest(1e0, least(20e0, (avg_rx_per_patient - 30e0) * 4e0 + 30e0)), 6) AS avg_rx_per_patient
FROM pr""",

    "standardize": w(PRESC) + f""",
g AS (SELECT {_gstats} FROM pr)
SELECT prescriber_id,
    {_gz}
FROM pr, g""",

    "rx_peer_zscore": w(PRESC, PEER) + "\nSELECT prescriber_id, specialty, "
    + ", ".join(f"round({m}_z, 6) AS {m}_z" for m in METRICS)
    + ", round(anomaly_score, 6) AS anomaly_score FROM ps",

    "flag_top_fraction": w(PRESC, PEER) + """
SELECT prescriber_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly FROM fl""",

    "rx_anomaly_type": w(PRESC, PEER) + "\nSELECT prescriber_id, is_anomaly, anomaly_type FROM fl",

    "rx_detection_quality": w(PRESC, PEER) + """
SELECT detected, true_anomalies, true_positives,
       round(CASE WHEN detected > 0 THEN true_positives * 1e0 / detected ELSE 0e0 END, 6) AS precision,
       round(CASE WHEN true_anomalies > 0 THEN true_positives * 1e0 / true_anomalies ELSE 0e0 END, 6) AS recall
FROM (SELECT count(*) FILTER (WHERE is_anomaly = 1) AS detected,
             count(*) FILTER (WHERE true_anomaly = 1) AS true_anomalies,
             count(*) FILTER (WHERE is_anomaly = 1 AND true_anomaly = 1) AS true_positives FROM fl) q""",

    "rx_breakdown": w(PRESC, PEER) + """
SELECT anomaly_type, n, round(n * 1e0 / sum(n) OVER () * 100e0, 6) AS share_pct
FROM (SELECT anomaly_type, count(*) AS n FROM fl WHERE is_anomaly = 1 GROUP BY anomaly_type) g""",

    "rx_rate_hospital": w(PRESC, PEER) + """
SELECT hospital, round(rate, 6) AS anomaly_rate_pct,
       CASE WHEN rate > 5 THEN 'red' WHEN rate > 3 THEN 'orange' ELSE 'green' END AS band
FROM (SELECT hospital, avg(is_anomaly) * 100e0 AS rate FROM fl GROUP BY hospital) g""",

    "rx_top_hospital": w(PRESC, PEER) + """
SELECT hospital, round(rate, 6) AS anomaly_rate_pct
FROM (SELECT hospital, avg(is_anomaly) * 100e0 AS rate FROM fl GROUP BY hospital) g
ORDER BY rate DESC, hospital LIMIT 1""",

    "rx_score_threshold": w(PRESC, PEER) + """
SELECT round(min(anomaly_score) FILTER (WHERE is_anomaly = 1), 6) AS threshold,
       count(*) FILTER (WHERE is_anomaly = 1) AS n_flagged, round(max(anomaly_score), 6) AS max_score FROM fl""",

    "rx_score_histogram": w(PRESC, PEER) + """,
rng AS (SELECT is_anomaly AS class, min(anomaly_score) AS mn, max(anomaly_score) AS mx, count(*) AS cnt
        FROM fl GROUP BY is_anomaly),
bb AS (SELECT rng.*, CASE WHEN mx - mn > 0 THEN CAST(least(floor((anomaly_score - mn) * 50 / (mx - mn)), 49)
                     AS INTEGER) ELSE 0 END AS bin
       FROM fl JOIN rng ON fl.is_anomaly = rng.class)
SELECT class, bin, round(mn + (mx - mn) * bin / 50, 6) AS lo, round(mn + (mx - mn) * (bin + 1) / 50, 6) AS hi,
       count(*) AS n,
       round(CASE WHEN mx - mn > 0 THEN count(*) / (any_value(cnt) * (mx - mn) / 50) END, 6) AS density
FROM bb GROUP BY class, bin, mn, mx""",

    "rx_audit_list": w(PRESC, PEER) + """
SELECT 'CPSO-' || CAST(prescriber_id + 100000 AS VARCHAR) AS prescriber_code, specialty, hospital, anomaly_type,
       round(anomaly_score, 6) AS anomaly_score, round(opioid_rate_pct, 6) AS opioid_rate_pct,
       round(avg_opioid_mme, 6) AS avg_opioid_mme, round(benzo_opioid_combo_pct, 6) AS benzo_opioid_combo_pct,
       round(patients_per_month, 6) AS patients_per_month
FROM fl WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, prescriber_id LIMIT 20""",

    "rx_risk_quadrant": w(PRESC) + """
SELECT prescriber_id,
       CASE (CASE WHEN opioid_rate_pct > rm THEN 1 ELSE 0 END) + (CASE WHEN avg_opioid_mme > mm THEN 1 ELSE 0 END)
            WHEN 2 THEN 'HIGH RISK' WHEN 1 THEN 'MONITOR' ELSE 'NORMAL' END AS quadrant
FROM pr, (SELECT avg(opioid_rate_pct) AS rm, avg(avg_opioid_mme) AS mm FROM pr) g""",

    "rx_corr": w(PRESC) + "\n" + _corr,

    "iforest_scores": _wr(PRESC, FOREST) + """
SELECT prescriber_id, round(anomaly_score, 6) AS anomaly_score, is_anomaly, anomaly_type, true_anomaly FROM ff""",

    "iforest_quality": _wr(PRESC, FOREST) + """
SELECT detected, true_anomalies, true_positives,
       round(CASE WHEN detected > 0 THEN true_positives * 1e0 / detected ELSE 0e0 END, 6) AS precision,
       round(CASE WHEN true_anomalies > 0 THEN true_positives * 1e0 / true_anomalies ELSE 0e0 END, 6) AS recall
FROM (SELECT count(*) FILTER (WHERE is_anomaly = 1) AS detected,
             count(*) FILTER (WHERE true_anomaly = 1) AS true_anomalies,
             count(*) FILTER (WHERE is_anomaly = 1 AND true_anomaly = 1) AS true_positives FROM ff) q""",

    "iforest_audit_list": _wr(PRESC, FOREST) + """
SELECT 'CPSO-' || CAST(prescriber_id + 100000 AS VARCHAR) AS prescriber_code, specialty, hospital, anomaly_type,
       round(anomaly_score, 6) AS anomaly_score, round(opioid_rate_pct, 6) AS opioid_rate_pct,
       round(avg_opioid_mme, 6) AS avg_opioid_mme, round(benzo_opioid_combo_pct, 6) AS benzo_opioid_combo_pct,
       round(patients_per_month, 6) AS patients_per_month
FROM ff WHERE is_anomaly = 1 ORDER BY anomaly_score DESC, prescriber_id LIMIT 20""",

    "rx_pca": _wr(PRESC, PCA) + f"""
SELECT prescriber_id, round(list_dot_product([{_zl}], e1.v), 6) AS pca1, round(list_dot_product([{_zl}], e2.v), 6) AS pca2,
       round(e1.value / {_K}, 6) AS evr1, round(e2.value / {_K}, 6) AS evr2
FROM pr, gs, e1, e2""",
}
