"""DuckDB oracle SQL for the surge queries (same results as plans/surge.py).

Each string inlines the fixture binding as CTEs; only the base tables are
registered as views by the checker.
"""

from __future__ import annotations

ED = """
v AS (
  SELECT CAST(l.l_shipdate AS DATE) AS visit_date, r.r_name AS hospital, count(*) AS ed_visits
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
       JOIN nation n ON s.s_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY CAST(l.l_shipdate AS DATE), r.r_name),
b AS (SELECT hospital, avg(ed_visits) AS base FROM v GROUP BY hospital),
ev AS (
  SELECT v.visit_date, v.hospital, v.ed_visits, b.base,
         CAST(floor(b.base * 1.25e0) AS BIGINT) AS surge_threshold
  FROM v JOIN b ON v.hospital = b.hospital)"""

HOL = """
yr AS (SELECT unnest(range(min(year(l_shipdate)) - 1, max(year(l_shipdate)) + 3)) AS y FROM lineitem),
es AS (
  SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (19 * (y % 19) + y // 100 - y // 400 - (y // 100 - (y // 100 + 8) // 25 + 1) // 3 + 15) % 30 AS h
  FROM yr),
el AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM es),
em AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM el),
ms AS (
  SELECT y, m, k, make_date(CAST(y AS INTEGER), m, 1) + CAST((8 - isodow(make_date(CAST(y AS INTEGER), m, 1))) % 7 + 7 * (k - 1) AS INTEGER) AS ds
  FROM yr, (VALUES (2, 3), (8, 1), (9, 1), (10, 2)) mk(m, k)),
hol AS (
  SELECT make_date(CAST(y AS INTEGER), m, d) AS ds FROM yr, (VALUES (1, 1), (7, 1), (12, 26)) md(m, d)
  UNION SELECT ds FROM ms
  UNION SELECT make_date(CAST(y AS INTEGER), CAST(n // 31 AS INTEGER), CAST(n % 31 + 1 AS INTEGER)) - 2 FROM em
  UNION SELECT make_date(CAST(y AS INTEGER), 5, CAST(d AS INTEGER)) FROM yr, (SELECT unnest(range(18, 25)) AS d) WHERE isodow(make_date(CAST(y AS INTEGER), 5, CAST(d AS INTEGER))) = 1
  UNION SELECT make_date(CAST(y AS INTEGER), 12, 25) FROM yr WHERE isodow(make_date(CAST(y AS INTEGER), 12, 25)) < 7),
hw AS (
  SELECT hday, max(CASE WHEN o = -1 THEN 1 ELSE 0 END) AS hol_m1,
         max(CASE WHEN o = 0 THEN 1 ELSE 0 END) AS hol_0,
         max(CASE WHEN o = 1 THEN 1 ELSE 0 END) AS hol_p1
  FROM (SELECT ds + o AS hday, o FROM hol, (VALUES (-1), (0), (1)) t(o)) x
  GROUP BY hday)"""

DOW = "CAST(isodow({d}) - 1 AS INTEGER)"
WD = DOW.format(d="visit_date")

RULE_IN = f"""
ri AS (
  SELECT ev.*, CASE WHEN h.ds IS NULL THEN 0 ELSE 1 END AS is_holiday,
         {WD} AS weekday, CAST(month(visit_date) AS INTEGER) AS month
  FROM ev LEFT JOIN (SELECT DISTINCT ds FROM hol) h ON ev.visit_date = h.ds)"""

DOW_CASE = ("CASE weekday WHEN 0 THEN 1.12e0 WHEN 1 THEN 1.05e0 WHEN 2 THEN 1.00e0 WHEN 3 THEN 1.00e0 "
            "WHEN 4 THEN 1.08e0 WHEN 5 THEN 0.92e0 WHEN 6 THEN 0.85e0 END")
MON_CASE = ("CASE month WHEN 1 THEN 1.22e0 WHEN 2 THEN 1.20e0 WHEN 3 THEN 1.05e0 WHEN 4 THEN 1.00e0 "
            "WHEN 5 THEN 0.98e0 WHEN 6 THEN 0.92e0 WHEN 7 THEN 0.90e0 WHEN 8 THEN 0.91e0 "
            "WHEN 9 THEN 0.97e0 WHEN 10 THEN 1.02e0 WHEN 11 THEN 1.08e0 WHEN 12 THEN 1.20e0 END")
PRED = f"""
pr AS (
  SELECT *, CAST(floor(base * 1.25e0) AS BIGINT) AS thr,
         CAST(floor(base * ({DOW_CASE}) * ({MON_CASE})
               * (CASE WHEN is_holiday = 1 THEN 1.30e0 ELSE 1e0 END)) AS BIGINT) AS predicted_visits
  FROM {{src}}),
sc AS (
  SELECT *, CASE WHEN thr > base THEN greatest(0e0, least(1e0, (predicted_visits - base) / (thr - base)))
                 WHEN predicted_visits > thr THEN 1e0 ELSE 0e0 END AS score
  FROM pr)"""

SCORE_COLS = """round(round_even(score, 4), 6) AS surge_risk_score, predicted_visits > thr AS surge_flag,
  CASE WHEN score >= 0.8e0 THEN 'HIGH' WHEN score >= 0.5e0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level"""

# Seasonal-index model (F1) over the history, then the forecast spine (F2).
MODEL_T = f"""
h AS (
  SELECT ev.hospital, ev.visit_date AS ds, CAST(ev.ed_visits AS DOUBLE) AS y,
         CAST(ev.visit_date - DATE '2000-01-01' AS BIGINT) AS t,
         {WD} AS weekday, CAST(month(ev.visit_date) AS INTEGER) AS month,
         CASE WHEN hw.hday IS NULL THEN 0 ELSE 1 END AS in_window
  FROM {{src}} ev LEFT JOIN hw ON ev.visit_date = hw.hday),
site AS (
  SELECT hospital, avg(y) AS base, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept,
         max(ds) AS last_date
  FROM h GROUP BY hospital),
dw AS (SELECT h.hospital, weekday, avg(y) / any_value(site.base) AS dow_idx
       FROM h JOIN site ON h.hospital = site.hospital GROUP BY h.hospital, weekday),
mo AS (SELECT h.hospital, month, avg(y) / any_value(site.base) AS month_idx
       FROM h JOIN site ON h.hospital = site.hospital GROUP BY h.hospital, month),
f0 AS (
  SELECT h.*, (site.intercept + site.slope * h.t) * dw.dow_idx * mo.month_idx AS fit0
  FROM h JOIN site ON h.hospital = site.hospital
         JOIN dw ON h.hospital = dw.hospital AND h.weekday = dw.weekday
         JOIN mo ON h.hospital = mo.hospital AND h.month = mo.month),
hi AS (SELECT hospital, coalesce(sum(CASE WHEN in_window = 1 THEN y END)
                                   / sum(CASE WHEN in_window = 1 THEN fit0 END), 1e0) AS holiday_idx
       FROM f0 GROUP BY hospital),
sd AS (
  SELECT f0.hospital, stddev_pop(y - fit0 * CASE WHEN in_window = 1 THEN hi.holiday_idx ELSE 1e0 END) AS resid_sd
  FROM f0 JOIN hi ON f0.hospital = hi.hospital GROUP BY f0.hospital),
ys AS (SELECT hospital, year(ds) AS yy, regr_slope(y, t) AS b FROM h GROUP BY hospital, year(ds) HAVING count(*) >= 300),
sv AS (SELECT p.hospital, avg((q.b - p.b) * (q.b - p.b)) / 365.25e0 AS slope_var
       FROM ys p JOIN ys q ON q.hospital = p.hospital AND q.yy = p.yy + 1 GROUP BY p.hospital),
model AS (SELECT site.*, hi.holiday_idx, sd.resid_sd, coalesce(sv.slope_var, 0e0) AS slope_var
          FROM site JOIN hi ON site.hospital = hi.hospital
          JOIN sd ON site.hospital = sd.hospital LEFT JOIN sv ON site.hospital = sv.hospital)"""

MODEL = MODEL_T.replace("{src}", "ev")

FORECAST = """
sp AS (
  SELECT m.*, CAST(m.last_date + CAST(k AS INTEGER) AS DATE) AS ds
  FROM model m, (SELECT unnest(range(1, {periods} + 1)) AS k) r),
fc AS (
  SELECT sp.hospital, sp.ds, sp.base,
         (sp.intercept + sp.slope * CAST(sp.ds - DATE '2000-01-01' AS BIGINT))
           * coalesce(dw.dow_idx, 1e0) * coalesce(mo.month_idx, 1e0)
           * CASE WHEN hw.hday IS NULL THEN 1e0 ELSE sp.holiday_idx END AS yhat,
         sp.ds - sp.last_date AS ahead,
         sqrt(sp.resid_sd ** 2 + (coalesce(dw.dow_idx, 1e0) * coalesce(mo.month_idx, 1e0)
           * CASE WHEN hw.hday IS NULL THEN 1e0 ELSE sp.holiday_idx END) ** 2 * sp.slope_var
           * (sp.ds - sp.last_date) ** 3 / 3e0) AS resid_sd
  FROM sp LEFT JOIN hw ON sp.ds = hw.hday
       LEFT JOIN dw ON sp.hospital = dw.hospital AND dw.weekday = CAST(isodow(sp.ds) - 1 AS INTEGER)
       LEFT JOIN mo ON sp.hospital = mo.hospital AND mo.month = CAST(month(sp.ds) AS INTEGER)),
ff AS (
  SELECT hospital, ds, ahead, yhat, yhat - 1.6448536269514722e0 * resid_sd AS yhat_lower,
         yhat + 1.6448536269514722e0 * resid_sd AS yhat_upper,
         CAST(floor(base * 1.25e0) AS BIGINT) AS surge_threshold,
         yhat > CAST(floor(base * 1.25e0) AS BIGINT) AS surge_flag
  FROM fc)"""


# The same forecast flagged at a lower threshold.
SENSITIVE = FORECAST.format(periods=30).replace("1.25e0", "1.12e0")


def w(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


BACKTEST = """
tg AS (SELECT ev.*, ev.visit_date > max(ev.visit_date) OVER (PARTITION BY ev.hospital) - 30 AS is_test FROM ev),
tr AS (SELECT * FROM tg WHERE NOT is_test),""" + MODEL_T.replace("{src}", "tr")

ORACLE = {
    "surge_flag": w(ED) + """
SELECT visit_date, hospital, ed_visits, surge_threshold,
       CAST(ed_visits > surge_threshold AS INTEGER) AS surge_flag FROM ev""",

    "calendar_features": w(ED) + f"""
SELECT visit_date, hospital, ed_visits, CAST(year(visit_date) AS INTEGER) AS year,
       CAST(month(visit_date) AS INTEGER) AS month, {WD} AS weekday,
       strftime(visit_date, '%b') AS month_name, strftime(visit_date, '%a') AS day_name,
       strftime(visit_date, '%Y-%m-%d') AS iso_date, strftime(visit_date, '%B %d, %Y') AS long_date,
       last_day(visit_date) AS month_end
FROM ev""",

    "holiday_flag": w(ED, HOL) + """
SELECT ev.visit_date, ev.hospital, ev.ed_visits, CASE WHEN h.ds IS NULL THEN 0 ELSE 1 END AS is_holiday
FROM ev LEFT JOIN (SELECT DISTINCT ds FROM hol) h ON ev.visit_date = h.ds""",

    "holiday_window": w(ED, HOL) + """
SELECT ev.visit_date, ev.hospital, coalesce(hol_m1, 0) AS hol_m1, coalesce(hol_0, 0) AS hol_0,
       coalesce(hol_p1, 0) AS hol_p1,
       greatest(coalesce(hol_m1, 0), coalesce(hol_0, 0), coalesce(hol_p1, 0)) AS in_window
FROM ev LEFT JOIN hw ON ev.visit_date = hw.hday""",

    "monthly_trend": w(ED) + """,
a AS (SELECT hospital, last_day(visit_date) AS month_end, avg(ed_visits) AS avg_visits,
             max(surge_threshold) AS thr FROM ev GROUP BY hospital, last_day(visit_date)),
rg AS (SELECT hospital, min(month_end) AS m0, max(month_end) AS m1, max(thr) AS thr FROM a GROUP BY hospital),
sp AS (SELECT hospital, thr, last_day(CAST(unnest(generate_series(date_trunc('month', m0), date_trunc('month', m1),
             INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM rg)
SELECT sp.hospital, sp.month_end, round(a.avg_visits, 6) AS avg_visits, sp.thr AS surge_threshold
FROM sp LEFT JOIN a ON sp.hospital = a.hospital AND sp.month_end = a.month_end""",

    "seasonality_month": w(ED) + """
SELECT CAST(m AS INTEGER) AS month, name AS month_name, round(avg_visits, 6) AS avg_visits,
       CASE WHEN m IN (12, 1, 2) THEN 'winter' ELSE 'other' END AS band
FROM (VALUES (1, 'Jan'), (2, 'Feb'), (3, 'Mar'), (4, 'Apr'), (5, 'May'), (6, 'Jun'), (7, 'Jul'),
             (8, 'Aug'), (9, 'Sep'), (10, 'Oct'), (11, 'Nov'), (12, 'Dec')) d(m, name)
LEFT JOIN (SELECT month(visit_date) AS mm, avg(ed_visits) AS avg_visits FROM ev GROUP BY 1) a ON a.mm = d.m""",

    "seasonality_dow": w(ED) + f"""
SELECT CAST(wd AS INTEGER) AS weekday, name AS day_name, round(avg_visits, 6) AS avg_visits,
       CASE WHEN wd IN (0, 4) THEN 'high' WHEN wd IN (5, 6) THEN 'low' ELSE 'normal' END AS band
FROM (VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun')) d(wd, name)
LEFT JOIN (SELECT {WD} AS x, avg(ed_visits) AS avg_visits FROM ev GROUP BY 1) a ON a.x = d.wd""",

    "profile_visits": w(ED) + """
SELECT min(visit_date) AS min_date, max(visit_date) AS max_date, count(DISTINCT hospital) AS n_sites,
       count(*) AS n_rows, CAST(sum(CASE WHEN ed_visits > surge_threshold THEN 1 ELSE 0 END) AS BIGINT) AS surge_days,
       round(avg(CASE WHEN ed_visits > surge_threshold THEN 1 ELSE 0 END), 6) AS surge_share
FROM ev""",

    "mean_of_means": w(ED) + f"""
SELECT round((SELECT avg(ed_visits) FROM ev), 6) AS overall_mean,
       round((SELECT avg(m) FROM (SELECT month(visit_date) AS k, avg(ed_visits) AS m FROM ev GROUP BY 1)), 6)
         AS month_mean_of_means,
       round((SELECT avg(m) FROM (SELECT {WD} AS k, avg(ed_visits) AS m FROM ev GROUP BY 1)), 6)
         AS dow_mean_of_means""",

    "distinct_sites": w(ED) + "\nSELECT DISTINCT hospital FROM ev",

    "last_90_days": w(ED) + """
SELECT hospital, visit_date, ed_visits, rn FROM (
  SELECT hospital, visit_date, ed_visits,
         CAST(row_number() OVER (PARTITION BY hospital ORDER BY visit_date DESC) AS INTEGER) AS rn FROM ev) x
WHERE rn <= 90""",

    "hospital_reference": w(ED) + """
SELECT hospital, CASE WHEN hospital IN ('AMERICA', 'EUROPE') THEN 'Academic' ELSE 'Community' END AS type,
       round(base, 6) AS base, CAST(floor(base * 1.25e0) AS BIGINT) AS surge_threshold,
       'Greater Toronto Area' AS region, 'Ontario, Canada' AS province
FROM b""",

    "surge_predicted": w(ED, HOL, RULE_IN, PRED.format(src="ri")) + """
SELECT visit_date, hospital, ed_visits, surge_threshold, predicted_visits FROM sc""",

    "surge_risk_score": w(ED, HOL, RULE_IN, PRED.format(src="ri")) + f"""
SELECT visit_date, hospital, predicted_visits, thr AS surge_threshold, {SCORE_COLS},
       printf('%.1f', predicted_visits / base * 100e0) || '%' AS capacity_pct,
       printf('%.1f', score * 100e0) || '%' AS surge_risk_pct
FROM sc""",

    "surge_grid": w(ED, """
g AS (SELECT b.hospital, b.base, CAST(wd AS INTEGER) AS weekday, CAST(mm AS INTEGER) AS month,
             CAST(hh AS INTEGER) AS is_holiday
      FROM b, (SELECT unnest(range(0, 7)) AS wd) x, (SELECT unnest(range(1, 13)) AS mm) y,
           (SELECT unnest(range(0, 2)) AS hh) z)""", PRED.format(src="g")) + f"""
SELECT hospital, weekday, month, is_holiday, predicted_visits, thr AS surge_threshold, {SCORE_COLS} FROM sc""",

    "expected_volume": w(ED, HOL, RULE_IN) + """
SELECT visit_date, hospital, ed_visits, round(greatest(base
    * (CASE weekday WHEN 0 THEN 1.12e0 WHEN 1 THEN 1.05e0 WHEN 2 THEN 1.00e0 WHEN 3 THEN 1.00e0
                    WHEN 4 THEN 1.08e0 WHEN 5 THEN 0.92e0 WHEN 6 THEN 0.85e0 END)
    * (CASE WHEN month IN (12, 1, 2) THEN 1.225e0 WHEN month IN (6, 7, 8) THEN 0.915e0 ELSE 1e0 END)
    * (CASE WHEN is_holiday = 1 THEN 1.325e0 ELSE 1e0 END)
    * pow(1.03e0, CAST(year(visit_date) - 2022 AS DOUBLE)), 50e0), 6) AS expected_visits
FROM ri""",

    "seasonal_index": w(ED, HOL, MODEL) + """
SELECT hospital, 'trend' AS component, 0 AS k, round(slope, 6) AS value, round(intercept, 6) AS value2 FROM model
UNION ALL
SELECT hospital, 'site', 0, round(holiday_idx, 6), round(resid_sd, 6) FROM model
UNION ALL
SELECT hospital, 'weekday', weekday, round(dow_idx, 6), CAST(NULL AS DOUBLE) FROM dw
UNION ALL
SELECT hospital, 'month', month, round(month_idx, 6), CAST(NULL AS DOUBLE) FROM mo""",

    "surge_forecast": w(ED, HOL, MODEL, FORECAST.format(periods=30)) + """
SELECT hospital, ds, round(yhat, 6) AS yhat, round(yhat_lower, 6) AS yhat_lower,
       round(yhat_upper, 6) AS yhat_upper FROM ff""",

    "combined_forecast": w(ED, HOL, MODEL, FORECAST.format(periods=30)) + """
SELECT ds, round(yhat, 6) AS yhat, round(yhat_lower, 6) AS yhat_lower, round(yhat_upper, 6) AS yhat_upper,
       hospital, surge_threshold, surge_flag FROM ff""",

    "surge_days": w(ED, HOL, MODEL, FORECAST.format(periods=30)) + """
SELECT hospital, ds, round(yhat, 6) AS yhat, surge_threshold FROM ff WHERE yhat > surge_threshold""",

    "surge_summary": w(ED, HOL, MODEL, FORECAST.format(periods=30)) + """
SELECT hospital, CASE WHEN hospital IN ('AMERICA', 'EUROPE') THEN 'Academic' ELSE 'Community' END AS type,
       CAST(round_even(avg(yhat), 0) AS BIGINT) AS avg_forecast,
       max(surge_threshold) AS surge_threshold, count(*) FILTER (WHERE surge_flag) AS surge_days,
       CASE WHEN count(*) FILTER (WHERE surge_flag) > 10 THEN 'HIGH'
            WHEN count(*) FILTER (WHERE surge_flag) > 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       coalesce(strftime(min(CASE WHEN surge_flag THEN ds END), '%Y-%m-%d'), 'None') AS first_surge_date
FROM ff GROUP BY hospital""",

    "surge_summary_sensitive": w(ED, HOL, MODEL, SENSITIVE) + """
SELECT hospital, CASE WHEN hospital IN ('AMERICA', 'EUROPE') THEN 'Academic' ELSE 'Community' END AS type,
       CAST(round_even(avg(yhat), 0) AS BIGINT) AS avg_forecast,
       max(surge_threshold) AS surge_threshold, count(*) FILTER (WHERE surge_flag) AS surge_days,
       CASE WHEN count(*) FILTER (WHERE surge_flag) > 10 THEN 'HIGH'
            WHEN count(*) FILTER (WHERE surge_flag) > 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       coalesce(strftime(min(CASE WHEN surge_flag THEN ds END), '%Y-%m-%d'), 'None') AS first_surge_date
FROM ff GROUP BY hospital""",

    "surge_days_sensitive": w(ED, HOL, MODEL, SENSITIVE) + """
SELECT hospital, ds, round(yhat, 6) AS yhat, surge_threshold FROM ff WHERE yhat > surge_threshold""",

    "monthly_trend_gaps": w(ED) + """,
a AS (SELECT hospital, last_day(visit_date) AS month_end, avg(ed_visits) AS avg_visits,
             max(surge_threshold) AS thr FROM ev WHERE month(visit_date) NOT IN (4, 9) GROUP BY hospital, last_day(visit_date)),
rg AS (SELECT hospital, min(month_end) AS m0, max(month_end) AS m1, max(thr) AS thr FROM a GROUP BY hospital),
sp AS (SELECT hospital, thr, last_day(CAST(unnest(generate_series(date_trunc('month', m0), date_trunc('month', m1),
             INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM rg)
SELECT sp.hospital, sp.month_end, round(a.avg_visits, 6) AS avg_visits, sp.thr AS surge_threshold
FROM sp LEFT JOIN a ON sp.hospital = a.hospital AND sp.month_end = a.month_end""",

    "validate_surge_inputs": w(ED) + """,
q AS (
  SELECT CASE WHEN o_orderkey % 41 = 0 THEN 'ELSEWHERE' ELSE r_name END AS hospital, o_orderkey % 8 AS day, o_orderkey % 14 AS month
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT month BETWEEN 1 AND 12 AS m, day < 7 AS d, hospital IN (SELECT hospital FROM ev) AS h FROM q)
SELECT rule, n_rows FROM (
  SELECT 'month' AS rule, count(*) FILTER (WHERE NOT m) AS n_rows FROM c
  UNION ALL SELECT 'day_name', count(*) FILTER (WHERE NOT d) FROM c
  UNION ALL SELECT 'hospital', count(*) FILTER (WHERE NOT h) FROM c
  UNION ALL SELECT 'valid', count(*) FILTER (WHERE m AND d AND h) FROM c) x WHERE n_rows > 0""",

    "forecast_backtest": w(ED, HOL, BACKTEST, FORECAST.format(periods=30)) + """
SELECT ff.hospital, count(*) AS n_test, round(avg(abs(tg.ed_visits - ff.yhat)), 6) AS mae,
       round(avg(abs(tg.ed_visits - ff.yhat) / tg.ed_visits * 100e0), 6) AS mape,
       round(avg(CASE WHEN tg.ed_visits >= ff.yhat_lower AND tg.ed_visits <= ff.yhat_upper THEN 1e0 ELSE 0e0 END), 6)
         AS coverage
FROM ff JOIN tg ON ff.hospital = tg.hospital AND ff.ds = tg.visit_date AND tg.is_test
GROUP BY ff.hospital""",

    "seasonal_index_dense": w(ED, HOL, """
rg AS (SELECT hospital, min(visit_date) AS a, max(visit_date) AS b FROM ev GROUP BY hospital),
dense AS (
  SELECT rg.hospital, rg.a + CAST(k AS INTEGER) AS visit_date, coalesce(ev.ed_visits, 0) AS ed_visits
  FROM rg, LATERAL (SELECT unnest(range(rg.b - rg.a + 1)) AS k)
       LEFT JOIN ev ON ev.hospital = rg.hospital AND ev.visit_date = rg.a + CAST(k AS INTEGER))""",
                              MODEL_T.replace("{src}", "dense")) + """
SELECT model.hospital, n_days, round(base, 6) AS base, round(slope, 6) AS slope, round(intercept, 6) AS intercept,
       round(holiday_idx, 6) AS holiday_idx, round(resid_sd, 6) AS resid_sd
FROM model JOIN (SELECT hospital, count(*) AS n_days FROM dense GROUP BY hospital) d ON d.hospital = model.hospital""",

    "forecast_horizon_width": w(ED, HOL, MODEL, FORECAST.format(periods=60)) + """
SELECT hospital, ds, CAST(ahead AS INTEGER) AS days_ahead, round(yhat, 6) AS yhat,
       round((yhat_upper - yhat_lower) / 2, 6) AS half_width FROM ff WHERE ahead IN (7, 30, 60)""",

    "forecast_rolling": w(ED, HOL, """
oo AS (SELECT unnest(range(6)) AS origin),
cuts AS (SELECT ev.hospital, origin, max(visit_date) - CAST(30 + 30 * (5 - origin) AS INTEGER) AS cut FROM ev, oo GROUP BY ev.hospital, origin),
tr AS (SELECT ev.hospital || '|' || origin AS hospital, ev.visit_date, ev.ed_visits
       FROM ev JOIN cuts ON cuts.hospital = ev.hospital AND ev.visit_date <= cut)""",
                          MODEL_T.replace("{src}", "tr").replace("max(ds) AS last_date", "(SELECT min(cut) FROM cuts WHERE cuts.hospital || '|' || cuts.origin = h.hospital) AS last_date"),
                          FORECAST.format(periods=30)) + """
SELECT cuts.hospital, CAST(cuts.origin AS INTEGER) AS origin, cuts.cut AS last_date, count(*) AS n_test,
       round(avg(abs(ev.ed_visits - ff.yhat)), 6) AS mae, round(avg(abs(ev.ed_visits - ff.yhat) / ev.ed_visits * 100e0), 6) AS mape,
       round(avg(CASE WHEN ev.ed_visits >= ff.yhat_lower AND ev.ed_visits <= ff.yhat_upper THEN 1e0 ELSE 0e0 END), 6) AS coverage,
       round(avg(ff.yhat_upper - ff.yhat_lower), 6) AS width
FROM ff JOIN cuts ON ff.hospital = cuts.hospital || '|' || cuts.origin
     JOIN ev ON ev.hospital = cuts.hospital AND ev.visit_date = ff.ds
GROUP BY cuts.hospital, cuts.origin, cuts.cut""",
}
