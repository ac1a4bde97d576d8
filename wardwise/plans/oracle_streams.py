"""DuckDB oracle SQL for the streaming queries."""

from __future__ import annotations

from wardwise.plans.oracle_alc import ADM, RISK
from wardwise.plans.oracle_surge import w

ORACLE = {
    "stream_alc_scores": w(ADM, RISK) + """
SELECT patient_id, hospital, round(alc_risk_raw, 6) AS alc_risk_raw,
       round(round_even(alc_risk_score, 4), 6) AS alc_risk_score,
       CASE WHEN alc_risk_pct >= 60 THEN 'HIGH' WHEN alc_risk_pct >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM sc""",

    "stream_daily_volume": """WITH d AS (
  SELECT CAST(ts AS DATE) AS visit_date, event_type AS hospital, count(*) AS visits FROM events GROUP BY 1, 2),
t AS (SELECT hospital, CAST(floor(avg(visits) * 1.25e0) AS BIGINT) AS surge_threshold FROM d GROUP BY hospital)
SELECT d.visit_date, d.hospital, d.visits, t.surge_threshold,
       CAST(d.visits > t.surge_threshold AS INTEGER) AS surge_flag
FROM d JOIN t ON d.hospital = t.hospital
WHERE d.visit_date < (SELECT max(CAST(ts AS DATE)) FROM events)""",

    "stream_hourly_volume": """WITH once AS (SELECT DISTINCT event_id, ts, event_type AS hospital FROM events),
seen AS (SELECT hospital, date_trunc('hour', ts) AS window_start, count(*) AS visits FROM once GROUP BY 1, 2),
ends AS (SELECT max(ts) - INTERVAL 1 HOUR AS passed FROM events),
grid AS (SELECT hospital, unnest(generate_series(min(window_start), date_trunc('hour', any_value(passed)) - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS window_start
         FROM seen, ends GROUP BY hospital),
h AS (SELECT grid.hospital, grid.window_start, coalesce(visits, 0) AS visits FROM grid LEFT JOIN seen USING (hospital, window_start)),
j AS (SELECT *, row_number() OVER w - 1 AS earlier_hours,
             CAST(floor(1.25e0 * sum(visits) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / (row_number() OVER w - 1)) AS BIGINT) AS surge_threshold
      FROM h WINDOW w AS (PARTITION BY hospital ORDER BY window_start))
SELECT hospital, CAST(window_start AS TIMESTAMP) AS window_start, visits, earlier_hours, surge_threshold,
       CAST(coalesce(visits > surge_threshold, false) AS INTEGER) AS surge_flag
FROM j""",
}
