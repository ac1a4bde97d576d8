"""Result exports (S1, S2): the surge summary and the audit list as headered CSV files.

The column headers are the result files' own headers; the tables are small
(one row per site, twenty prescribers), so each is written as one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.sources.io import read_csv, write_csv

# Result file headers.
SUMMARY_HEADERS = {
    "hospital": "Hospital", "avg_forecast": "Avg Forecast (visits/day)", "surge_threshold": "Surge Threshold",
    "surge_days": "Surge Days (next 30)", "risk_level": "Risk Level", "first_surge_date": "First Surge Date",
}
AUDIT_HEADERS = {
    "prescriber_code": "prescriber_id", "specialty": "specialty", "hospital": "hospital",
    "anomaly_type": "anomaly_type", "anomaly_score": "anomaly_score", "opioid_rate_pct": "opioid_rate_pct",
    "avg_opioid_mme": "avg_opioid_mme", "benzo_opioid_combo_pct": "benzo_opioid_combo_pct",
    "patients_per_month": "patients_per_month",
}
AUDIT_SCHEMA = ("prescriber_id string, specialty string, hospital string, anomaly_type string, anomaly_score double, "
                "opioid_rate_pct double, avg_opioid_mme double, benzo_opioid_combo_pct double, "
                "patients_per_month double")


def _renamed(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(h) for c, h in headers.items()])


def export_surge_summary(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """The per-site surge summary, sorted by surge days (desc, then site)."""
    from wardwise.plans.surge import q_surge_summary

    out = _renamed(q_surge_summary(spark, sf), SUMMARY_HEADERS).orderBy(
        F.col("`Surge Days (next 30)`").desc(), F.col("Hospital"))
    write_csv(out, path)
    return out


def export_audit_list(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """The top-20 audit list, highest score first."""
    from wardwise.plans.rx import q_rx_audit_list

    out = _renamed(q_rx_audit_list(spark, sf), AUDIT_HEADERS).orderBy(
        F.col("anomaly_score").desc(), F.col("prescriber_id"))
    write_csv(out, path)
    return out


def read_audit_list(spark: SparkSession, path: str) -> DataFrame | None:
    """The audit list back from CSV (None with a message when it was not written)."""
    return read_csv(spark, path, AUDIT_SCHEMA)
