"""Streaming queries registered for the driver (K1, K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardwise.functions.columns import r6
from wardwise.streaming.jobs import hourly_volume, stream_alc_scores, stream_daily_volume


def q_stream_alc_scores(spark, sf):
    """K1: streamed admission scores (must equal the batch D1/D2)."""
    s = stream_alc_scores(spark, sf)
    return s.select("patient_id", "hospital", r6("alc_risk_raw").alias("alc_risk_raw"),
                    r6(F.bround("alc_risk_score", 4)).alias("alc_risk_score"), "risk_level")


def q_stream_daily_volume(spark, sf):
    """K2: closed daily windows per site with surge flag."""
    return stream_daily_volume(spark, sf)


def q_stream_hourly_volume(spark, sf):
    """K2 by the hour: closed hours against the mean of the site's earlier hours, kept in the stream's state."""
    return hourly_volume(spark, sf)


QUERIES = {
    "stream_alc_scores": q_stream_alc_scores,
    "stream_daily_volume": q_stream_daily_volume,
    "stream_hourly_volume": q_stream_hourly_volume,
}
