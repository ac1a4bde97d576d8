"""Prescriber anomaly queries: profiles, peer scores, flags, types, audit list, forest, PCA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions.columns import band, clip, prescriber_code, r6
from wardwise.operators import metrics, ml
from wardwise.operators.iforest import fit_iforest, score_iforest
from wardwise.operators.joins import scalar, with_scalar
from wardwise.sources import dims
from wardwise.sources.bindings import RX_FEATURES, prescribers
from wardwise.sources.io import materialize

METRICS = RX_FEATURES + ["patients_per_month"]
PROFILE_METRICS = ["opioid_rate_pct", "avg_opioid_mme", "benzo_opioid_combo_pct", "polypharmacy_pct",
                   "patients_per_month", "refill_rate_pct"]
CLIP_RANGES = dims.CLIP_RANGES
LOOKUP_SPECIALTIES = ["BUILDING", "MACHINERY"]
LOOKUP_SITES = ["AMERICA", "ASIA"]
AUDIT_COLUMNS = ["prescriber_code", "specialty", "hospital", "anomaly_type", "anomaly_score", "opioid_rate_pct",
                 "avg_opioid_mme", "benzo_opioid_combo_pct", "patients_per_month"]


def classify_anomaly(flag: str = "is_anomaly") -> F.Column:
    """First matching rule wins."""
    opioid = (F.col("opioid_rate_pct") > dims.OPIOID_RATE_CUT) | (F.col("avg_opioid_mme") > dims.OPIOID_MME_CUT)
    combo = (F.col("benzo_opioid_combo_pct") > dims.COMBO_CUT) | (F.col("polypharmacy_pct") > dims.POLYPHARMACY_CUT)
    volume = ((F.col("patients_per_month") > dims.PATIENTS_CUT)
              | (F.col("avg_rx_per_patient") > dims.RX_PER_PATIENT_CUT))
    normal, of_opioid, of_combo, of_volume, other = dims.ANOMALY_TYPES
    return (F.when(F.col(flag) == 0, normal).when(opioid, of_opioid).when(combo, of_combo)
            .when(volume, of_volume).otherwise(other))


def prescriber_table(spark: SparkSession, sf: str) -> DataFrame:
    """The prescriber binding written once per plan that reads it several times."""
    return materialize(prescribers(spark, sf))


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    """M19 -> M13 -> P8: peer z-score, top-4% flag, anomaly type."""
    p = ml.peer_zscore(prescriber_table(spark, sf), "specialty", METRICS)
    p = ml.flag_top_fraction(p, "anomaly_score", dims.CONTAMINATION)
    return p.withColumn("anomaly_type", classify_anomaly())


def q_prescriber_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """P4 + O3: specialty AND site filter, 6 columns, first 50 by id."""
    p = prescribers(spark, sf)
    if not LOOKUP_SPECIALTIES or not LOOKUP_SITES:
        return p.limit(0)
    return (p.filter(F.col("specialty").isin(LOOKUP_SPECIALTIES) & F.col("hospital").isin(LOOKUP_SITES))
            .select("prescriber_id", "specialty", "hospital", r6("opioid_rate_pct").alias("opioid_rate_pct"),
                    r6("avg_opioid_mme").alias("avg_opioid_mme"), r6("patients_per_month").alias("patients_per_month"))
            .orderBy("prescriber_id").limit(dims.LOOKUP_SIZE))


def q_rx_specialty_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of six metrics per specialty."""
    p = prescribers(spark, sf)
    return p.groupBy("specialty").agg(*[r6(F.avg(m)).alias(f"avg_{m}") for m in PROFILE_METRICS],
                                      F.count(F.lit(1)).alias("n_prescribers"))


def q_clip_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics clipped to their plausible ranges."""
    p = prescribers(spark, sf)
    return p.select("prescriber_id", *[r6(clip(c, lo, hi)).alias(c) for c, (lo, hi) in CLIP_RANGES.items()])


def q_clip_stretched(spark: SparkSession, sf: str) -> DataFrame:
    """P9 where both bounds bind: metrics stretched fourfold around 30, clipped to their ranges."""
    p = prescribers(spark, sf)
    return p.select("prescriber_id", *[r6(clip((F.col(c) - 30.0) * 4.0 + 30.0, float(lo), float(hi))).alias(c)
                                       for c, (lo, hi) in CLIP_RANGES.items()])


def q_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Population-standardised metrics."""
    z = ml.standardize(prescribers(spark, sf), METRICS)
    return z.select("prescriber_id", *[r6(f"{m}_z").alias(f"{m}_z") for m in METRICS])


def q_rx_peer_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Z-scores within specialty and the max-|z| outlier score."""
    p = ml.peer_zscore(prescribers(spark, sf), "specialty", METRICS)
    return p.select("prescriber_id", "specialty", *[r6(f"{m}_z").alias(f"{m}_z") for m in METRICS],
                    r6("anomaly_score").alias("anomaly_score"))


def q_flag_top_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Top-4% flag on the peer score (exact linear percentile, strict >)."""
    f = flagged(spark, sf)
    return f.select("prescriber_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly")


def q_rx_anomaly_type(spark: SparkSession, sf: str) -> DataFrame:
    """Anomaly type of every prescriber."""
    return flagged(spark, sf).select("prescriber_id", "is_anomaly", "anomaly_type")


def q_rx_detection_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Precision / recall of the flags against the injected anomalies."""
    q = metrics.detection_quality(flagged(spark, sf), "is_anomaly", "true_anomaly")
    return q.select("detected", "true_anomalies", "true_positives", r6("precision").alias("precision"),
                    r6("recall").alias("recall"))


def breakdown(df: DataFrame, key: str) -> DataFrame:
    """A10: counts among flagged rows with their share (%)."""
    g = df.filter(F.col("is_anomaly") == 1).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.withColumn("share_pct", F.col("n") / scalar(total)["total"] * 100.0).orderBy(F.col("n").desc(), key)


def q_rx_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """A10: anomaly types among flagged prescribers, with share."""
    b = breakdown(flagged(spark, sf), "anomaly_type")
    return b.select("anomaly_type", "n", r6("share_pct").alias("share_pct"))


def rate_by_site(df: DataFrame) -> DataFrame:
    return df.groupBy("hospital").agg((F.avg("is_anomaly") * 100.0).alias("rate"))


def q_rx_rate_hospital(spark: SparkSession, sf: str) -> DataFrame:
    """A11 + P11: anomaly rate per site with band (> 5, > 3)."""
    r = rate_by_site(flagged(spark, sf))
    return r.select("hospital", r6("rate").alias("anomaly_rate_pct"),
                    band("rate", *dims.BANDS["rx_rate_hospital"]).alias("band")).orderBy("anomaly_rate_pct", "hospital")


def q_rx_top_hospital(spark: SparkSession, sf: str) -> DataFrame:
    """Site with the highest anomaly rate (ties: first name)."""
    r = rate_by_site(flagged(spark, sf))
    return r.orderBy(F.col("rate").desc(), F.col("hospital")).limit(1).select(
        "hospital", r6("rate").alias("anomaly_rate_pct"))


def q_rx_score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Detection threshold = lowest score among flagged prescribers."""
    f = flagged(spark, sf)
    return f.agg(r6(F.min(F.when(F.col("is_anomaly") == 1, F.col("anomaly_score")))).alias("threshold"),
                 F.count_if(F.col("is_anomaly") == 1).alias("n_flagged"),
                 r6(F.max("anomaly_score")).alias("max_score"))


def q_rx_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """A14 + M15: score histogram per class (50 bins, density)."""
    h = metrics.histogram(materialize(flagged(spark, sf)), "anomaly_score", "is_anomaly", dims.SCORE_BINS, density=True)
    return h.select("class", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n",
                    r6("density").alias("density"))


def audit_list(df: DataFrame, n: int = dims.AUDIT_SIZE) -> DataFrame:
    """O2 + X11: flagged rows by score (desc, id asc), top n, nine columns."""
    top = (df.filter(F.col("is_anomaly") == 1)
           .orderBy(F.col("anomaly_score").desc(), F.col("prescriber_id")).limit(n))
    return top.withColumn("prescriber_code", prescriber_code("prescriber_id")).select(
        "prescriber_code", "specialty", "hospital", "anomaly_type", r6("anomaly_score").alias("anomaly_score"),
        r6("opioid_rate_pct").alias("opioid_rate_pct"), r6("avg_opioid_mme").alias("avg_opioid_mme"),
        r6("benzo_opioid_combo_pct").alias("benzo_opioid_combo_pct"),
        r6("patients_per_month").alias("patients_per_month"))


def q_rx_audit_list(spark: SparkSession, sf: str) -> DataFrame:
    """O2: top-20 audit list on the peer score."""
    return audit_list(flagged(spark, sf))


def q_rx_risk_quadrant(spark: SparkSession, sf: str) -> DataFrame:
    """P10 + J6: quadrant vs the global means of opioid rate and MME."""
    p = prescribers(spark, sf)
    means = p.agg(F.avg("opioid_rate_pct").alias("rate_mean"), F.avg("avg_opioid_mme").alias("mme_mean"))
    j = with_scalar(p, means, "_m")  # one-row aggregate as a scalar subquery
    above = ((F.col("opioid_rate_pct") > F.col("_m.rate_mean")).cast("int")
             + (F.col("avg_opioid_mme") > F.col("_m.mme_mean")).cast("int"))
    return j.select("prescriber_id", F.when(above == 2, "HIGH RISK").when(above == 1, "MONITOR")
                    .otherwise("NORMAL").alias("quadrant"))


def q_rx_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation matrix of the metrics (pairs a < b)."""
    c = ml.corr_matrix(prescriber_table(spark, sf), METRICS)
    return c.select("feature_a", "feature_b", r6("corr").alias("corr"))


def q_rx_pca(spark: SparkSession, sf: str) -> DataFrame:
    """First two principal coordinates and explained-variance ratios."""
    p = ml.pca2(prescriber_table(spark, sf), METRICS, "prescriber_id")
    return p.select("prescriber_id", *[r6(c).alias(c) for c in ("pca1", "pca2", "evr1", "evr2")])


_FORESTS: dict[tuple, dict] = {}


def forest_flagged(spark: SparkSession, sf: str, trees: int = dims.FOREST_TREES) -> DataFrame:
    """M12 -> M13 -> P8 on standardised metrics.

    A forest is shared by the queries of an application that see the same
    rows (their count and the sum of their hashes).
    """
    p = prescriber_table(spark, sf)
    z = ml.standardize(p, METRICS)
    zc = [f"{m}_z" for m in METRICS]
    # whole millionths of a standard deviation: values that differ in the last bit only are equal
    z = z.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5).cast("double") for c in zc})
    seen = p.agg(F.count(F.lit(1)), F.sum(F.xxhash64("prescriber_id", *METRICS).cast("decimal(38,0)"))).first()
    key = (spark.sparkContext.applicationId, trees, *seen)
    if key not in _FORESTS:
        _FORESTS.clear()  # only the last forest is kept
        _FORESTS[key] = fit_iforest(z, zc, "prescriber_id", trees=trees, psi=dims.FOREST_SAMPLES, seed=42)
    s = materialize(score_iforest(z, _FORESTS[key]))
    s = ml.flag_top_fraction(s, "anomaly_score", dims.CONTAMINATION)
    return s.withColumn("anomaly_type", classify_anomaly())


def q_iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation-forest score, flag and type of every prescriber."""
    f = forest_flagged(spark, sf)
    return f.select("prescriber_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "anomaly_type",
                    "true_anomaly")


def q_iforest_quality(spark: SparkSession, sf: str) -> DataFrame:
    """M12 + M14: forest detection precision / recall."""
    return metrics.detection_quality(forest_flagged(spark, sf), "is_anomaly", "true_anomaly")


def q_iforest_audit_list(spark: SparkSession, sf: str) -> DataFrame:
    """O2 on the forest score (the reference's audit CSV)."""
    return audit_list(forest_flagged(spark, sf))


QUERIES = {
    "prescriber_lookup": q_prescriber_lookup,
    "rx_specialty_profile": q_rx_specialty_profile,
    "clip_metrics": q_clip_metrics,
    "clip_stretched": q_clip_stretched,
    "standardize": q_standardize,
    "rx_peer_zscore": q_rx_peer_zscore,
    "flag_top_fraction": q_flag_top_fraction,
    "rx_anomaly_type": q_rx_anomaly_type,
    "rx_detection_quality": q_rx_detection_quality,
    "rx_breakdown": q_rx_breakdown,
    "rx_rate_hospital": q_rx_rate_hospital,
    "rx_top_hospital": q_rx_top_hospital,
    "rx_score_threshold": q_rx_score_threshold,
    "rx_score_histogram": q_rx_score_histogram,
    "rx_audit_list": q_rx_audit_list,
    "rx_risk_quadrant": q_rx_risk_quadrant,
    "rx_corr": q_rx_corr,
    "rx_pca": q_rx_pca,
    "iforest_scores": q_iforest_scores,
    "iforest_quality": q_iforest_quality,
    "iforest_audit_list": q_iforest_audit_list,
}
