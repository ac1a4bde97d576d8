"""Evaluation metrics and histograms.

All metrics are exact and distributed: scores are first reduced to one row
per distinct value with positive/negative counts, and the global running
sums come from ``ordered_cumsum`` (no single-partition window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.operators.joins import bounded_broadcast, scalar, with_scalar
from wardwise.operators.ordering import ordered_cumsum


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """(by..., score, pos, neg) per distinct score of each group."""
    y = F.col(label).cast("long")
    return (df.filter(F.col(score).isNotNull())
            .groupBy(*(by or []), F.col(score).cast("double").alias("score"))
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """M6: ROC-AUC with average ranks on ties (Mann-Whitney U / (P N)), one row or one per ``by`` group."""
    c = ordered_cumsum(score_counts(df, label, score, by), "score", ["neg"], by=by)
    below = F.col("cum_neg") - F.col("neg")
    return c.groupBy(*(by or [])).agg((F.sum(F.col("pos") * (below + F.col("neg") * 0.5)) / (F.sum("pos") * F.sum("neg"))).alias("auc"),
                 F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _desc_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    c = ordered_cumsum(score_counts(df, label, score), "score", ["pos", "neg"], descending=True)
    return c.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """M7: step-wise AP = sum over thresholds of (R_k - R_k-1) x P_k."""
    c = _desc_counts(df, label, score)
    p_all = scalar(c.agg(F.sum("pos").alias("P")))["P"]
    return c.agg(F.sum(F.col("pos") / p_all * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("average_precision"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """M9: (threshold, fpr, tpr) at every distinct score, highest first."""
    c = _desc_counts(df, label, score)
    tot = with_scalar(c, c.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")), "_tot")
    return tot.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("_tot.N")).alias("fpr"),
                      (F.col("tp") / F.col("_tot.P")).alias("tpr"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """M8: counts per (actual, predicted)."""
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(pred).cast("int").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support for classes 0 and 1."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    per_class = [F.struct(F.lit(cls).alias("class"), F.count_if((y == cls) & (p == cls)).alias("tp"),
                          F.count_if(p == cls).alias("pp"), F.count_if(y == cls).alias("support")) for cls in (0, 1)]
    r = df.agg(F.array(*per_class).alias("c")).select(F.inline("c"))  # one scan, both classes
    prec = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return (r.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(0.0))
            .select("class", "precision", "recall", "f1", "support"))


def detection_quality(df: DataFrame, flag: str, truth: str) -> DataFrame:
    """Precision / recall of flags against the truth; 0 on empty denominators."""
    agg = df.agg(F.count_if(F.col(flag) == 1).alias("detected"), F.count_if(F.col(truth) == 1).alias("true_anomalies"),
                 F.count_if((F.col(flag) == 1) & (F.col(truth) == 1)).alias("true_positives"))
    return agg.select("detected", "true_anomalies", "true_positives",
                      F.when(F.col("detected") > 0, F.col("true_positives") / F.col("detected")).otherwise(0.0)
                      .alias("precision"),
                      F.when(F.col("true_anomalies") > 0, F.col("true_positives") / F.col("true_anomalies"))
                      .otherwise(0.0).alias("recall"))


def histogram(df: DataFrame, value: str, by: str | None, bins: int, density: bool = False) -> DataFrame:
    """Fixed-width bins over each class's own [min, max]; last bin closed.

    Output: (class, bin, lo, hi, n[, density]).
    """
    key = F.col(by) if by else F.lit(0)
    d = df.select(key.alias("class"), F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull())
    rng = d.groupBy("class").agg(F.min("x").alias("_min"), F.max("x").alias("_max"), F.count(F.lit(1)).alias("_n"))
    # one row per class, joined back on a low-cardinality key: a shuffle join would
    # send each class to one task, so the ranges are broadcast (size checked)
    rng = bounded_broadcast(rng)
    span = F.col("_max") - F.col("_min")
    idx = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("_min")) * bins / span), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    counts = d.join(rng, "class").groupBy("class", idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = counts.join(rng, "class").select(
        "class", "bin",
        (F.col("_min") + span * F.col("bin") / bins).alias("lo"),
        (F.col("_min") + span * (F.col("bin") + 1) / bins).alias("hi"),
        "n", "_n", span.alias("_span"))
    if density:
        out = out.withColumn("density", F.when(F.col("_span") > 0,
                                                F.col("n") / (F.col("_n") * F.col("_span") / bins)))
    return out.drop("_n", "_span")
