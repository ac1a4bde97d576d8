"""ALC bed-block queries: validation, scores, label, rates, beds blocked, model, metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions.columns import band, pct_text, r6
from wardwise.functions.rules import (alc_factors, alc_label, alc_report, alc_risk_score, alc_tier, top_factors,
                                      weighted_terms)
from wardwise.operators import metrics, ml
from wardwise.operators.attribution import attribution_ranking
from wardwise.operators.joins import scalar
from wardwise.operators.ordering import sample_n
from wardwise.sources import dims
from wardwise.sources.bindings import admission_rules, admissions, intake
from wardwise.sources.io import materialize
from wardwise.sources.validate import validate

ALC_FEATURES = ["age", "sex_enc", "diagnosis_enc", "hospital_enc", "lives_alone", "has_caregiver",
                "prior_admissions", "ed_visits_6m", "ambulatory_pre_admit", "cognitive_impairment",
                "functional_score", "charlson_index", "los_days"]


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Admissions with the D4 label."""
    return alc_label(admissions(spark, sf))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Admissions with the D4 label and the D1 score; predicted = score > 0.5."""
    s = alc_risk_score(labelled(spark, sf))
    return s.withColumn("predicted", (F.col("alc_risk_score") > dims.PREDICT_CUTOFF).cast("int"))


def q_validate_admissions(spark: SparkSession, sf: str) -> DataFrame:
    """Violations per rule and the number of valid rows."""
    checked = validate(intake(admissions(spark, sf)), admission_rules(spark, sf))
    per_rule = checked.select(F.explode("violations").alias("rule")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_rows"))
    valid = checked.agg(F.count_if(F.size("violations") == 0).alias("n_rows")).select(
        F.lit("valid").alias("rule"), "n_rows")
    return per_rule.unionByName(valid)


def q_profile_admissions(spark: SparkSession, sf: str) -> DataFrame:
    """A4: admissions profile."""
    a = labelled(spark, sf)
    return a.agg(F.count(F.lit(1)).alias("n_patients"), F.sum("alc_flag").cast("bigint").alias("n_alc"),
                 r6(F.avg("alc_flag") * 100.0).alias("alc_rate_pct"), r6(F.avg("age")).alias("avg_age"),
                 r6(F.avg("los_days")).alias("avg_los"), F.countDistinct("hospital").alias("n_sites"))


def q_alc_label(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped label probability and flag per patient."""
    return labelled(spark, sf).select("patient_id", r6("alc_prob").alias("alc_prob"), "alc_flag")


def q_alc_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """D1 (+ X6, X9): form score per patient, rounded and as percent text."""
    s = alc_risk_score(admissions(spark, sf))
    return s.select("patient_id", r6("alc_risk_raw").alias("alc_risk_raw"),
                    r6(F.bround("alc_risk_score", 4)).alias("alc_risk_score"),
                    pct_text("alc_risk_pct").alias("alc_risk_pct"))


def q_alc_tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Patients per tier (with colour and recommendation)."""
    s = alc_tier(alc_risk_score(admissions(spark, sf)))
    return s.groupBy("risk_level", "risk_colour", "recommendation").agg(F.count(F.lit(1)).alias("n_patients"))


def q_alc_top_factors(spark: SparkSession, sf: str) -> DataFrame:
    """O4 + D3: top-5 factors per patient, exploded with their rank."""
    s = top_factors(alc_factors(admissions(spark, sf)))
    # inline(transform(...)) rather than posexplode: under whole-stage codegen an
    # explode re-evaluated the sorted array once per emitted element (4x slower)
    ranked = F.transform("top_factors", lambda f, i: F.struct(
        (i + 1).alias("rank"), f["factor"].alias("factor"), r6(f["contribution"]).alias("contribution")))
    return s.select("patient_id", F.inline(ranked))


def q_alc_report(spark: SparkSession, sf: str) -> DataFrame:
    """Nested scoring response per patient."""
    return alc_report(admissions(spark, sf))


def q_alc_report_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the nested response, one column each, with the first of the top factors."""
    r = alc_report(admissions(spark, sf))
    first = F.element_at("top_risk_factors", 1)
    return r.select("patient_id", F.col("patient_summary.age").alias("age"), F.col("patient_summary.diagnosis").alias("diagnosis"),
                    F.col("patient_summary.lives_alone").alias("lives_alone"), r6("alc_risk_score").alias("alc_risk_score"),
                    "alc_risk_pct", "risk_level", "recommendation", first["factor"].alias("first_factor"),
                    r6(first["contribution"]).alias("first_contribution"), F.size("top_risk_factors").alias("n_factors"))


def q_alc_rate_age(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + P11: ALC rate (%) per ten years of age, living, care and cognitive state: bands of all three colours."""
    a = labelled(spark, sf).withColumn("age_from", (F.floor(F.col("age") / 10) * 10).cast("int"))
    keys = ["age_from", "lives_alone", "has_caregiver", "cognitive_impairment"]
    g = a.groupBy(*keys).agg((F.avg("alc_flag") * 100.0).alias("rate"))
    return g.select(*keys, r6("rate").alias("alc_rate_pct"),
                    band("rate", *dims.BANDS["alc_rate_hospital"]).alias("band")).orderBy(*keys)


def q_split_members(spark: SparkSession, sf: str) -> DataFrame:
    """M3: the side of every admission."""
    s = ml.stratified_split(labelled(spark, sf), "alc_flag", ["patient_id"], dims.TEST_FRACTION, 42)
    return s.select("patient_id", "alc_flag", "is_test")


def q_alc_model_census(spark: SparkSession, sf: str) -> DataFrame:
    """A7 + O6: beds blocked by the model's predictions in the 400-patient census."""
    model, split = fitted_model(spark, sf)
    return beds_blocked(ml.predict(model, sample_n(split, dims.CENSUS_SIZE, ["patient_id"], seed=42)), "predicted")


def q_alc_rate_hospital(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + P11: ALC rate (%) per site with colour band (> 20, > 15)."""
    a = labelled(spark, sf)
    g = a.groupBy("hospital").agg((F.avg("alc_flag") * 100.0).alias("rate"))
    return g.select("hospital", r6("rate").alias("alc_rate_pct"),
                    band("rate", *dims.BANDS["alc_rate_hospital"]).alias("band")).orderBy("alc_rate_pct", "hospital")


def q_alc_rate_diagnosis(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + P11: ALC rate (%) per diagnosis with colour band (> 25, > 15)."""
    a = labelled(spark, sf)
    g = a.groupBy("diagnosis").agg((F.avg("alc_flag") * 100.0).alias("rate"))
    return g.select("diagnosis", r6("rate").alias("alc_rate_pct"),
                    band("rate", *dims.BANDS["alc_rate_diagnosis"]).alias("band")).orderBy("alc_rate_pct", "diagnosis")


def beds_blocked(df: DataFrame, flag: str) -> DataFrame:
    """Total and flagged patients per site, rate rounded half-even to 1 place."""
    g = df.groupBy("hospital").agg(F.count(F.lit(1)).alias("total_patients"),
                                   F.sum(flag).cast("bigint").alias("alc_patients"))
    return (g.withColumn("alc_rate_pct", F.bround(F.col("alc_patients") / F.col("total_patients") * 100.0, 1))
            .withColumn("band", band("alc_patients", *dims.BANDS["beds_blocked"]))
            .orderBy(F.col("alc_patients").desc(), "hospital"))


def q_beds_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """A7 on the D4 label over all admissions."""
    return beds_blocked(labelled(spark, sf), "alc_flag")


def q_census_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O6 + A7: beds blocked in an exact 400-patient seeded sample (the 'current census')."""
    s = sample_n(labelled(spark, sf), dims.CENSUS_SIZE, ["patient_id"], seed=42)
    return beds_blocked(s, "alc_flag")


def q_age_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Age histogram per label class, 30 bins over each class's own range."""
    h = metrics.histogram(labelled(spark, sf), "age", "alc_flag", dims.AGE_BINS)
    return h.select("class", "bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


def q_alc_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    """Class-imbalance weight negatives / positives."""
    w = ml.imbalance_weight(labelled(spark, sf), "alc_flag")
    return w.select(r6("scale_pos_weight").alias("scale_pos_weight"), "n_neg", "n_pos")


def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    """M1: alphabetical codes of sex, diagnosis and site per patient."""
    e = ml.label_encode(admissions(spark, sf), ["sex", "diagnosis", "hospital"])
    return e.select("patient_id", "sex_enc", "diagnosis_enc", "hospital_enc")


def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    """M3: exact 80/20 split per label class; counts per (class, side)."""
    s = ml.stratified_split(labelled(spark, sf), "alc_flag", ["patient_id"], dims.TEST_FRACTION, 42)
    return s.groupBy("alc_flag", "is_test").agg(F.count(F.lit(1)).alias("n"))


_MODELS: dict[tuple, PipelineModel] = {}


def model_input(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M3: encoded admissions with the hold-out flag.

    They are written once: the split, the key of the fit, the class weight, the fit and the queries on it read them again.
    """
    a = ml.label_encode(labelled(spark, sf), ["sex", "diagnosis", "hospital"])
    a = materialize(a.select("patient_id", "hospital", "alc_flag", *ALC_FEATURES))
    return ml.stratified_split(a, "alc_flag", ["patient_id"], dims.TEST_FRACTION, 42)


def fitted_model(spark: SparkSession, sf: str, rounds: int = dims.GBT_ROUNDS) -> tuple[PipelineModel, DataFrame]:
    """M1-M4: encode, split, fit all boosting rounds.

    A fit is shared by the queries of an application that see the same
    training rows: it is known by their count and the sum of their hashes,
    so other rows under the same path are fitted anew.
    """
    split = model_input(spark, sf)
    seen = split.agg(F.count(F.lit(1)), F.sum(F.xxhash64("patient_id", "alc_flag", "is_test", *ALC_FEATURES).cast("decimal(38,0)")))
    key = (spark.sparkContext.applicationId, rounds, *seen.first())
    if key not in _MODELS:
        _MODELS.clear()  # only the last fit is kept
        _MODELS[key] = fit_model(split, rounds)
    return _MODELS[key], split


def fit_model(split: DataFrame, rounds: int = dims.GBT_ROUNDS) -> PipelineModel:
    """M4 on the training side of a split, classes weighted by their imbalance."""
    w = ml.imbalance_weight(split, "alc_flag").first()["scale_pos_weight"] or 1.0
    train = split.filter(~F.col("is_test")).withColumn(
        "w", F.when(F.col("alc_flag") == 1, F.lit(float(w))).otherwise(F.lit(1.0)))
    return ml.fit_gbt(train, ALC_FEATURES, "alc_flag", rounds=rounds, weight="w")


def q_alc_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """M4 + M5: boosted-tree probability and class for every admission."""
    model, split = fitted_model(spark, sf)
    p = ml.predict(model, split)
    return p.select("patient_id", "hospital", "is_test", "alc_flag", F.col("score").alias("alc_model_score"),
                    "predicted")


def q_alc_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """M4 acceptance: hold-out ROC-AUC and average precision of the model."""
    model, split = fitted_model(spark, sf)
    test = ml.predict(model, split.filter(F.col("is_test")))
    auc = metrics.roc_auc(test, "alc_flag", "score")
    ap = metrics.average_precision(test, "alc_flag", "score")
    return auc.select(r6("auc").alias("auc"), r6(scalar(ap)["average_precision"]).alias("average_precision"),
                      "n_pos", "n_neg")


def q_alc_model_beds(spark: SparkSession, sf: str) -> DataFrame:
    """A7 on model predictions of every admission (the reference's beds view)."""
    model, split = fitted_model(spark, sf)
    return beds_blocked(ml.predict(model, split), "predicted")


def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """M6: ROC-AUC of the D1 score against the D4 label (tie-averaged ranks)."""
    r = metrics.roc_auc(scored(spark, sf), "alc_flag", "alc_risk_score")
    return r.select(r6("auc").alias("auc"), "n_pos", "n_neg")


def q_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """M7: step-wise average precision of the D1 score."""
    r = metrics.average_precision(scored(spark, sf), "alc_flag", "alc_risk_score")
    return r.select(r6("average_precision").alias("average_precision"))


def q_roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    """M9: ROC points of the D1 score at every distinct threshold."""
    r = metrics.roc_curve(scored(spark, sf), "alc_flag", "alc_risk_score")
    return r.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def q_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """M8: confusion counts of D1 score > 0.5 against the D4 label."""
    return metrics.confusion(scored(spark, sf), "alc_flag", "predicted")


def q_class_report(spark: SparkSession, sf: str) -> DataFrame:
    """Precision / recall / F1 / support per class."""
    r = metrics.class_report(scored(spark, sf), "alc_flag", "predicted")
    return r.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                    r6("f1").alias("f1"), "support")


def linear_terms() -> dict:
    return dict(weighted_terms(dims.ALC_TERMS, dims.DIAGNOSIS_RISK))


def q_linear_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """M10a + O5: mean |w (x - mean x)| per term of the D1 rule, ranked."""
    r = ml.linear_attribution(admissions(spark, sf), linear_terms())
    return r.select("feature", r6("mean_abs_attribution").alias("mean_abs_attribution"), "rank")


def q_permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Hold-out AUC drop of the boosted model per permuted feature."""
    model, split = fitted_model(spark, sf)
    test = split.filter(F.col("is_test"))
    r = ml.permutation_importance(model, test, ALC_FEATURES, "alc_flag", "patient_id")
    return r.select("feature", r6("base_auc").alias("base_auc"), r6("permuted_auc").alias("permuted_auc"),
                    r6("importance").alias("importance"))


def q_alc_model_attribution(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the boosted model by their mean absolute attribution on the hold-out."""
    model, split = fitted_model(spark, sf)
    ranked = attribution_ranking(model, split.filter(F.col("is_test")), ALC_FEATURES)
    return ranked.select("feature", r6("mean_abs_attribution").alias("mean_abs_attribution"),
                         r6("mean_attribution").alias("mean_attribution"), "rank")


QUERIES = {
    "validate_admissions": q_validate_admissions,
    "profile_admissions": q_profile_admissions,
    "alc_label": q_alc_label,
    "alc_risk_score": q_alc_risk_score,
    "alc_tier_counts": q_alc_tier_counts,
    "alc_top_factors": q_alc_top_factors,
    "alc_report": q_alc_report,
    "alc_report_fields": q_alc_report_fields,
    "alc_rate_age": q_alc_rate_age,
    "split_members": q_split_members,
    "alc_model_census": q_alc_model_census,
    "alc_rate_hospital": q_alc_rate_hospital,
    "alc_rate_diagnosis": q_alc_rate_diagnosis,
    "beds_blocked": q_beds_blocked,
    "census_sample": q_census_sample,
    "age_histogram": q_age_histogram,
    "alc_imbalance": q_alc_imbalance,
    "label_encode": q_label_encode,
    "stratified_split": q_stratified_split,
    "alc_model_scores": q_alc_model_scores,
    "alc_model_metrics": q_alc_model_metrics,
    "alc_model_beds": q_alc_model_beds,
    "roc_auc": q_roc_auc,
    "average_precision": q_average_precision,
    "roc_curve": q_roc_curve,
    "confusion_matrix": q_confusion_matrix,
    "class_report": q_class_report,
    "linear_attribution": q_linear_attribution,
    "permutation_importance": q_permutation_importance,
    "alc_model_attribution": q_alc_model_attribution,
}
