"""Bindings from the driver's parquet tables to the domain tables.

``ed_visits``   one row per (visit day, site); a site is a supplier region.
``admissions``  one row per order, ``patient_id`` = order key.
``prescribers`` one row per customer, with injected anomalies by key.
``events``      the raw event stream used by the streaming jobs.

The formulas are fixed by FIXTURES.md (the same text runs in the DuckDB
oracle). Plans are written so that the fact tables (lineitem, orders) are
scanned once and reduced before any shuffle. Dimension sides carry no hint:
Spark broadcasts those that its size threshold allows, from file sizes or, at
run time, from the measured size of a finished stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.sources.dims import DAY_NAMES, DIAGNOSIS_RISK, LABEL_DIAGNOSIS_RISK

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as its files are now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nation_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> region name (the 'hospital' of every binding)."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("hospital"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "hospital")


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    ns = nation_sites(spark, sf_dir)
    return sup.join(ns, sup.s_nationkey == ns.n_nationkey).select("s_suppkey", "hospital")


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    cus = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    ns = nation_sites(spark, sf_dir)
    return cus.join(ns, cus.c_nationkey == ns.n_nationkey).select("c_custkey", "c_mktsegment", "hospital")


# --------------------------------------------------------------------------- ed_visits

def daily_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(visit_date, hospital, ed_visits): lineitems per ship day and supplier region.

    lineitem -> (broadcast or shuffle) join to supplier sites -> partial
    aggregation per (day, site) before the shuffle, so the exchange carries
    at most (#days x #sites) rows per task.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.to_date("l_shipdate").alias("visit_date"))
    sites = supplier_sites(spark, sf_dir)
    return (li.join(sites, li.l_suppkey == sites.s_suppkey)
            .groupBy("visit_date", "hospital")
            .agg(F.count(F.lit(1)).alias("ed_visits")))


def ed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily visits with the site's mean (``base``) and ``surge_threshold``.

    ``surge_threshold`` = floor(base * 1.25) (Python ``int`` truncation;
    values are positive). The per-site mean is a window over the small
    daily table: one group per site holds at most one row per calendar day.
    """
    from pyspark.sql import Window

    from wardwise.functions.rules import surge_threshold

    v = daily_visits(spark, sf_dir)
    w = Window.partitionBy("hospital")
    return (v.withColumn("base", F.avg("ed_visits").over(w))
            .withColumn("surge_threshold", surge_threshold("base")))


ACADEMIC_SITES = ["AMERICA", "EUROPE"]  # the fixture's site types; all others are community sites


def site_type(hospital: str | Column = "hospital") -> Column:
    return F.when(F.col(hospital).isin(ACADEMIC_SITES), "Academic").otherwise("Community")


def intake(admitted: DataFrame) -> DataFrame:
    """Admissions as a front desk might send them: every rule of the validation broken for some keys."""
    k = F.col("patient_id")
    wrong = {
        "age": (97, F.col("age") - 60), "los_days": (89, F.col("los_days") + 120), "charlson_index": (83, F.col("charlson_index") + 12),
        "functional_score": (79, -F.col("functional_score") - 1.0), "prior_admissions": (73, F.lit(None).cast("long")),
        "diagnosis": (71, F.lit("Unlisted")), "hospital": (67, F.lit("ELSEWHERE")),
    }
    return admitted.withColumns({c: F.when(k % n == 0, bad).otherwise(F.col(c)) for c, (n, bad) in wrong.items()})


def surge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a surge estimate, one per order: site, day name, month and holiday flag, some of them invalid."""
    k = F.col("patient_id")
    names = F.array(*[F.lit(d) for d in [*DAY_NAMES, "Someday"]])
    return admissions(spark, sf_dir).select(
        k.alias("request_id"), F.when(k % 41 == 0, "ELSEWHERE").otherwise(F.col("hospital")).alias("hospital"),
        F.element_at(names, (k % 8 + 1).cast("int")).alias("day_name"), (k % 14).alias("month"),
        (k % 10 == 0).alias("is_holiday"))


# --------------------------------------------------------------------------- admissions

# The fixture's diagnosis by key, in the order FIXTURES.md fixes.
FIXTURE_DIAGNOSES = ["Hip Fracture", "Stroke", "Dementia", "COPD", "CHF", "Pneumonia", "UTI", "Sepsis",
                     "Elective Surgery", "Other"]


def _bool(c) -> F.Column:
    return F.when(c, 1).otherwise(0)


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One admission per order (patient_id = o_orderkey) with ``alc_prob_raw``."""
    o = table(spark, sf_dir, "orders")
    return admissions_from(o, customer_sites(spark, sf_dir).select("c_custkey", "hospital"))


def admissions_from(orders: DataFrame, sites: DataFrame) -> DataFrame:
    """Admission attributes of an orders frame (batch or stream) joined to
    customer sites (``c_custkey``, ``hospital``). An order of an unknown
    customer is kept with a null site, which validation (S5) reports.

    All attributes are arithmetic on the keys (FIXTURES.md); ``noise`` is an
    input column of the label formula (D4).
    """
    o = orders.select("o_orderkey", "o_custkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    diag = F.element_at(F.array(*[F.lit(name) for name in FIXTURE_DIAGNOSES]), ((k * 3 + c) % 10 + 1).cast("int"))
    a = (o.join(sites, o.o_custkey == sites.c_custkey, "left")
         .select(k.alias("patient_id"), "hospital",
                 (F.lit(18) + (k * 13 + c * 7) % 82).alias("age"),
                 F.when(c % 2 == 0, "M").otherwise("F").alias("sex"),
                 diag.alias("diagnosis"),
                 _bool(k % 3 == 0).alias("lives_alone"),
                 _bool((k * 5 + c) % 7 < 3).alias("has_caregiver"),
                 _bool((k + c * 11) % 5 < 2).alias("cognitive_impairment"),
                 _bool((k * 17) % 11 < 6).alias("ambulatory_pre_admit"),
                 ((k * 19 + c) % 12).alias("charlson_index"),
                 (((k * 37) % 1001) / F.lit(10.0)).alias("functional_score"),
                 (F.lit(1) + (k * 23) % 29).alias("los_days"),
                 ((k * 29 + c) % 6).alias("prior_admissions"),
                 ((k * 41) % 5).alias("ed_visits_6m"),
                 (((k * 53 + c * 3) % 161 - 80) / F.lit(1000.0)).alias("noise")))
    return a.withColumn("alc_prob_raw", label_linear(a) + F.col("noise"))


def label_linear(df: DataFrame) -> F.Column:
    """Linear part of the label formula (three diagnosis weights), without noise."""
    from wardwise.functions.rules import linear_score

    return linear_score(LABEL_DIAGNOSIS_RISK, unknown=0.0)


# --------------------------------------------------------------------------- prescribers

ANOMALY_MOD, OPIOID_KEY, COMBO_KEY, VOLUME_KEY = 75, 7, 32, 57
RX_FEATURES = ["avg_rx_per_patient", "opioid_rate_pct", "avg_opioid_mme", "benzo_opioid_combo_pct",
               "polypharmacy_pct", "avg_days_supply", "refill_rate_pct", "high_dose_opioid_pct",
              "generic_prescribe_pct"]


def prescribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prescriber per customer with per-line prescribing metrics.

    lineitem is first reduced to one row per order (partial sums), which
    leaves the aggregate hash-partitioned on the order key, so the join to
    orders only shuffles the orders side. The per-customer aggregate then
    needs one more shuffle on the customer key; partial aggregation keeps a
    hot customer from landing whole in one task.
    """
    li = table(spark, sf_dir, "lineitem")
    per_order = (li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_discount") >= 0.095, 100.0).otherwise(0.0)).alias("s_opioid"),
        F.sum("l_quantity").alias("s_qty"),
        F.sum(F.when((F.col("l_tax") >= 0.075) & (F.col("l_discount") >= 0.075), 100.0)
              .otherwise(0.0)).alias("s_combo"),
        F.sum(F.when(F.col("l_quantity") >= 41.0, 100.0).otherwise(0.0)).alias("s_poly"),
        F.sum("l_tax").alias("s_tax"),
        F.sum(F.when(F.col("l_returnflag") == "A", 100.0).otherwise(0.0)).alias("s_refill"),
        F.sum(F.when((F.col("l_quantity") >= 45.0) & (F.col("l_discount") >= 0.05), 100.0)
              .otherwise(0.0)).alias("s_high"),
        F.sum(F.when(F.col("l_linestatus") == "O", 100.0).otherwise(0.0)).alias("s_generic")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    m = (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
         .groupBy(F.col("o_custkey").alias("prescriber_id"))
         .agg(F.sum("n").alias("n_rx"), F.count(F.lit(1)).alias("n_patients"),
              F.sum("s_opioid").alias("s_opioid"), F.sum("s_qty").alias("s_qty"),
              F.sum("s_combo").alias("s_combo"), F.sum("s_poly").alias("s_poly"),
              F.sum("s_tax").alias("s_tax"), F.sum("s_refill").alias("s_refill"),
              F.sum("s_high").alias("s_high"), F.sum("s_generic").alias("s_generic")))
    cs = customer_sites(spark, sf_dir)
    key = F.col("prescriber_id") % ANOMALY_MOD

    def boost(is_key, factor):
        return F.when(is_key, F.lit(factor)).otherwise(F.lit(1.0))

    n = F.col("n_rx")
    return (m.join(cs, m.prescriber_id == cs.c_custkey)
            .select("prescriber_id", F.col("c_mktsegment").alias("specialty"), "hospital",
                    "n_rx", "n_patients",
                    (n * 1.0 / F.col("n_patients") * boost(key == VOLUME_KEY, 2.2)).alias("avg_rx_per_patient"),
                    (F.col("s_opioid") / n * boost(key == OPIOID_KEY, 3.2)).alias("opioid_rate_pct"),
                    (F.col("s_qty") / n * 1.8 * boost(key == OPIOID_KEY, 2.8)).alias("avg_opioid_mme"),
                    (F.col("s_combo") / n * boost(key == COMBO_KEY, 5.5)).alias("benzo_opioid_combo_pct"),
                    (F.col("s_poly") / n * boost(key == COMBO_KEY, 2.2)).alias("polypharmacy_pct"),
                    (F.col("s_tax") / n * 350.0).alias("avg_days_supply"),
                    (F.col("s_refill") / n).alias("refill_rate_pct"),
                    (F.col("s_high") / n * boost(key == OPIOID_KEY, 2.5)).alias("high_dose_opioid_pct"),
                    (F.col("s_generic") / n).alias("generic_prescribe_pct"),
                    (F.col("n_patients") * 12.0 * boost(key == VOLUME_KEY, 3.2)).alias("patients_per_month"),
                    F.when(key.isin(OPIOID_KEY, COMBO_KEY, VOLUME_KEY), 1).otherwise(0).alias("true_anomaly")))


# --------------------------------------------------------------------------- events

def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream rows; ``hospital`` = event_type, one visit per event."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("hospital"), "value")


def admission_rules(spark: SparkSession, sf: str) -> dict:
    """S5 rules of an admission: inclusive ranges, listed diagnoses, and the known sites."""
    sites = table(spark, sf, "region").select(F.col("r_name").alias("hospital"))
    return {
        "age": (18, 110), "los_days": (1, 120), "charlson_index": (0, 11), "functional_score": (0, 100),
        "prior_admissions": (0, 10), "diagnosis": list(DIAGNOSIS_RISK), "hospital": sites,
    }
