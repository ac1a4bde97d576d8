"""Property tests of the distributed operators against brute force on small inputs."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardwise.operators import metrics, ml
from wardwise.operators.iforest import fit_iforest, score_iforest
from wardwise.operators.joins import bounded_broadcast, with_holiday, with_holiday_window
from wardwise.operators.ordering import exact_quantile, ordered_cumsum, sample_n
from wardwise.sources import dims
from wardwise.sources.io import read_csv, write_csv
from wardwise.sources.validate import split_valid


@pytest.mark.parametrize("seed", [1, 2])
def test_ordered_cumsum_matches_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"v": rng.permutation(500).astype(float), "w": rng.integers(0, 10, 500)})
    out = ordered_cumsum(spark.createDataFrame(pdf).repartition(5), "v", ["w"], buckets=16).toPandas()
    exp = pdf.sort_values("v").assign(cum_w=lambda d: d["w"].cumsum())
    got = out.sort_values("v")
    assert got["cum_w"].tolist() == exp["cum_w"].tolist()
    desc = ordered_cumsum(spark.createDataFrame(pdf), "v", ["w"], descending=True).toPandas().sort_values("v")
    assert desc["cum_w"].tolist() == pdf.sort_values("v", ascending=False)["w"].cumsum()[::-1].tolist()


@pytest.mark.parametrize("q", [0.0, 0.5, 0.96, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    x = np.random.default_rng(3).normal(size=301).round(2)  # ties included
    got = exact_quantile(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", q)
    assert got == pytest.approx(float(np.percentile(x, q * 100)), abs=1e-12)


def _auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    ap, tp, fp, prev_r, p = 0.0, 0, 0, 0.0, y.sum()
    i = 0
    while i < len(ss):
        j = i
        while j < len(ss) and ss[j] == ss[i]:
            tp += ys[j]
            fp += 1 - ys[j]
            j += 1
        r = tp / p
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r, i = r, j
    return ap


def test_auc_and_ap_match_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + 0.5 * y * rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = metrics.roc_auc(df, "y", "s").first()["auc"]
    ap = metrics.average_precision(df, "y", "s").first()["average_precision"]
    assert auc == pytest.approx(_auc_brute(y, s), abs=1e-12)
    assert ap == pytest.approx(_ap_brute(y, s), abs=1e-12)
    curve = metrics.roc_curve(df, "y", "s").orderBy(F.col("threshold").desc()).collect()
    assert curve[-1]["fpr"] == 1.0 and curve[-1]["tpr"] == 1.0


def test_stratified_split_is_exact(spark):
    df = spark.range(1, 1001).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    s = ml.stratified_split(df, "y", ["id"], 0.2, 42)
    counts = {(r.y, r.is_test): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    n1 = 1000 // 7
    assert counts[(1, True)] == math.ceil(0.2 * n1)
    assert counts[(0, True)] == math.ceil(0.2 * (1000 - n1))
    again = ml.stratified_split(df.repartition(3), "y", ["id"], 0.2, 42).filter("is_test")
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in s.filter("is_test").collect())


def test_sample_n_exact_and_deterministic(spark):
    df = spark.range(5000)
    a = sorted(r.id for r in sample_n(df, 400, ["id"], 42).collect())
    b = sorted(r.id for r in sample_n(df.repartition(7), 400, ["id"], 42).collect())
    assert len(a) == 400 and a == b


def test_histogram_counts_sum_to_n(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(1, 200)], "c int, x double")
    h = metrics.histogram(df, "x", "c", 30, density=True).toPandas()
    assert h.groupby("class")["n"].sum().to_dict() == {0: 99, 1: 100}
    assert h["bin"].max() == 29
    for _, g in h.groupby("class"):
        assert (g["density"] * (g["hi"] - g["lo"])).sum() == pytest.approx(1.0)


def test_iforest_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    x[:6] += 8.0
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=np.arange(600))
    df = spark.createDataFrame(pdf)
    model = fit_iforest(df, ["a", "b", "c"], "k", trees=50, psi=64, seed=1)
    s1 = score_iforest(df, model).toPandas().set_index("k")["anomaly_score"]
    assert ((s1 > 0) & (s1 < 1)).all()
    assert s1.loc[:5].min() > s1.loc[6:].quantile(0.95)
    m2 = fit_iforest(df.repartition(4), ["a", "b", "c"], "k", trees=50, psi=64, seed=1)
    s2 = score_iforest(df, m2).toPandas().set_index("k")["anomaly_score"]
    assert np.allclose(s1.sort_index(), s2.sort_index())


def test_validation_routes_bad_rows(spark):
    df = spark.createDataFrame([(30, "Stroke"), (10, "Stroke"), (50, "Flu"), (None, "Other")], "age int, diagnosis string")
    ok, bad = split_valid(df, {"age": (18, 110), "diagnosis": list(dims.DIAGNOSIS_RISK)})
    assert ok.count() == 1
    reasons = {tuple(r.violations) for r in bad.collect()}
    assert reasons == {("age",), ("diagnosis",)} | {("age",)}


def test_holiday_joins(spark):
    hol = dims.holidays(spark, 2023, 2024)
    days = spark.createDataFrame([("2023-12-24",), ("2023-12-25",), ("2023-12-27",), ("2024-03-03",)], "d string") \
        .select(F.to_date("d").alias("d"))
    flags = {str(r.d): r.is_holiday for r in with_holiday(days, hol, "d").collect()}
    assert flags == {"2023-12-24": 0, "2023-12-25": 1, "2023-12-27": 0, "2024-03-03": 0}
    win = {str(r.d): (r.hol_m1, r.hol_0, r.hol_p1) for r in with_holiday_window(days, hol, "d").collect()}
    assert win["2023-12-24"] == (1, 0, 0) and win["2023-12-25"] == (1, 1, 0) and win["2023-12-27"] == (0, 0, 1)
    assert win["2024-03-03"] == (0, 0, 0)


def test_bounded_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in str(bounded_broadcast(small, 100).join(spark.range(100), "id")._jdf.queryExecution()
                              .optimizedPlan()).lower()
    assert bounded_broadcast(spark.range(1000), 100).count() == 1000


def test_csv_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="wardwise-csv-"), "t")
    df = spark.createDataFrame([("a", 1, 2.5), ("b", 2, None)], "k string, n int, v double")
    write_csv(df, out)
    back = read_csv(spark, out, "k string, n int, v double")
    assert sorted(back.collect()) == sorted(df.collect())
    assert read_csv(spark, out + "-missing", "k string") is None


def test_result_exports_round_trip(spark):
    from tests.conftest import SF_SMALL
    from wardwise.plans import reports

    base = tempfile.mkdtemp(prefix="wardwise-reports-")
    summary = reports.export_surge_summary(spark, SF_SMALL, os.path.join(base, "summary"))
    back = spark.read.option("header", True).csv(os.path.join(base, "summary"))
    assert back.columns == list(reports.SUMMARY_HEADERS.values())
    assert back.count() == summary.count() == 5
    audit = reports.export_audit_list(spark, SF_SMALL, os.path.join(base, "audit"))
    again = reports.read_audit_list(spark, os.path.join(base, "audit"))
    assert sorted(r.prescriber_id for r in again.collect()) == sorted(r.prescriber_id for r in audit.collect())
    assert reports.read_audit_list(spark, os.path.join(base, "missing")) is None


def test_lookup_and_unknown_keys(spark):
    from wardwise.operators.joins import lookup, unknown_keys

    df = spark.createDataFrame([(1, "Stroke"), (2, "Flu"), (3, "UTI")], "id int, diagnosis string")
    dim = dims.diagnosis_dim(spark)
    got = {r.id: r.diag_weight for r in lookup(df, dim, "diagnosis").collect()}
    assert got == {1: 0.20, 3: 0.02}
    assert [r.id for r in unknown_keys(df, dim, "diagnosis").collect()] == [2]
