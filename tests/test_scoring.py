"""Scores by tables against MLlib's own walk through the trees."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardwise.operators import attribution, ml, scoring

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module", params=[3, 6, 7])
def fitted(spark, request):
    rng = np.random.default_rng(request.param)
    made = [(i, float(rng.uniform(0, 10)), int(rng.integers(0, 4)), float(rng.normal()), 1.0) for i in range(600)]
    df = spark.createDataFrame(made, "k int, a double, b int, c double, d double")
    df = df.withColumn("y", (F.col("a") + 2 * F.col("b") + 3 * F.sin(F.col("a") * F.col("c")) > 8).cast("int"))
    return ml.fit_gbt(df, FEATURES, "y", rounds=5, depth=request.param), df


def by_key(df, *columns):
    return {r.k: tuple(r)[1:] for r in df.select("k", *columns).collect()}


def test_scores_are_mllibs(spark, fitted):
    """Also at the trees' own thresholds and at infinities; trees of more than 64 leaves are left to MLlib."""
    model, df = fitted
    ends = sorted({(n.feature, n.threshold) for n in attribution.node_table(model, spark).collect() if n.feature >= 0})
    odd = [(1000 + i, *[v if f == j else 0.5 for j in range(4)]) for i, (f, v) in enumerate([*ends, (0, np.inf), (2, -np.inf)])]
    x = df.select("k", *FEATURES).unionByName(spark.createDataFrame(odd, "k int, a double, b double, c double, d double"))
    want = by_key(model.transform(x), vector_to_array("probability")[1], F.col("prediction").cast("int"))
    got = by_key(ml.predict(model, x), "score", "predicted")
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-14) for k in want)
    plan = ml.predict(model, x)._jdf.queryExecution().optimizedPlan().toString()
    assert ("ArrowEvalPython" in plan) == (scoring.Leaves.of(model, spark) is not None)
    assert ml.predict(model, x).columns == [*x.columns, "score", "predicted"] and ml.predict(model, x.limit(0)).count() == 0


def test_rows_with_missing_features_are_refused(fitted):
    model, df = fitted
    for missing in (None, float("nan")):
        with pytest.raises(Exception):
            ml.predict(model, df.withColumn("c", F.when(F.col("k") != 3, F.col("c")).otherwise(F.lit(missing)))).collect()


def test_a_row_has_one_leaf_a_tree(spark, fitted, monkeypatch):
    model, _ = fitted
    own = scoring.Leaves.of(model, spark)
    if own is None:
        return
    rng = np.random.default_rng(1)
    x = [rng.uniform(-2, 11, 500) for _ in FEATURES]
    whole = own.margins(x)
    monkeypatch.setattr(scoring, "CHUNK", 7)
    assert (own.margins(x) == whole).all()
    for tables in own.allowed:
        left = np.bitwise_and.reduce([t.take(c) for t, c in zip(tables, own.layout.codes(x), strict=True)])
        assert all(int(v).bit_count() == 1 for v in left)
