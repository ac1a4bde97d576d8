"""Percentiles by histogram passes and moments by blocks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardwise.operators import ml, moments, ordering

HARD = {
    "ties": np.repeat([1.0, 2.0, 3.0], [400, 3, 200]),
    "tails": np.concatenate([np.geomspace(1e-300, 1e300, 700), -np.geomspace(1e-9, 1e9, 300), [0.0, -0.0]]),
    "dense": 1.0 + np.arange(3000) * np.finfo(float).eps,
    "outlier": np.append(np.linspace(0.5, 0.5001, 2000), [1e18, -1e18]),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", HARD)
@pytest.mark.parametrize("rows", [5, 10_000])
def test_quantiles_of_hard_columns(spark, monkeypatch, name, rows):
    """Few rows a bin: the passes alone find the order statistics."""
    monkeypatch.setattr(ordering, "QUANTILE_ROWS", rows)
    monkeypatch.setattr(ordering, "QUANTILE_BINS", 16 if rows == 5 else 4096)
    x = HARD[name]
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).permutation(x)], "x double")
    df = df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    for q in (0.0, 0.5, 0.96, 1.0):
        assert ordering.exact_quantile(df, "x", q) == pytest.approx(np.quantile(x, q), rel=1e-12, abs=0)


def test_quantile_of_infinities_and_of_nothing(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert ordering.exact_quantile(df, "x", 1 / 3) == 1.0 and ordering.exact_quantile(df, "x", 2 / 3) == 2.0
    assert ordering.exact_quantile(df.limit(0), "x", 0.5) is None


def test_moments_merge_exactly(spark):
    """Far from zero and over many partitions, where sums of squares would cancel."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]]) + [1e8, -1e6, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(7)
    n, mean, m2 = moments.moments(df.unionByName(spark.createDataFrame([(None, 1.0, 2.0)], df.schema)), ["a", "b", "c"])
    assert n == 900 and np.allclose(mean, x.mean(axis=0), rtol=1e-14)
    assert np.allclose(m2, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)), rtol=1e-6)
    parts = [moments.block(p) for p in (x[:10], x[10:10], x[10:600], x[600:])]
    whole = parts[0]
    for p in parts[1:]:
        whole = moments.merged(whole, p)
    assert whole[0] == 900 and np.allclose(whole[2], m2, rtol=1e-6)


def test_correlations_beside_a_constant(spark):
    df = spark.range(50).select((F.col("id") * 1.0).alias("a"), F.lit(2.0).alias("b"), (-3.0 * F.col("id")).alias("c"))
    got = {(r.feature_a, r.feature_b): r.corr for r in ml.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): pytest.approx(-1.0), ("b", "c"): None}
    rows = ml.pca2(df.withColumn("k", F.col("a")), ["a", "b", "c"], "k").collect()
    assert len(rows) == 50 and rows[0].evr1 == pytest.approx(1.0)
    assert ml.corr_matrix(df.limit(0), ["a", "c"]).first()["corr"] is None
