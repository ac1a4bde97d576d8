"""Tree attributions against enumeration of all feature sets, and against the model's own scores."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardwise.operators import attribution, ml

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    rows = [(float(rng.uniform(0, 10)), int(rng.integers(0, 4)), float(rng.normal()), 1.0) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    df = df.withColumn("y", (F.col("a") + 2 * F.col("b") + 3 * F.sin(F.col("a") * F.col("c")) > 8).cast("int"))
    return ml.fit_gbt(df, FEATURES, "y", rounds=6, depth=4), df


def known_value(nodes, at, x, known):
    """A tree's output with the features outside ``known`` averaged by training rows."""
    n = nodes[at]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return known_value(nodes, n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
    return sum(nodes[c]["n"] / n["n"] * known_value(nodes, c, x, known) for c in (n["left"], n["right"]))


def enumerated(trees, weights, x):
    k = len(FEATURES)
    value = {s: sum(w * known_value(t, 0, x, s) for t, w in zip(trees, weights, strict=True))
             for size in range(k + 1) for s in combinations(range(k), size)}
    out = np.zeros(k)
    for j in range(k):
        for s in value:
            if j not in s:
                w = factorial(len(s)) * factorial(k - len(s) - 1) / factorial(k)
                out[j] += w * (value[tuple(sorted((*s, j)))] - value[s])
    return out, value[()]


def test_attributions_equal_enumeration(spark, fitted):
    model, df = fitted
    trees = {}
    for n in attribution.node_table(model, spark).collect():
        trees.setdefault(n["tree"], {})[n["id"]] = n
    trees = [trees[t] for t in sorted(trees)]
    for r in attribution.with_attribution(model, df.limit(25).withColumn("mean_raw", F.lit("clash")), FEATURES).collect():
        want, mean = enumerated(trees, model.stages[-1].treeWeights, [r[f] for f in FEATURES])
        assert np.allclose(r.attribution, want, atol=1e-9) and r.mean_raw == pytest.approx(mean)


def test_attributions_sum_to_the_raw_score(fitted, monkeypatch):
    model, df = fitted
    monkeypatch.setattr(attribution, "BLOCK", 3000)
    scored = attribution.with_attribution(model, df, FEATURES)
    raw = model.transform(scored).select("attribution", "mean_raw", vector_to_array("rawPrediction")[1].alias("raw")).collect()
    assert len(raw) == 400 and all(sum(r.attribution) + r.mean_raw == pytest.approx(r.raw, abs=1e-9) for r in raw)


def test_ranking(fitted):
    model, df = fitted
    ranked = attribution.attribution_ranking(model, df, FEATURES).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4] and ranked[-1].feature == "d" and ranked[-1].mean_abs_attribution == 0
    assert {r.feature for r in ranked[:2]} <= {"a", "b", "c"}
    assert attribution.attribution_ranking(model, df.limit(0), FEATURES).count() == 0


def test_values_are_binned_as_the_paths_are(spark, fitted, monkeypatch):
    """Thresholds themselves, infinities and missing values satisfy the intervals that comparing them one by one gives."""
    model, _ = fitted
    monkeypatch.setattr(attribution, "LEAVES", 7)
    own = attribution.attribution_model(model, spark, len(FEATURES))
    leaves = attribution.leaf_paths(attribution.node_table(model, spark).collect(), list(model.stages[-1].treeWeights))
    ends = sorted({v for _, p in leaves for low, high, _ in p.values() for v in (low, high)})
    x = np.array([[v, w, v, w] for v in [*ends, np.nan, 0.3] for w in (ends[3], np.nan, 1.0)])
    want = np.zeros(x.shape)
    for value, path in leaves:
        table = attribution._tables(np.array([value]), np.array([[s for _, _, s in path.values()]]))[0]
        for r, row in enumerate(x):
            mask = sum(1 << j for j, (f, (low, high, _)) in enumerate(path.items()) if low < row[f] <= high)
            for j, f in enumerate(path):
                want[r, f] += table[mask, j]
    assert len(own["cuts"][0]) > 3 and np.allclose(attribution.attributions(own, x), want, atol=1e-12)
