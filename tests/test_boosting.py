"""Trees on binned rows against MLlib's own: with every row and feature in every tree there is nothing left to draw."""

import glob
import os

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardwise.operators import attribution, boosting, ml

FEATURES = ["a", "b", "c", "d", "e", "z"]
WHOLE = {"subsample": 1.0, "col_frac": "all"}


@pytest.fixture(scope="module")
def rows(spark):
    """More than 32 values, a constant, many zeros, and weights."""
    rng = np.random.default_rng(5)
    made = [(i, float(rng.uniform(0, 10)), int(rng.integers(0, 4)), float(rng.normal()), 1.0, int(rng.integers(0, 82)),
             float(rng.choice([0, 0, 0, 1.5, 2.5])), float(rng.uniform())) for i in range(3000)]
    df = spark.createDataFrame(made, "k int, a double, b int, c double, d double, e int, z double, u double")
    y = F.col("a") + 2 * F.col("b") + 3 * F.sin(F.col("a") * F.col("c")) + F.col("e") / 20 + F.col("u") > 10
    return df.withColumn("y", y.cast("int")).withColumn("w", F.when(F.col("y") == 1, 0.37).otherwise(1.0)).persist()


def fitted(monkeypatch, most, *args, **how):
    monkeypatch.setattr(ml, "MLLIB_ROWS", most)
    return ml.fit_gbt(*args, **how)


def scores(model, df):
    p = model.transform(df).select("k", vector_to_array("probability")[1].alias("p")).orderBy("k").collect()
    return np.array([r.p for r in p])


def table(spark, model):
    return sorted(tuple(r) for r in attribution.node_table(model, spark).collect())


@pytest.mark.parametrize("features, rounds, depth, weight, cells", [
    (FEATURES, 4, 5, "w", 4096), (FEATURES, 3, 3, None, 40), (["b", "d"], 3, 5, "w", 4096), (["d"], 2, 2, None, 4096)])
def test_trees_are_mllibs(spark, rows, monkeypatch, features, rounds, depth, weight, cells):
    """Bounds, splits, leaves, counts and weights are the same, also of trees that end early or have no split at all."""
    monkeypatch.setattr(boosting, "CELLS", cells)
    monkeypatch.setattr(boosting, "CHUNK", 300)
    how = dict(rounds=rounds, depth=depth, weight=weight, **WHOLE)
    want = fitted(monkeypatch, 10_000, rows, features, "y", **how)
    got = fitted(monkeypatch, 10, rows, features, "y", **how)
    a, b = table(spark, want), table(spark, got)
    assert [(r[:2], *r[3:]) for r in a] == [(r[:2], *r[3:]) for r in b] and [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-12)
    assert got.stages[-1].treeWeights == want.stages[-1].treeWeights
    assert scores(got, rows) == pytest.approx(scores(want, rows), abs=1e-12)
    own = got.stages[-1]
    assert own.getMaxIter() == rounds and own.getLabelCol() == "y" and own.numFeatures == len(features)


def test_drawn_rows_and_features_learn_as_well(spark, rows, monkeypatch):
    """Rows are drawn per tree and features per node; the model separates the classes as MLlib's does, and is the same each time."""
    got = [fitted(monkeypatch, most, rows, FEATURES, "y", rounds=12, weight="w") for most in (10, 10, 10_000)]
    y = np.array([r.y for r in rows.orderBy("k").collect()])
    ranks = [scores(m, rows).argsort().argsort() for m in got]
    auc = [(r[y == 1].sum() - (n := (y == 1).sum()) * (n - 1) / 2) / (n * (y == 0).sum()) for r in ranks]
    assert auc[0] == auc[1] and abs(auc[0] - auc[2]) < 0.01
    roots = [r for r in attribution.node_table(got[0], spark).collect() if r.id == 0]
    assert len({r.n for r in roots}) > 3 and all(0.7 * 3000 < r.n < 0.9 * 3000 for r in roots)


def test_many_rows_stay_on_the_executors(rows, monkeypatch):
    """Beyond MLLIB_ROWS no object of a row is made for each level of each tree, and the files are gone afterwards."""
    seen = []
    monkeypatch.setattr(ml, "FIT_ROWS", 800)
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda *_: pytest.fail("MLlib was to fit many rows"))
    place = boosting.Trainer.place

    def noted(self, trees):
        place(self, trees)
        seen.extend(self.files.collect())

    monkeypatch.setattr(boosting.Trainer, "place", noted)
    fitted(monkeypatch, 10, rows, FEATURES, "y", rounds=2, depth=2, weight="w")
    assert len(seen) == 4 and sum(name[1] for name in seen) == 3000
    assert not any(glob.glob(os.path.dirname(name[0])) for name in seen)


@pytest.mark.parametrize("way, at", [("gone", 0), ("gone", 7), ("again", 5), ("gone", 12)])
def test_lost_rows_are_dealt_again(rows, monkeypatch, way, at):
    """A file that is gone, or made anew without the trees since, costs time and changes nothing."""
    how = dict(rounds=4, depth=3, weight="w", **WHOLE)
    want = scores(fitted(monkeypatch, 10, rows, FEATURES, "y", **how), rows)
    job, place, calls, placed = boosting.Trainer.job, boosting.Trainer.place, [], []

    def failing(self, work):
        calls.append(work)
        if len(calls) == at + 1:
            if way == "gone":
                os.remove(self.files.first()[0])
            else:
                self.files.unpersist(blocking=True)
        return job(self, work)

    monkeypatch.setattr(boosting.Trainer, "job", failing)
    monkeypatch.setattr(boosting.Trainer, "place", lambda self, trees: placed.append(len(trees)) or place(self, trees))
    got = scores(fitted(monkeypatch, 10, rows, FEATURES, "y", **how), rows)
    assert placed == [0, max(0, at // 3 - 1 + (at % 3 > 0))] and len(calls) > 13 and got == pytest.approx(want, abs=1e-12)


def test_rows_that_are_no_numbers_are_refused(rows, monkeypatch):
    for wrong in (rows.withColumn("a", F.when(F.col("k") != 7, F.col("a"))), rows.withColumn("y", F.col("y") + 1)):
        with pytest.raises(Exception, match="must be"):
            fitted(monkeypatch, 10, wrong, FEATURES, "y", rounds=1, depth=2, weight="w")
