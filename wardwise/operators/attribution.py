"""Exact attribution of boosted trees (M10): how much each feature moves a row's raw score from the mean.

The value of a set of known features is the trees' output when known
features are followed and unknown ones averaged by the training rows on
either side (path-dependent expectation); a feature's attribution is its
Shapley value under that game. A tree is the sum over its leaves, and for one
leaf the game has only the features on its path: feature j contributes a
factor 1 or 0 if known (the row is, or is not, inside the interval that the
path leaves for j) and the share of training rows that go along if unknown.

1. The node table is read from the saved model as a DataFrame; it has at most
   trees x 2 ** (depth + 1) rows, so it is collected.
2. Per leaf, and for each set of path features that a row may satisfy (2 **
   depth at most), the attributions are computed once: the product over the
   other features of (share + satisfied x t) is a polynomial in t whose
   coefficients, by subset size, are weighted s! (k - s - 1)! / k!.
3. These tables are broadcast, with the satisfied leaves of every feature by
   the bin of its value (its thresholds are the bins' bounds). A row costs one
   look-up a feature for the sets of all leaves, and one per leaf and path
   feature (``mapInPandas``, NumPy over blocks of rows and leaves).

The attributions of a row sum to its raw score less the mean.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from math import factorial

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardwise.operators.ml import dealt
from wardwise.session import checkpoint_dir

BLOCK = 1 << 16  # (row, leaf) pairs held at once
LEAVES = 1024  # leaves held at once


def node_table(model: PipelineModel, spark) -> DataFrame:
    """(tree, id, value, n, left, right, feature, threshold) of the pipeline's tree ensemble."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("value"),
        node["rawCount"].alias("n"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"), node["split"]["numCategories"].alias("categories"),
        F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"))


def leaf_paths(nodes: list, weights: list[float]) -> list[tuple[float, dict[int, list[float]]]]:
    """(weighted value, {feature: [low, high, share]}) per leaf: a row is on the path if low < x <= high for all."""
    trees = defaultdict(dict)
    for n in nodes:
        if n["feature"] >= 0 and n["categories"] >= 0:
            raise ValueError("only ordered splits are attributed")
        trees[n["tree"]][n["id"]] = n
    leaves = []
    for tree, by_id in trees.items():
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            node = by_id[at]
            if node["left"] < 0:
                leaves.append((weights[tree] * node["value"], path))
                continue
            for child, side in ((node["left"], 1), (node["right"], 0)):
                on = {f: list(v) for f, v in path.items()}
                interval = on.setdefault(node["feature"], [-np.inf, np.inf, 1.0])
                interval[side] = (min if side else max)(interval[side], node["threshold"])
                interval[2] *= by_id[child]["n"] / node["n"]
                stack.append((child, on))
    return leaves


def _tables(values: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(leaves, 2 ** k, k): attribution of each leaf's path features for each set of satisfied ones."""
    k = shares.shape[1]
    weight = [factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)]
    on = np.arange(1 << k)[:, None] >> np.arange(k) & 1
    out = np.zeros((len(values), 1 << k, k))
    for j in range(k):
        poly = np.zeros((len(values), 1 << k, k))
        poly[:, :, 0] = 1.0
        for i in range(k):
            if i != j:
                longer = poly * shares[:, i, None, None]
                longer[:, :, 1:] += poly[:, :, :-1] * on[:, i, None]
                poly = longer
        out[:, :, j] = values[:, None] * (on[:, j] - shares[:, j, None]) * (poly @ weight)
    return out


def attribution_model(model: PipelineModel, spark, n_features: int) -> dict:
    """Leaves grouped by the number of features on their path, with their tables, and the mean raw score."""
    leaves = leaf_paths(node_table(model, spark).collect(), list(model.stages[-1].treeWeights))
    groups = defaultdict(list)
    for value, path in leaves:
        groups[len(path)].append((value, path))
    cuts = [np.unique([b for _, p in leaves if f in p for b in p[f][:2] if np.isfinite(b)]) for f in range(n_features)]
    packed = []
    for k, members in groups.items():
        if k == 0:
            continue
        for a in range(0, len(members), LEAVES):
            part = members[a:a + LEAVES]
            features = np.array([list(p) for _, p in part])
            # a row a bin; the last one is for values that are no numbers and lie on no path
            bits = [np.zeros((len(c) + 2, len(part)), np.min_scalar_type((1 << k) - 1)) for c in cuts]
            for i, (_, p) in enumerate(part):
                for j, (f, (low, high, _)) in enumerate(p.items()):
                    bits[f][np.searchsorted(cuts[f], low) + np.isfinite(low):np.searchsorted(cuts[f], high) + 1, i] = 1 << j
            tables = _tables(np.array([v for v, _ in part]), np.array([[p[f][2] for f in p] for _, p in part]))
            own = [(f, b) for f, b in enumerate(bits) if b.any()]
            packed.append((k, own, [np.ascontiguousarray(tables[:, :, j]).ravel() for j in range(k)],
                           [np.eye(n_features)[features[:, j]] for j in range(k)]))
    mean = sum(v * np.prod([s for _, _, s in p.values()]) for v, p in leaves)
    return {"groups": packed, "cuts": cuts, "mean": float(mean), "n_features": n_features}


def attributions(own: dict, x: np.ndarray) -> np.ndarray:
    """(rows, features) attributions of rows ``x``."""
    out = np.zeros((len(x), own["n_features"]))
    bins = [np.where(v > -np.inf, np.searchsorted(c, v), len(c) + 1) for c, v in zip(own["cuts"], x.T, strict=True)]
    for k, bits, tables, to in own["groups"]:
        leaves = len(to[0])
        first = np.arange(leaves) << k
        step = max(1, BLOCK // leaves)
        for a in range(0, len(x), step):
            at = first + sum(b[bins[f][a:a + step]] for f, b in bits)
            for table, names in zip(tables, to, strict=True):
                out[a:a + step] += table[at] @ names
    return out


def with_attribution(model: PipelineModel, df: DataFrame, features: list[str],
                     out: str = "attribution") -> DataFrame:
    """``df`` plus ``out`` (one value per feature) and ``mean_raw``, the score they start from."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(attribution_model(model, spark, len(features)))
    kept = df.drop(out, "mean_raw")
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType())),
                           T.StructField("mean_raw", T.DoubleType())])

    def run(batches):
        for pdf in batches:
            pdf[out] = list(attributions(sent.value, pdf[features].to_numpy(dtype=float)))
            pdf["mean_raw"] = sent.value["mean"]
            yield pdf

    return dealt(kept).mapInPandas(run, schema)


def attribution_ranking(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs_attribution, mean_attribution, rank) over all rows."""
    rows = with_attribution(model, df.select(*features), features)
    named = rows.select(F.posexplode("attribution").alias("k", "v"))
    agg = named.groupBy("k").agg(F.avg(F.abs("v")).alias("mean_abs_attribution"), F.avg("v").alias("mean_attribution"))
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("k") + 1)
    order = Window.orderBy(F.col("mean_abs_attribution").desc(), F.col("k"))  # one row per feature
    return agg.select(name.alias("feature"), "mean_abs_attribution", "mean_attribution",
                      F.row_number().over(order).alias("rank"))
