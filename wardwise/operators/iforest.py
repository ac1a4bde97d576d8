"""Isolation forest (M12): trees grown level by level as a table, rows scored in Arrow batches.

1. *Per-tree samples*: every row of the table joins each tree with
   probability ``oversample`` x psi / n, drawn by geometric skips over the
   tree numbers, so at any table size a row that joins no tree costs one
   hash. The (tree, row) pairs are reduced to the ``psi`` smallest hashes per
   tree (a window over about 3 psi rows), without replacement.
2. *Growth*: the state is one row per (tree, sampled row) with its present
   node. At each level windows over (tree, node) give the node's size and
   bounds; a feature among those that vary and a threshold between its
   bounds are drawn from the MD5 of (seed, tree, node); every row moves on to
   child 2 node or 2 node + 1. All levels run on the partitions by tree that
   sampling made: the state (trees x psi rows at most) is shuffled once.
3. *Scoring*: the node table has at most trees x 4 psi rows (a proven bound),
   so it is collected once and broadcast; ``mapInPandas`` walks all trees
   for a batch of rows at a time with NumPy.

All draws are functions of the seed, the row key, the tree and the node, so a
forest depends neither on partitions nor on a process's random generator.
Score = 2 ** (-E[h(x)] / c(psi)) (Liu, Ting, Zhou 2008); higher = more anomalous.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329
def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def uniform(*parts) -> Column:
    """Value in (0, 1] from 52 bits of the MD5 of the parts, joined by bars."""
    digest = F.md5(F.concat_ws("|", *[(F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def tree_samples(df: DataFrame, cols: list[str], key: str, n: int, trees: int, psi: int, seed: int,
                 oversample: float = 3.0) -> DataFrame:
    """(tree, x): at most ``psi`` rows a tree, drawn from all ``n`` rows."""
    vec = df.select(F.col(key), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    # Bernoulli trials over the trees by geometric skips: the distance to a row's next tree
    # is floor(ln u / ln(1 - rate)) + 1, so a row that is in no tree costs one hash.
    rate = min(1.0, oversample * psi / max(n, 1))
    per_skip = math.log1p(-rate) if rate < 1.0 else -math.inf

    def skip(j) -> Column:
        return F.least(F.floor(F.log(uniform(seed + 1, F.col(key), j)) / F.lit(per_skip)), F.lit(trees)).cast("long")

    some = vec.filter(skip(0) < trees)
    steps = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda j: skip(j) + 1)
    at = F.aggregate(steps, F.array(F.lit(-1).cast("long")),
                     lambda acc, s: F.when(F.element_at(acc, -1) >= trees, acc)
                     .otherwise(F.concat(acc, F.array(F.element_at(acc, -1) + s))))
    member = F.filter(at, lambda t: (t >= 0) & (t < trees))
    pairs = some.select(key, "x", F.explode(member).alias("tree")).withColumn("tree", F.col("tree").cast("int"))
    w = Window.partitionBy("tree").orderBy(uniform(seed + 2, F.col(key), F.col("tree")), key)
    return pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).select("tree", "x")


def grow(sample: DataFrame, n_features: int, height: int, seed: int) -> DataFrame:
    """Node table (tree, node, feature, threshold, size) of trees over (tree, x); a leaf's feature is -1."""
    here = Window.partitionBy("tree", "node")
    step = "array<struct<node: int, feature: int, threshold: double, size: int>>"
    state = sample.withColumns({"node": F.lit(1), "path": F.expr(f"CAST(array() AS {step})")})
    for depth in range(height + 1):
        bounds = {name: F.array(*[agg(F.col("x")[i]).over(here) for i in range(n_features)])
                  for name, agg in (("lo", F.min), ("hi", F.max))}
        state = state.withColumns(bounds | {"size": F.count(F.lit(1)).over(here).cast("int")})
        varying = F.filter(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.get("hi", i) > F.get("lo", i))
        state = state.withColumn("varying", F.when((F.col("size") > 1) & F.lit(depth < height), varying))
        pick = F.floor(uniform(seed, F.col("tree"), F.col("node"), 0) * F.size("varying")).cast("int")
        feature = F.when(F.size("varying") > 0, F.get("varying", F.least(pick, F.size("varying") - 1)))
        state = state.withColumn("feature", feature)
        low, high = F.get("lo", F.col("feature")), F.get("hi", F.col("feature"))
        cut = low + uniform(seed, F.col("tree"), F.col("node"), 1) * (high - low)
        state = state.withColumn("threshold", cut)
        made = F.struct("node", F.coalesce("feature", F.lit(-1)).alias("feature"),
                        F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "size")
        right = (F.get("x", F.col("feature")) >= F.col("threshold")).cast("int")
        state = state.select("tree", "x", (2 * F.col("node") + right).alias("node"),  # null in a leaf
                             F.when(F.col("node").isNull(), F.col("path"))
                             .otherwise(F.concat("path", F.array(made))).alias("path"))
    nodes = state.select("tree", F.inline("path"))
    return nodes.groupBy("tree", "node").agg(*[F.first(c).alias(c) for c in ("feature", "threshold", "size")])


def fit_iforest(df: DataFrame, cols: list[str], key: str, trees: int = 300, psi: int = 256,
                seed: int = 42, oversample: float = 3.0) -> dict:
    """Grow the forest; returns the model (node arrays + metadata)."""
    n = df.count()
    psi = min(psi, n)
    height = int(math.ceil(math.log2(max(psi, 2))))
    nodes = grow(tree_samples(df, cols, key, n, trees, psi, seed, oversample), len(cols), height, seed)
    nd = nodes.toPandas()
    shape = (trees, 2 << height)
    feature, threshold, size = np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape, np.int32)
    at = nd["tree"].to_numpy(), nd["node"].to_numpy()
    feature[at], threshold[at], size[at] = (nd[c].to_numpy() for c in ("feature", "threshold", "size"))
    return {"feature": feature, "threshold": threshold, "size": size, "grown": size[:, 1] > 0, "psi": psi, "cols": cols}


def path_lengths(model: dict, x: np.ndarray) -> np.ndarray:
    """Mean adjusted path length of each row of ``x`` over all grown trees."""
    feat, thr, size = (model[k] for k in ("feature", "threshold", "size"))
    trees = np.flatnonzero(model["grown"])
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        node = np.ones(len(x), dtype=np.int64)
        depth = np.zeros(len(x))
        active = feat[t, node] >= 0
        while active.any():
            a = rows[active]
            f = feat[t, node[a]]
            node[a] = 2 * node[a] + (x[a, f] >= thr[t, node[a]])
            depth[a] += 1.0
            active = feat[t, node] >= 0
        total += depth + c_factor(size[t, node])
    return total / max(len(trees), 1)


def score_iforest(df: DataFrame, model: dict, out: str = "anomaly_score") -> DataFrame:
    """Anomaly score of every row (Arrow batches; the model is broadcast)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(model)
    cols = model["cols"]
    denom = float(c_factor([model["psi"]])[0]) or 1.0
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.DoubleType())])

    def run(batches):
        m = bc.value
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            pdf[out] = np.power(2.0, -path_lengths(m, x) / denom) if len(pdf) else np.zeros(0)
            yield pdf

    return df.mapInPandas(run, schema)
