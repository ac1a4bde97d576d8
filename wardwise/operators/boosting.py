"""Boosted trees over many rows (M4): MLlib's method on binned rows that stay where they are.

MLlib's ``GBTClassifier`` reads objects of every row for each level of each
tree. This is the same method (its bin bounds from its sample, variance gain,
rows drawn per tree, features drawn per node, mean pseudo-residuals of the
logistic loss in the leaves, first tree of weight one) with other draws:

1. Rows are dealt to one partition a core, binned, and kept as plain arrays in a
   file of the executor's Spark folder (``SPARK_LOCAL_DIRS``, where Python's
   own spills go; Spark clears it). A row takes some 50 bytes.
2. Features are packed into a few codes (mixed radix, at most ``CELLS`` values
   each), so a level counts a row once per code and not once per feature; sums
   over the other digits give each feature's histogram.
3. A level is one job over the cached names of these files, which holds each
   task to the executor that has the file. Tasks return histograms (nodes x bins
   x 2 numbers), the driver adds them and draws the splits.
4. A job writes only what it does not read, so a task may run again. A file says
   how far its rows are; if one is lost with its executor (or made again, without
   the trees since), rows are dealt again and the trees so far replayed.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from contextlib import suppress

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardwise.session import checkpoint_dir

CELLS = 4096  # values of a code
CHUNK = 1 << 17  # rows of an array operation
SAMPLE = 10_000  # rows that MLlib looks at for the bounds of its bins, or bins squared if that is more
ROWS_MOST = 20_000_000  # rows of a partition
NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, "
        "gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, "
        "numCategories: int>>")
FAILED = (Py4JJavaError, PySparkException)


# --------------------------------------------------------------------------- bins and codes

def bounds(values: np.ndarray, weights: np.ndarray, expected: float, bins: int) -> np.ndarray:
    """Thresholds of one feature from sampled values, as MLlib chooses them (zeros count as what the others leave of ``expected``)."""
    own, at = np.unique(values, return_inverse=True)
    counts = np.bincount(at, weights, len(own))
    rest = expected - counts[own != 0].sum()
    counts, own = counts[own != 0], own[own != 0]
    if rest > 100 * np.finfo(float).eps * len(values):
        counts, own = np.insert(counts, k := np.searchsorted(own, 0.0), rest), np.insert(own, k, 0.0)
    middles = (own[1:] + own[:-1]) / 2
    if len(middles) < bins:
        return middles
    chosen, stride, count = [], expected / bins, counts[0]
    target = stride
    for middle, more in zip(middles, counts[1:], strict=True):
        if abs(count - target) < abs(count + more - target):
            chosen.append(middle)
            target += stride
        count += more
    return np.array(chosen)


def packed(sizes: list[int], cells: int | None = None) -> list[list[int]]:
    """Features in groups whose bin counts multiply to at most ``cells``, largest first."""
    groups: list[tuple[int, list[int]]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for i, (n, own) in enumerate(groups):
            if n * sizes[f] <= (cells or CELLS):
                groups[i] = (n * sizes[f], [*own, f])
                break
        else:
            groups.append((sizes[f], [f]))
    return [own for _, own in groups]


class Layout:
    """Where the features' bins lie in the codes and in the histograms."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.sizes = cuts, [len(c) + 1 for c in cuts]
        self.groups = packed(self.sizes)
        self.shapes = [[self.sizes[f] for f in own] for own in self.groups]
        self.cells = max(int(np.prod(s)) for s in self.shapes)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """(groups, rows): values to the bins' places, a value at a bound to the left of it."""
        out = np.zeros((len(self.groups), len(columns[0])), np.min_scalar_type(self.cells))
        for code, own in zip(out, self.groups, strict=True):
            for f in own:
                code *= code.dtype.type(self.sizes[f])
                code += np.searchsorted(self.cuts[f], columns[f]).astype(code.dtype)
        return out

    def by_feature(self, counts: list[np.ndarray], nodes: int) -> np.ndarray:
        """(nodes, all bins) from one histogram (nodes x cells) a code."""
        out = np.empty((nodes, self.start[-1]))
        for count, shape, own in zip(counts, self.shapes, self.groups, strict=True):
            cube = count.reshape(nodes, self.cells)[:, :np.prod(shape)].reshape(nodes, *shape)
            for i, f in enumerate(own):
                out[:, self.start[f]:self.start[f + 1]] = cube.sum(tuple(j + 1 for j in range(len(shape)) if j != i))
        return out

    def goes_right(self, feature: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
        """(nodes x cells) of each code: whether a row of that node and code is beyond the node's bound."""
        out = []
        for shape, own in zip(self.shapes, self.groups, strict=True):
            table = np.zeros((len(feature), self.cells), bool)
            digits = np.unravel_index(np.arange(np.prod(shape)), shape)
            for node, f in enumerate(feature):
                if f in own:
                    table[node, :np.prod(shape)] = digits[own.index(f)] > cut[node]
            out.append(table.ravel())
        return out


# --------------------------------------------------------------------------- rows of a partition

class Rows:
    """A partition's arrays in a file; ``margin`` and ``node`` are read from one half and written to the other.

    ``stage``: the tree that the rows are drawn for (trees before it are in the margins) and the level of ``node``.
    """

    def __init__(self, path: str, n: int, groups: int, code: str, node: str, made: bool = False):
        self.n, at = n, 0
        for name, dtype, shape in (("stage", "i8", (2,)), ("margin", "f8", (2, n)), ("pull", "f8", (n,)), ("weight", "f8", (n,)),
                                   ("codes", code, (groups, n)), ("node", node, (2, n)), ("label", "i1", (n,)), ("drawn", "?", (n,))):
            if n or name == "stage":
                setattr(self, name, np.memmap(path, dtype, "r+" if at or not made else "w+", at, shape).view(np.ndarray))
            else:
                setattr(self, name, np.empty(shape, dtype))
            at = -(-(at + np.dtype(dtype).itemsize * int(np.prod(shape))) // 64) * 64

    def at(self, *stages: tuple[int, int]) -> None:
        if (found := tuple(self.stage.tolist())) not in stages:
            raise LookupError(f"rows of a partition are at {found} and not at {stages}: their file was made again")

    def chunks(self):
        return (slice(a, min(a + CHUNK, self.n)) for a in range(0, self.n, CHUNK))


def step(rows: Rows, c: slice, layout: Layout, level: int, splits: tuple) -> np.ndarray:
    """The nodes of rows one level further down, kept for the next level; ``splits`` are those of ``level``."""
    right, child = splits
    at = rows.node[level % 2, c] if level else np.zeros(c.stop - c.start, rows.node.dtype)
    base = at.astype(np.int64) * layout.cells
    on = np.zeros(len(at), bool)
    for codes, table in zip(rows.codes, right, strict=True):
        on |= table.take(base + codes[c])
    below = child.take(at) + on
    rows.node[(level + 1) % 2, c] = below
    return below


def routes(layout: Layout, tree: list[dict], level: int) -> tuple:
    """Tables of one level: nodes are numbered from the left of their level, and one that is a leaf goes on as a left child."""
    found = tree[level]
    return layout.goes_right(found["feature"], found["cut"]), (2 * np.arange(len(found["feature"]))).astype(np.int64)


def histograms(rows: Rows, layout: Layout, level: int, depth_nodes) -> np.ndarray:
    """(2, nodes, all bins): weights and weighted residuals of the drawn rows."""
    nodes = 1 << level
    sums = [[np.zeros(nodes * layout.cells) for _ in layout.groups] for _ in range(2)]
    for c in rows.chunks():
        at = depth_nodes(c)
        weight = rows.weight[c] * rows.drawn[c]
        pull = rows.pull[c]
        base = None if at is None else at.astype(np.int64) * layout.cells
        for g, codes in enumerate(rows.codes):
            cell = codes[c].astype(np.int64) if base is None else base + codes[c]
            sums[0][g] += np.bincount(cell, weight, nodes * layout.cells)
            sums[1][g] += np.bincount(cell, pull, nodes * layout.cells)
    return np.stack([layout.by_feature(s, nodes) for s in sums])


def add_tree(rows: Rows, layout: Layout, tree: list[dict], weight: float, done: int, level: int = 0, stats: bool = False) -> np.ndarray | None:
    """The ``done``-th tree (from 0) on the rows' margins; returns the sums of its drawn rows by leaf place if asked to.

    ``level``: that of the nodes at which the rows stand.
    """
    value = tree[-1]["leaf"] * weight
    own = np.zeros((4, len(value))) if stats else None
    tables = [routes(layout, tree, k) for k in range(level, len(tree))]
    for c in rows.chunks():
        for k, table in enumerate(tables, level):
            at = step(rows, c, layout, k, table)
        before = rows.margin[done % 2, c] if done else 0.0
        if stats:
            w, pull = rows.weight[c] * rows.drawn[c], rows.pull[c]
            square = np.divide(pull * pull, w, out=np.zeros(len(w)), where=w > 0)
            for sums, v in zip(own, (w, pull, square, rows.drawn[c]), strict=True):
                sums += np.bincount(at, v, len(value))
        rows.margin[(done + 1) % 2, c] = before + value.take(at)
    return own


def draw(rows: Rows, seed: int, tree: int, part: int, share: float) -> None:
    """Rows of the next tree and their weighted pseudo-residuals."""
    rng = np.random.default_rng([seed, tree, part])
    for c in rows.chunks():
        y = rows.label[c].astype(float)
        drawn = np.ones(len(y), bool) if share >= 1 else rng.random(len(y), np.float32) < share
        rows.drawn[c] = drawn
        residual = y if not tree else 4 * y / (1 + np.exp(2 * y * rows.margin[tree % 2, c]))
        rows.pull[c] = rows.weight[c] * drawn * residual


# --------------------------------------------------------------------------- growing

def best_splits(layout: Layout, found: np.ndarray, open_: np.ndarray, allowed: list[np.ndarray]) -> dict:
    """Per node the split of most variance gain over the ``allowed`` features: feature (-1: none), cut, gain and both sides' means."""
    nodes, widest = found.shape[1], max(layout.sizes)
    cube = np.zeros((2, nodes, len(layout.sizes), widest))
    valid = np.zeros((nodes, len(layout.sizes), widest), bool)
    for f, size in enumerate(layout.sizes):
        cube[:, :, f, :size] = found[:, :, layout.start[f]:layout.start[f + 1]]
        valid[:, f, :size - 1] = True
    may = np.zeros((nodes, len(layout.sizes)), bool)
    for node, own in enumerate(allowed):
        may[node, own] = open_[node]
    left = cube.cumsum(3)
    total = left[:, :, :, -1:]
    right = total - left
    valid &= may[:, :, None] & (left[0] > 0) & (right[0] > total[0] * 1e-14)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
        gain = np.where(valid, parts - total[1] ** 2 / total[0], -np.inf)
        gain[valid & (gain <= 1e-13 * parts)] = -np.inf  # no more than the last digits of equal means
        mean = np.stack([left[1] / left[0], right[1] / right[0]])
    flat = gain.reshape(nodes, -1)
    at, take = flat.argmax(1), np.arange(nodes)
    most = flat[take, at]
    splits = np.isfinite(most)
    f, cut = np.unravel_index(at, gain.shape[1:])
    return {"feature": np.where(splits, f, -1), "cut": np.where(splits, cut, 0),
            "gain": np.divide(most, total[0, :, 0, 0], out=np.full(nodes, -1.0), where=splits), "means": mean[:, take, f, cut].T}


class Trainer:
    """The rows of a fit on the executors, and its jobs."""

    def __init__(self, rows: DataFrame, layout: Layout, depth: int, share: float, seed: int, rate: float, partitions: int):
        self.rows, self.depth, self.share, self.seed, self.rate, self.partitions = rows, depth, share, seed, rate, partitions
        self.context = rows.sparkSession.sparkContext
        self.layout = self.context.broadcast(layout)
        self.files = None

    def weight(self, tree: int) -> float:
        return self.rate if tree else 1.0

    def place(self, trees: list) -> None:
        """Deal the rows to files, with the margins of ``trees``."""
        self.clear()
        features, depth, sent, past = len(self.rows.columns) - 2, self.depth, self.layout, self.context.broadcast(trees)
        weights = [self.weight(t) for t in range(len(trees))]
        folder = str(uuid.uuid4().int)

        def write(batches):
            layout, codes, labels, weight = sent.value, [], [], []
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns]
                if any(np.isnan(c).any() for c in columns):
                    raise ValueError("features, label and weight of training rows must be numbers")
                if not np.isin(columns[features], (0.0, 1.0)).all() or (columns[-1] < 0).any():
                    raise ValueError("labels must be 0 or 1, weights 0 or more")
                codes.append(layout.codes(columns[:features]))
                labels.append((2 * columns[features] - 1).astype(np.int8))
                weight.append(columns[-1].copy())
            n = sum(map(len, labels))
            local = random.choice(os.environ["SPARK_LOCAL_DIRS"].split(","))
            at = f"{local}/python/{os.getpid()}/{folder}"
            os.makedirs(at, exist_ok=True)
            path = f"{at}/{uuid.uuid4().int}"
            kind = (n, len(layout.groups), np.min_scalar_type(layout.cells).str, np.min_scalar_type((1 << depth) - 1).str)
            rows = Rows(path, *kind, made=True)
            if n:
                np.concatenate(codes, axis=1, out=rows.codes)
                np.concatenate(labels, out=rows.label)
                np.concatenate(weight, out=rows.weight)
            for i, tree in enumerate(past.value):
                add_tree(rows, layout, tree, weights[i], i)
            rows.stage[:] = len(past.value) - 1, depth
            yield pa.RecordBatch.from_pydict({"file": [json.dumps([path, *kind])]})

        dealt = self.rows.repartition(self.partitions)
        self.files = dealt.mapInArrow(write, "file string").rdd.map(lambda r: json.loads(r[0])).persist(
            StorageLevel.MEMORY_AND_DISK)
        self.files.count()

    def clear(self) -> None:
        if self.files is not None:
            def drop(name):
                with suppress(OSError):
                    os.remove(name[0])
                    os.rmdir(os.path.dirname(name[0]))

            with suppress(*FAILED):
                self.files.foreach(drop)
            self.files.unpersist()
            self.files = None

    def job(self, work) -> np.ndarray:
        """The sum of what ``work`` (partition, rows, layout) returns for each partition, in the order of partitions."""
        sent = self.layout

        def run(part, names):
            for name in names:
                yield work(part, Rows(*name), sent.value)

        return sum(self.files.mapPartitionsWithIndex(run).collect())

    def root(self, trees: list, pending: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Add the last tree if it is ``pending`` and draw the next one's rows: the histograms of its root, the last one's sums by leaf."""
        tree, seed, share, depth = len(trees), self.seed, self.share, self.depth
        last, weight, bins = (trees[-1] if pending else None), self.weight(tree - 1), 1 << depth

        def work(part, rows, layout):
            sums = np.zeros((4, bins))
            if last:
                rows.at((tree - 1, last[-1]["level"]), (tree, 0))
                sums = add_tree(rows, layout, last, weight, tree - 1, last[-1]["level"], True)
            else:
                rows.at((tree - 1, depth), (tree, 0))
            draw(rows, seed, tree, part, share)
            rows.stage[:] = tree, 0
            return np.concatenate([sums.ravel(), histograms(rows, layout, 0, lambda c: None).ravel()])

        out = self.job(work)
        return out[4 * bins:].reshape(2, 1, -1), out[:4 * bins].reshape(4, -1) if pending else None

    def below(self, grown: list, tree: int, level: int) -> np.ndarray:
        """The rows one level down, and the histograms there."""
        table = [{"feature": grown[-1]["feature"], "cut": grown[-1]["cut"]}]

        def work(part, rows, layout):
            rows.at((tree, level - 1), (tree, level))
            route = routes(layout, table, 0)
            found = histograms(rows, layout, level, lambda c: step(rows, c, layout, level - 1, route))
            rows.stage[1] = level
            return found

        return self.job(work)

    def finish(self, trees: list) -> np.ndarray:
        last, weight, tree = trees[-1], self.weight(len(trees) - 1), len(trees) - 1

        def work(part, rows, layout):
            rows.at((tree, last[-1]["level"]))
            return add_tree(rows, layout, last, weight, tree, last[-1]["level"], True)

        return self.job(work)


def grow(trainer: Trainer, layout: Layout, found: np.ndarray, tree: int, per_node: int) -> list[dict]:
    """The levels of one tree below the root's histograms."""
    rng = np.random.default_rng([trainer.seed, tree])
    n_features = len(layout.sizes)
    open_, values = np.ones(1, bool), np.array([found[1, 0, :layout.sizes[0]].sum() / found[0, 0, :layout.sizes[0]].sum()])
    levels, reached = [], 0
    for level in range(trainer.depth):
        if level and open_.any():
            found, reached = trainer.below(levels, tree, level), level
        if open_.any():
            allowed = [np.sort(rng.choice(n_features, per_node, replace=False)) if o else np.arange(0) for o in open_]
            own = best_splits(layout, found, open_, allowed)
        else:
            none = np.full(len(open_), -1)
            own = {"feature": none, "cut": none * 0, "gain": none * 1.0, "means": np.zeros((len(none), 2))}
        split = own["feature"] >= 0
        # a leaf goes on as a left child that is not split again
        values = np.where(split[:, None], own.pop("means"), np.stack([values, values], axis=1)).ravel()
        levels.append(own)
        open_ = np.stack([split, split], axis=1).ravel()
    levels[-1] |= {"leaf": values, "level": reached}
    return levels


def node_rows(tree: int, levels: list[dict], sums: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """MLlib's saved nodes of a tree (numbered from the root, left before right; sides of one prediction are one leaf)."""
    depth = len(levels)
    leaf = levels[-1]["leaf"]
    out: list = []

    def add(level: int, at: int) -> float | None:
        """Append the subtree; its value if it is a leaf."""
        place = slice(at << (depth - level), (at + 1) << (depth - level))
        weight, total, square = (float(x) for x in sums[:3, place].sum(1))
        raw = int(sums[3, place].sum())
        mean = total / weight if weight else 0.0
        impurity = max(square / weight - mean * mean, 0.0) if weight else 0.0
        mine = len(out)
        out.append(None)
        split = level < depth and levels[level]["feature"][at] >= 0
        if split:
            left, sides = mine + 1, [add(level + 1, 2 * at)]
            right = len(out)
            sides.append(add(level + 1, 2 * at + 1))
            if sides[0] is None or sides[0] != sides[1]:
                f = int(levels[level]["feature"][at])
                out[mine] = (tree, (mine, mean, impurity, [weight, total, square], raw, float(levels[level]["gain"][at]), left, right,
                                    (f, [float(cuts[f][levels[level]["cut"][at]])], -1)))
                return None
            del out[mine + 1:]
        value = float(leaf[place.start])
        out[mine] = (tree, (mine, value, impurity, [weight, total, square], raw, -1.0, -1, -1, (-1, [], -1)))
        return value

    add(0, 0)
    return out


def features_per_node(strategy: str, n: int) -> int:
    """MLlib's reading of ``featureSubsetStrategy`` for one tree."""
    named = {"auto": n, "all": n, "sqrt": np.ceil(np.sqrt(n)), "log2": max(1, np.ceil(np.log2(n))), "onethird": np.ceil(n / 3)}
    if strategy.lower() in named:
        return int(named[strategy.lower()])
    return min(int(strategy), n) if strategy.isdigit() else int(np.ceil(float(strategy) * n))


def model_of(spark, estimator: GBTClassifier, trees: list[list[tuple]], weights: list[float], n_features: int) -> GBTClassificationModel:
    """MLlib's model of these nodes, by its saved form."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/boosted-{uuid.uuid4().hex}"

    def head(kind: str, uid: str, own: dict) -> str:
        return json.dumps({"class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {p.name: v for p, v in estimator._paramMap.items() if p.name in own or "*" in own},
                           "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items() if p.name in own or "*" in own}})

    shared = {p.name: 1 for p in estimator.params if p.name in (
        "cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
        "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed")}
    whole = json.loads(head("org.apache.spark.ml.classification.GBTClassificationModel", estimator.uid, {"*": 1}))
    whole |= {"numFeatures": n_features, "numTrees": len(trees)}
    heads = [(i, head("org.apache.spark.ml.regression.DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[-12:]}", shared), w)
             for i, w in enumerate(weights)]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([n for t in trees for n in t], NODE).coalesce(1).write.parquet(f"{path}/data")
    model = GBTClassificationModel.load(path)
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return model


def fit(train: DataFrame, features: list[str], label: str, weight: str | None, estimator: GBTClassifier, n: int,
        total: float, partitions: int) -> GBTClassificationModel:
    """``estimator``'s trees on ``n`` rows of weight ``total``, which numeric columns hold."""
    spark = train.sparkSession
    own = {p: estimator.getOrDefault(p) for p in ("maxIter", "maxDepth", "maxBins", "stepSize", "subsamplingRate", "seed", "featureSubsetStrategy")}
    columns = [*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"),
               (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
    rows = train.select(columns)
    seed = own["seed"] & 0xFFFFFFFF
    share = min(1.0, max(SAMPLE, own["maxBins"] ** 2) / n)
    looked = (rows.sample(share, seed) if share < 1 else rows).toPandas()
    layout = Layout([bounds(looked[f"x{i}"].to_numpy(), looked["w"].to_numpy(), share * total, own["maxBins"]) for i in range(len(features))])
    per_node = features_per_node(own["featureSubsetStrategy"], len(features))
    trainer = Trainer(rows, layout, own["maxDepth"], own["subsamplingRate"], seed, own["stepSize"], partitions)
    trees: list[list[dict]] = []
    sums: list[np.ndarray] = []
    try:
        trainer.place(trees)
        again = -1
        while len(sums) < own["maxIter"]:
            try:
                if len(trees) == own["maxIter"]:
                    sums.append(trainer.finish(trees))
                    continue
                found, past = trainer.root(trees, pending := len(trees) > len(sums))
                sums += [past] if pending else []
                trees.append(grow(trainer, layout, found, len(trees), per_node))
            except FAILED:
                # a file went with its executor: deal the rows again, but not twice in a row for one tree
                if again == len(sums):
                    raise
                again = len(sums)
                del trees[len(sums):]  # rows of a tree without sums are drawn again
                trainer.place(trees)
    finally:
        trainer.clear()
        trainer.layout.unpersist()
    nodes = [node_rows(i, tree, s, layout.cuts) for i, (tree, s) in enumerate(zip(trees, sums, strict=True))]
    return model_of(spark, estimator, nodes, [trainer.weight(t) for t in range(len(trees))], len(features))
