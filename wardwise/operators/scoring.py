"""Scores of boosted trees for many rows (M5): the leaf of every tree by table look-ups on binned values.

A row is in the leaf that no feature rules out. Per tree and feature, each bin
of a value (the trees' thresholds bound the bins) has the set of leaves that
it allows, as bits; features are packed into a few codes (``boosting.Layout``), so a
tree costs a row one look-up a code, and one for the value of the single leaf left
over (its bit times a de Bruijn number gives its place). MLlib's ``transform``
walks objects of 300 trees for each row instead.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.operators.boosting import Layout

CHUNK = 1 << 13  # rows of an array operation
PLACES = {32: (np.uint32, 0x077CB531, 27), 64: (np.uint64, 0x03F79D71B4CB0A89, 58)}  # leaves: type, de Bruijn number, shift


class Leaves:
    """The tables of an ensemble; ``None`` from ``of`` if a tree has more than 64 leaves or a split that is not ordered."""

    def __init__(self, trees: list[list[tuple[float, dict]]], n_features: int):
        most = max(map(len, trees))
        self.kind, self.number, self.shift = PLACES[min(k for k in PLACES if k >= most)]
        ends = [[b for leaves in trees for _, path in leaves if f in path for b in path[f][:2] if np.isfinite(b)] for f in range(n_features)]
        self.layout = Layout([np.unique(own).astype(float) for own in ends])
        self.values, self.allowed = [], []
        for leaves in trees:
            values, masks = np.zeros(8 * self.kind().itemsize), [np.full(n, self.kind(~self.kind(0))) for n in self.layout.sizes]
            for i, (value, path) in enumerate(leaves):
                bit = self.kind(1 << i)
                values[int(self.kind((int(bit) * self.number) % (1 << len(values))) >> self.kind(self.shift))] = value
                for f, (low, high, _) in path.items():
                    cuts = self.layout.cuts[f]
                    first, end = np.searchsorted(cuts, low) + np.isfinite(low), np.searchsorted(cuts, high) + 1
                    masks[f][:first] &= ~bit
                    masks[f][end:] &= ~bit
            tables = []
            for own in self.layout.groups:
                table = np.full(1, self.kind(~self.kind(0)))
                for f in own:
                    table = (table[:, None] & masks[f]).ravel()
                tables.append(table & self.kind((1 << len(leaves)) - 1))
            self.values.append(values)
            self.allowed.append(tables)

    @classmethod
    def of(cls, model: PipelineModel, spark) -> Leaves | None:
        from wardwise.operators.attribution import leaf_paths, node_table

        nodes = defaultdict(list)
        for n in node_table(model, spark).collect():  # trees x 2 ** (depth + 1) rows at most
            if n["feature"] >= 0 and n["categories"] >= 0:
                return None
            nodes[n["tree"]].append(n)
        weights = list(model.stages[-1].treeWeights)
        trees = [leaf_paths(nodes[t], weights) for t in sorted(nodes)]
        return cls(trees, model.stages[-1].numFeatures) if max(map(len, trees)) <= max(PLACES) else None

    def margins(self, columns: list[np.ndarray]) -> np.ndarray:
        """The weighted sum of the trees for each row."""
        out = np.zeros(len(columns[0]))
        codes = self.layout.codes(columns)
        for a in range(0, len(out), CHUNK):
            own, sums = [c[a:a + CHUNK].astype(np.intp) for c in codes], out[a:a + CHUNK]
            for values, tables in zip(self.values, self.allowed, strict=True):
                left = tables[0].take(own[0])
                for table, code in zip(tables[1:], own[1:], strict=True):
                    left &= table.take(code)
                left *= self.kind(self.number)
                left >>= self.kind(self.shift)
                sums += values.take(left.astype(np.intp))
        return out


def score(model: PipelineModel, df: DataFrame) -> Column | None:
    """Probability of class 1, as MLlib computes it from the trees' sum; ``None`` if the trees don't fit the tables."""
    leaves = Leaves.of(model, df.sparkSession)
    if leaves is None:
        return None
    sent = df.sparkSession.sparkContext.broadcast(leaves)

    @F.pandas_udf("double")
    def of_row(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(float) for c in columns]
        if any(np.isnan(v).any() for v in values):
            raise ValueError("features to score must be numbers")
        with np.errstate(over="ignore"):
            return pd.Series(1 - 1 / (1 + np.exp(2 * sent.value.margins(values))))

    return of_row(*[F.col(c).cast("double") for c in model.stages[0].getInputCols()])
