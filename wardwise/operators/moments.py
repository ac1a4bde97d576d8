"""One mergeable table of moments (count, means, co-moments) for correlation and principal components.

Every task reduces its rows to one block (n, means, sums of products of
deviations from the block's means), merging batch by batch; blocks merge by
the pairwise rule C = sum (C_b + n_b (m_b - m)(m_b - m)'), which stays exact
where sums of squares would cancel. The rows are read once, in Arrow batches of
the metric columns only; what is shuffled is one row per task, and what
reaches the driver is one k x k matrix.

Rows with a null in any of the columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(a: tuple, b: tuple) -> tuple:
    """Moments (n, means, co-moments) of two sets of rows together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def block(x: np.ndarray) -> tuple:
    """Moments of the rows of ``x``."""
    if not len(x):
        return 0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))
    mean = x.mean(axis=0)
    return len(x), mean, (x - mean).T @ (x - mean)


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, co-moments) of all rows."""
    from wardwise.sources.io import materialize

    k = len(cols)

    def run(batches):
        total = block(np.zeros((0, k)))
        for pdf in batches:
            total = merged(total, block(pdf.to_numpy(dtype=float)))
        yield pd.DataFrame({"n": [total[0]], "mean": [total[1].tolist()], "m2": [total[2].ravel().tolist()]})

    rows = df.select(*[F.col(c).cast("double") for c in cols]).dropna()
    blocks = materialize(rows.mapInPandas(run, "n long, mean array<double>, m2 array<double>").where("n > 0"))
    means = blocks.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"), F.sum("n").alias("n")).collect()
    if not means:
        return block(np.zeros((0, k)))
    mean = np.zeros(k)
    for r in means:
        mean[r["i"]] = r["m"]
    centre = F.array(*[F.lit(float(m)) for m in mean])

    def off(i: Column) -> Column:
        return F.get("mean", i) - F.get(centre, i)

    apart = F.transform("m2", lambda c, p: c + F.col("n") * off((p / k).cast("int")) * off(p % k))
    sums = blocks.select(F.posexplode(apart).alias("p", "c")).groupBy("p").agg(F.sum("c").alias("c")).collect()
    out = np.zeros(k * k)
    for r in sums:
        out[r["p"]] = r["c"]
    return int(means[0]["n"]), mean, out.reshape(k, k)


def correlation(m2: np.ndarray) -> np.ndarray:
    """Correlations from co-moments; not a number beside a constant column."""
    sd = np.sqrt(np.diag(m2))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m2 / np.outer(sd, sd)
