"""Fourier / piecewise-trend forecaster.

Per site: log(y) = a + b t + sum_j d_j max(0, t - s_j) + yearly Fourier
(order 10) + weekly Fourier (order 3) + holiday-window indicators (-1, 0, +1).
``t`` is the site's history scaled to [0, 1]; the 25 hinge knots are evenly
spaced over the first 80% of it (the published defaults of Taylor & Letham
2018). The prior of the slope changes d_j is a Laplace distribution of scale
0.05, that of seasons and holidays a normal one of scale 10: with noise
variance s^2 (from a ridge fit) the estimate minimises

    |r|^2 / 2 + s^2 / 0.05 x sum |d_j| + ridge / 2

The changes' L1 penalty leaves most knots out (``active_knots``). The other
coefficients are eliminated exactly, and the 25 changes found by coordinate
descent over what remains of the Gram matrix.

Interval, in logs: mu -/+ z(0.95) x sqrt(s^2 + v u^3 / 3), u the horizon in
units of t: the slope is taken to go on changing at the rate of the knots by
changes like the fitted ones (mean absolute value m, variance 2 m^2), and a
change at w moves the trend at u by (u - w) times itself.

Distribution: every task turns its rows into design-matrix blocks and emits
the partial normal-equation sums X'X, X'z, z'z per site (``mapInPandas``);
a grouped sum adds the partials (at most #sites x k^2 values); each site's
k x k system (k = 56) is solved with its forecast spine in one
``cogroup().applyInPandas`` call. No step sees more than one site's sums. A
"site" may also be a site with a cut-off day (``rolling_fourier``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_KNOTS, KNOT_RANGE, YEARLY, WEEKLY = 25, 0.8, 10, 3
TREND_SCALE, SEASON_SCALE = 0.05, 10.0
Z90 = 1.6448536269514722


def n_features() -> int:
    return 2 + N_KNOTS + 2 * YEARLY + 2 * WEEKLY + 3


def design(t: np.ndarray, day: np.ndarray, hol: np.ndarray) -> np.ndarray:
    """Design matrix: t in [0, 1] (scaled), day = days since epoch, hol = (n, 3) indicators."""
    knots = KNOT_RANGE * np.arange(1, N_KNOTS + 1) / (N_KNOTS + 1)
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - s) for s in knots]
    for k in range(1, YEARLY + 1):
        a = 2 * np.pi * k * day / 365.25
        cols += [np.sin(a), np.cos(a)]
    for k in range(1, WEEKLY + 1):
        a = 2 * np.pi * k * day / 7.0
        cols += [np.sin(a), np.cos(a)]
    x = np.column_stack(cols + [hol[:, 0], hol[:, 1], hol[:, 2]])
    return x


def penalties() -> np.ndarray:
    p = np.zeros(n_features())
    p[2:2 + N_KNOTS] = 1.0 / TREND_SCALE ** 2
    p[2 + N_KNOTS:] = 1.0 / SEASON_SCALE ** 2
    return p


def _features(pdf: pd.DataFrame) -> np.ndarray:
    span = (pdf["t1"] - pdf["t0"]).where(lambda s: s > 0, 1).to_numpy(dtype=float)
    t = (pdf["t"].to_numpy(dtype=float) - pdf["t0"].to_numpy(dtype=float)) / span
    day = pdf["day"].to_numpy(dtype=float)
    hol = pdf[["hol_m1", "hol_0", "hol_p1"]].to_numpy(dtype=float)
    return design(t, day, hol)


def solve_sparse(xtx: np.ndarray, xtz: np.ndarray, zz: float, n: float) -> tuple[np.ndarray, float]:
    """Coefficients and residual variance from the normal-equation sums."""
    ridge = penalties() + 1e-9
    start = np.linalg.solve(xtx + np.diag(ridge), xtz)
    noise = max(zz - 2 * start @ xtz + start @ xtx @ start, 0.0) / max(n, 1.0)
    knots = np.arange(2, 2 + N_KNOTS)
    rest = np.setdiff1d(np.arange(len(xtz)), knots)
    prior = np.where(rest >= 2 + N_KNOTS, noise / SEASON_SCALE ** 2, 0.0) + 1e-9
    inner = np.linalg.solve(xtx[np.ix_(rest, rest)] + np.diag(prior),
                            np.column_stack([xtx[np.ix_(rest, knots)], xtz[rest]]))
    gram = xtx[np.ix_(knots, knots)] - xtx[np.ix_(knots, rest)] @ inner[:, :-1]
    right = xtz[knots] - xtx[np.ix_(knots, rest)] @ inner[:, -1]
    changes = coordinate_descent(gram, right, noise / TREND_SCALE)
    beta = np.zeros(len(xtz))
    beta[knots] = changes
    beta[rest] = inner[:, -1] - inner[:, :-1] @ changes
    return beta, max(zz - 2 * beta @ xtz + beta @ xtx @ beta, 0.0) / max(n, 1.0)


def coordinate_descent(gram: np.ndarray, right: np.ndarray, penalty: float, sweeps: int = 20_000) -> np.ndarray:
    """argmin of d'Gd / 2 - c'd + penalty x sum |d|."""
    d, gradient = np.zeros(len(right)), right.copy()  # gradient = c - Gd
    scale = np.abs(right).max() if len(right) else 0.0
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(d)):
            if gram[j, j] <= 1e-12:
                continue
            pull = gradient[j] + gram[j, j] * d[j]
            new = np.sign(pull) * max(abs(pull) - penalty, 0.0) / gram[j, j]
            if new != d[j]:
                gradient -= gram[:, j] * (new - d[j])
                moved = max(moved, abs(new - d[j]) * gram[j, j])
                d[j] = new
        if moved <= 1e-12 * (scale + penalty):
            break
    return d


def _partial_sums(by: list[str]):
    k = n_features()
    iu = np.triu_indices(k)

    def run(batches):
        for pdf in batches:
            rows = []
            for key, g in pdf.groupby(by, sort=False):
                x = _features(g)
                z = np.log(np.maximum(g["y"].to_numpy(dtype=float), 1e-9))
                vals = np.concatenate([(x.T @ x)[iu], x.T @ z, [z @ z, float(len(z))]])
                rows.append(pd.DataFrame(dict(zip(by, key, strict=True)) | {"idx": np.arange(len(vals), dtype=np.int32), "v": vals}))
            if rows:
                yield pd.concat(rows, ignore_index=True)

    return run


def _solve_and_forecast(by: list[str]):
    columns = [*by, "ds", "days_ahead", "yhat", "yhat_lower", "yhat_upper", "active_knots"]

    def run(sums: pd.DataFrame, spine: pd.DataFrame) -> pd.DataFrame:
        k = n_features()
        iu = np.triu_indices(k)
        m = len(iu[0])
        v = sums.sort_values("idx")["v"].to_numpy()
        if len(v) == 0 or len(spine) == 0:
            return pd.DataFrame(columns=columns)
        xtx = np.zeros((k, k))
        xtx[iu] = v[:m]
        xtx = xtx + np.triu(xtx, 1).T
        beta, variance = solve_sparse(xtx, v[m:m + k], v[m + k], v[m + k + 1])
        changes = np.abs(beta[2:2 + N_KNOTS])
        per_unit = N_KNOTS / KNOT_RANGE * 2 * changes.mean() ** 2
        span = np.maximum(spine["t1"] - spine["t0"], 1).to_numpy(dtype=float)
        u = (spine["t"] - spine["t1"]).to_numpy(dtype=float) / span
        sd = np.sqrt(variance + per_unit * u ** 3 / 3)
        mu = _features(spine) @ beta
        out = spine[[*by, "ds"]].assign(days_ahead=(spine["t"] - spine["t1"]).astype("int32"), yhat=np.exp(mu),
                                        yhat_lower=np.exp(mu - Z90 * sd), yhat_upper=np.exp(mu + Z90 * sd),
                                        active_knots=np.int32((changes > 0).sum()))
        return out[columns]

    return run


def forecast_fourier(h: DataFrame, holidays: DataFrame | list, periods: int = 30,
                     by: Sequence[str] = ("hospital",)) -> DataFrame:
    """F4 fit + forecast. ``h`` = prepared history (``by``, ds, y, t, in_window, ...)."""
    from wardwise.operators.joins import with_holiday_window

    by = list(by)
    keys = ", ".join(f"{c} {h.schema[c].dataType.simpleString()}" for c in by)
    rng = h.groupBy(*by).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("ds").alias("last"))
    hist = with_holiday_window(h.select(*by, "ds", "y", "t"), holidays, "ds").join(rng, by)
    hist = hist.withColumn("day", F.datediff("ds", F.lit("1970-01-01")))
    sums = (hist.select(*by, "y", "t", "t0", "t1", "day", "hol_m1", "hol_0", "hol_p1")
            .mapInPandas(_partial_sums(by), f"{keys}, idx int, v double")
            .groupBy(*by, "idx").agg(F.sum("v").alias("v")))
    spine = rng.select(*by, "t0", "t1", F.explode(
        F.sequence(F.date_add("last", 1), F.date_add("last", periods))).alias("ds"))
    spine = (spine.withColumn("t", F.datediff("ds", F.lit("2000-01-01")))
             .withColumn("day", F.datediff("ds", F.lit("1970-01-01"))))
    spine = with_holiday_window(spine, holidays, "ds")
    return (sums.groupBy(*by).cogroup(spine.groupBy(*by))
            .applyInPandas(_solve_and_forecast(by), f"{keys}, ds date, days_ahead int, yhat double, yhat_lower double, "
                                                    "yhat_upper double, active_knots int"))


def rolling_fourier(h: DataFrame, holidays: DataFrame | list, origins: int = 6, every: int = 30,
                    periods: int = 30) -> DataFrame:
    """F5 for F4: every cut-off's normal equations from one scan (a day is copied to the cut-offs it counts for)."""
    from wardwise.operators.forecast import cut_offs, score_origins
    from wardwise.operators.joins import bounded_broadcast

    cuts = bounded_broadcast(cut_offs(h, origins, every, periods))
    copies = h.join(cuts, "hospital").where(F.col("ds") <= F.col("cut")).drop("cut")
    return score_origins(forecast_fourier(copies, holidays, periods + every, ["hospital", "origin"])
                         .join(cuts, ["hospital", "origin"])
                         .withColumn("days_ahead", F.datediff("ds", "cut"))
                         .where((F.col("days_ahead") > 0) & (F.col("days_ahead") <= periods)), h)
