"""Rows-only operators checked against single-machine brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardwise.operators import forecast, fourier, ml
from wardwise.operators.forecast import prepare_history
from wardwise.plans import alc, surge
from wardwise.sources import dims


def plain_sparse(x, z, steps=4000):
    """The same minimum by enumerating signs of the active knots: from all knots, drop and flip until the conditions hold."""
    first = np.linalg.solve(x.T @ x + np.diag(fourier.penalties() + 1e-9), x.T @ z)
    noise = ((z - x @ first) ** 2).mean()
    k, knots = x.shape[1], range(2, 2 + fourier.N_KNOTS)
    weight = noise / fourier.TREND_SCALE
    ridge = np.array([1e-9 + (noise / fourier.SEASON_SCALE ** 2 if j >= 2 + fourier.N_KNOTS else 0.0) for j in range(k)])
    ridge[list(knots)] = 0.0
    signs = {}
    for _ in range(steps):
        use = [j for j in range(k) if j not in knots or j in signs]
        c = x.T @ z - np.array([weight * signs.get(j, 0) for j in range(k)])
        beta = np.zeros(k)
        beta[use] = np.linalg.solve((x.T @ x + np.diag(ridge))[np.ix_(use, use)], c[use])
        flipped = [j for j in signs if np.sign(beta[j]) != signs[j]]
        if flipped:
            del signs[min(flipped, key=lambda j: beta[j] * signs[j])]
            continue
        pull = x.T @ (z - x @ beta)
        out = [j for j in knots if j not in signs and abs(pull[j]) > weight * (1 + 1e-9)]
        if not out:
            return beta
        worst = max(out, key=lambda j: abs(pull[j]))
        signs[worst] = np.sign(pull[worst])
    raise AssertionError("no minimum found")


def test_coordinate_descent_meets_the_conditions():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 25)).cumsum(axis=0)
    gram, right = x.T @ x, x.T @ rng.normal(size=80)
    for penalty in (0.0, 1.0, 20.0, 1e4):
        d = fourier.coordinate_descent(gram, right, penalty)
        pull = right - gram @ d
        scale = np.abs(right).max()
        assert (np.abs(pull) <= penalty + 1e-6 * scale).all()
        assert np.allclose(pull[d != 0], penalty * np.sign(d[d != 0]), atol=1e-6 * scale)


def test_fourier_matches_numpy_solve(spark):
    rng = np.random.default_rng(11)
    days = pd.date_range("2021-01-01", "2022-12-31", freq="D")
    rows = []
    for site, base in [("A", 40.0), ("B", 90.0)]:
        y = base * (1 + 0.2 * np.sin(2 * np.pi * days.dayofyear / 365.25)) * rng.uniform(0.9, 1.1, len(days))
        rows += [(site, d.date(), float(v)) for d, v in zip(days, y)]
    hist = spark.createDataFrame(rows, "hospital string, visit_date date, ed_visits double")
    hol = dims.holidays(spark, 2020, 2023)
    h = prepare_history(hist, hol)
    got = fourier.forecast_fourier(h, hol, periods=10).toPandas().sort_values(["hospital", "ds"])

    hp = h.toPandas()
    hset = set(dims.holidays(spark, 2020, 2023).toPandas()["ds"])
    for site, g in hp.groupby("hospital"):
        g = g.sort_values("ds")
        t0, t1 = g["t"].min(), g["t"].max()

        def feats(ds, t):
            ds = pd.to_datetime(pd.Series(ds))
            hol_cols = np.column_stack([[int((d + pd.Timedelta(days=o)).date() in hset) for d in ds]
                                        for o in (1, 0, -1)])
            day = (ds - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
            return fourier.design((np.asarray(t, float) - t0) / (t1 - t0), day, hol_cols)

        x = feats(g["ds"], g["t"])
        z = np.log(g["y"].to_numpy())
        beta = plain_sparse(x, z)
        fut = pd.date_range(pd.Timestamp(g["ds"].max()) + pd.Timedelta(days=1), periods=10, freq="D")
        tf = (fut - pd.Timestamp("2000-01-01")).days.to_numpy(float)
        exp = np.exp(feats(fut, tf) @ beta)
        own = got[got.hospital == site]
        assert own["yhat"].to_numpy() == pytest.approx(exp, rel=1e-6)
        assert set(own["active_knots"]) == {int((np.abs(beta[2:2 + fourier.N_KNOTS]) > 0).sum())} and own["active_knots"].iloc[0] < 15
        width = np.log(own["yhat_upper"] / own["yhat_lower"]).to_numpy()
        assert (np.diff(width) > 0).all()


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(k=np.arange(300))
    out = ml.pca2(spark.createDataFrame(pdf), list("abcd"), "k").toPandas().sort_values("k")
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    comps = vt[:2].T
    comps = comps * np.where(comps[np.abs(comps).argmax(0), range(2)] >= 0, 1, -1)
    exp = z @ comps
    assert out[["pca1", "pca2"]].to_numpy() == pytest.approx(exp, abs=1e-6)
    evr = s ** 2 / (s ** 2).sum()
    assert out["evr1"].iloc[0] == pytest.approx(evr[0], abs=1e-9)


def test_total_surge_days_is_sum_of_summary(spark):
    """Total forecast surge days equals the sum over the per-site summary."""
    summ = surge.q_surge_summary(spark, SF_SMALL)
    total = summ.agg(F.sum("surge_days")).first()[0]
    assert total == surge.q_surge_days(spark, SF_SMALL).count()


def test_rolling_origins_equal_separate_fits(spark):
    """One scan for all cut-offs gives what fits on the cut histories give, for both models."""
    v = surge._visits(spark, "/root/testdata/sf0.01")
    hol = dims.HOLIDAY_RULES
    h = prepare_history(v, hol).where("hospital IN ('ASIA', 'EUROPE')").persist()
    for rolling, fit in ((forecast.rolling_backtest, lambda x: forecast.forecast(forecast.fit_seasonal_index(x), hol, 40)),
                         (fourier.rolling_fourier, lambda x: fourier.forecast_fourier(x, hol, 60))):
        got = rolling(h, hol, origins=3, every=20, periods=15).orderBy("hospital", "origin").collect()
        assert len(got) == 6
        for r in got:
            own = h.where((F.col("hospital") == r.hospital))
            past = own.where(F.col("ds") <= F.lit(r.last_date))
            days = {x.ds: x.y for x in own.collect()}
            fc = {x.ds: x for x in fit(past).collect() if 0 < (x.ds - r.last_date).days <= 15 and x.ds in days}
            assert r.n_test == len(fc) and r.mae == pytest.approx(np.mean([abs(days[d] - x.yhat) for d, x in fc.items()]), rel=1e-6)


@pytest.mark.parametrize("days", [7, 30, 60])
def test_interval_coverage_at_horizons(spark, days):
    """The interval holds about nine of ten days at all horizons and widens with them."""
    h = prepare_history(surge._visits(spark, "/root/testdata/sf0.01"), dims.HOLIDAY_RULES)
    bt = forecast.backtest(h, dims.HOLIDAY_RULES, days).agg(F.sum(F.col("coverage") * F.col("n_test")) / F.sum("n_test")).first()[0]
    assert 0.8 <= bt <= 0.98
    fc = forecast.forecast(forecast.fit_seasonal_index(h), dims.HOLIDAY_RULES, days)
    wide = fc.where("hospital = 'ASIA'").select("days_ahead", (F.col("yhat_upper") - F.col("yhat_lower")).alias("w")).collect()
    assert max(wide, key=lambda r: r.days_ahead).w > min(wide, key=lambda r: r.days_ahead).w


def test_training_rows_fill_the_cores_and_no_more(spark, monkeypatch):
    """Beyond a partition per core more of them only add tasks to the jobs of every round."""
    seen = []
    monkeypatch.setattr(ml, "FIT_ROWS", 10)
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or self)
    for n in (25, 4000):
        ml.fit_gbt(spark.range(n).withColumn("y", F.col("id") % 2), ["id"], "y")
    assert seen == [3, spark.sparkContext.defaultParallelism]
    assert ml.fit_partitions(0, 6) == 1 and ml.fit_partitions(7_200_000, 6) == 18


def test_model_rows_are_made_once(spark):
    """What follows the encoding reads written rows and not the tables, and the split's cut is not looked for again."""
    split = alc.model_input(spark, SF_SMALL)
    assert not split.inputFiles()
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    want = {r.patient_id: r.is_test for r in alc.q_split_members(spark, SF_SMALL).collect()}
    assert {r.patient_id: r.is_test for r in split.collect()} == want
