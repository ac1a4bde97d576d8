"""Edges the fixtures do not reach: unknown keys, small sites, far years, part files, changed files."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wardwise.functions.columns import band
from wardwise.functions.rules import alc_risk_score, alc_tier, horizon_tier, surge_risk_score
from wardwise.operators.iforest import fit_iforest, grow, tree_samples
from wardwise.operators.joins import with_holiday, with_holiday_window
from wardwise.plans import registry
from wardwise.sources import dims
from wardwise.sources.bindings import admission_rules, admissions, table
from wardwise.sources.validate import validate
from wardwise.streaming import jobs


def copy_tables(spark, names, change=None, files=1):
    """The named small tables in a new folder, ``change`` applied to each frame."""
    to = tempfile.mkdtemp(prefix="wardwise-tables-")
    for name in names:
        df = table(spark, SF_SMALL, name)
        df = change(name, df) if change else df
        df.repartition(files).write.parquet(os.path.join(to, f"{name}.parquet"))
    return to


SITES = ["region", "nation", "customer"]


def test_null_has_no_tier_or_band(spark):
    df = spark.createDataFrame([(None,), (12,), (5,), (0,)], "n int")
    assert [r[0] for r in df.select(horizon_tier("n")).collect()] == [None, "HIGH", "MEDIUM", "LOW"]
    assert [r[0] for r in df.select(band("n", 10, 4)).collect()] == [None, "red", "orange", "green"]


def test_unknown_diagnosis_has_no_score(spark):
    a = admissions(spark, SF_SMALL).limit(5).withColumn("diagnosis", F.lit("Broken Heart"))
    for r in alc_tier(alc_risk_score(a)).collect():
        assert (r.alc_risk_score, r.risk_level, r.recommendation) == (None, None, None)


def test_small_site_scores_are_not_inverted(spark):
    df = spark.createDataFrame([(2.5, 3, 4), (2.5, 3, 3), (1.7, 1, 2), (1.7, 1, 1), (4.0, 4, 5), (4.0, 4, 4), (100.0, 125, 120)],
                               "base double, surge_threshold long, predicted_visits long")
    got = [(r.surge_flag, r.surge_risk_score, r.risk_level) for r in surge_risk_score(df).orderBy("base", "predicted_visits").collect()]
    assert got == [(False, 0.0, "LOW"), (True, 1.0, "HIGH"), (False, 1.0, "HIGH"), (True, 1.0, "HIGH"),
                   (False, 0.0, "LOW"), (True, 1.0, "HIGH"), (False, 0.8, "HIGH")]


def test_holidays_in_any_year_and_by_table(spark):
    days = spark.createDataFrame([(datetime.date(y, 12, 25),) for y in (1850, 2024, 2101, 2999)], "d date")
    assert [r.is_holiday for r in with_holiday(days, dims.HOLIDAY_MONTH_DAYS, "d").collect()] == [1, 1, 1, 1]
    moving = dims.holidays_on(spark, ["2024-05-20", datetime.date(2024, 10, 14)])
    near = spark.createDataFrame([(datetime.date(2024, 5, d),) for d in (18, 19, 20, 21, 22)], "d date")
    got = {r.d.day: (r.hol_m1, r.hol_0, r.hol_p1, r.in_window) for r in with_holiday_window(near, moving, "d").collect()}
    assert got == {18: (0, 0, 0, 0), 19: (1, 0, 0, 1), 20: (0, 1, 0, 1), 21: (0, 0, 1, 1), 22: (0, 0, 0, 0)}
    span = spark.sql("SELECT explode(sequence(DATE'2022-12-20', DATE'2023-07-05')) AS d")
    rule = with_holiday_window(span, dims.HOLIDAY_MONTH_DAYS, "d")
    assert rule.exceptAll(with_holiday_window(span, dims.holidays(spark, 2021, 2024), "d").select(rule.columns)).isEmpty()


@pytest.mark.parametrize("rows", [700, 9_000])
def test_forest_samples_the_whole_table_at_any_size(spark, rows):
    """Trees draw from all rows by one rule: small tables whole, large ones at a rate."""
    df = spark.range(rows).select("id", (F.col("id") * 1.0).alias("x"), F.rand(3).alias("y"))
    one = fit_iforest(df, ["x", "y"], "id", trees=20, psi=64)
    two = fit_iforest(df.repartition(7), ["x", "y"], "id", trees=20, psi=64)
    assert (one["size"][:, 1] == 64).all() and (one["threshold"] == two["threshold"]).all()
    cuts = one["threshold"][one["feature"] == 0]
    assert cuts.min() < 0.1 * rows and cuts.max() > 0.9 * rows


def test_forest_grows_on_one_exchange(spark):
    """Sampling deals the rows by tree; no level deals them anew."""
    df = spark.range(3000).select("id", (F.col("id") % 50 * 1.0).alias("x"), F.rand(3).alias("y"))
    sample = tree_samples(df, ["x", "y"], "id", 3000, 20, 64, 42)
    nodes = grow(sample, 2, 6, 42)
    plan = nodes._jdf.queryExecution().sparkPlan().toString() + nodes._jdf.queryExecution().executedPlan().toString()
    executed = nodes._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning(tree") <= 2 and "Window" in plan
    by_tree = {}
    for n in nodes.collect():
        by_tree.setdefault(n.tree, {})[n.node] = n
    for tree in by_tree.values():
        assert tree[1].size == 64
        for k, n in tree.items():
            if n.feature >= 0:
                assert tree[2 * k].size + tree[2 * k + 1].size == n.size and tree[2 * k].size and tree[2 * k + 1].size
            else:
                assert 2 * k not in tree


def unknown_customers(name, df):
    return df if name != "orders" else df.unionByName(df.limit(10).withColumns({"o_orderkey": F.col("o_orderkey") + 10**9, "o_custkey": F.lit(10**9)}))


def test_scored_and_rejected_are_all_rows(spark):
    """Orders of unknown customers, in a folder of part files read one by one."""
    to = copy_tables(spark, [*SITES, "orders"], unknown_customers, files=3)
    scored, rejected = jobs.score_admissions(spark, to, max_files=1)
    n = table(spark, to, "orders").count()
    assert (scored.count(), rejected.count()) == (n - 10, 10)
    assert {tuple(r.violations) for r in rejected.collect()} == {("hospital",)}
    assert all(len(r.top_factors) == dims.TOP_FACTORS for r in scored.limit(20).collect())
    batch = validate(admissions(spark, to), admission_rules(spark, to))
    assert batch.where(F.size("violations") > 0).count() == 10


def test_a_sink_is_resumed_and_an_empty_source_has_sinks(spark):
    to = copy_tables(spark, [*SITES, "orders"])
    out = tempfile.mkdtemp(prefix="wardwise-sink-")
    first = jobs.score_admissions(spark, to, out)[0].count()
    table(spark, SF_SMALL, "orders").limit(7).write.mode("append").parquet(f"{to}/orders.parquet")
    assert jobs.score_admissions(spark, to, out)[0].count() == first + 7
    empty = copy_tables(spark, [*SITES, "orders"], lambda n, df: df.limit(0) if n == "orders" else df)
    assert [x.count() for x in jobs.score_admissions(spark, empty)] == [0, 0]


def test_daily_volume_does_not_depend_on_files(spark):
    want = {tuple(r) for r in jobs.stream_daily_volume(spark, SF_SMALL).collect()}
    to = tempfile.mkdtemp(prefix="wardwise-events-")
    events = table(spark, SF_SMALL, "events")
    for part in range(5, 0, -1):  # newest first
        lo, hi = [events.selectExpr(f"percentile_approx(ts, {q})").first()[0] for q in ((part - 1) / 5, part / 5)]
        keep = (F.col("ts") > lo) if part > 1 else F.lit(True)
        events.where(keep & (F.col("ts") <= hi)).coalesce(1).write.mode("append").parquet(f"{to}/events.parquet")
    assert table(spark, to, "events").count() == events.count()
    assert {tuple(r) for r in jobs.stream_daily_volume(spark, to).collect()} == want
    _, late = jobs.count_volume(spark, to, max_files=1)
    assert late > 0  # file by file, late rows are counted


def test_a_replaced_file_changes_the_answer(spark):
    names = ["region", "nation", "supplier", "lineitem"]
    to = copy_tables(spark, names)
    before = {r[0] for r in registry.queries()["distinct_sites"](spark, to).collect()}
    table(spark, SF_SMALL, "region").withColumn("r_name", F.concat(F.lit("NEW "), "r_name")).write.mode("overwrite").parquet(f"{to}/region.parquet")
    after = {r[0] for r in registry.queries()["distinct_sites"](spark, to).collect()}
    assert after == {f"NEW {x}" for x in before}
