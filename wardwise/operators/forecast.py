"""Forecasting (F1-F5): seasonal-index model, n-day forecast, flags, back-test.

The reference fits one model per site in a Python loop. Here all sites are
fitted in one plan, built on sufficient statistics:

1. The daily history is reduced to *cells* (site, year, weekday, month,
   in-holiday-window) holding n, sum y, sum t, sum t^2, sum t*y, sum y^2.
   That is one grouped aggregate with partial aggregation; a site has at
   most 7 x 12 x 2 = 168 cells a year.
2. Trend, weekday / month / holiday indices and the residual variance are
   closed-form functions of the cell sums, computed with windows over a
   site's cells (168 rows a year) and one grouped aggregate that needs
   no further shuffle.
3. The model is one row per site (weekday and month indices as arrays), so
   the forecast spine is a per-site ``explode`` with no join.

Model (multiplicative): yhat(d) = (a + b t) x D[weekday] x M[month] x
(H if d is in a holiday window), t = days since 2000-01-01, (a, b) the
least-squares trend, D / M = group mean / site mean, H = sum of y / sum of the
non-holiday fit over holiday-window days.

Interval: yhat -/+ z(0.95) x sqrt(s^2 + (D M H)^2 v h^3 / 3), with s the
population std of the in-sample residuals, h the days since the last observed
one, and v the variance of slope changes a day. The slope is taken to change
at random times as it did between the observed years: v is the mean square of
the differences between the least-squares slopes of consecutive years (of 300
observed days or more), a year long; a change s days ahead moves the trend of
day h by h - s, and the square of that, summed over s, is h^3 / 3.

Because every step needs sums only, several fits come from one scan: cells of
parts of the history add up to the cells of every longer history (rolling
origins), and days without rows count as zero visits (``densify``) by adding a
generated calendar's n, sum t and sum t^2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardwise.functions.rules import horizon_tier, surge_threshold
from wardwise.operators.joins import bounded_broadcast, with_holiday_window
from wardwise.sources import dims

ORIGIN = "2000-01-01"
Z90 = 1.6448536269514722  # two-sided 90% interval


def prepare_history(hist: DataFrame, holidays: DataFrame | list, site: str = "hospital",
                    date: str = "visit_date", y: str = "ed_visits") -> DataFrame:
    """P1 + P2: (site, ds, y) with day number, calendar parts and holiday window."""
    h = hist.select(F.col(site).alias("hospital"), F.col(date).alias("ds"), F.col(y).cast("double").alias("y"))
    h = (h.withColumn("t", F.datediff("ds", F.lit(ORIGIN)))
         .withColumn("weekday", F.weekday("ds"))
         .withColumn("month", F.month("ds")))
    return with_holiday_window(h, holidays, "ds").drop("hol_m1", "hol_0", "hol_p1")


SUMS = ["n", "sy", "st", "stt", "sty", "syy"]
CELL = ["year", "weekday", "month", "in_window"]
FULL_YEAR = 300  # observed days from which a year's slope counts


def cell_sums(h: DataFrame, by: Sequence[str] = ("hospital",)) -> DataFrame:
    """Step 1: sufficient statistics per (``by``, year, weekday, month, in_window)."""
    t, y = F.col("t").cast("double"), F.col("y")
    return h.groupBy(*by, F.year("ds").alias("year"), "weekday", "month", "in_window").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("sy"), F.sum(t).alias("st"),
        F.sum(t * t).alias("stt"), F.sum(t * y).alias("sty"), F.sum(y * y).alias("syy"),
        F.max("ds").alias("last"))


def dense_cell_sums(h: DataFrame, holidays: DataFrame | list) -> DataFrame:
    """Step 1 with zero visits on the days between a site's first and last that have no row.

    Such a day adds nothing to the sums of y, so the sums of t come from a
    generated calendar and those of y from the rows; no day is joined.
    """
    spine = h.groupBy("hospital").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    days = prepare_history(spine.select("hospital", F.explode(F.sequence("a", "b")).alias("visit_date"),
                                        F.lit(0).alias("ed_visits")), holidays)
    of_days = cell_sums(days).withColumns({c: F.lit(0.0) for c in ("sy", "sty", "syy")})
    of_rows = cell_sums(h).withColumns({c: F.lit(0.0) for c in ("n", "st", "stt")})
    return of_days.unionByName(of_rows).groupBy("hospital", *CELL).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("last").alias("last"))


def fit_seasonal_index(h: DataFrame) -> DataFrame:
    """one model row per site."""
    return fit_cells(cell_sums(h))


def fit_cells(cells: DataFrame, by: Sequence[str] = ("hospital",)) -> DataFrame:
    """F1 from cells: one model row per ``by`` group (a site, or a site and an origin).

    Columns: ``by``, n_days, base, slope, intercept, holiday_idx, resid_sd, slope_var,
    last_date, dow_idx (array of 7, Monday first), month_idx (array of 12).
    Three projections (one per window level) and one grouped aggregate.
    """
    keep = [*CELL, *SUMS, "last"]
    site, wd, mo, yr = (Window.partitionBy(*by, *k) for k in ([], ["weekday"], ["month"], ["year"]))
    n, sy, st = F.sum("n").over(site), F.sum("sy").over(site), F.sum("st").over(site)
    stt, sty = F.sum("stt").over(site), F.sum("sty").over(site)
    base = sy / n
    slope = (n * sty - st * sy) / (n * stt - st * st)
    ny, sy_y, st_y, stt_y, sty_y = (F.sum(c).over(yr) for c in ("n", "sy", "st", "stt", "sty"))
    # level 1: site trend, the slope of each year, and the weekday / month indices
    c = cells.select(*by, *keep, n.alias("n_site"), base.alias("base"), slope.alias("slope"),
                     ((sy - slope * st) / n).alias("intercept"),
                     F.when(ny >= FULL_YEAR, (ny * sty_y - st_y * sy_y) / (ny * stt_y - st_y * st_y)).alias("slope_y"),
                     (F.sum("sy").over(wd) / F.sum("n").over(wd) / base).alias("D"),
                     (F.sum("sy").over(mo) / F.sum("n").over(mo) / base).alias("M"))
    a, b, hol = F.col("intercept"), F.col("slope"), F.col("in_window") == 1
    f0 = F.col("D") * F.col("M") * (a * F.col("n") + b * F.col("st"))  # sum of the non-holiday fit over the cell
    # level 2: holiday index = holiday visits / their non-holiday fit
    hidx = F.coalesce(F.sum(F.when(hol, F.col("sy"))).over(site) / F.sum(F.when(hol, f0)).over(site), F.lit(1.0))
    c = c.select("*", hidx.alias("H"))
    # level 3: residual sums per cell, expanded from the sufficient statistics
    k = F.col("D") * F.col("M") * F.when(hol, F.col("H")).otherwise(F.lit(1.0))
    lin_y = a * F.col("sy") + b * F.col("sty")  # sum (a + b t) y
    lin_sq = a * a * F.col("n") + 2 * a * b * F.col("st") + b * b * F.col("stt")  # sum (a + b t)^2
    c = c.select("*", (F.col("syy") - 2 * k * lin_y + k * k * lin_sq).alias("rss"),
                 (F.col("sy") - k * (a * F.col("n") + b * F.col("st"))).alias("r1"))
    first = ["n_site", "base", "slope", "intercept", "H"]
    agg = c.groupBy(*by).agg(
        *[F.first(x).alias(x) for x in first],
        F.sum("rss").alias("_rss"), F.sum("r1").alias("_r1"), F.max("last").alias("last_date"),
        F.map_from_entries(F.collect_set(F.when(F.col("slope_y").isNotNull(), F.struct("year", "slope_y")))).alias("_years"),
        F.expr("array(" + ", ".join(f"max(CASE WHEN weekday = {i} THEN D END)" for i in range(7)) + ")")
        .alias("dow_idx"),
        F.expr("array(" + ", ".join(f"max(CASE WHEN month = {i} THEN M END)" for i in range(1, 13)) + ")")
        .alias("month_idx"))
    var = F.col("_rss") / F.col("n_site") - (F.col("_r1") / F.col("n_site")) ** 2
    change = F.filter(F.transform(F.map_keys("_years"), lambda y: F.try_element_at("_years", y + 1) - F.element_at("_years", y)),
                      lambda d: d.isNotNull())
    agg = agg.withColumn("_change", change)
    squares = F.aggregate("_change", F.lit(0.0), lambda acc, d: acc + d * d)
    per_day = F.when(F.size("_change") > 0, squares / F.size("_change") / 365.25).otherwise(0.0)
    return agg.select(*by, F.col("n_site").cast("bigint").alias("n_days"), "base", "slope", "intercept",
                      F.col("H").alias("holiday_idx"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("resid_sd"),
                      per_day.alias("slope_var"), "last_date", "dow_idx", "month_idx")


def forecast(model: DataFrame, holidays: DataFrame | list, periods: int = 30,
             by: Sequence[str] = ("hospital",)) -> DataFrame:
    """F2 + P5: ``periods`` days after each model's last observed day.

    The spine is exploded from the one-row-per-site model, so only future
    days exist (P5's 'later than history' cut is built in) and the indices
    are array lookups, not joins.
    """
    if periods < 1:
        raise ValueError("periods must be at least 1")
    spine = model.select(*by, "base", "slope", "intercept", "holiday_idx", "resid_sd", "slope_var", "last_date", "dow_idx",
                         "month_idx", F.explode(F.sequence(F.date_add("last_date", 1),
                                                           F.date_add("last_date", periods))).alias("ds"))
    spine = with_holiday_window(spine, holidays, "ds")
    t = F.datediff("ds", F.lit(ORIGIN))
    dow = F.coalesce(F.element_at("dow_idx", F.weekday("ds") + 1), F.lit(1.0))
    mon = F.coalesce(F.element_at("month_idx", F.month("ds")), F.lit(1.0))
    hol = F.when(F.col("in_window") == 1, F.col("holiday_idx")).otherwise(F.lit(1.0))
    ahead = F.datediff("ds", "last_date").cast("double")
    spine = spine.withColumn("k", dow * mon * hol)
    sd = F.sqrt(F.col("resid_sd") * F.col("resid_sd")
                + F.col("k") * F.col("k") * F.col("slope_var") * ahead * ahead * ahead / 3.0)
    return (spine.withColumn("yhat", (F.col("intercept") + F.col("slope") * t) * F.col("k"))
            .withColumn("yhat_lower", F.col("yhat") - F.lit(Z90) * sd)
            .withColumn("yhat_upper", F.col("yhat") + F.lit(Z90) * sd)
            .select(*by, "ds", ahead.cast("int").alias("days_ahead"), "yhat", "yhat_lower", "yhat_upper", "base"))


def flag_forecast(fc: DataFrame, multiplier: float = dims.SURGE_MULTIPLIER) -> DataFrame:
    """threshold = int(base x multiplier) and flag yhat > threshold."""
    return (fc.withColumn("surge_threshold", surge_threshold("base", multiplier))
            .withColumn("surge_flag", F.col("yhat") > F.col("surge_threshold")))


def surge_summary(fc: DataFrame) -> DataFrame:
    """A15 + D8: per-site summary of a flagged forecast.

    Columns: hospital, avg_forecast (half-even rounded mean), surge_threshold,
    surge_days, risk_level, first_surge_date ('None' when there is none).
    """
    agg = fc.groupBy("hospital").agg(
        F.bround(F.avg("yhat"), 0).cast("bigint").alias("avg_forecast"),
        F.max("surge_threshold").alias("surge_threshold"),
        F.count_if(F.col("surge_flag")).alias("surge_days"),
        F.min(F.when(F.col("surge_flag"), F.col("ds"))).alias("_first"))
    return agg.select(
        "hospital", "avg_forecast", "surge_threshold", "surge_days",
        horizon_tier("surge_days").alias("risk_level"),
        F.coalesce(F.date_format("_first", "yyyy-MM-dd"), F.lit("None")).alias("first_surge_date"))


def backtest(h: DataFrame, holidays: DataFrame | list, holdout: int = 30) -> DataFrame:
    """hold out each site's last ``holdout`` days, fit on the rest, score.

    Returns per site: n, MAE, MAPE (%) and the share of held-out days inside
    the 90% interval. A site's window holds one row per calendar day.
    """
    tagged = h.withColumn("_test", F.col("ds") > F.date_sub(F.max("ds").over(Window.partitionBy("hospital")),
                                                              holdout))
    train = tagged.filter(~F.col("_test")).drop("_test")
    test = tagged.filter(F.col("_test")).select("hospital", "ds", F.col("y").alias("actual"))
    fc = forecast(fit_seasonal_index(train), holidays, periods=holdout)
    j = fc.join(test, ["hospital", "ds"])
    return j.groupBy("hospital").agg(*error_measures())


def error_measures() -> list[Column]:
    """Aggregates of a forecast beside what happened (``actual``): n_test, mae, mape (%), coverage of the interval."""
    err = F.abs(F.col("actual") - F.col("yhat"))
    inside = (F.col("actual") >= F.col("yhat_lower")) & (F.col("actual") <= F.col("yhat_upper"))
    return [F.count(F.lit(1)).alias("n_test"), F.avg(err).alias("mae"),
            F.avg(F.when(F.col("actual") != 0, err / F.col("actual") * 100.0)).alias("mape"),
            F.avg(inside.cast("double")).alias("coverage")]


def cut_offs(h: DataFrame, origins: int, every: int, periods: int) -> DataFrame:
    """(hospital, origin, cut): the last leaves ``periods`` days of a site's history, the others lie ``every`` days apart."""
    ends = h.groupBy("hospital").agg(F.max("ds").alias("end"))
    origin = F.explode(F.sequence(F.lit(0), F.lit(origins - 1)))
    return ends.select("hospital", "end", origin.alias("origin")).select(
        "hospital", "origin", F.date_sub("end", periods + (origins - 1 - F.col("origin")) * every).alias("cut"))


def score_origins(fc: DataFrame, h: DataFrame) -> DataFrame:
    """Error measures per (hospital, origin) of a forecast, on the days that were observed."""
    j = fc.join(h.select("hospital", "ds", F.col("y").alias("actual")), ["hospital", "ds"])
    return j.groupBy("hospital", "origin").agg(
        F.min(F.date_sub("ds", F.col("days_ahead"))).alias("last_date"), *error_measures(),
        F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("width"))


def rolling_backtest(h: DataFrame, holidays: DataFrame | list, origins: int = 6, every: int = 30,
                     periods: int = 30) -> DataFrame:
    """F5 with rolling origins: fits up to each of ``origins`` cut-off days and scores the ``periods`` days after each.

    A day counts for all cut-offs that do not precede it: cells of the parts
    between cut-offs are made in one scan, and each is added to the cut-offs
    from its part on. Returns (hospital, origin, last_date, n_test, mae, mape, coverage, width).
    """
    cuts = bounded_broadcast(cut_offs(h, origins, every, periods).where(F.col("origin") == origins - 1)
                             .select("hospital", F.col("cut").alias("last_cut")))
    back = F.floor(F.datediff("last_cut", "ds") / every)  # cut-offs between a day and the last one
    part = F.when(F.col("ds") > F.col("last_cut"), origins).otherwise(F.greatest(F.lit(0), origins - 1 - back))
    parts = cell_sums(h.join(cuts, "hospital").withColumn("part", part.cast("int")), ["hospital", "part"])
    later = F.filter(F.sequence(F.lit(0), F.lit(origins - 1)), lambda o: o >= F.col("part"))
    by = ["hospital", "origin"]
    cells = parts.withColumn("origin", F.explode(later)).groupBy(*by, *CELL).agg(
        *[F.sum(c).alias(c) for c in SUMS], F.max("last").alias("last"))
    days_back = (origins - 1 - F.col("origin")) * every
    fitted = fit_cells(cells, by).join(cuts, "hospital").withColumn("last_date", F.date_sub("last_cut", days_back))
    return score_origins(forecast(fitted.drop("last_cut"), holidays, periods, by), h)
