"""ED surge queries: visits, calendar features, seasonality, forecast, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardwise.functions.columns import pct_text, r6
from wardwise.functions.rules import (expected_volume, flag_surge, predicted_visits, surge_report, surge_risk_score,
                                      surge_threshold)
from wardwise.operators import forecast as fcast
from wardwise.operators.joins import reindex, scalar, with_holiday, with_holiday_window
from wardwise.operators.ordering import top_n_per_group
from wardwise.sources import dims
from wardwise.sources.bindings import ed_visits, site_type, surge_inputs
from wardwise.sources.validate import validate


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    return ed_visits(spark, sf)


def _holidays(v: DataFrame) -> list:
    """The ten statutory holidays by rule, valid in every year of the data and the horizon."""
    return dims.HOLIDAY_RULES


def q_surge_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Actual-day surge flag per (day, site)."""
    v = flag_surge(_visits(spark, sf))
    return v.select("visit_date", "hospital", "ed_visits", "surge_threshold", "surge_flag")


def q_calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    """P2 + X1-X3: calendar parts and names of each visit day."""
    v = _visits(spark, sf)
    d = F.col("visit_date")
    return v.select("visit_date", "hospital", "ed_visits",
                    F.year(d).alias("year"), F.month(d).alias("month"),
                    F.weekday(d).alias("weekday"),
                    F.date_format(d, "MMM").alias("month_name"),
                    F.date_format(d, "E").alias("day_name"),
                    F.date_format(d, "yyyy-MM-dd").alias("iso_date"),
                    F.date_format(d, "MMMM dd, yyyy").alias("long_date"),
                    F.last_day(d).alias("month_end"))


def q_holiday_flag(spark: SparkSession, sf: str) -> DataFrame:
    """Holiday membership of each visit day."""
    v = _visits(spark, sf)
    return with_holiday(v, _holidays(v), "visit_date").select("visit_date", "hospital", "ed_visits", "is_holiday")


def q_holiday_window(spark: SparkSession, sf: str) -> DataFrame:
    """-1 / 0 / +1 day holiday indicators of each visit day."""
    v = _visits(spark, sf)
    return with_holiday_window(v, _holidays(v), "visit_date").select(
        "visit_date", "hospital", "hol_m1", "hol_0", "hol_p1", "in_window")


def q_monthly_trend(spark: SparkSession, sf: str) -> DataFrame:
    """A1: monthly mean of daily visits per site, labelled by month end.

    Months with no visit day inside a site's range appear with a null mean
    (pandas ``resample`` emits them as NaN): a month spine per site from
    its first to its last month, left-joined to the aggregate.
    """
    return _monthly(_visits(spark, sf))


def _monthly(v: DataFrame) -> DataFrame:
    agg = v.groupBy("hospital", F.last_day("visit_date").alias("month_end")).agg(
        F.avg("ed_visits").alias("avg_visits"), F.max("surge_threshold").alias("surge_threshold"))
    rng = agg.groupBy("hospital").agg(F.min("month_end").alias("m0"), F.max("month_end").alias("m1"),
                                      F.max("surge_threshold").alias("thr"))
    spine = rng.select("hospital", "thr", F.explode(
        F.sequence(F.trunc("m0", "month"), F.trunc("m1", "month"), F.expr("interval 1 month"))).alias("m"))
    spine = spine.select("hospital", "thr", F.last_day("m").alias("month_end"))
    return (spine.join(agg.drop("surge_threshold"), ["hospital", "month_end"], "left")
            .select("hospital", "month_end", r6("avg_visits").alias("avg_visits"),
                    F.col("thr").alias("surge_threshold")))


def q_seasonality_month(spark: SparkSession, sf: str) -> DataFrame:
    """A2 + J4 + P11: mean visits by month over all sites, Jan..Dec, winter band."""
    v = _visits(spark, sf)
    agg = v.groupBy(F.month("visit_date").alias("month")).agg(F.avg("ed_visits").alias("avg_visits"))
    out = reindex(agg, dims.month_dim(spark).select("month", "month_abbr"), "month", "month")
    return out.select("month", F.col("month_abbr").alias("month_name"), r6("avg_visits").alias("avg_visits"),
                      F.when(F.col("month").isin(*dims.WINTER_MONTHS), "winter").otherwise("other").alias("band"))


def q_seasonality_dow(spark: SparkSession, sf: str) -> DataFrame:
    """A3 + J4 + P11: mean visits by weekday, Mon..Sun, band Mon/Fri high, Sat/Sun low."""
    v = _visits(spark, sf)
    agg = v.groupBy(F.weekday("visit_date").alias("weekday")).agg(F.avg("ed_visits").alias("avg_visits"))
    out = reindex(agg, dims.dow_dim(spark).select("weekday", "day_abbr"), "weekday", "weekday")
    return out.select("weekday", F.col("day_abbr").alias("day_name"), r6("avg_visits").alias("avg_visits"),
                      F.when(F.col("weekday").isin(*dims.BUSY_WEEKDAYS), "high")
                      .when(F.col("weekday").isin(*dims.QUIET_WEEKDAYS), "low")
                      .otherwise("normal").alias("band"))


def q_profile_visits(spark: SparkSession, sf: str) -> DataFrame:
    """A4: dataset profile of the daily visits."""
    v = flag_surge(_visits(spark, sf))
    return v.agg(F.min("visit_date").alias("min_date"), F.max("visit_date").alias("max_date"),
                 F.countDistinct("hospital").alias("n_sites"), F.count(F.lit(1)).alias("n_rows"),
                 F.sum("surge_flag").cast("bigint").alias("surge_days"),
                 r6(F.avg("surge_flag")).alias("surge_share"))


def q_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted mean of per-month means vs the overall mean."""
    v = _visits(spark, sf)
    per_month = v.groupBy(F.month("visit_date").alias("month")).agg(F.avg("ed_visits").alias("m"))
    per_dow = v.groupBy(F.weekday("visit_date").alias("weekday")).agg(F.avg("ed_visits").alias("m"))
    overall = v.agg(F.avg("ed_visits").alias("overall_mean"))
    a = per_month.agg(F.avg("m").alias("month_mean_of_means"))
    b = per_dow.agg(F.avg("m").alias("dow_mean_of_means"))
    return overall.select(
        r6("overall_mean").alias("overall_mean"),
        r6(scalar(a)["month_mean_of_means"]).alias("month_mean_of_means"),
        r6(scalar(b)["dow_mean_of_means"]).alias("dow_mean_of_means"))


def q_distinct_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct site names (filter choices)."""
    return _visits(spark, sf).select("hospital").distinct()


def q_last_90_days(spark: SparkSession, sf: str) -> DataFrame:
    """The last 90 observed days per site (top-n per group)."""
    v = _visits(spark, sf)
    last = top_n_per_group(v, ["hospital"], [F.col("visit_date").desc()], dims.HISTORY_TAIL)
    return last.select("hospital", "visit_date", "ed_visits", "rn")


def q_hospital_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Site listing with base, threshold and the constant region/province."""
    v = _visits(spark, sf)
    s = v.groupBy("hospital").agg(F.first("base").alias("base"))
    return s.select("hospital", site_type().alias("type"), r6("base").alias("base"),
                    surge_threshold("base").alias("surge_threshold"),
                    F.lit(dims.REGION_NAME).alias("region"), F.lit(dims.PROVINCE_NAME).alias("province"))


def _rule_inputs(spark: SparkSession, sf: str) -> DataFrame:
    v = _visits(spark, sf)
    v = with_holiday(v, _holidays(v), "visit_date")
    return v.withColumn("weekday", F.weekday("visit_date")).withColumn("month", F.month("visit_date"))


def q_surge_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """D6 on every observed (day, site): rule-based predicted visits."""
    p = predicted_visits(_rule_inputs(spark, sf))
    return p.select("visit_date", "hospital", "ed_visits", "surge_threshold", "predicted_visits")


def q_surge_risk_score(spark: SparkSession, sf: str) -> DataFrame:
    """D7 on every observed (day, site): score, flag, tier, capacity text."""
    p = surge_risk_score(predicted_visits(_rule_inputs(spark, sf)))
    return p.select("visit_date", "hospital", "predicted_visits", "surge_threshold",
                    r6(F.bround("surge_risk_score", 4)).alias("surge_risk_score"),
                    "surge_flag", "risk_level",
                    pct_text("capacity_pct").alias("capacity_pct"),
                    pct_text(F.col("surge_risk_score") * 100.0).alias("surge_risk_pct"))


def q_surge_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Rule outcome over every (site, weekday, month, holiday) input.

    Sites and their bases come from the data; the grid is #sites x 168 rows.
    """
    v = _visits(spark, sf)
    sites = v.groupBy("hospital").agg(F.first("base").alias("base"))
    grid = (sites.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
            .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .withColumn("is_holiday", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    p = surge_risk_score(predicted_visits(grid))
    return p.select("hospital", "weekday", "month", "is_holiday", "predicted_visits", "surge_threshold",
                    r6(F.bround("surge_risk_score", 4)).alias("surge_risk_score"), "surge_flag", "risk_level")


def q_expected_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic expected volume on each observed (day, site)."""
    p = expected_volume(_rule_inputs(spark, sf))
    return p.select("visit_date", "hospital", "ed_visits", r6("expected_visits").alias("expected_visits"))


# --------------------------------------------------------------------------- forecasting

def _model(spark: SparkSession, sf: str):
    v = _visits(spark, sf)
    hol = _holidays(v)
    h = fcast.prepare_history(v, hol)
    return h, hol, fcast.fit_seasonal_index(h)


def q_seasonal_index(spark: SparkSession, sf: str) -> DataFrame:
    """fitted per-site trend, indices and residual std (long form, one pass)."""
    _, _, m = _model(spark, sf)
    none = F.lit(None).cast("double")

    def row(component, k, value, value2):
        return F.struct(F.lit(component).alias("component"), k.cast("int").alias("k"),
                        value.alias("value"), value2.alias("value2"))

    rows = F.concat(
        F.array(row("trend", F.lit(0), F.col("slope"), F.col("intercept")),
                row("site", F.lit(0), F.col("holiday_idx"), F.col("resid_sd"))),
        F.transform("dow_idx", lambda v, i: row("weekday", i, v, none)),
        F.transform("month_idx", lambda v, i: row("month", i + 1, v, none)))
    out = m.select("hospital", F.inline(rows))
    out = out.filter(F.col("value").isNotNull() | (F.col("component") == "site"))
    return out.select("hospital", "component", "k", r6("value").alias("value"), r6("value2").alias("value2"))


def q_surge_forecast(spark: SparkSession, sf: str, periods: int = dims.FORECAST_DAYS) -> DataFrame:
    """30-day forecast with 90% interval for every site."""
    _, hol, m = _model(spark, sf)
    fc = fcast.forecast(m, hol, periods)
    return fc.select("hospital", "ds", r6("yhat").alias("yhat"), r6("yhat_lower").alias("yhat_lower"),
                     r6("yhat_upper").alias("yhat_upper"))


def flagged_forecast(spark: SparkSession, sf: str, periods: int = dims.FORECAST_DAYS) -> DataFrame:
    _, hol, m = _model(spark, sf)
    return fcast.flag_forecast(fcast.forecast(m, hol, periods))


def q_combined_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """U1 + F3: all sites' flagged forecasts as one table."""
    fc = flagged_forecast(spark, sf)
    return fc.select("ds", r6("yhat").alias("yhat"), r6("yhat_lower").alias("yhat_lower"),
                     r6("yhat_upper").alias("yhat_upper"), "hospital", "surge_threshold", "surge_flag")


def q_surge_days(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast days above the site threshold."""
    fc = flagged_forecast(spark, sf)
    return fc.filter(F.col("yhat") > F.col("surge_threshold")).select(
        "hospital", "ds", r6("yhat").alias("yhat"), "surge_threshold")


def q_surge_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A15 (flagship): per-site 30-day surge summary with risk tier and site type."""
    return _summary(flagged_forecast(spark, sf))


def _summary(flagged: DataFrame) -> DataFrame:
    s = fcast.surge_summary(flagged)
    return s.select("hospital", site_type().alias("type"), *s.columns[1:]).orderBy(
        F.col("surge_days").desc(), F.col("avg_forecast").desc(), "hospital")


SENSITIVE = 1.12  # a threshold near the mean: days above it, first dates and all horizon tiers occur


def _sensitive(spark: SparkSession, sf: str) -> DataFrame:
    _, hol, m = _model(spark, sf)
    return fcast.flag_forecast(fcast.forecast(m, hol, dims.FORECAST_DAYS), SENSITIVE)


def q_surge_summary_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    """A15 + D8 at a lower threshold."""
    return _summary(_sensitive(spark, sf))


def q_surge_days_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    """P6 + F3 at a lower threshold: the flagged forecast days."""
    return _sensitive(spark, sf).where("surge_flag").select("hospital", "ds", r6("yhat").alias("yhat"), "surge_threshold")


def q_monthly_trend_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """A1 where some months have no visit days: they appear with a null mean."""
    return _monthly(_visits(spark, sf).where(~F.month("visit_date").isin(4, 9)))


def q_validate_surge_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """S5 on requests for a surge estimate: month, day name and site; rows per failed rule."""
    sites = _visits(spark, sf).select("hospital").distinct()
    rules = {"month": (1, 12), "day_name": dims.DAY_NAMES, "hospital": sites}
    checked = validate(surge_inputs(spark, sf), rules)
    failed = F.when(F.size("violations") == 0, F.array(F.lit("valid"))).otherwise(F.col("violations"))
    return checked.select(F.explode(failed).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def q_surge_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nested response over every (site, weekday, month, holiday) input."""
    v = _visits(spark, sf)
    sites = v.groupBy("hospital").agg(F.first("base").alias("base"))
    grid = (sites.withColumn("weekday", F.explode(F.sequence(F.lit(0), F.lit(6))))
            .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
            .withColumn("is_holiday", F.explode(F.sequence(F.lit(0), F.lit(1)))))
    names = F.element_at(F.array(*[F.lit(d) for d in dims.DAY_NAMES]), F.col("weekday") + 1)
    return surge_report(surge_risk_score(predicted_visits(grid)).withColumn("day_name", names))


def q_forecast_backtest(spark: SparkSession, sf: str) -> DataFrame:
    """hold out 30 days per site; MAE, MAPE and interval coverage."""
    v = _visits(spark, sf)
    hol = _holidays(v)
    h = fcast.prepare_history(v, hol)
    bt = fcast.backtest(h, hol, dims.FORECAST_DAYS)
    return bt.select("hospital", "n_test", r6("mae").alias("mae"), r6("mape").alias("mape"),
                     r6("coverage").alias("coverage"))


def q_surge_forecast_fourier(spark: SparkSession, sf: str, periods: int = dims.FORECAST_DAYS) -> DataFrame:
    """sparse piecewise-trend + Fourier + holiday forecast on log visits."""
    from wardwise.operators.fourier import forecast_fourier

    v = _visits(spark, sf)
    hol = _holidays(v)
    fc = forecast_fourier(fcast.prepare_history(v, hol), hol, periods)
    return fc.select("hospital", "ds", r6("yhat").alias("yhat"), r6("yhat_lower").alias("yhat_lower"),
                     r6("yhat_upper").alias("yhat_upper"), "active_knots")


def q_fourier_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """F5 for F4: six cut-offs a month apart, their normal equations from one scan."""
    from wardwise.operators.fourier import rolling_fourier

    v = _visits(spark, sf)
    hol = _holidays(v)
    bt = rolling_fourier(fcast.prepare_history(v, hol), hol)
    return bt.select("hospital", "origin", "last_date", "n_test", r6("mae").alias("mae"), r6("mape").alias("mape"),
                     r6("coverage").alias("coverage"), r6("width").alias("width"))


def q_seasonal_index_dense(spark: SparkSession, sf: str) -> DataFrame:
    """F1 with ``densify``: days without rows count as zero visits."""
    v = _visits(spark, sf)
    hol = _holidays(v)
    m = fcast.fit_cells(fcast.dense_cell_sums(fcast.prepare_history(v, hol), hol))
    return m.select("hospital", "n_days", r6("base").alias("base"), r6("slope").alias("slope"),
                    r6("intercept").alias("intercept"), r6("holiday_idx").alias("holiday_idx"),
                    r6("resid_sd").alias("resid_sd"))


def q_forecast_horizon_width(spark: SparkSession, sf: str) -> DataFrame:
    """half-width of the interval 7, 30 and 60 days ahead, which grows with the horizon."""
    _, hol, m = _model(spark, sf)
    fc = fcast.forecast(m, hol, 60).where(F.col("days_ahead").isin(7, 30, 60))
    return fc.select("hospital", "ds", "days_ahead", r6("yhat").alias("yhat"),
                     r6((F.col("yhat_upper") - F.col("yhat_lower")) / 2).alias("half_width"))


def q_forecast_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """F5 with rolling origins: six cut-offs a month apart, all from one scan of the history."""
    v = _visits(spark, sf)
    hol = _holidays(v)
    bt = fcast.rolling_backtest(fcast.prepare_history(v, hol), hol)
    return bt.select("hospital", "origin", "last_date", "n_test", r6("mae").alias("mae"), r6("mape").alias("mape"),
                     r6("coverage").alias("coverage"), r6("width").alias("width"))


QUERIES = {
    "surge_flag": q_surge_flag,
    "calendar_features": q_calendar_features,
    "holiday_flag": q_holiday_flag,
    "holiday_window": q_holiday_window,
    "monthly_trend": q_monthly_trend,
    "seasonality_month": q_seasonality_month,
    "seasonality_dow": q_seasonality_dow,
    "profile_visits": q_profile_visits,
    "mean_of_means": q_mean_of_means,
    "distinct_sites": q_distinct_sites,
    "last_90_days": q_last_90_days,
    "hospital_reference": q_hospital_reference,
    "surge_predicted": q_surge_predicted,
    "surge_risk_score": q_surge_risk_score,
    "surge_grid": q_surge_grid,
    "expected_volume": q_expected_volume,
    "seasonal_index": q_seasonal_index,
    "surge_forecast": q_surge_forecast,
    "combined_forecast": q_combined_forecast,
    "surge_days": q_surge_days,
    "surge_summary": q_surge_summary,
    "surge_summary_sensitive": q_surge_summary_sensitive,
    "surge_days_sensitive": q_surge_days_sensitive,
    "monthly_trend_gaps": q_monthly_trend_gaps,
    "validate_surge_inputs": q_validate_surge_inputs,
    "surge_report": q_surge_report,
    "forecast_backtest": q_forecast_backtest,
    "seasonal_index_dense": q_seasonal_index_dense,
    "forecast_horizon_width": q_forecast_horizon_width,
    "forecast_rolling": q_forecast_rolling,
    "surge_forecast_fourier": q_surge_forecast_fourier,
    "fourier_rolling": q_fourier_rolling,
}
