"""Domain rule operators D1-D10: pure column expressions, usable on batch and stream.

Each function takes a DataFrame carrying the input columns and returns it
with the derived columns added. Lookups against the literal weight tables are
compiled into ``CASE`` expressions (a 10-entry dictionary does not need a
join), so the whole rule stays inside one whole-stage-codegen span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions.columns import clip, pct_text, trunc_int
from wardwise.sources import dims


def sql_literal(v) -> str:
    """A Python constant as a Spark SQL literal (doubles typed as DOUBLE)."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def case_map(c: Column | str, mapping: dict, default=None) -> Column:
    """Dictionary lookup as one CASE expression (J1 for literal dictionaries).

    With a SQL expression string for ``c`` the whole CASE is parsed JVM-side
    in one call; a Column falls back to chained ``when``.
    """
    if isinstance(c, str):
        arms = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in mapping.items())
        return F.expr(f"CASE {c} {arms} ELSE {sql_literal(default)} END")
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _tier(x: Column, tiers, idx: int) -> Column:
    """Tiers as (min value, fields...) with the last entry as default; >= cut-offs; null has no tier."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for t in tiers[:-1]:
        out = out.when(x >= t[0], F.lit(t[idx]))
    return out.otherwise(F.lit(tiers[-1][idx]))


# --------------------------------------------------------------------------- ALC

def diagnosis_weight(c: str = "diagnosis") -> Column:
    return case_map(f"`{c}`", dims.DIAGNOSIS_RISK, None)


def term_input(name: str) -> Column:
    """Input column of a score term (see dims.ALC_TERMS / ALC_FACTORS)."""
    if name == "age_over_18":
        return F.col("age") - dims.AGE_OFFSET
    if name == "no_caregiver":
        return F.lit(1) - F.col("has_caregiver")
    return F.col(name)


def weighted_terms(terms, diagnosis_weights: dict, unknown: float | None = None) -> list[tuple[str, Column]]:
    """(name, weight x input) for each term, the diagnosis term as a lookup
    (``unknown`` for diagnoses missing from the table)."""
    out = []
    for name, col_name, w in terms:
        expr = (case_map("diagnosis", diagnosis_weights, unknown) if w is None
                else F.lit(w) * term_input(col_name))
        out.append((name, expr))
    return out


def linear_score(diagnosis_weights: dict, unknown: float | None = None) -> Column:
    """Intercept + the ALC terms, summed left to right in their fixed order."""
    total = F.lit(dims.ALC_INTERCEPT)
    for _, expr in weighted_terms(dims.ALC_TERMS, diagnosis_weights, unknown):
        total = total + expr
    return total


def alc_risk_raw(df: DataFrame | None = None) -> Column:
    """Unclipped nine-weight linear score of the online form."""
    return linear_score(dims.DIAGNOSIS_RISK)


def alc_risk_score(df: DataFrame) -> DataFrame:
    """Clipped score, percent, rounded score and percent text."""
    return (df.withColumn("alc_risk_raw", alc_risk_raw())
            .withColumn("alc_risk_score", clip("alc_risk_raw", 0.0, 1.0))
            .withColumn("alc_risk_pct", F.col("alc_risk_score") * 100.0))


def alc_tier(df: DataFrame) -> DataFrame:
    """Tiers on the unrounded percent (>= 60 HIGH, >= 35 MEDIUM)."""
    p = F.col("alc_risk_pct")
    return (df.withColumn("risk_level", _tier(p, dims.ALC_TIERS, 1))
            .withColumn("risk_colour", _tier(p, dims.ALC_TIERS, 2))
            .withColumn("recommendation", _tier(p, dims.ALC_TIERS, 3)))


def alc_factor_values() -> list[Column]:
    """D3: the eight named contributions, rounded half-even to 3 places."""
    return [F.bround(v.cast("double"), 3) for _, v in weighted_terms(dims.ALC_FACTORS, dims.DIAGNOSIS_RISK)]


def alc_factors(df: DataFrame) -> DataFrame:
    """D3 as ``array<struct<neg, pos, factor, contribution>>`` in declaration order.

    ``neg`` = -contribution leads the struct so the natural struct order is
    (contribution desc, declaration order asc): the order of a stable
    descending sort.
    """
    items = [F.struct((-v).alias("neg"), F.lit(i).alias("pos"), F.lit(name).alias("factor"),
                      v.alias("contribution"))
             for i, (name, v) in enumerate(zip(dims.ALC_FACTOR_NAMES, alc_factor_values()))]
    return df.withColumn("factors", F.array(*items))


def top_factors(df: DataFrame, k: int = dims.TOP_FACTORS) -> DataFrame:
    """Top-k factors by contribution desc, stable on ties (declaration order).

    ``sort_array`` on the structs uses Spark's native ordering (no lambda
    comparator, so it stays in generated code)."""
    return df.withColumn("top_factors", F.slice(F.sort_array("factors"), 1, k))


def alc_label(df: DataFrame, raw: str = "alc_prob_raw", threshold: float = dims.ALC_LABEL_CUTOFF) -> DataFrame:
    """label = clip(raw probability, 0, 1) > 0.45."""
    return (df.withColumn("alc_prob", clip(raw, 0.0, 1.0))
            .withColumn("alc_flag", (F.col("alc_prob") > threshold).cast("int")))


def alc_report(df: DataFrame) -> DataFrame:
    """Nested scoring response per patient."""
    scored = top_factors(alc_factors(alc_tier(alc_risk_score(df))))
    return scored.select(
        "patient_id",
        F.struct("age", "diagnosis", "hospital", "los_days",
                 F.col("lives_alone").cast("boolean").alias("lives_alone"),
                 F.col("has_caregiver").cast("boolean").alias("has_caregiver")).alias("patient_summary"),
        F.bround("alc_risk_score", 4).alias("alc_risk_score"),
        pct_text("alc_risk_pct").alias("alc_risk_pct"),
        "risk_level", "risk_colour", "recommendation",
        F.transform("top_factors", lambda s: F.struct(s["factor"].alias("factor"),
                                                       s["contribution"].alias("contribution")))
        .alias("top_risk_factors"),
        F.struct(F.lit("linear rule").alias("kind"), F.lit(len(dims.ALC_TERMS)).alias("n_terms"),
                 F.lit(dims.ALC_LABEL_CUTOFF).alias("label_cutoff")).alias("model_info"))


# --------------------------------------------------------------------------- surge

def surge_threshold(base: str | Column = "base", multiplier: float = dims.SURGE_MULTIPLIER) -> Column:
    b = F.col(base) if isinstance(base, str) else base
    return trunc_int(b * F.lit(float(multiplier)))


def predicted_visits(df: DataFrame) -> DataFrame:
    """int(base x weekday factor x month factor x (1.30 if holiday)).

    Expects ``base``, ``weekday`` (Monday = 0), ``month`` and ``is_holiday``.
    """
    dow = case_map("weekday", dict(enumerate(dims.DOW_EFFECT)), None)
    mon = case_map("month", {i + 1: v for i, v in enumerate(dims.MONTH_EFFECT)}, None)
    hol = F.when(F.col("is_holiday") == 1, F.lit(dims.HOLIDAY_FACTOR)).otherwise(F.lit(1.0))
    return (df.withColumn("surge_threshold", surge_threshold("base"))
            .withColumn("predicted_visits", trunc_int(F.col("base") * dow * mon * hol)))


def surge_risk_score(df: DataFrame) -> DataFrame:
    """score = clip((pred - base)/(threshold - base), 0, 1), flag pred > threshold,
    tiers at 0.8 / 0.5 (on the unrounded score), capacity percent = pred/base.

    A small site's truncated threshold may not exceed its base; there is no
    scale between the two then, and the score is 1 above the threshold, else 0.
    """
    pred, base, thr = F.col("predicted_visits"), F.col("base"), F.col("surge_threshold")
    score = (F.when(thr > base, clip((pred - base) / (thr - base), 0.0, 1.0))
             .when(pred > thr, F.lit(1.0)).when(pred <= thr, F.lit(0.0)))
    return (df.withColumn("surge_risk_score", score)
            .withColumn("surge_flag", pred > thr)
            .withColumn("risk_level", _tier(F.col("surge_risk_score"), dims.SURGE_TIERS, 1))
            .withColumn("recommendation", _tier(F.col("surge_risk_score"), dims.SURGE_TIERS, 2))
            .withColumn("capacity_pct", pred / base * 100.0))


def horizon_tier(count: str | Column) -> Column:
    """Surge-day count > 10 HIGH, > 4 MEDIUM, else LOW; null has no tier."""
    c = F.col(count) if isinstance(count, str) else count
    return (F.when(c > dims.HORIZON_HIGH, "HIGH").when(c > dims.HORIZON_MEDIUM, "MEDIUM")
            .when(c.isNotNull(), "LOW"))


def surge_report(df: DataFrame) -> DataFrame:
    """D7 as a nested response: input, prediction, risk and recommendation per request.

    Expects the columns of ``surge_risk_score`` and ``hospital``, ``day_name``,
    ``month`` and ``is_holiday``.
    """
    return df.select(
        F.struct("hospital", "day_name", "month", F.col("is_holiday").cast("boolean").alias("is_holiday")).alias("input"),
        F.struct("predicted_visits", F.col("base").alias("base_visits"), "surge_threshold",
                 pct_text("capacity_pct").alias("capacity_pct")).alias("prediction"),
        F.struct("surge_flag", F.bround("surge_risk_score", 4).alias("surge_risk_score"), "risk_level").alias("risk"),
        "recommendation")


def flag_surge(df: DataFrame, visits: str = "ed_visits", threshold: str = "surge_threshold") -> DataFrame:
    """Actual-day surge flag, strict >."""
    return df.withColumn("surge_flag", (F.col(visits) > F.col(threshold)).cast("int"))


def expected_volume(df: DataFrame) -> DataFrame:
    """Base x weekday factor x season factor x holiday factor x growth, floor 50.

    Expects ``base``, ``visit_date`` and ``is_holiday``. Season factors are
    the mid-points of the generator's random ranges (Dec-Feb winter,
    Jun-Aug summer).
    """
    d = F.col("visit_date")
    dow = case_map("weekday(visit_date)", dict(enumerate(dims.DOW_EFFECT)), None)
    season = (F.when(F.month(d).isin(*dims.WINTER_MONTHS), F.lit(dims.WINTER_FACTOR))
              .when(F.month(d).isin(*dims.SUMMER_MONTHS), F.lit(dims.SUMMER_FACTOR)).otherwise(F.lit(1.0)))
    hol = F.when(F.col("is_holiday") == 1, F.lit(dims.HOLIDAY_VOLUME_FACTOR)).otherwise(F.lit(1.0))
    growth = F.pow(F.lit(dims.ANNUAL_GROWTH), (F.year(d) - dims.GROWTH_BASE_YEAR).cast("double"))
    return df.withColumn("expected_visits",
                         F.greatest(F.col("base") * dow * season * hol * growth, F.lit(float(dims.VOLUME_FLOOR))))
