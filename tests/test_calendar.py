"""Holidays by rule against given dates and against a plain calendar."""

import datetime as dt

from dateutil.easter import easter
from pyspark.sql import functions as F

from wardwise.functions.calendar import easter_sunday, is_rule_holiday
from wardwise.operators.joins import with_holiday, with_holiday_window
from wardwise.sources import dims

# The dates that the published analysis lists; Christmas 2022, a Sunday, is not among them.
GIVEN = """
2022-01-01 2022-02-21 2022-04-15 2022-05-23 2022-07-01 2022-08-01 2022-09-05 2022-10-10 2022-12-26
2023-01-01 2023-02-20 2023-04-07 2023-05-22 2023-07-01 2023-08-07 2023-09-04 2023-10-09 2023-12-25 2023-12-26
2024-01-01 2024-02-19 2024-03-29 2024-05-20 2024-07-01 2024-08-05 2024-09-02 2024-10-14 2024-12-25 2024-12-26
2025-01-01 2025-02-17 2025-04-18 2025-05-19 2025-07-01 2025-08-04 2025-09-01 2025-10-13 2025-12-25 2025-12-26
""".split()


def test_given_dates_are_reproduced(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2022-01-01', DATE'2025-12-31')) AS d")
    found = days.where(is_rule_holiday("d", dims.HOLIDAY_RULES) == 1).orderBy("d").collect()
    assert [str(r.d) for r in found] == GIVEN
    table = dims.holidays(spark, 2022, 2025, dims.HOLIDAY_RULES)
    assert sorted(str(r.ds) for r in table.collect()) == GIVEN


def test_easter_in_any_year(spark):
    got = spark.range(1583, 4100).select(F.col("id"), F.expr(easter_sunday("CAST(id AS INT)")).alias("d")).collect()
    assert all(r.d == easter(r.id) for r in got)


def test_rules_equal_the_table_join(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1999-12-20', DATE'2003-01-10')) AS d").unionByName(spark.sql("SELECT CAST(NULL AS DATE) AS d"))
    table = dims.holidays(spark, 1998, 2004, dims.HOLIDAY_RULES)
    for join in (with_holiday, with_holiday_window):
        rule, joined = join(days, dims.HOLIDAY_RULES, "d"), join(days, table, "d")
        assert rule.count() == joined.count() == days.count()
        assert rule.exceptAll(joined.select(rule.columns)).isEmpty()


def test_window_reaches_over_the_new_year(spark):
    days = spark.createDataFrame([(dt.date(2023, 12, 31),), (dt.date(2024, 1, 2),), (dt.date(2024, 4, 1),)], "d date")
    got = {str(r.d): (r.hol_m1, r.hol_0, r.hol_p1) for r in with_holiday_window(days, dims.HOLIDAY_RULES, "d").collect()}
    assert got == {"2023-12-31": (1, 0, 0), "2024-01-02": (0, 0, 1), "2024-04-01": (0, 0, 0)}
