"""Holidays by rule, as SQL expressions over a year or a date.

A rule is a yearly month-day (``"07-01"``) or a tuple:

* ``("nth", month, weekday, n)``: the n-th such weekday of a month (Monday = 0);
* ``("before", month, day, weekday)``: the last such weekday before a date;
* ``("easter", offset)``: days from Easter Sunday;
* ``("shifted", month, day)``: a date, or the Monday after it if it is a Sunday.

Nothing is looked up in a calendar table, so any year works and no join is
needed. Expressions are written as text, which Spark parses in one go.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUNDAY = 6


def easter_sunday(year: str) -> str:
    """Easter Sunday of the Gregorian calendar: the Sunday after the full moon of spring, from the moon's age."""
    golden, century = f"({year} % 19)", f"floor({year} / 100)"
    skipped = f"({century} - floor({century} / 4))"  # leap days that centuries left out
    moon_shift = f"floor((8 * {century} + 13) / 25)"
    days = f"pmod({skipped} - {moon_shift} + 19 * {golden} + 15, 30)"  # from 21 March to the full moon
    late = f"CASE WHEN {days} = 29 OR ({days} = 28 AND {golden} > 10) THEN 1 ELSE 0 END"
    return f"next_day(date_add(make_date({year}, 3, 21), CAST({days} - {late} AS INT)), 'Sunday')"


def nth_weekday(year: str, month: int, weekday: int, n: int) -> str:
    first = f"make_date({year}, {month}, 1)"
    return f"date_add({first}, pmod({weekday} - weekday({first}), 7) + {7 * (n - 1)})"


def weekday_before(year: str, month: int, day: int, weekday: int) -> str:
    last = f"make_date({year}, {month}, {day - 1})"
    return f"date_sub({last}, pmod(weekday({last}) - {weekday}, 7))"


def rule_date(rule: str | tuple, year: str) -> str:
    """The day of a rule in a year."""
    if isinstance(rule, str):
        month, day = map(int, rule.split("-"))
        return f"make_date({year}, {month}, {day})"
    kind, *args = rule
    if kind == "nth":
        return nth_weekday(year, *args)
    if kind == "before":
        return weekday_before(year, *args)
    if kind == "easter":
        return f"date_add({easter_sunday(year)}, {args[0]})"
    if kind == "shifted":
        date = f"make_date({year}, {args[0]}, {args[1]})"
        return f"date_add({date}, CASE WHEN weekday({date}) = {SUNDAY} THEN 1 ELSE 0 END)"
    raise ValueError(f"unknown holiday rule {rule}")


def is_rule_holiday(date: str, rules: list) -> Column:
    """0/1: whether a date expression is the day of one of the rules in its year; null dates are none."""
    fixed = ", ".join(f"'{r}'" for r in rules if isinstance(r, str))
    tests = [f"date_format({date}, 'MM-dd') IN ({fixed})"] if fixed else []
    tests += [f"{date} = {rule_date(r, f'year({date})')}" for r in rules if not isinstance(r, str)]
    return F.expr(f"CAST(coalesce({' OR '.join(tests) or 'false'}, false) AS INT)")
