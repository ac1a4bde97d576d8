"""Input validation (S5): range and enumeration rules as column expressions.

``validate`` adds ``violations`` (array of the names of failed rules) to
every row; ``split_valid`` separates accepted rows from rejected ones. A rule
is either ``(lo, hi)`` (inclusive range, null fails), a list of allowed
values, or a one-column DataFrame of allowed values (a reference table,
checked with a left join so its size does not matter).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(df: DataFrame, rules: dict) -> DataFrame:
    out = df
    checks = []
    for i, (colname, rule) in enumerate(rules.items()):
        c = F.col(colname)
        if isinstance(rule, DataFrame):
            ok_col = f"_ok_{i}"
            ref = rule.select(F.col(rule.columns[0]).alias(f"_ref_{i}")).distinct().withColumn(ok_col, F.lit(True))
            out = out.join(ref, c == F.col(f"_ref_{i}"), "left").drop(f"_ref_{i}")
            ok = F.col(ok_col).isNotNull()
        elif isinstance(rule, (list, tuple, set)) and not (isinstance(rule, tuple) and len(rule) == 2
                                                           and all(isinstance(x, (int, float)) for x in rule)):
            ok = c.isin(list(rule))
        else:
            lo, hi = rule
            ok = c.between(lo, hi)
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(colname)))
    out = out.withColumn("violations", F.filter(F.array(*checks), lambda x: x.isNotNull()))
    return out.drop(*[c for c in out.columns if c.startswith("_ok_")])


def split_valid(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, rules)
    return (checked.filter(F.size("violations") == 0).drop("violations"),
            checked.filter(F.size("violations") > 0))
