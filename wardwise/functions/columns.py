"""Scalar column functions (X1-X11, P9, P11). All JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip to [lo, hi]; null stays null (``greatest``/``least`` skip nulls)."""
    x = col(c)
    out = x
    if lo is not None:
        out = F.greatest(F.lit(lo), out)
    if hi is not None:
        out = F.least(F.lit(hi), out)
    return F.when(x.isNull(), F.lit(None)).otherwise(out)


def weekday(c: str | Column) -> Column:
    """Day of week with Monday = 0 (pandas ``dayofweek``)."""
    return F.weekday(col(c))


def fixed_text(c: str | Column, digits: int = 1) -> Column:
    """Python ``f'{x:.1f}'``: ``format_number`` rounds half-even on the exact
    binary value like Python does (``format_string`` and ``bround`` work on
    the shortest decimal form and differ, e.g. 0.35 -> 0.4); the grouping
    commas it inserts are removed."""
    return F.regexp_replace(F.format_number(col(c), digits), ",", "")


def pct_text(c: str | Column, digits: int = 1) -> Column:
    """Python ``f'{x:.1f}%'``."""
    return F.concat(fixed_text(c, digits), F.lit("%"))


def trunc_int(c: str | Column) -> Column:
    """Python ``int(x)`` for x >= 0 (DuckDB's cast rounds, so we floor)."""
    return F.floor(col(c)).cast("bigint")


def band(c: str | Column, hi: float, mid: float, labels=("red", "orange", "green")) -> Column:
    """Strict threshold tiers: > hi, > mid, else; null has no band."""
    x = col(c)
    return F.when(x > hi, labels[0]).when(x > mid, labels[1]).when(x.isNotNull(), labels[2])


def prescriber_code(c: str | Column, offset: int = 100000) -> Column:
    """X11: ``CPSO-<n>`` identifiers."""
    return F.concat(F.lit("CPSO-"), (col(c) + offset).cast("string"))


def r6(c: str | Column) -> Column:
    """Round a double to 6 decimals (the oracle comparison's precision)."""
    return F.round(col(c), 6)
