"""Join helpers: size-checked broadcast, dictionary lookups, holiday joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardwise.functions.calendar import is_rule_holiday

# Rows of group statistics (a few hundred bytes each) that may be broadcast;
# override with the session setting ``wardwise.broadcast.maxRows``.
DEFAULT_BROADCAST_ROWS = 10_000


def broadcast_limit(df: DataFrame) -> int:
    value = df.sparkSession.conf.get("wardwise.broadcast.maxRows", None)
    return int(value) if value else DEFAULT_BROADCAST_ROWS


def bounded_broadcast(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast a derived statistics table only if it has at most ``max_rows`` rows.

    For tables that are joined back on a key of few values, where a shuffle
    join would put each value's rows into one task. The rows are collected
    once (``limit(max_rows + 1)`` stops at the bound) and joined as a local
    relation, so the join does not compute them a second time. Beyond the
    bound the key has many values, the frame is returned as is, and the
    planner uses a shuffle join. Nothing is remembered between calls.
    """
    limit = broadcast_limit(df) if max_rows is None else max_rows
    rows = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= limit else df


def lookup(df: DataFrame, dim: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Dictionary lookup (J1): equi-join to a small literal dimension.

    The dimension is broadcast after a check of its size.
    """
    return df.join(bounded_broadcast(dim), on=key, how=how)


def unknown_keys(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose key is missing from the dimension (the lookup's error case)."""
    return df.join(bounded_broadcast(dim.select(key)), on=key, how="left_anti")


def holiday_days(holidays: DataFrame) -> DataFrame:
    """Distinct holiday dates (J2 build side)."""
    return holidays.select(F.col("ds").alias("_hday")).distinct()


def with_holiday(df: DataFrame, holidays: DataFrame | list, date_col: str, out: str = "is_holiday") -> DataFrame:
    """0/1 flag for dates that are holidays.

    ``holidays`` is a table of dates (left join, broadcast after a size check:
    one row per holiday) or a list of rules (``functions.calendar``), which needs no table.
    """
    if isinstance(holidays, list):
        return df.withColumn(out, is_rule_holiday(f"`{date_col}`", holidays))
    hd = holiday_days(holidays)
    return (df.join(bounded_broadcast(hd), F.col(date_col) == F.col("_hday"), "left")
            .withColumn(out, F.col("_hday").isNotNull().cast("int")).drop("_hday"))


def holiday_offsets(holidays: DataFrame) -> DataFrame:
    """Explode each holiday into (day, offset) rows for its window."""
    return (holidays
            .select("ds", F.explode(F.sequence("lower_window", "upper_window")).alias("offset"))
            .select(F.date_add("ds", F.col("offset")).alias("_hday"), "offset")
            .distinct())


def with_holiday_window(df: DataFrame, holidays: DataFrame | list, date_col: str,
                        prefix: str = "hol") -> DataFrame:
    """One indicator per window offset (-1, 0, +1) plus ``in_window``.

    For a table of dates the window is expanded into literal days, so this
    is an equi-join against at most (#holidays x window width) rows. For a
    list of rules the dates around each row's are tested directly.
    """
    if isinstance(holidays, list):
        for suffix, offset in (("m1", -1), ("0", 0), ("p1", 1)):
            df = df.withColumn(f"{prefix}_{suffix}", is_rule_holiday(f"date_add(`{date_col}`, {-offset})", holidays))
        return df.withColumn("in_window", F.greatest(*[f"{prefix}_{s}" for s in ("m1", "0", "p1")]))
    offs = holiday_offsets(holidays)
    per_day = (offs.groupBy("_hday")
               .agg(F.max((F.col("offset") == -1).cast("int")).alias(f"{prefix}_m1"),
                    F.max((F.col("offset") == 0).cast("int")).alias(f"{prefix}_0"),
                    F.max((F.col("offset") == 1).cast("int")).alias(f"{prefix}_p1")))
    joined = df.join(bounded_broadcast(per_day), F.col(date_col) == F.col("_hday"), "left").drop("_hday")
    cols = [f"{prefix}_m1", f"{prefix}_0", f"{prefix}_p1"]
    joined = joined.fillna(0, subset=cols)
    return joined.withColumn("in_window", F.greatest(*[F.col(c) for c in cols]))


def reindex(agg: DataFrame, dim: DataFrame, key: str, order_col: str) -> DataFrame:
    """Align an aggregate to a fixed ordered domain; null where absent.

    ``agg`` is keyed by the domain's values and is the side that is broadcast
    after a check of its size (the domain is the preserved side of the left join).
    """
    return dim.join(bounded_broadcast(agg), on=key, how="left").orderBy(order_col)


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach a one-row aggregate to every row as struct column ``name``.

    Expressed as a scalar subquery (``DataFrame.scalar()``): Spark runs the
    aggregate once and inlines its value, so there is no join at all.
    """
    return df.withColumn(name, scalar(one_row))


def scalar(one_row: DataFrame):
    """The single row of ``one_row`` as a struct-valued scalar-subquery column."""
    return one_row.select(F.struct(*one_row.columns).alias("_row")).scalar()
