"""Registry of every query (name -> callable(spark, sf_dir)) and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from wardwise.plans import alc, rx, streams, surge

    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for mod in (surge, alc, rx, streams):
        out.update(mod.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    from wardwise.plans import oracle_alc, oracle_rx, oracle_streams, oracle_surge

    out: dict[str, str] = {}
    for mod in (oracle_surge, oracle_alc, oracle_rx, oracle_streams):
        out.update(mod.ORACLE)
    return out
