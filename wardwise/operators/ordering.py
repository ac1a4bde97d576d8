"""Order operators without a single-partition window (W1, O2, O6, ranks, quantiles).

A global running sum ("how many rows are below this value") is the building
block of ROC-AUC, average precision, ROC curves, exact percentiles and exact
stratified splits. A window with ``orderBy`` and no ``partitionBy`` would
move every row into one task. ``ordered_cumsum`` instead:

1. range-partitions the rows by the ordering column; a row's partition is its
   bucket, and ties share one;
2. computes per-bucket totals (at most ``buckets`` rows) and their running
   offsets (a window over those few rows only);
3. computes the running sum inside each bucket with a window partitioned by
   bucket, and adds the bucket's offset.

The result is exact; only the balance of the buckets depends on Spark's range sample.
Callers first aggregate to one row per distinct ordering value, so a value
held by a third of all rows is still a single row here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(16, 4 * n)


def ordered_cumsum(df: DataFrame, order_col: str, sum_cols: list[str], tie_cols: list[str] | None = None,
                   descending: bool = False, buckets: int | None = None, prefix: str = "cum_",
                   by: list[str] | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_col`` order (inclusive of the row), within each ``by`` group.

    ``order_col`` (plus ``tie_cols``) must identify a row of its group;
    ``descending`` accumulates from the largest value down.
    """
    from wardwise.sources.io import materialize

    key, by = "_okey", by or []
    keyed = df.withColumn(key, (-F.col(order_col) if descending else F.col(order_col)).cast("double"))
    # the range partition of a row is its bucket; written once, so the buckets stay as they are
    ranges = keyed.repartitionByRange(buckets or default_buckets(df), *by, key)
    src = materialize(ranges.withColumn("_bucket", F.spark_partition_id()))
    totals = src.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wb = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    offsets = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(wb), F.lit(0)).alias(f"_o_{c}")
                                              for c in sum_cols])
    order = [F.col(key)] + [F.col(c) for c in (tie_cols or [])]
    wi = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = src
    for c in sum_cols:
        within = within.withColumn(f"_w_{c}", F.sum(c).over(wi))
    joined = within.join(F.broadcast(offsets), [*by, "_bucket"])  # <= buckets + groups rows: proven bound
    for c in sum_cols:
        joined = joined.withColumn(f"{prefix}{c}", F.col(f"_w_{c}") + F.col(f"_o_{c}"))
    return joined.drop(key, "_bucket", *[f"_w_{c}" for c in sum_cols], *[f"_o_{c}" for c in sum_cols])


def value_counts(df: DataFrame, value_col: str, count_cols: dict[str, Column] | None = None) -> DataFrame:
    """One row per distinct value with counts (partial aggregation absorbs hot values)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, c in (count_cols or {}).items():
        aggs.append(F.sum(c).alias(name))
    return df.groupBy(value_col).agg(*aggs)


QUANTILE_BINS = 4096  # bins of a pass
QUANTILE_ROWS = 10_000  # rows of a bin from which it is divided again


def exact_quantile(df: DataFrame, value_col: str, q: float) -> float | None:
    """Linear-interpolated percentile (numpy default); None for an empty column. Nulls and NaN take no part.

    Selection by histograms: a pass counts the rows of each bin, with the
    bin's least and greatest value; the bin that holds both order statistics
    around q x (n - 1) is divided in the next pass. The first pass bins by sign
    and binary exponent, the next ones by value, so a pass leaves one part in
    4,096 of the doubles in question. A bin of few rows is read as values with
    counts. Passes are narrow scans of one column; no exchange and nothing on
    the driver is wider than a histogram, and rows are never sorted or written.
    """
    x = df.select(F.col(value_col).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    # semi-monotonic in x, which is all that a bin has to be
    exponent = F.when(F.col("x") == 0, 0.0).otherwise(F.signum("x") * (F.floor(F.least(F.log2(F.abs("x")), F.lit(2000.0))) + 1100))
    skipped, ranks, low, high, bin_of = 0, None, None, None, exponent
    while True:
        part = x if low is None else x.where(F.col("x").between(low, high))
        bins = sorted(part.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"),
                                                            F.max("x").alias("b")).collect(), key=lambda r: r["bin"])
        if ranks is None:
            n = sum(r["n"] for r in bins)
            if not n:
                return None
            at = q * (n - 1)
            ranks = math.floor(at), math.ceil(at)
        # ``skipped`` rows lie below these bins
        holding, below = [], skipped
        for r in bins:
            holding += [(r, below)] * sum(below <= rank < below + r["n"] for rank in set(ranks))
            below += r["n"]
        (first, before), (last, _) = holding[0], holding[-1]
        if first is not last:  # the lower one ends its bin, the upper one begins the next
            found = first["b"], last["a"]
            break
        if first["a"] == first["b"]:
            found = first["a"], first["a"]
            break
        if first["n"] <= QUANTILE_ROWS:
            counts = sorted(x.where(F.col("x").between(first["a"], first["b"])).groupBy("x").count().collect())
            values = [v for v, k in counts for _ in range(k)]
            found = values[ranks[0] - before], values[ranks[1] - before]
            break
        skipped, low, high = before, first["a"], first["b"]
        bin_of = F.floor((F.col("x") - low) / (high - low) * QUANTILE_BINS)
    return found[0] + (at - math.floor(at)) * (found[1] - found[0])


def uniform_hash(key_cols: list[str], seed: int) -> Column:
    """Deterministic value in [0, 1) from the row key and a seed: 52 bits of an MD5, which other engines have too."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def kth_per_group(df: DataFrame, group_cols: list[str], u_col: str, tie_cols: list[str], k_col: str,
                  buckets: int = 64) -> DataFrame:
    """The row ranked ``k_col`` in its group by (``u_col``, ``tie_cols``), one row per group.

    ``u_col`` is uniform on [0, 1) (a hash), so equal-width buckets are
    balanced; counts per (group, bucket) locate the bucket holding rank k,
    and only that bucket is ranked row by row (a window over ~n/buckets rows).
    """
    t = df.withColumn("_b", F.least(F.floor(F.col(u_col) * buckets), F.lit(buckets - 1)).cast("int"))
    cnt = t.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_c"), F.first(k_col).alias("_k"))
    wb = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.withColumn("_before", F.coalesce(F.sum("_c").over(wb), F.lit(0)))
    # the one bucket per group whose rank range covers k (groups x buckets rows)
    cut = cnt.filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
    t = t.join(F.broadcast(cut.select(*group_cols, "_b", "_before")), group_cols + ["_b"])  # <= #groups rows
    wr = Window.partitionBy(*group_cols, "_b").orderBy(u_col, *tie_cols)
    t = t.withColumn("_rank", F.col("_before") + F.row_number().over(wr))
    return t.filter(F.col("_rank") == F.col(k_col)).drop("_b", "_before", "_rank")


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """Exact-size sample without replacement, seeded by the row key.

    Rows are ordered by a keyed hash and the first ``n`` kept; Spark plans
    this as a per-partition top-n plus one merge of at most n rows per
    partition (``TakeOrderedAndProject``).
    """
    return (df.withColumn("_u", uniform_hash(key_cols, seed))
            .orderBy("_u", *key_cols).limit(n).drop("_u"))


def top_n_per_group(df: DataFrame, group_cols: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group by ``order`` (groups are bounded by the caller)."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
