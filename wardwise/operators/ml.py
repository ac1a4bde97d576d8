"""Statistics and learning.

Model fitting uses MLlib (distributed tree boosting); scoring stays in ``transform`` so predictions keep
their row keys (no positional alignment).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wardwise.operators import boosting, scoring
from wardwise.operators.joins import bounded_broadcast, scalar, with_scalar
from wardwise.operators.moments import correlation, moments
from wardwise.sources import dims
from wardwise.operators.ordering import exact_quantile, kth_per_group, uniform_hash


# --------------------------------------------------------------------------- M1 / M2

def label_encode(df: DataFrame, cols: list[str], suffix: str = "_enc") -> DataFrame:
    """M1: alphabetical integer codes 0.. per column (scikit-learn LabelEncoder order).

    StringIndexer collects only the distinct labels (bounded by the
    column's cardinality) and applies them JVM-side.
    """
    idx = StringIndexer(inputCols=cols, outputCols=[f"{c}{suffix}_d" for c in cols],
                        stringOrderType="alphabetAsc", handleInvalid="keep")
    out = idx.fit(df).transform(df)
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"{c}{suffix}_d").cast("int")).drop(f"{c}{suffix}_d")
    return out


# --------------------------------------------------------------------------- M3

ROWS_PER_BUCKET = 200_000  # rows one task ranks when locating a split boundary


def stratified_split(df: DataFrame, label: str, key_cols: list[str], test_frac: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """M3: exact stratified hold-out; adds ``is_test`` (ceil(frac x n_class) per class).

    Rows are ranked by a keyed hash inside their class without putting a
    class in one task (see ``smallest_k_per_group``).
    """
    u = df.withColumn("_u", uniform_hash(key_cols, seed))
    sizes = u.groupBy(label).agg(F.count(F.lit(1)).alias("_n"),
                                 F.ceil(F.count(F.lit(1)) * F.lit(test_frac)).alias("_k"))
    rows = sizes.collect()  # one row per class: bounded by the label's cardinality
    largest = max([r["_n"] for r in rows] or [0])
    buckets = max(64, -(-largest // ROWS_PER_BUCKET))
    tagged = u.join(F.broadcast(df.sparkSession.createDataFrame(rows, sizes.schema).drop("_n")), label)
    # the k-th (hash, key) of each class; rows at or below it are the hold-out
    kth = kth_per_group(tagged, [label], "_u", key_cols, "_k", buckets=buckets).select(
        label, F.struct("_u", *key_cols).alias("_cut"))
    marked = u.join(bounded_broadcast(kth), label, "left")  # <= #classes rows, found once for all readers of the split
    return (marked.withColumn("is_test", F.coalesce(F.struct("_u", *key_cols) <= F.col("_cut"), F.lit(False)))
            .drop("_u", "_cut"))


# --------------------------------------------------------------------------- M4 / M5

FIT_ROWS = 20_000  # rows of a training partition, if there are no more partitions than cores
MLLIB_ROWS = 20_000  # rows that MLlib itself fits
DEPTH_MOST = 8  # levels whose histograms fit the driver and a task
FIT_ROWS_MOST = 500_000  # rows of a training partition, if there are


def fit_partitions(n: int, cores: int) -> int:
    """Partitions of ``n`` training rows: each of the rounds x depth jobs starts two tasks for every one of them."""
    waves = max(1, -(-n // (cores * FIT_ROWS_MOST)))
    return max(1, min(-(-n // FIT_ROWS), waves * cores))


def fit_gbt(train: DataFrame, features: list[str], label: str, rounds: int = dims.GBT_ROUNDS,
            depth: int = dims.GBT_DEPTH, step: float = dims.GBT_RATE, subsample: float = dims.GBT_SUBSAMPLE,
            col_frac: str = str(dims.GBT_COLSAMPLE), seed: int = 42, weight: str | None = None) -> PipelineModel:
    """M4: boosted-tree binary classifier in a Pipeline (assembler + GBT).

    MLlib fits tables of up to ``MLLIB_ROWS`` rows; above that the same method runs on binned rows (``boosting``).
    """
    gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth,
                        stepSize=step, subsamplingRate=subsample, featureSubsetStrategy=col_frac, seed=seed)
    if weight:
        gbt.setWeightCol(weight)
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    ordered = all(isinstance(train.schema[f].dataType, NumericType) and not train.schema[f].metadata for f in features)
    if ordered and depth > 0 and rounds > 0:
        n, total = train.agg(F.count(F.lit(1)), F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")).first()
        if n > MLLIB_ROWS and depth <= DEPTH_MOST:
            cores = train.sparkSession.sparkContext.defaultParallelism
            waves = -(-n // (cores * boosting.ROWS_MOST))
            return PipelineModel(stages=[assembler, boosting.fit(train, features, label, weight, gbt, n, total,
                                                                 min(-(-n // FIT_ROWS), waves * cores))])
    columns = ["features", label, *([weight] if weight else [])]
    rows = assembler.transform(train.withColumn(label, F.col(label).cast("double"))).select(columns)
    # every round reads all rows: keep the assembled vectors, computed once, in no more partitions than they fill
    made = rows.persist()
    dealt = made.repartition(fit_partitions(made.count(), train.sparkSession.sparkContext.defaultParallelism)).persist()
    try:
        return PipelineModel(stages=[assembler, gbt.fit(dealt)])
    finally:
        dealt.unpersist()
        made.unpersist()


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt to all tasks, for work of many trees a row: a few large files that cannot be split would leave it to as many tasks."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism))


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """M5: probability of class 1 and class at ``threshold`` (strict >)."""
    score = scoring.score(model, df)
    rows = dealt(df)
    if score is None:
        rows, score = model.transform(rows), vector_to_array("probability")[1]
    return (rows.withColumn("score", score)
            .withColumn("predicted", (F.col("score") > threshold).cast("int"))
            .drop("features", "rawPrediction", "probability", "prediction"))


def imbalance_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives / positives (one row)."""
    return df.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("scale_pos_weight"),
                  F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))


# --------------------------------------------------------------------------- M10

def linear_attribution(df: DataFrame, terms: dict[str, F.Column]) -> DataFrame:
    """Exact attribution of a linear score, w_j (x_j - mean x_j).

    ``terms`` maps a feature name to its weighted term w_j x_j; the mean
    term is a one-row aggregate (scalar subquery); all terms are averaged in
    absolute value in one pass. Returns (feature, mean_abs, rank).
    """
    names = list(terms)
    t = df.select(*[terms[n].cast("double").alias(f"_t{i}") for i, n in enumerate(names)])
    means = t.agg(*[F.avg(f"_t{i}").alias(f"_m{i}") for i in range(len(names))])
    wide = with_scalar(t, means, "_m").agg(
        *[F.avg(F.abs(F.col(f"_t{i}") - F.col(f"_m._m{i}"))).alias(n) for i, n in enumerate(names)])
    agg = wide.unpivot([], names, "feature", "mean_abs_attribution")  # one row before it is unpivoted
    from pyspark.sql import Window
    w = Window.orderBy(F.col("mean_abs_attribution").desc(), F.col("feature"))  # <= #features rows
    return agg.withColumn("rank", F.row_number().over(w))


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str,
                           key: str, seed: int = 7, block: int = 1024) -> DataFrame:
    """AUC drop when one feature's values are permuted.

    The permutation is drawn inside random blocks of about ``block`` rows
    (rows are assigned to blocks by a keyed hash, then matched by hash rank
    within the block), so no step ranks the whole table. Every row meets its
    donor once, is exploded to one copy per feature (and one as it is), and
    all copies are scored and ranked together, grouped by feature.
    """
    from pyspark.sql import Window

    from wardwise.operators.metrics import roc_auc

    n = df.count()
    n_blocks = max(1, n // block)
    base = df.withColumn("_blk", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(n_blocks)))
    w_src = Window.partitionBy("_blk").orderBy(key)
    w_dst = Window.partitionBy("_blk").orderBy(F.xxhash64(F.lit(seed + 1), F.col(key)), key)
    ranked = base.withColumn("_r_src", F.row_number().over(w_src)).withColumn("_r_dst", F.row_number().over(w_dst))
    donor = ranked.select("_blk", F.col("_r_src").alias("_r_dst"), F.struct(*features).alias("_donor"))
    copies = ranked.join(donor, ["_blk", "_r_dst"]).withColumn(
        "feature", F.explode(F.array(F.lit(""), *[F.lit(f) for f in features])))
    swapped = copies.select(label, "feature", *[
        F.when(F.col("feature") == f, F.col("_donor")[f]).otherwise(F.col(f)).alias(f) for f in features])
    auc = roc_auc(predict(model, swapped), label, "score", by=["feature"])
    whole = Window.partitionBy()  # one row per feature
    return (auc.withColumn("base_auc", F.max(F.when(F.col("feature") == "", F.col("auc"))).over(whole))
            .where("feature <> ''")
            .select("feature", F.col("auc").alias("permuted_auc"), "base_auc",
                    (F.col("base_auc") - F.col("auc")).alias("importance")))


# --------------------------------------------------------------------------- M11 / M13 / M19

def standardize(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """Zero mean, unit population std (one-row aggregate, broadcast)."""
    stats = df.agg(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])
    out = with_scalar(df, stats, "_st")
    for c in cols:
        mu, sd = F.col(f"_st.mu_{c}"), F.col(f"_st.sd_{c}")
        out = out.withColumn(f"{c}{suffix}", F.when(sd > 0, (F.col(c) - mu) / sd).otherwise(F.lit(0.0)))
    return out.drop("_st")


def peer_zscore(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Z-score of each metric within its peer group; score = max |z|.

    Group statistics are a grouped aggregate (partial aggregation, so a
    peer group holding a third of the rows is never gathered in one task)
    broadcast back on the group key after a size check.
    """
    stats = df.groupBy(by).agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols],
                               *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    # one row per peer group joined back on a low-cardinality key: broadcast (size
    # checked) so no group is shuffled into a single task
    out = df.join(bounded_broadcast(stats), by)
    for c in cols:
        out = out.withColumn(f"{c}_z", F.when(F.col(f"_sd_{c}") > 0,
                                              (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}"))
                             .otherwise(F.lit(0.0)))
    out = out.withColumn("anomaly_score", F.greatest(*[F.abs(F.col(f"{c}_z")) for c in cols]))
    return out.drop(*[f"_mu_{c}" for c in cols], *[f"_sd_{c}" for c in cols])


def flag_top_fraction(df: DataFrame, score: str, fraction: float = 0.04, out: str = "is_anomaly") -> DataFrame:
    """Flag rows above the (1 - fraction) percentile (strict >).

    ``df`` is read a few times (see ``exact_quantile``): write it first if it is dear.
    """
    cut = exact_quantile(df, score, 1.0 - fraction)
    return df.withColumn(out, (F.col(score) > F.lit(cut)).cast("int"))


# --------------------------------------------------------------------------- M16 / M17

def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (a < b in column order), long form; null beside a constant column."""
    corr = correlation(moments(df, cols)[2])
    rows = [(a, b, None if np.isnan(corr[i, j]) else float(corr[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")


def pca2(df: DataFrame, cols: list[str], key: str, k: int = 2) -> DataFrame:
    """First ``k`` principal coordinates of the standardised metrics.

    Standardisation uses the population std (the reference's scaler), so the
    components are the eigenvectors of the correlation matrix, which has one
    row per metric; the sign of each is fixed so that its largest-magnitude
    loading is positive. Coordinates are column expressions over the rows.
    Adds ``explained_variance_ratio`` per component as columns.
    """
    n, mean, m2 = moments(df, cols)
    sd = np.sqrt(np.diag(m2) / max(n, 1))
    corr = np.nan_to_num(correlation(m2))
    values, vectors = np.linalg.eigh(corr)
    order = np.argsort(values)[::-1][:k]
    total = float(np.trace(corr)) or 1.0
    z = [((F.col(c) - float(m)) / float(s)) if s > 0 else F.lit(0.0) for c, m, s in zip(cols, mean, sd, strict=True)]
    out = [F.col(key)]
    for j, at in enumerate(order):
        v = vectors[:, at] * (1.0 if vectors[np.abs(vectors[:, at]).argmax(), at] >= 0 else -1.0)
        out.append(sum((zi * float(w) for zi, w in zip(z, v, strict=True)), F.lit(0.0)).alias(f"pca{j + 1}"))
    return df.select(*out, *[F.lit(float(values[at]) / total).alias(f"evr{j + 1}") for j, at in enumerate(order)])
