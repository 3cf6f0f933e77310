"""Statistics, scaling, feature selection and split search over long tables (row_id, feature, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.operators.moments import moments
from colligo.operators.order import with_global_rank
from colligo.operators.quantiles import quantile_midpoints


def weighted_mean(x: str, w: str) -> Column:
    return F.try_divide(F.sum(F.col(w) * F.col(x)), F.sum(w))


def weighted_moments(long: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """feature, mean, variance, covariance with the label, label_variance; all weighted.

    Deviations are taken from each feature's own means, found by a first pass, so that large
    means cancel nothing.  Features are few: their means are broadcast.
    """
    known = long.where(F.col("v").isNotNull() & F.col(label).isNotNull() & F.col(weight).isNotNull())
    means = known.groupBy("feature").agg(weighted_mean("v", weight).alias("mean"), weighted_mean(label, weight).alias("label_mean"))
    means = means.select(F.col("feature").alias("f2"), "mean", "label_mean")
    w, a, b = F.col(weight), F.col("v") - F.col("mean"), F.col(label) - F.col("label_mean")
    near = known.join(F.broadcast(means), F.col("feature").eqNullSafe(F.col("f2")))
    return near.groupBy("feature").agg(
        F.first("mean").alias("mean"), F.try_divide(F.sum(w * a * a), F.sum(w)).alias("variance"), F.try_divide(F.sum(w * a * b), F.sum(w)).alias("covariance"), F.try_divide(F.sum(w * b * b), F.sum(w)).alias("label_variance"),
    )


def feature_correlations(long: DataFrame, label: str = "y", weight: str = "w") -> DataFrame:
    """feature, corr: absolute weighted correlation of every feature with the label; null where either is constant."""
    return weighted_moments(long, label, weight).select("feature", F.abs(F.try_divide(F.col("covariance"), F.sqrt("variance") * F.sqrt("label_variance"))).alias("corr"))


def vector_correlations(df: DataFrame, x: str = "x", label: str = "y", weight: str | None = None) -> DataFrame:
    """feature, corr of every entry of a vector column with the label, from one pass and without unfolding it."""
    told = moments(df, F.concat(F.transform(x, lambda v: v.cast("double")), F.array(F.col(label).cast("double"))), weight)
    c = told.correlations()[:-1, -1] if told.rows else []
    return df.sparkSession.createDataFrame([(j, None if v != v else abs(float(v))) for j, v in enumerate(c)], "feature int, corr double")


def top_features(scores: DataFrame, k: int, score: str = "corr") -> DataFrame:
    """The k best features; ties to the lower one, nulls last."""
    return scores.orderBy(F.col(score).desc_nulls_last(), "feature").limit(k)


def impurity(df: DataFrame, label: str, classification: bool, weight: str | None = None) -> DataFrame:
    """One row: Gini, or the (weighted) variance, of the label."""
    if not classification:
        one = df.select(F.lit(0).alias("feature"), F.col(label).alias("v"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
        return weighted_moments(one, "v").select(F.col("variance").alias("impurity"))
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return counts.agg((1 - F.sum(F.col("n") * F.col("n")) / (total * total)).alias("impurity"))


def column_statistics(long: DataFrame) -> DataFrame:
    return long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("deviation"), F.count("*").alias("n"))


def min_max(long: DataFrame, smoother: float = 0.0) -> DataFrame:
    """(v - min + s) / (max - min + s) per feature."""
    stats = long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    s = F.lit(float(smoother))
    return long.join(F.broadcast(stats), "feature").select("row_id", "feature", F.try_divide(F.col("v") - F.col("low") + s, F.col("high") - F.col("low") + s).alias("v"))


def standardize(long: DataFrame, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """Population z-score per feature; a constant feature becomes 0."""
    stats = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    v = F.col("v") - F.col("mean") if with_mean else F.col("v")
    v = F.coalesce(F.try_divide(v, F.col("deviation")), F.lit(0.0)) if with_std else v
    return long.join(F.broadcast(stats), "feature").select("row_id", "feature", v.alias("v"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """``df`` with <column>_code: the value's rank among the distinct values.

    The distinct values are ranked, not the rows, so the sort is as large as the domain.
    """
    codes = with_global_rank(df.select(column).where(F.col(column).isNotNull()).distinct(), column, name=f"{column}_code")
    return df.join(codes, column, "left")


def split_candidates(long: DataFrame, max_bins: int) -> DataFrame:
    """feature, split_id, threshold.

    With max_bins distinct values or more: max_bins - 1 midpoints of neighbours at equal
    rank steps b = floor(n / max_bins).  Else every distinct value but the last; one
    distinct value is its own candidate.  Ranks are found by a radix search, without a sort.
    """
    rows = [(f, i, t) for f, ts in quantile_midpoints(long, max_bins).items() for i, t in enumerate(ts)]
    return long.sparkSession.createDataFrame(rows, "feature int, split_id int, threshold double")


def bucketize(long: DataFrame, splits: DataFrame) -> DataFrame:
    """``long`` with bucket: the number of thresholds below v (v <= threshold i in bucket i), 0 for null; features without thresholds are left out."""
    held: dict = {}
    for row in splits.select("feature", F.col("threshold").cast("double").alias("t")).distinct().collect():  # as many as features times bins
        held.setdefault(row["feature"], []).append(row["t"])
    held = {f: np.sort(np.array(t)) for f, t in held.items()}

    @F.arrow_udf("int")
    def bucket(feature: pa.Array, v: pa.Array) -> pa.Array:
        f, x = feature.to_numpy(zero_copy_only=False), v.fill_null(-np.inf).to_numpy(zero_copy_only=False)
        out = np.zeros(len(f), np.int32)
        for name, ts in held.items():
            mine = f == name
            out[mine] = np.searchsorted(ts, x[mine])
        return pa.array(out)

    return long.where(F.col("feature").isin(list(held))).withColumn("bucket", bucket("feature", F.col("v").cast("double")))


def split_statistics(bucketed: DataFrame, splits: DataFrame, keys: tuple[str, ...] = ("node",), label: str = "y") -> DataFrame:
    """keys, feature, bucket, threshold and left and right n, sum and sum of squares of the label.

    Rows are added up by bucket first; prefix sums run over buckets only.
    """
    cells = bucketed.groupBy(*keys, "feature", "bucket").agg(F.count("*").alias("n"), F.sum(label).alias("s"), F.sum(F.col(label) * F.col(label)).alias("q"))
    upto = Window.partitionBy(*keys, "feature").orderBy("bucket")
    every = Window.partitionBy(*keys, "feature")
    sums = {f"{side}_{c}": value for c in ("n", "s", "q") for side, value in (("left", F.sum(c).over(upto)), ("right", F.sum(c).over(every) - F.sum(c).over(upto)))}
    order = Window.partitionBy("feature").orderBy("threshold")
    limits = splits.select("feature", "threshold").distinct().withColumn("bucket", F.row_number().over(order) - 1)
    return cells.withColumns(sums).join(F.broadcast(limits), ["feature", "bucket"]).select(*keys, "feature", "bucket", "threshold", *sums)


def split_gain(classification: bool) -> Column:
    """n I - nL IL - nR IR over n: Gini of 0/1 labels, or variance."""

    def weighted(n: Column, s: Column, q: Column) -> Column:
        return F.try_divide(2 * s * (n - s), n) if classification else q - F.try_divide(s * s, n)

    l, r = ([F.col(f"{side}_{c}") for c in ("n", "s", "q")] for side in ("left", "right"))
    whole = weighted(l[0] + r[0], l[1] + r[1], l[2] + r[2])
    return (whole - F.coalesce(weighted(*l), F.lit(0.0)) - F.coalesce(weighted(*r), F.lit(0.0))) / (l[0] + r[0])
