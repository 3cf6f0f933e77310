"""Evaluation reports as one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.functions.vectors import TOLERANCE, log_loss_term
from colligo.operators import quantiles


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def classification_report(df: DataFrame, prediction: str = "prediction", label: str = "y") -> DataFrame:
    """Confusion cells and rates of 0/1 labels; other labels are ignored, and 0 / 0 is null."""
    p, y = F.col(prediction), F.col(label)
    cells = df.agg(_count((p == 1) & (y == 1)).alias("tp"), _count((p == 1) & (y == 0)).alias("fp"), _count((p == 0) & (y == 1)).alias("fn"), _count((p == 0) & (y == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    return cells.withColumns({
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "sensitivity": sensitivity, "specificity": specificity, "balanced_accuracy": (sensitivity + specificity) / 2,
        "precision": F.try_divide(tp, tp + fp), "npv": F.try_divide(tn, tn + fn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })


def confusion_matrix(df: DataFrame, prediction: str = "prediction", label: str = "y") -> DataFrame:
    """label, predicted_0, predicted_1."""
    p = F.col(prediction)
    return df.groupBy(F.col(label).cast("int").alias("label")).agg(_count(p == 0).alias("predicted_0"), _count(p == 1).alias("predicted_1"))


def regression_report(df: DataFrame, prediction: str = "prediction", label: str = "y", weight: str | None = None, exact_median: bool = True) -> DataFrame:
    """mse, rmse, msle, rmsle, median and mean absolute error, largest error; weights apply to the squared ones.

    The exact median comes from a radix search, a few counts over ``df`` that run at once;
    without ``exact_median`` it is approximate, and part of the one aggregation.
    """
    p, y = F.col(prediction), F.col(label)
    w = F.col(weight) if weight else F.lit(1.0)
    mean = lambda e: F.try_divide(F.sum(w * e), F.sum(w))
    square, log_square = (p - y) * (p - y), F.pow(F.log1p(p) - F.log1p(y), 2)
    error = F.abs(p - y)
    median = F.lit(quantiles.median(df, error)).cast("double") if exact_median else F.percentile_approx(error, 0.5, 10000)
    return df.agg(
        mean(square).alias("mse"), F.sqrt(mean(square)).alias("rmse"), mean(log_square).alias("msle"), F.sqrt(mean(log_square)).alias("rmsle"),
        median.alias("median_abs_error"), F.avg(error).alias("mean_abs_error"), F.max(error).alias("max_error"),
    )


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "y", tolerance: bool = False) -> DataFrame:
    error = F.abs(F.col(prediction) - F.col(label))
    return df.agg(F.avg((error <= TOLERANCE if tolerance else error == 0).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, probability: str = "probability", label: str = "y") -> DataFrame:
    return df.agg(F.avg(log_loss_term(F.col(probability), F.col(label))).alias("log_loss"))


def table_mse(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Mean squared difference of two tables that share keys."""
    both = a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys)
    return both.agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("mse"))


def vote_probabilities(votes: DataFrame, classes: int, key: str = "row_id", vote: str = "prediction") -> DataFrame:
    """key, probabilities: share of votes of each class."""
    shares = [F.avg((F.col(vote) == c).cast("double")) for c in range(classes)]
    return votes.groupBy(key).agg(F.array(*shares).alias("probabilities"))
