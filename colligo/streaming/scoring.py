"""Scoring a stream of requests with a fitted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_stream(requests: DataFrame, features: DataFrame, prediction: Column, key: str = "row_id") -> DataFrame:
    """Requests (key, ...) joined to a static feature table (key, x), with the prediction: a stream-static join."""
    return requests.join(features, key).withColumn("prediction", prediction)


def windowed_rate(scored: DataFrame, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and mean prediction of each window; rows later than ``late`` are left out by the watermark."""
    marked = scored.withWatermark(time, late)
    return marked.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("requests"), F.avg("prediction").alias("mean_prediction")).select(F.col("w.start").alias("start"), "requests", "mean_prediction")
