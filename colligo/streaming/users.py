"""Scores of users, kept up to date from a stream of events that may be sent again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Times are microseconds, so that no time zone plays a part.
RESULT = "user_id long, n long, total double, score double, last long"
STATE = "n long, total double, score double, last long, ids array<long>, times array<long>"


def user_scores(events: DataFrame, score: Callable[[np.ndarray], np.ndarray], late: str = "1 hour") -> DataFrame:
    """user_id, n, total, score, last of every user with new events (event_id, user_id, ts, value), counted from the start.

    An event that was seen counts once: ids later than the watermark are kept per user, and
    events at or before the watermark come too late and are left out, whether seen or not.
    So state is bounded by a user's events of the last ``late``.  Null ids, users and times are left
    out; null values count as 0.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, points, last, ids, times = state.get if state.exists else (0, 0.0, 0.0, None, [], [])
        mark, seen = state.getCurrentWatermarkMs() * 1000, dict(zip(ids, times, strict=True))
        for b in batches:
            b = b[(b["at"] > mark) & ~b["event_id"].isin(seen.keys())].drop_duplicates("event_id")
            if len(b):
                n, total, points = n + len(b), total + float(b["value"].sum()), points + float(score(b["value"].to_numpy()).sum())
                last = max(int(b["at"].max()), last if last is not None else int(b["at"].max()))
                seen.update(zip(b["event_id"].tolist(), b["at"].tolist(), strict=True))
        seen = {i: t for i, t in seen.items() if t > mark}
        state.update((n, total, points, last, list(seen), list(seen.values())))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "score": [points / n if n else None], "last": pd.array([last], "Int64")})

    rows = events.where("event_id is not null and user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.select("event_id", "user_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("value", F.lit(0.0)).alias("value"))
    found = rows.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)
    return found.withColumn("last", F.timestamp_micros("last"))


def write_updates(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch to a folder of its own, written anew if the batch is run again: a restart leaves nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scores.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every user."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("r.*")
