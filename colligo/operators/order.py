"""Ranks and exact shares of a table, without gathering it in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from colligo.functions.vectors import hash32, hashed
from colligo.operators import quantiles
from colligo.sources.scratch import materialize


def with_global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows with their position, from 0, in a total order; one distributed sort and a count per partition."""
    place, part = "__place", "__part"
    ranged = materialize(df.sort(*order).withColumn(place, F.monotonically_increasing_id()), "ranked")
    ranged = ranged.withColumn(part, F.shiftright(place, 33))
    sizes = sorted(ranged.groupBy(part).count().collect())  # a row for each partition of the sort
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row[0], total))
        total += row[1]
    start = df.sparkSession.createDataFrame(offsets, f"{part} long, __start long")
    own = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(start), part).withColumn(name, F.col("__start") + own).drop(place, part, "__start")


def _hash(df: DataFrame, key: str, seed: int) -> Column:
    """hash32 of a whole-number key; keys of other types are hashed to one first."""
    c = F.col(key)
    return hash32(c if isinstance(df.schema[key].dataType, IntegralType) else F.xxhash64(c), seed)


def _near(df: DataFrame, key: str, seeds: Sequence[int], low: int, high: int) -> DataFrame:
    """(k, feature, v, below): keys whose hash v under a seed is in [low, high), and of each batch and seed a row without v that counts the hashes below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = b["h"].fill_null(0).to_numpy(zero_copy_only=False)
            for i, s in enumerate(seeds):
                v = hashed(number, s)
                inside = np.flatnonzero((v >= low) & (v < high))
                n = len(inside) + 1
                k = b["k"].take(pa.array(np.r_[inside, -1][:-1], pa.int64()))
                columns = [pa.concat_arrays([k, pa.nulls(1, k.type)]), pa.array(np.full(n, i, np.int32)), pa.array([*v[inside].tolist(), None], pa.int64()), pa.array(np.r_[np.zeros(n - 1, np.int64), (v < low).sum()])]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "feature", "v", "below"])

    kind = df.schema[key].dataType
    number = F.col(key).cast("long") if isinstance(kind, IntegralType) else F.xxhash64(key)
    return df.select(F.col(key).alias("k"), number.alias("h")).mapInArrow(run, f"k {kind.simpleString()}, feature int, v long, below long")


def hash_limits(df: DataFrame, key: str, n: int, seeds: Sequence[int]) -> list[tuple[int, Any] | None]:
    """For each seed, (hash, key) of the n-th row in its hash order; None for n <= 0, (2^32, None) if n is not below the number of rows.

    Hashes are spread evenly, so the n-th lies in a narrow window: one pass counts the hashes below it
    and keeps the rows inside it, and a radix search over those finds the limits of all seeds.  If
    one was outside, all rows are searched.  The jobs do not grow with the seeds.
    """
    if n <= 0:
        return [None] * len(seeds)
    rows = df.count()
    if n >= rows:
        return [(2**32, None)] * len(seeds)
    room = 8 * math.sqrt(n * (1 - n / rows)) + 64
    edge = lambda at: min(max(int(at / rows * 2**32), 0), 2**32)
    for low, high in ((edge(n - room), edge(n + room)), (0, 2**32)):
        near = materialize(_near(df, key, seeds, low, high), "near")
        below = {r["feature"]: r["below"] for r in near.groupBy("feature").agg(F.sum("below").alias("below")).collect()}
        near = near.where("v is not null").select("k", "feature", "v")
        found = {i: int(h) for (i, _), h in quantiles.select_ranks(near, [(i, n - 1 - below[i]) for i in range(len(seeds))], whole=(20, 8, 0)).items()}
        if len(found) == len(seeds):
            break
    limits = df.sparkSession.createDataFrame(list(found.items()), "f2 int, h long")
    upto = near.join(F.broadcast(limits), (F.col("feature") == F.col("f2")) & (F.col("v") <= F.col("h")))
    ties = F.sort_array(F.collect_list(F.when(F.col("v") == F.col("h"), F.col("k"))))  # rows of one 32-bit hash
    told = {r["feature"]: r for r in upto.groupBy("feature").agg(F.count_if(F.col("v") < F.col("h")).alias("less"), ties.alias("ties")).collect()}
    return [(found[i], told[i]["ties"][n - below[i] - told[i]["less"] - 1]) for i in range(len(seeds))]


def hash_limit(df: DataFrame, key: str, n: int, seed: int = 51) -> tuple[int, Any] | None:
    return hash_limits(df, key, n, [seed])[0]


def first_in_hash_orders(df: DataFrame, key: str, n: int, seeds: Sequence[int]) -> list[Column]:
    """For each seed, a condition that holds for exactly the first n rows of ``df`` in its hash order (distinct keys)."""
    out = []
    for seed, limit in zip(seeds, hash_limits(df, key, n, seeds), strict=True):
        h = _hash(df, key, seed)
        out.append(F.lit(False) if limit is None else F.lit(True) if limit[1] is None else (h < limit[0]) | ((h == limit[0]) & (F.col(key) <= F.lit(limit[1]))))
    return out


def first_in_hash_order(df: DataFrame, key: str, n: int, seed: int = 51) -> Column:
    return first_in_hash_orders(df, key, n, [seed])[0]


def shuffled(df: DataFrame, key: str, seed: int = 51) -> DataFrame:
    """(key, place): every row's place, from 0, in the hash order that samples and splits of this seed are taken from."""
    return with_global_rank(df.select(key, _hash(df, key, seed).alias("__hash")), "__hash", key, name="place").select(key, "place")


def split_train_test(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 51) -> DataFrame:
    """``df`` with is_train: exactly floor(fraction * rows) rows, the same ones for every party that holds the keys."""
    n = int(df.count() * fraction + 1e-9)
    return df.withColumn("is_train", first_in_hash_order(df, key, n, seed))
