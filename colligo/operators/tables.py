"""Party tables: aligning, splitting and sampling rows and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligo.functions.vectors import hash32
from colligo.operators.order import first_in_hash_orders, with_global_rank


def align(parties: Sequence[DataFrame], key: str = "row_id") -> DataFrame:
    """Inner equi-join of party tables (key, x array); x is the concatenation in the order given.

    Parties have about as many rows as each other, so they are merged: files that compress well look small enough to be broadcast.
    """
    first, *rest = parties
    out = first.withColumnRenamed("x", "x0")
    for i, p in enumerate(rest, 1):
        out = out.join(p.withColumnRenamed("x", f"x{i}").hint("merge"), key)
    xs = [f"x{i}" for i in range(len(parties))]
    return out.withColumn("x", F.concat(*xs)).drop(*xs)


def check_sizes(parties: Sequence[DataFrame]) -> int:
    """The number of rows that all tables have; ValueError if they differ."""
    sizes = [p.count() for p in parties]
    if len(set(sizes)) > 1:
        raise ValueError(f"parties have {', '.join(map(str, sizes))} rows")
    return sizes[0] if sizes else 0


def align_by_position(parties: Sequence[DataFrame], key: str = "row_id") -> DataFrame:
    """Parties whose ``key`` is the row's position: none may have more rows than another, so that none is dropped."""
    check_sizes(parties)
    return align(parties, key)


def to_vector(df: DataFrame, features: Sequence[str], key: str, label: str | None = None) -> DataFrame:
    columns = [F.col(key).alias("row_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")]
    return df.select(*columns, *([F.col(label).cast("double").alias("y")] if label else []))


def to_long(df: DataFrame, x: str = "x", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(keep..., feature, v): one row for each entry of the vector."""
    return df.select(*keep, F.posexplode(x).alias("feature", "v"))


def add_bias(x: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), x)


def vertical_split(df: DataFrame, sizes: Sequence[int], label_party: int | None = 0) -> list[DataFrame]:
    """A table (row_id, x, y) as one table a party; the label stays with one of them, or is dropped."""
    out, at = [], 1
    for p, size in enumerate(sizes):
        columns = ["row_id", F.slice("x", at, size).alias("x")]
        out.append(df.select(*columns, *(["y"] if p == label_party and "y" in df.columns else [])))
        at += size
    return out


def equal_sizes(features: int, parties: int) -> list[int]:
    """Equal feature counts, the remainder to the last party."""
    size = features // parties
    return [size] * (parties - 1) + [features - size * (parties - 1)]


def feature_dimension(spark: SparkSession, sizes: Sequence[int]) -> DataFrame:
    """features(global_idx, party, local_idx)."""
    rows = [(p, i) for p, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame([(g, p, i) for g, (p, i) in enumerate(rows)], "global_idx int, party int, local_idx int")


def party_offsets(sizes: DataFrame) -> DataFrame:
    """(party, size) with each party's global offset; a row for each party."""
    before = Window.partitionBy(F.lit(0)).orderBy("party").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def importance_split(scores: DataFrame, parties: int) -> DataFrame:
    """(feature, score) dealt to parties in turn from the most important on: a balanced vertical split."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "feature"))  # a row for each feature
    return scores.withColumn("party", ((rank - 1) % parties).cast("int"))


def batch_conditions(df: DataFrame, key: str, size: int, iterations: Sequence[int], seed: int = 51) -> list[Column]:
    """For each iteration, a condition that holds for its batch: the first ``size`` rows of a hash order of its own.

    The limits of all iterations come from the same few counts; a batch is then a filter.
    """
    return first_in_hash_orders(df, key, size, [seed + 7919 * (t + 1) for t in iterations])


def mini_batch(df: DataFrame, key: str, size: int, iteration: int, seed: int = 51) -> DataFrame:
    return df.where(batch_conditions(df, key, size, [iteration], seed)[0])


def tree_samples(df: DataFrame, key: str, trees: int, rate: float, seed: int = 51) -> DataFrame:
    """``df`` once for each tree with tree_id, each with exactly floor(rate * rows) rows, without replacement.

    A row is repeated for the trees that it belongs to, from one scan.
    """
    keys = df.select(key)
    n = int(keys.count() * rate + 1e-9)
    limits = first_in_hash_orders(keys, key, n, [seed + 104729 * (t + 1) for t in range(trees)])
    mine = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in enumerate(limits)]), lambda t: t.isNotNull())
    return df.select("*", F.explode(mine).alias("tree_id"))


def bootstrap(df: DataFrame, rank: str, rows: int, size: int, seed: int = 51) -> DataFrame:
    """``size`` draws with replacement: draw i takes the row whose rank is its hash modulo ``rows``."""
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(hash32(F.col("id"), seed), F.lit(rows)).alias(rank))
    return draws.join(df, rank)


def random_label(key: Column, seed: int = 51) -> Column:
    return F.floor(hash32(key, seed) / 65536) % 2


def even_partition(position: Column, n: int, parts: int) -> Column:
    """Partition of a position, from 0, when n are cut into contiguous chunks of ceil(n / parts)."""
    return F.floor(position / (-(-n // parts))).cast("int")


def partition_by_rank(df: DataFrame, parts: int, *order: Column | str) -> DataFrame:
    """``df`` with part: rows in a total order, cut into contiguous chunks of ceil(rows / parts)."""
    ranked = with_global_rank(df, *order, name="__rank")
    return ranked.withColumn("part", even_partition(F.col("__rank"), ranked.count(), parts)).drop("__rank")


def subset_with_first(df: DataFrame, key: str, first, n: int, seed: int = 51) -> DataFrame:
    """The row whose key is ``first``, and exactly n others (all, if fewer) in hash order."""
    others = df.where(F.col(key) != F.lit(first))
    return df.where((F.col(key) == F.lit(first)) | ((F.col(key) != F.lit(first)) & first_in_hash_orders(others, key, n, [seed])[0]))


def balanced_partition(dimension: DataFrame, parts: int) -> DataFrame:
    """Each party's features over all partitions in contiguous chunks of ceil(size / parts)."""
    sizes = dimension.groupBy("party").agg(F.count("*").alias("size"))
    return dimension.join(F.broadcast(sizes), "party").withColumn("part", F.floor(F.col("local_idx") / F.ceil(F.col("size") / parts)).cast("int")).drop("size")
