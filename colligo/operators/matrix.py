"""Algebra of large sparse matrices (i, j, v), as products by blocks of the result and element-wise sums and products.

A block of the result is summed in one place: its rows of the left factor meet those rows of the
right one that they need, each once a block, cut to the block's columns.  So products are added
where they are made and never shuffled, and a task holds one bounded block, however many entries
an inner index has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.sources.scratch import materialize

#: Columns of a block of the result.
COLUMNS = 512
#: Blocks that the rows of a product are cut into, at least, and cells of a block, at most: 256 MB.
GROUPS, CELLS = 48, 1 << 25
#: Entries of the left factor in a row of the join.
PIECE = 256


def _known(df: DataFrame) -> DataFrame:
    return df.where("i is not null and j is not null and v is not null").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def entries(df: DataFrame) -> DataFrame:
    """(i, j, v) with one row an entry: repeated ones are summed, null indices or values are left out."""
    return _known(df).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _block_rows(m: DataFrame, size: int, groups: int) -> int | None:
    """Rows of a block, a power of two: ``groups`` blocks span the rows of ``m``, more if those would be too large; None without entries."""
    low, high = m.agg(F.min("i"), F.max("i")).first()
    if low is None:
        return None
    most = max(1, CELLS // size).bit_length() - 1
    return 1 << min(most, (-(-(high - low + 1) // groups) - 1).bit_length())


def product(a: DataFrame, b: DataFrame, size: int = COLUMNS, groups: int = GROUPS) -> DataFrame:
    """(i, j, v) of a b: entries for which some inner index is present in both, also if they cancel out.

    A block has ``size`` columns (at most 32767); rows are cut into ``groups`` blocks, or more that hold CELLS cells.
    """
    left, spark = materialize(entries(a), "left"), a.sparkSession
    rows = _block_rows(left, size, groups)
    if rows is None:
        return spark.createDataFrame([], "i long, j long, v double")
    block, inside = lambda c, n: F.expr(f"({c} - pmod({c}, {n})) div {n}"), lambda c, n, kind: F.pmod(c, F.lit(n)).cast(kind)
    left = left.groupBy(block("i", rows).alias("bi"), F.col("j").alias("k")).agg(F.collect_list(F.struct(inside("i", rows, "int").alias("i"), "v")).alias("e"))
    places = F.sequence(F.lit(1), F.size("e"), F.lit(PIECE))
    left = left.select("bi", "k", F.explode(F.transform(places, lambda at: F.slice("e", at, PIECE))).alias("e")).select("bi", "k", F.col("e.i").alias("ai"), F.col("e.v").alias("av"))
    right = entries(b).groupBy(F.col("i").alias("k2"), block("j", size).alias("bj")).agg(F.collect_list(F.struct(inside("j", size, "smallint").alias("j"), "v")).alias("e"))
    right = right.select("k2", "bj", F.col("e.j").alias("bc"), F.col("e.v").alias("bv"))
    met = left.join(right, F.col("k") == F.col("k2")).select("bi", "bj", "ai", "av", "bc", "bv")
    # a block is much work for its bytes, so that tasks are not put together by size
    dealt = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bi", "bj").sortWithinPartitions("bi", "bj")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, used, at = None, np.zeros(rows, bool), None

        def told() -> Iterator[pa.RecordBatch]:
            where = np.flatnonzero(used)
            step = max(1, (1 << 20) // size)
            for s in range(0, len(where), step):
                part = where[s : s + step]
                cells = held[part]
                i, j = np.nonzero((cells != 0) | ~np.signbit(cells))
                yield pa.RecordBatch.from_arrays([pa.array(part[i] + at[0] * rows), pa.array(j + at[1] * size), pa.array(cells[i, j])], names=["i", "j", "v"])
                held[part] = -0.0
            used[:] = False

        for batch in batches:
            if held is None:
                held = np.full((rows, size), -0.0)  # a cell without products: a sum of products is never -0.0, as 0.0 is added to each
            lists = {c: (batch[c].offsets.to_numpy(), batch[c].values.to_numpy(zero_copy_only=False)) for c in ("ai", "av", "bc", "bv")}
            for n, key in enumerate(zip(batch["bi"].to_pylist(), batch["bj"].to_pylist(), strict=True)):
                if key != at:
                    if at is not None:
                        yield from told()
                    at = key
                ai, av, bc, bv = (v[o[n] : o[n + 1]] for o, v in lists.values())
                held[ai[:, None], bc] += av[:, None] * bv + 0.0
                used[ai] = True
        if at is not None:
            yield from told()

    return dealt.mapInArrow(multiply, "i long, j long, v double")


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, x, y): entries of either matrix, null where one has none; both are summed in one aggregation."""
    none = F.lit(None).cast("double")
    both = _known(a).select("i", "j", F.col("v").alias("x"), none.alias("y")).union(_known(b).select("i", "j", none.alias("x"), F.col("v").alias("y")))
    return both.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum; entries of either, a missing one counts as 0."""
    return beside(a, b).select("i", "j", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("v"))


def multiply_elements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise product; entries of both."""
    return beside(a, b).where("x is not null and y is not null").select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.select("i", "j", (F.col("v") * by).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
