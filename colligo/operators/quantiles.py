"""Exact order statistics of many columns at once, without a sort: a radix search over order-preserving keys.

A double becomes a 64-bit key of the same order.  A round counts rows by the next digits
of the keys, but only of those whose leading digits hold a wanted rank, and so narrows
every rank of every feature; five rounds reach single values, fewer where values repeat.
Each round is one aggregation by (feature, digits): batches of rows count their own cells, from
keys as the bits of the doubles, and Spark adds the counts up.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that are still open after each round: 2^16 cells in the first, 2^12 a cell in the others.
SHIFTS = (48, 36, 24, 12, 0)
_NAN = 2**63 - 1


def order_key(v: Column) -> Column:
    """A long that orders as the double does: -0.0 equals 0.0, NaN is the largest; null stays null.

    The magnitude is the double's exponent and mantissa bits, from exact arithmetic; it is negative for negative values.
    """
    v = v.cast("double")
    a = F.abs(v)
    tiny = F.lit(2.0**-1022)
    guess = F.floor(F.log2(F.greatest(F.least(a, F.lit(1.7e308)), tiny)))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # the logarithm may round across a power of two
    exponent = F.when(guess > 1023, F.lit(1023)).otherwise(guess)
    exponent = F.when(a < power(exponent), exponent - 1).when(a / power(exponent) >= 2, exponent + 1).otherwise(exponent)
    step = F.lit(2**52)
    normal = (exponent.cast("long") + 1023) * step + ((a / power(exponent) - 1) * F.lit(2.0**52)).cast("long")
    size = F.when(a < tiny, (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")).when(a == F.lit(float("inf")), F.lit(2047) * step).otherwise(normal)
    return F.when(F.isnan(v), F.lit(_NAN)).when(v < 0, -size).otherwise(size)


def _keys(v: np.ndarray) -> np.ndarray:
    """``order_key`` of a batch: the bits of its doubles."""
    v = np.asarray(v, np.float64) + 0.0
    size = v.view(np.int64) & np.int64(_NAN)
    return np.where(np.isnan(v), np.int64(_NAN), np.where(v < 0, -size, size))


def _value(key: int, whole: bool = False) -> float | int:
    """The value of a key."""
    if whole:
        return key
    return float("nan") if key == _NAN else float(np.copysign(np.int64(abs(key)).view(np.float64), key))


def _known(long: DataFrame, whole: bool = False) -> DataFrame:
    """(feature, v) without nulls; ``whole`` values are longs, and their own keys."""
    return long.where(F.col("v").isNotNull()).select("feature", F.col("v").cast("long" if whole else "double").alias("v"))


def _cells(known: DataFrame, kind: str, shift: int, active: Iterable[tuple] | None, above: int, whole: bool = False) -> DataFrame:
    """(feature, cell, n, low, high): rows counted by key >> shift, those under ``active`` (feature, up) cells only."""
    ups: dict = {}
    for f, up in active or ():
        ups.setdefault(f, []).append(up)
    held = None if active is None else {f: np.array(sorted(u), np.int64) for f, u in ups.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b["v"].to_numpy(zero_copy_only=False)
            keys, names = v if whole else _keys(v), b["feature"].dictionary_encode()
            at = names.indices.to_numpy(zero_copy_only=False)
            for place, name in enumerate(names.dictionary.to_pylist()):
                mine = keys[at == place] if len(names.dictionary) > 1 else keys
                if held is not None:
                    mine = mine[np.isin(mine >> above, held[name])] if name in held else mine[:0]
                if not len(mine):
                    continue
                mine = np.sort(mine)
                cell = mine >> shift
                first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
                last = np.r_[first[1:], len(mine)]
                columns = [pa.array([name] * len(first), names.dictionary.type), *map(pa.array, (cell[first], last - first, mine[first], mine[last - 1]))]
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "cell", "n", "low", "high"])

    told = known.mapInArrow(count, f"feature {kind}, cell long, n long, low long, high long")
    return told.groupBy("feature", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def select_ranks(long: DataFrame, wanted: Iterable[tuple], kind: str = "int", whole: tuple[int, ...] = ()) -> dict[tuple, float]:
    """{(feature, rank): value} of the rows (feature, v): the value at each rank, from 0, in ascending order.

    ``wanted`` are pairs of a feature and a rank, ranks of rows that are not null; the driver holds
    as many entries as there are pairs.  Ranks beyond the feature's rows have no entry.
    ``kind`` is the type of ``feature``, which is not null.  With ``whole``, values are longs
    and its entries the bits that stay open after each round, 12 a round at most.
    """
    spark, known = long.sparkSession, _known(long.select(F.col("feature").cast(kind).alias("feature"), "v"), bool(whole))
    shifts = whole or SHIFTS
    # (feature, rank) -> cell above and the rank inside it
    open_ = {(f, r): (None, r) for f, r in wanted if r >= 0}
    found: dict[tuple, float] = {}
    for i, shift in enumerate(shifts):
        if not open_:
            break
        above = shifts[i - 1] if i else 64
        active = {(f, up) for (f, _), (up, _) in open_.items()} if i else None
        cells = _cells(known, kind, shift, active, above, bool(whole))
        group = ["feature", F.shiftright("cell", above - shift)] if i else ["feature"]
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("cell"))  # 2^16 cells of a feature, or 2^12 of a cell, at most
        cells = cells.withColumn("upto", upto).withColumn("up", F.shiftright("cell", above - shift) if i else F.lit(0).cast("long"))
        asked = spark.createDataFrame([(f, up or 0, r, left) for (f, r), (up, left) in open_.items()], f"f2 {kind}, u2 long, rank long, left long")
        here = (F.col("feature") == F.col("f2")) & (F.col("up") == F.col("u2")) & (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n"))
        hits = cells.join(F.broadcast(asked), here).select("feature", "rank", "cell", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), "low", "high")
        open_ = {}
        for h in hits.collect():  # a row for each wanted rank
            if h["low"] == h["high"]:
                found[h["feature"], h["rank"]] = _value(h["low"], bool(whole))
            else:
                open_[h["feature"], h["rank"]] = (h["cell"], h["left"])
    return found


def distinct_values(long: DataFrame, limit: int, kind: str = "int") -> dict:
    """{feature: (rows, values)}: the ascending distinct values of (feature, v), or None for ``limit`` values or more.

    Cells are split until they hold one value each, or are too many; no set of values is
    gathered but of features with fewer than ``limit``.
    """
    held = _known(long.select(F.col("feature").cast(kind).alias("feature"), "v"))
    rows: dict = {}
    known: dict = {}
    many: set = set()
    active: list[tuple] = []
    for i, shift in enumerate(SHIFTS):
        if i and not active:
            break
        above = SHIFTS[i - 1] if i else 64
        one = F.struct("cell", "low", "high")
        told = _cells(held, kind, shift, active if i else None, above).groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.slice(F.sort_array(F.collect_list(one)), 1, limit).alias("some"))
        active = []
        for r in told.collect():  # a row for each feature, of ``limit`` cells at most
            f = r["feature"]
            rows.setdefault(f, r["n"])
            values = known.setdefault(f, [])
            if f in many or r["cells"] + len(values) >= limit:
                many.add(f)
                continue
            values += [_value(c["low"]) for c in r["some"] if c["low"] == c["high"]]
            active += [(f, c["cell"]) for c in r["some"] if c["low"] != c["high"]]
    order = lambda v: (v != v, v)
    return {f: (n, None if f in many else sorted(known[f], key=order)) for f, n in rows.items()}


def median(df: DataFrame, value: Column | str) -> float | None:
    """The exact median of a column, the mean of the two middle values of an even number; nulls are left out, none gives None."""
    value = F.col(value) if isinstance(value, str) else value
    long = df.select(F.lit(0).alias("feature"), value.cast("double").alias("v"))
    return grouped_medians(long).get(0)


def grouped_medians(long: DataFrame, kind: str = "int") -> dict:
    """{feature: exact median} of (feature, v); the driver holds an entry for each feature."""
    counts = {r["feature"]: r["n"] for r in long.where(F.col("v").isNotNull()).groupBy("feature").agg(F.count("*").alias("n")).collect()}
    found = select_ranks(long, {(f, k) for f, n in counts.items() for k in ((n - 1) // 2, n // 2)}, kind)
    return {f: (found[f, (n - 1) // 2] + found[f, n // 2]) / 2 for f, n in counts.items()}


def with_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """One row for each group of ``keys`` (few groups, none null) with its exact median."""
    group = F.to_json(F.struct(*keys))
    told = grouped_medians(df.select(group.alias("feature"), F.col(value).alias("v")), "string")
    spark = df.sparkSession
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    out = spark.createDataFrame(list(told.items()), f"g string, `{name}` double").withColumn("g", F.from_json("g", kinds))
    return out.select(*[F.col("g").getField(k).alias(k) for k in keys], name)


def quantile_midpoints(long: DataFrame, max_bins: int) -> dict[int, list[float]]:
    """{feature: thresholds}: with ``max_bins`` distinct values or more, max_bins - 1 midpoints of neighbours at equal rank steps; else all distinct values but the last, or the only one."""
    told = distinct_values(long, max_bins)
    ranks = lambda n: [[min((i + 1) * (n // max_bins) + side, n - 1) for side in (0, 1)] for i in range(max_bins - 1)]
    found = select_ranks(long, {(f, r) for f, (n, values) in told.items() if values is None for pair in ranks(n) for r in pair})
    out = {}
    for f, (n, values) in sorted(told.items()):
        out[f] = values[:-1] or values if values is not None else [(found[f, a] + found[f, b]) / 2 for a, b in ranks(n)]
    return out


def mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """keys and the most frequent value, the lowest of equally frequent ones: rows are counted by value first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), value)).alias(name))
