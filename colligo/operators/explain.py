"""Explanations of predictions: locally weighted surrogate models and Shapley values.

Many rows are explained at once: their samples, scores and weights are columns of one table,
a row's samples become its sums of products, and tasks solve those of a batch of rows at once.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.functions.vectors import hash32, hashed, kernel_shap_weight
from colligo.operators import linear, stats, tree
from colligo.operators.ensemble import dense_rows
from colligo.operators.tables import to_long


def _noise(cell: Column, seed: int) -> Column:
    """A standard normal number from two hashes of a cell."""
    u, v = ((F.pmod(F.xxhash64(cell, F.lit(seed + k)), F.lit(2**32)) + 1) / float(2**32 + 1) for k in (0, 1))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def gaussian_samples(spark: SparkSession, row: Sequence[float], deviation: Sequence[float], n: int, seed: int = 51) -> DataFrame:
    """(row_id, x): row 0 is the explained one; others add noise, kept within (0, 1] (at least 1e-3)."""
    d = len(row)
    cells = [F.least(F.lit(1.0), F.when((v := F.lit(float(m)) + F.lit(float(s)) * _noise(F.col("row_id") * d + j, seed)) <= 0, 1e-3).otherwise(v)) for j, (m, s) in enumerate(zip(row, deviation, strict=True))]
    return spark.range(n).withColumnRenamed("id", "row_id").select("row_id", F.when(F.col("row_id") == 0, F.array(*[F.lit(float(v)) for v in row])).otherwise(F.array(*cells)).alias("x"))


def coalition_samples(spark: SparkSession, row: Sequence[float], mean: Sequence[float], n: int, seed: int = 51) -> DataFrame:
    """(row_id, z, x): 0/1 coalitions; an absent feature takes its mean. Row 0 has all features."""
    d = len(row)
    bits = [F.when(F.col("row_id") == 0, 1).otherwise(F.pmod(F.xxhash64(F.col("row_id") * d + j, F.lit(seed)), F.lit(2)).cast("int")) for j in range(d)]
    out = spark.range(n).withColumnRenamed("id", "row_id").select("row_id", F.array(*bits).alias("z"))
    return out.withColumn("x", F.array(*[F.when(F.get("z", F.lit(j)) == 1, float(a)).otherwise(float(b)) for j, (a, b) in enumerate(zip(row, mean, strict=True))]))


def distance_weights(samples: DataFrame, row: Sequence[float], kernel_width: float | None = None) -> DataFrame:
    """``samples`` with w = sqrt(exp(-d^2 / k^2)); k is 0.75 sqrt(features) unless given."""
    k = kernel_width or 0.75 * math.sqrt(len(row))
    d2 = sum(((F.get("x", F.lit(j)) - float(v)) * (F.get("x", F.lit(j)) - float(v)) for j, v in enumerate(row)), F.lit(0.0))
    return samples.withColumn("w", F.sqrt(F.exp(-d2 / (k * k))))


def coalition_weights(samples: DataFrame, features: int) -> DataFrame:
    z = F.aggregate("z", F.lit(0), lambda a, e: a + e)
    return samples.withColumn("w", kernel_shap_weight(F.lit(features), z))


def select_features(samples: DataFrame, k: int, method: str = "pearson", by_abs: bool = False) -> list[int]:
    """The k features of (x, y, w) that matter most, in order: by correlation, or by linear weights."""
    if method == "pearson":
        scores = stats.feature_correlations(to_long(samples, keep=("row_id", "y", "w")))
        return [r["feature"] for r in stats.top_features(scores, k).collect()]
    if method != "linear":
        raise ValueError(f"unknown selection {method}")
    d = len(samples.select("x").first()["x"])
    weights = linear.least_squares(samples, d, "w", ridge=1e-9).weights[1:]
    return sorted(range(d), key=lambda j: (-abs(weights[j]) if by_abs else -weights[j], j))[:k]


def explain(samples: DataFrame, features: Sequence[int], surrogate: str = "linear", max_depth: int = 3) -> DataFrame:
    """feature, importance of a surrogate fitted to (x, y, w) over the chosen features."""
    spark = samples.sparkSession
    chosen = samples.withColumn("x", F.array(*[F.get("x", F.lit(j)) for j in features]))
    if surrogate == "linear":
        w = linear.least_squares(chosen, len(features), "w", ridge=1e-9).weights[1:]
        return spark.createDataFrame([(int(f), float(v)) for f, v in zip(features, w, strict=True)], "feature int, importance double")
    if surrogate != "tree":
        raise ValueError(f"unknown surrogate {surrogate}")
    importance = tree.grow(chosen, 0, max_depth, weight="w").importance(spark)
    names = spark.createDataFrame([(i, int(f)) for i, f in enumerate(features)], "feature int, name int")
    return names.join(importance, "feature", "left").select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))


# many rows at once ----------------------------------------------------------------------------------------


#: Fixed value: the step between a row's cells, odd so that they differ below 2^32.
CELL_STEP = 2654435761


def _cell_noise(start: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """Standard normal numbers of rows' hashes and places in the rows, from hashes that any engine can compute."""
    cell = start + place * CELL_STEP
    u, v = ((hashed(cell, seed + k) + 1) / 4294967297.0 for k in (0, 1))
    return np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * v)


def samples_around(rows: DataFrame, deviation: Sequence[float], n: int, seed: int = 51, low: float | None = None, high: float | None = None) -> DataFrame:
    """(row_id, sample, around, x): sample 0 of each row (row_id, x) is the row, the n - 1 others add normal noise, kept within [low, high].

    A row's samples follow each other, in the task that held the row.
    """
    d, spread = len(deviation), np.array(deviation, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 19) // (n * max(d, 1)))
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                around, start = dense_rows(b["around"], d)[:, :d], b["start"].fill_null(0).to_numpy(zero_copy_only=False)
                x = around[:, None, :] + spread * _cell_noise(start[:, None, None], np.arange(n * d).reshape(1, n, d), seed)
                x = x if low is None else np.maximum(x, low)
                x = x if high is None else np.minimum(x, high)
                x[:, 0] = around
                each = pa.array(np.repeat(np.arange(len(x)), n))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) * n + 1) * d, pa.int32()), pa.array(x.ravel(), pa.float64(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([b["row_id"].take(each), pa.array(np.tile(np.arange(n, dtype=np.int32), len(x))), b["around"].take(each), cells], names=["row_id", "sample", "around", "x"])

    told = rows.select("row_id", F.col("x").cast("array<double>").alias("around"), hash32(F.col("row_id"), seed - 2).alias("start"))
    return told.mapInArrow(run, f"row_id {rows.schema['row_id'].dataType.simpleString()}, sample int, around array<double>, x array<double>")


def weigh_samples(samples: DataFrame, kernel_width: float | None = None, features: int | None = None) -> DataFrame:
    """``samples`` with w = sqrt(exp(-d^2 / k^2)) of the distance d to their row; k is 0.75 sqrt(features) unless given."""
    k2 = F.lit(kernel_width * kernel_width) if kernel_width else 0.5625 * (F.lit(features) if features else F.size("around"))
    if features:
        apart = [F.get("x", F.lit(j)) - F.get("around", F.lit(j)) for j in range(features)]
        d2 = sum((a * a for a in apart), F.lit(0.0))
    else:
        d2 = F.aggregate(F.zip_with("x", "around", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, e: t + e)
    return samples.withColumn("w", F.sqrt(F.exp(-d2 / k2)))


def flat_samples(samples: DataFrame, features: int, outputs: int) -> DataFrame:
    """row_id, sample, x0.., y0..: samples and their predictions side by side, as a plain table to be written."""
    cells = [F.get(c, F.lit(i)).alias(f"{c}{i}") for c, n in (("x", features), ("y", outputs)) for i in range(n)]
    return samples.select("row_id", "sample", *cells)


def _flat(rows: np.ndarray) -> pa.Array:
    """Rows of a table as lists."""
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _products(samples: DataFrame, features: int, outputs: int) -> DataFrame:
    """(row_id, products): the weighted products of [1, x - around, y] of each run of samples of one row, as one flat matrix."""
    m = 1 + features + outputs
    step = max(1, (1 << 21) // (m * m))  # samples whose products are held at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda ids, sums: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _flat(sums)], names=["row_id", "products"])
        last, under_way = None, None
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                cells = dense_rows(b["cells"], m)
                cells = np.where(np.isnan(cells).any(axis=1)[:, None], 0.0, cells)
                z, w = np.concatenate([np.ones((len(cells), 1)), cells[:, :-1]], axis=1), cells[:, -1]
                ids = b["row_id"].to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                sums = np.add.reduceat((z * w[:, None])[:, :, None] * z[:, None, :], edges, axis=0).reshape(len(edges), m * m)
                if last is not None and ids[0] == last:
                    sums[0] += under_way
                elif last is not None:
                    yield told([last], under_way[None])
                last, under_way = int(ids[-1]), sums[-1].copy()
                if len(edges) > 1:
                    yield told(ids[edges[:-1]], sums[:-1])
        if last is not None:
            yield told([last], under_way[None])

    cell = lambda c, j: F.get(c, F.lit(j)).cast("double")
    cells = [*[cell("x", j) - cell("around", j) for j in range(features)], *[cell("y", o) for o in range(outputs)], F.col("w").cast("double")]
    rows = samples.select(F.col("row_id").cast("long").alias("row_id"), F.array(*cells).alias("cells")).where("row_id is not null")  # one array a sample: crossing to Python is most of the work
    return rows.mapInArrow(run, "row_id long, products array<double>")


def _best(g: np.ndarray, features: int, y: int, k: int) -> np.ndarray:
    """For each matrix, the k features with the largest absolute weighted correlation with column y, ties to the lower one."""
    with np.errstate(invalid="ignore", divide="ignore"):
        w = g[:, :1, :1]
        cov = np.where(w != 0, g - g[:, :1, :].transpose(0, 2, 1) * g[:, :1, :] / w, 0.0)
        spread = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0))
        c = np.abs(cov[:, 1 : 1 + features, y]) / (spread[:, 1 : 1 + features] * spread[:, y : y + 1])
    return np.argsort(-np.where(np.isnan(c), -1.0, np.round(c, 9)), axis=1, kind="stable")[:, :k]


def local_products(samples: DataFrame, features: int, outputs: int, together: bool = False) -> DataFrame:
    """(row_id, products): each row's weighted products of [1, x - around, y] as one flat matrix; all that selection and surrogates need.

    ``samples``: (row_id, around, x, w, y), y ARRAY with an entry for each output; null or NaN
    samples are left out.  A task adds up what it has of a row, and one shuffle brings the
    partial sums together; none is needed if the samples of every row are ``together``, one
    after the other in one task, as ``samples_around`` makes them.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [np.sum([p.values.to_numpy(zero_copy_only=False) for p in parts.values], axis=0) if len(parts.values) > 1 else parts.values[0].values.to_numpy(zero_copy_only=False) for parts in b["parts"]]
            yield pa.RecordBatch.from_arrays([b["row_id"], pa.array(sums, pa.list_(pa.float64()))], names=["row_id", "products"])

    parts = _products(samples, features, outputs)
    if together:
        return parts
    parts = parts.groupBy("row_id").agg(F.collect_list("products").alias("parts"))  # as many as runs of the row's samples
    return parts.mapInArrow(total, "row_id long, products array<double>")


def _matrices(b: pa.RecordBatch, m: int) -> np.ndarray:
    return dense_rows(b["products"], m * m).reshape(b.num_rows, m, m)


def _kept(chosen: np.ndarray) -> np.ndarray:
    """Which features any output of a row chose, as a table of rows and features."""
    kept = np.zeros((len(chosen), int(chosen.max(initial=-1)) + 1), bool)
    kept[np.arange(len(chosen))[:, None, None], chosen] = True
    return kept


def _triangle(kept: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of [1, kept features] against themselves and the outputs, each pair of features once."""
    return np.triu_indices(1 + kept, 0, 1 + kept + outputs)


def local_selection(products: DataFrame, features: int, outputs: int, k: int) -> DataFrame:
    """row_id, chosen, products: for each output, the k features that correlate most with it among a row's samples, best first.

    ``products`` are those that the models over these features need (see ``_triangle``), so
    that ``local_models`` reads this table alone.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = _matrices(b, 1 + features + outputs)
            chosen = np.stack([_best(g, features, 1 + features + o, k) for o in range(outputs)], axis=1).astype(np.int32)
            kept = _kept(chosen)
            for size in np.unique(kept.sum(axis=1)):
                of = np.flatnonzero(kept.sum(axis=1) == size)
                at = np.concatenate([np.zeros((len(of), 1), int), 1 + np.nonzero(kept[of])[1].reshape(len(of), size), np.tile(1 + features + np.arange(outputs), (len(of), 1))], axis=1)
                i, j = _triangle(size, outputs)
                picks = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * outputs, pa.int32()), _flat(chosen[of].reshape(len(of) * outputs, -1)))
                yield pa.RecordBatch.from_arrays([b["row_id"].take(pa.array(of)), picks, _flat(g[of[:, None], at[:, i], at[:, j]])], names=["row_id", "chosen", "products"])

    return products.mapInArrow(choose, "row_id long, chosen array<array<int>>, products array<double>")


MODELS = "row_id long, output int, feature int, importance double, intercept double"


def _solved(g: np.ndarray, ids: np.ndarray, output: np.ndarray, chosen: np.ndarray, features: int, ridge: float, names: np.ndarray | None = None) -> pa.RecordBatch:
    """The models of matrices g[i] for output[i] over the features chosen[i], the shortest ones where there are many; names[i] are told for chosen[i]."""
    row, k = np.arange(len(g)), chosen.shape[1]
    at = np.concatenate([np.zeros((len(g), 1), int), 1 + chosen], axis=1)
    a = g[row[:, None, None], at[:, :, None], at[:, None, :]] + ridge * np.diag([0.0] + [1.0] * k)
    solved = (np.linalg.pinv(a, rcond=np.finfo(float).eps * (k + 1)) @ g[row[:, None], at, (1 + features + output)[:, None]][:, :, None])[:, :, 0]
    each = lambda v, t: pa.array(np.repeat(v, k), t)
    columns = [each(ids, pa.int64()), each(output, pa.int32()), pa.array((chosen if names is None else names).ravel(), pa.int32()), pa.array(solved[:, 1:].ravel()), each(solved[:, 0], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["row_id", "output", "feature", "importance", "intercept"])


def local_models(selected: DataFrame, outputs: int, ridge: float = 0.0) -> DataFrame:
    """row_id, output, feature, importance, intercept: a weighted linear model of each output around each row, over the features of ``local_selection``.

    The intercept is the surrogate's value at the row.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            ids, chosen = b["row_id"].to_numpy(), b["chosen"].flatten().flatten().to_numpy().reshape(b.num_rows, outputs, -1)
            kept = _kept(chosen)
            for size in np.unique(kept.sum(axis=1)):
                of = np.flatnonzero(kept.sum(axis=1) == size)
                i, j = _triangle(size, outputs)
                g = np.zeros((len(of), 1 + size, 1 + size + outputs))
                g[:, i, j] = dense_rows(b["products"].take(pa.array(of)), len(i))
                square = j <= size
                g[:, j[square], i[square]] = g[:, i[square], j[square]]
                place = np.cumsum(kept[of], axis=1) - 1
                for o in range(outputs):
                    names = chosen[of, o]
                    yield _solved(g, ids[of], np.full(len(of), o), np.take_along_axis(place, names, axis=1), size, ridge, names)

    return selected.mapInArrow(solve, MODELS)


def local_surrogates(samples: DataFrame, features: int, outputs: int, k: int | None = None, ridge: float = 0.0, together: bool = False) -> DataFrame:
    """Selection and models of every row and output from its products, in one step; see ``local_products``, ``local_selection`` and ``local_models``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = _matrices(b, 1 + features + outputs)
            for o in range(outputs):
                chosen = _best(g, features, 1 + features + o, features if k is None else k)
                yield _solved(g, b["row_id"].to_numpy(), np.full(len(g), o), chosen, features, ridge)

    return local_products(samples, features, outputs, together).mapInArrow(solve, MODELS)


# Shapley values -----------------------------------------------------------------------------------------------


def coalition_plan(features: int, budget: int = 2048, seed: int = 51) -> tuple[list[int], np.ndarray]:
    """(bit masks, kernel weights) of coalitions, empty and full ones left out.

    Sizes are taken from both ends, a coalition always with its complement, while all of a size
    fit into ``budget``; what is left of it draws pairs of the next sizes, which share the
    weight of all sizes that are not complete.
    """
    d, masks, weights = features, [], []
    full = (1 << d) - 1
    sizes = [(s, math.comb(d, s) if 2 * s == d else 2 * math.comb(d, s)) for s in range(1, d // 2 + 1)]
    mass = {s: (d - 1) / (s * (d - s)) * (1 if 2 * s == d else 2) for s, _ in sizes}
    left = budget
    while sizes and sizes[0][1] <= left:
        s, n = sizes.pop(0)
        both = {m for c in itertools.combinations(range(d), s) for m in (sum(1 << j for j in c), full ^ sum(1 << j for j in c))}
        masks += sorted(both)
        weights += [mass[s] / n] * n
        left -= n
    if sizes and left >= 2:
        rnd, drawn = random.Random(seed), set()
        while len(drawn) < left - 1:
            s = rnd.choices([s for s, _ in sizes], [mass[s] for s, _ in sizes])[0]
            m = sum(1 << j for j in rnd.sample(range(d), s))
            drawn |= {m, full ^ m}
        masks += sorted(drawn)
        weights += [sum(mass[s] for s, _ in sizes) / len(drawn)] * len(drawn)
    return masks, np.array(weights)


def _shap_matrix(features: int, masks: Sequence[int], weights: np.ndarray) -> np.ndarray:
    """Row z, the empty and the full coalition last, says what the prediction under z adds to each feature's value.

    It is weighted least squares under the constraint that the values sum to the full
    prediction minus the empty one, which removes the last feature.
    """
    d = features
    if d == 1:
        return np.array([[-1.0], [1.0]])
    z = np.array([[m >> j & 1 for j in range(d)] for m in masks], float).reshape(len(masks), d)
    free = z[:, :-1] - z[:, -1:]
    solve = np.linalg.pinv((free * weights[:, None]).T @ free) @ (free * weights[:, None]).T
    last = z[:, -1]
    head = np.concatenate([solve.T, [-solve.sum(axis=1) + solve @ last], [-solve @ last]])
    whole = np.zeros(len(masks) + 2)
    whole[-2:] = -1, 1
    return np.concatenate([head, (whole - head.sum(axis=1))[:, None]], axis=1)


def shap_values(rows: DataFrame, background: Sequence[Sequence[float]], score: Callable[[str], Column], features: int, outputs: int = 1, budget: int = 2048) -> DataFrame:
    """row_id, output, base, prediction, values ARRAY: KernelSHAP of every row (row_id, x).

    ``score(x)`` is the model's ARRAY of outputs for a vector column.  A feature outside a
    coalition takes the values of ``background``, a bounded list of rows whose scores are
    averaged.  Values sum to prediction - base, and equal the Shapley values if all
    coalitions fit into ``budget``.  Values are linear in the scores, so a row takes one
    aggregation over its coalitions and background rows; the plan holds both as constants.
    """
    masks, weights = coalition_plan(features, budget)
    told = _shap_matrix(features, masks, weights)
    plan = [{"mask": m, "adds": a} for m, a in zip([*masks, 0, (1 << features) - 1], told.tolist(), strict=True)]
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    each = rows.select("row_id", "x", F.explode(constant(plan, "array<struct<mask: bigint, adds: array<double>>>")).alias("c"))
    each = each.select("row_id", "x", "c.mask", "c.adds", F.explode(constant([list(map(float, b)) for b in background], "array<array<double>>")).alias("b"))
    mixed = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << j)) != 0, F.get("x", F.lit(j))).otherwise(F.get("b", F.lit(j))) for j in range(features)])
    scored = each.select("row_id", "mask", "adds", mixed.alias("x")).select("row_id", "mask", "adds", score("x").alias("y"))
    share, full = 1.0 / len(background), (1 << features) - 1
    y = lambda o: F.get("y", F.lit(o)) * share
    sums = [F.struct(
        F.lit(o).alias("output"), F.sum(F.when(F.col("mask") == 0, y(o)).otherwise(0.0)).alias("base"), F.sum(F.when(F.col("mask") == full, y(o)).otherwise(0.0)).alias("prediction"),
        F.array(*[F.sum(F.get("adds", F.lit(j)) * y(o)) for j in range(features)]).alias("values"),
    ) for o in range(outputs)]
    return scored.groupBy("row_id").agg(F.array(*sums).alias("all")).select("row_id", F.inline("all"))
