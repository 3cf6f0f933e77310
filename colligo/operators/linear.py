"""Linear and logistic regression by gradient steps; a step is one aggregation, the weights live on the driver."""

from __future__ import annotations

import functools
import math
import operator
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.functions.vectors import LOG_LOSS_EPSILON, logistic
from colligo.operators.moments import moments
from colligo.operators.tables import batch_conditions
from colligo.sources.scratch import materialize

#: Iterations whose batches are saved together.
DRAWN = 64


@dataclass(frozen=True)
class LinearModel:
    """kind is linear or logistic; with bias the first weight belongs to a constant 1."""

    kind: str
    weights: tuple[float, ...]
    bias: bool = True

    def raw(self, x: str = "x") -> Column:
        total = F.lit(self.weights[0] if self.bias else 0.0)
        for j, w in enumerate(self.weights[self.bias :]):
            total = total + F.lit(float(w)) * F.get(x, F.lit(j))
        return total

    def predict(self, x: str = "x") -> Column:
        return logistic(self.raw(x)) if self.kind == "logistic" else self.raw(x)

    def probabilities(self, x: str = "x") -> Column:
        """[1 - p, p]."""
        return F.array(1 - self.predict(x), self.predict(x))

    def label(self, x: str = "x", threshold: float = 0.5) -> Column:
        return F.when(self.predict(x) >= threshold, 1.0).otherwise(0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(j, float(w)) for j, w in enumerate(self.weights)], "global_idx int, w double")


def gradient(df: DataFrame, model: LinearModel, x: str = "x", y: str = "y", weight: str | None = None) -> tuple[int, list[float]]:
    """Rows, and the sum of (prediction - y) times each input, from one pass."""
    error = (model.predict(x) - F.col(y)) * (F.col(weight) if weight else F.lit(1.0))
    inputs = [F.lit(1.0)] * model.bias + [F.get(x, F.lit(j)) for j in range(len(model.weights) - model.bias)]
    row = df.select(error.alias("e"), *[i.alias(f"i{n}") for n, i in enumerate(inputs)]).agg(F.count("*"), *[F.sum(F.col("e") * F.col(f"i{n}")) for n in range(len(inputs))]).first()
    return row[0], [v or 0.0 for v in row[1:]]


def step(model: LinearModel, rows: int, sums: Sequence[float], rate: float, penalty: str | None, alpha: float) -> LinearModel:
    """w - rate (c / B sum + penalty); c is 2 for squared loss. The bias is penalised like any weight."""
    c = 2.0 if model.kind == "linear" else 1.0
    out = []
    for w, s in zip(model.weights, sums, strict=True):
        extra = {None: 0.0, "l2": 2 * alpha * w, "l1": alpha * ((w > 0) - (w < 0))}[penalty]
        out.append(w - rate * (c * s / max(rows, 1) + extra))
    return LinearModel(model.kind, tuple(out), model.bias)


def fit(
    df: DataFrame, kind: str, features: int, iterations: int = 10, rate: float = 0.1, penalty: str | None = None, alpha: float = 0.0, bias: bool = True,
    batch: int | None = None, key: str = "row_id", weight: str | None = None, initial: Sequence[float] | None = None,
) -> LinearModel:
    """Exactly ``iterations`` steps from ``initial`` (zeros), on all rows or on a batch of its own hash order each.

    The batches of all iterations are planned by the same few counts, and the rows of ``DRAWN`` batches
    saved by one pass; a step is then one job over them.
    """
    if kind not in ("linear", "logistic"):
        raise ValueError(f"unknown model {kind}")
    model = LinearModel(kind, tuple(initial or [0.0] * (features + bias)), bias)
    mine = not df.is_cached
    if mine:
        df = df.persist()
    try:
        batches = batch_conditions(df, key, batch, range(iterations)) if batch else [None] * iterations
        for t, condition in enumerate(batches):
            if condition is not None and t % DRAWN == 0:
                drawn = materialize(df.where(functools.reduce(operator.or_, batches[t : t + DRAWN])), "batches")
            rows, sums = gradient(df if condition is None else drawn.where(condition), model, weight=weight)
            model = step(model, rows, sums, rate, penalty, alpha)
    finally:
        if mine:
            df.unpersist()
    return model


def uniform_start(features: int, bias: bool = True, seed: int = 51) -> list[float]:
    """Seeded weights from the uniform distribution on [-sqrt(2 / n), sqrt(2 / n)], n the number of weights."""
    n = features + bias
    rnd = random.Random(seed)
    return [rnd.uniform(-math.sqrt(2 / n), math.sqrt(2 / n)) for _ in range(n)]


def least_squares(df: DataFrame, features: int, weight: str | None = None, ridge: float = 0.0) -> LinearModel:
    """Exact (weighted) least squares with bias, from the moments of (x, y); as few operators for many features as for one."""
    told = moments(df, F.concat(F.slice("x", 1, features), F.array(F.col("y").cast("double"))), weight)
    if not told.rows:
        return LinearModel("linear", (0.0,) * (features + 1), True)
    intercept, slopes = told.regression(range(features), features, ridge)
    return LinearModel("linear", (intercept, *slopes.tolist()), True)


def loss(df: DataFrame, model: LinearModel, alpha: float = 0.0) -> DataFrame:
    """loss: mean log loss, or the sum of squared errors plus alpha |w|^2."""
    p = model.predict()
    if model.kind == "logistic":
        c = F.least(F.greatest(p, F.lit(LOG_LOSS_EPSILON)), F.lit(1 - LOG_LOSS_EPSILON))
        return df.agg(F.avg(-(F.col("y") * F.ln(c) + (1 - F.col("y")) * F.ln(1 - c))).alias("loss"))
    return df.agg((F.sum((p - F.col("y")) * (p - F.col("y"))) + F.lit(alpha * sum(w * w for w in model.weights))).alias("loss"))
