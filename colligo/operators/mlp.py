"""Multi-layer perceptrons: gradients are summed per partition with numpy, weights live on the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.functions.vectors import affine, softmax
from colligo.operators.tables import batch_conditions

ACTIVATIONS = {"logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)), "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)), "identity": (lambda z: z, np.ones_like)}


@dataclass
class Mlp:
    """weights[l]: inputs x outputs of layer l; activations one a layer (the last: logistic, softmax or identity)."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    activations: list[str]

    @classmethod
    def initial(cls, sizes: Sequence[int], activations: Sequence[str], seed: int = 51) -> Mlp:
        """Uniform within sqrt(f / (in + out)), f = 2 for logistic layers and 6 for others."""
        rng = np.random.default_rng(seed)
        bounds = [np.sqrt((2 if a == "logistic" else 6) / (i + o)) for i, o, a in zip(sizes, sizes[1:], activations, strict=False)]
        return cls([rng.uniform(-b, b, (i, o)) for i, o, b in zip(sizes, sizes[1:], bounds, strict=False)], [np.zeros(o) for o in sizes[1:]], list(activations))

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for w, b, a in zip(self.weights, self.biases, self.activations, strict=True):
            z = out[-1] @ w + b
            if a == "softmax":
                e = np.exp(z - z.max(axis=1, keepdims=True))
                out.append(e / e.sum(axis=1, keepdims=True))
            else:
                out.append(ACTIVATIONS[a][0](z))
        return out

    def output(self, x: str = "x") -> Column:
        """The last layer as Spark expressions: scoring needs no Python."""
        v = F.col(x)
        for w, b, a in zip(self.weights, self.biases, self.activations, strict=True):
            v = affine(v, w.T.tolist(), b.tolist())
            if a == "logistic":
                v = F.transform(v, lambda e: 1 / (1 + F.exp(-e)))
            elif a == "relu":
                v = F.transform(v, lambda e: F.greatest(e, F.lit(0.0)))
            elif a == "softmax":
                v = softmax(v)
        return v

    def label(self, x: str = "x") -> Column:
        out = self.output(x)
        if self.weights[-1].shape[1] == 1:
            return F.when(F.get(out, F.lit(0)) >= 0.5, 1.0).otherwise(0.0)
        return F.array_position(out, F.array_max(out)).cast("double") - 1


def gradients(df: DataFrame, model: Mlp) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """Rows and summed gradients of (x, y): each task sends one row of the size of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, gw, gb = 0, [np.zeros_like(w) for w in model.weights], [np.zeros_like(b) for b in model.biases]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch["y"].to_numpy(zero_copy_only=False)
            a = model.forward(x)
            target = y[:, None] if a[-1].shape[1] == 1 else np.eye(a[-1].shape[1])[y.astype(int)]
            delta = a[-1] - target
            for layer in range(len(model.weights) - 1, -1, -1):
                gw[layer] += a[layer].T @ delta
                gb[layer] += delta.sum(axis=0)
                if layer:
                    delta = (delta @ model.weights[layer].T) * ACTIVATIONS[model.activations[layer - 1]][1](a[layer])
            rows += batch.num_rows
        flat = np.concatenate([g.ravel() for g in (*gw, *gb)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.concatenate([flat, [rows]]))], names=["i", "g"])

    sums = {r["i"]: r["g"] for r in df.select("x", "y").mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()}
    flat = np.array([sums[i] for i in range(len(sums))])
    out, at = [], 0
    for shape in [w.shape for w in model.weights] + [b.shape for b in model.biases]:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    k = len(model.weights)
    return int(flat[-1]), out[:k], out[k:]


def fit(df: DataFrame, model: Mlp, iterations: int, rate: float, alpha: float = 0.0, batch: int | None = None) -> Mlp:
    """Gradient steps of mean loss plus alpha / B W per step."""
    mine = not df.is_cached
    if mine:
        df = df.persist()
    batches = batch_conditions(df, "row_id", batch, range(iterations)) if batch else [None] * iterations
    for condition in batches:
        rows, gw, gb = gradients(df if condition is None else df.where(condition), model)
        rows = max(rows, 1)
        model = Mlp([w - rate / rows * (g + alpha * w) for w, g in zip(model.weights, gw, strict=True)], [b - rate / rows * g for b, g in zip(model.biases, gb, strict=True)], model.activations)
    if mine:
        df.unpersist()
    return model
