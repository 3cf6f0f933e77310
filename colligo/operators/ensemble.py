"""Tree ensembles as parallel arrays, walked level by level over all trees of a batch of rows at once.

A nested CASE grows with every node and stops compiling in the hundreds of trees.  Here
the plan holds one function, whatever the number of trees, and a step is one comparison of a
(rows x trees) table; as many steps are taken as the deepest tree has levels.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRAYS = "start array<int>, feature array<int>, threshold array<double>, left array<int>, right array<int>, node_id array<bigint>, value array<double>, output array<int>, base array<double>, depth int, outputs int"
#: Rows of a walk times its trees, at most: bounds a task's memory.
CELLS = 1 << 20


def _expit(raw: np.ndarray, _: int) -> np.ndarray:
    p = 1 / (1 + np.exp(-raw))
    return np.concatenate([1 - p, p], axis=1)


def _softmax(raw: np.ndarray, _: int) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


LINKS = {"identity": lambda raw, _: raw, "mean": lambda raw, trees: raw / trees, "exp": lambda raw, _: np.exp(raw), "expit": _expit, "softmax": _softmax}


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees one after the other.

    Node i sends a row to left[i] if x[feature[i]] <= threshold[i], else, also for null and
    NaN, to right[i]; a leaf leads to itself.  A leaf adds value[i] to output[i]; the outputs
    start at ``base``.
    """

    start: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    node_id: np.ndarray
    value: np.ndarray
    output: np.ndarray
    base: np.ndarray
    depth: int

    @classmethod
    def of_nodes(cls, trees: Sequence[Sequence], base: Sequence[float], add) -> Ensemble:
        """From trees of nodes (node_id, is_leaf, feature, threshold), heap-numbered; ``add(tree, node)`` is the (output, value) of a leaf."""
        start, rows, depth = [], [], 0
        for t, nodes in enumerate(trees):
            at = {n.node_id: len(rows) + k for k, n in enumerate(nodes)}
            start.append(at[0])
            for n in nodes:
                here = at[n.node_id]
                depth = max(depth, (n.node_id + 1).bit_length() - 1)
                if n.is_leaf:
                    rows.append((0, np.inf, here, here, n.node_id, *add(t, n)[::-1]))
                else:
                    rows.append((n.feature, n.threshold, at[2 * n.node_id + 1], at[2 * n.node_id + 2], n.node_id, 0.0, 0))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (np.int32, np.float64, np.int32, np.int32, np.int64, np.float64, np.int32)
        return cls(np.array(start, np.int32), *[np.array(c, k) for c, k in zip(columns, kinds, strict=True)], np.array(base, np.float64), depth)

    # walking ---------------------------------------------------------------------------------------

    def _leaves(self, x: np.ndarray) -> np.ndarray:
        """Index of the leaf that each row (of x) reaches in each tree."""
        at = np.broadcast_to(self.start, (len(x), len(self.start))).copy()
        row = np.arange(len(x))[:, None]
        with np.errstate(invalid="ignore"):
            for _ in range(self.depth):
                at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def _pieces(self, x: pa.Array):
        dense = dense_rows(x, int(self.feature.max(initial=0)) + 1)
        step = max(1, CELLS // max(1, len(self.start)))
        for k in range(0, len(dense), step):
            yield self._leaves(dense[k : k + step])

    def leaves(self, x: str | Column = "x") -> Column:
        """ARRAY<BIGINT>: heap number of the leaf in each tree."""

        @F.arrow_udf("array<bigint>")
        def walk(x: pa.Array) -> pa.Array:
            return _lists([self.node_id[at] for at in self._pieces(x)], len(self.start), pa.int64())

        return walk(x)

    def votes(self, x: str | Column = "x") -> Column:
        """ARRAY<DOUBLE>: value of the leaf in each tree."""

        @F.arrow_udf("array<double>")
        def walk(x: pa.Array) -> pa.Array:
            return _lists([self.value[at] for at in self._pieces(x)], len(self.start), pa.float64())

        return walk(x)

    def scores(self, x: str | Column = "x", link: str = "identity") -> Column:
        """ARRAY<DOUBLE>: every output, its base and the values of all leaves that add to it, in the order of the trees.

        ``link`` mean divides by the trees, softmax gives shares, expit the two shares of one output.
        """
        if link not in LINKS:
            raise ValueError(f"unknown link {link}")
        k = len(self.base) + (link == "expit")

        @F.arrow_udf("array<double>")
        def walk(x: pa.Array) -> pa.Array:
            out = []
            for at in self._pieces(x):
                total = np.tile(self.base, (len(at), 1))
                row = np.arange(len(at))
                for t in range(at.shape[1]):
                    total[row, self.output[at[:, t]]] += self.value[at[:, t]]
                out.append(LINKS[link](total, max(1, len(self.start))))
            return _lists(out, k, pa.float64())

        return walk(x)

    # saving ----------------------------------------------------------------------------------------

    def table(self, spark: SparkSession) -> DataFrame:
        """One row of arrays."""
        row = [getattr(self, name).tolist() for name in ("start", "feature", "threshold", "left", "right", "node_id", "value", "output", "base")]
        return spark.createDataFrame([(*row, self.depth, len(self.base))], ARRAYS)

    @classmethod
    def of_table(cls, df: DataFrame) -> Ensemble:
        r = df.first()
        kinds = {"start": np.int32, "feature": np.int32, "threshold": np.float64, "left": np.int32, "right": np.int32, "node_id": np.int64, "value": np.float64, "output": np.int32, "base": np.float64}
        return cls(*[np.array(r[name], kind) for name, kind in kinds.items()], r["depth"])


def dense_rows(x: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of a table of ``width`` columns at least; null vectors and entries, and missing ones, are NaN."""
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    sizes = np.array(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.array(x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    wide = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.full((len(sizes), wide), np.nan)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _lists(pieces: list[np.ndarray], width: int, kind: pa.DataType) -> pa.Array:
    rows = np.concatenate(pieces) if pieces else np.zeros((0, width))
    offsets = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel(), kind))
