"""Weighted means and all products of many columns from one pass: X'WX by feature blocks.

Each partition multiplies its rows block by block and sends one row a block of features;
blocks are summed entry by entry with map-side sums.  No row is unfolded to (row, feature), and
the plan does not grow with the features.  Columns are shifted by a reference point near
their means first, so that large means cancel nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.operators.ensemble import dense_rows

#: Features of a block.
BLOCK = 64
#: Rows whose mean is the reference point; it only has to be near.
REFERENCE_ROWS = 64


@dataclass(frozen=True)
class Moments:
    """rows, sum of weights, means, and the weighted sums of products of deviations from the means."""

    rows: int
    weight: float
    mean: np.ndarray
    scatter: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.scatter / self.weight if self.weight else np.full_like(self.scatter, np.nan)

    def correlations(self) -> np.ndarray:
        """NaN where a column is constant."""
        spread = np.sqrt(np.maximum(np.diag(self.scatter), 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.clip(self.scatter / np.outer(spread, spread), -1, 1)

    def regression(self, inputs: Sequence[int], target: int, ridge: float = 0.0) -> tuple[float, np.ndarray]:
        """(intercept, slopes) of weighted least squares, the shortest solution where there are many."""
        inputs = list(inputs)
        a = self.scatter[np.ix_(inputs, inputs)] + ridge * np.eye(len(inputs))
        slopes = np.linalg.lstsq(a, self.scatter[inputs, target], rcond=None)[0]
        return float(self.mean[target] - slopes @ self.mean[inputs]), slopes


def moments(df: DataFrame, x: Column | str = "x", weight: Column | str | None = None, block: int = BLOCK) -> Moments:
    """Moments of the vector column ``x``; rows with a null or NaN entry, a null weight, or of another length than the first row's are left out.

    The driver gets the square of the length in numbers. An empty table has zero rows and no columns.
    """
    x = F.col(x) if isinstance(x, str) else x
    w = F.lit(1.0) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    rows = df.select(F.transform(x, lambda v: v.cast("double")).alias("x"), w.cast("double").alias("w")).where("x is not null and w is not null")
    near = rows.limit(REFERENCE_ROWS).collect()
    if not near:
        return Moments(0, 0.0, np.zeros(0), np.zeros((0, 0)))
    d = len(near[0]["x"])
    first = np.array([[np.nan if v is None else v for v in r["x"]] for r in near if len(r["x"]) == d])
    reference = np.nan_to_num(np.array([np.mean(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in first.T]))
    size = F.size("x") == d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, total = 0, np.zeros(d + 1), np.zeros((d, d))
        for b in batches:
            z, v = dense_rows(b["x"], d) - reference, b["w"].to_numpy(zero_copy_only=False)
            whole = ~np.isnan(z).any(axis=1) & ~np.isnan(v)
            z, v = z[whole], v[whole]
            count += len(z)
            sums[0] += v.sum()
            sums[1:] += v @ z
            for a in range(0, d, block):
                total[a : a + block, a:] += (z[:, a : a + block] * v[:, None]).T @ z[:, a:]
        if count:
            places, parts = [(-1, -1)], [np.concatenate([[count], sums])]
            for a in range(0, d, block):
                for c in range(a, d, block):
                    places.append((a, c))
                    parts.append(total[a : a + block, c : c + block].ravel())
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in places], pa.int32()) for i in (0, 1)] + [pa.array(parts, pa.list_(pa.float64()))], names=["a", "c", "part"])

    parts = rows.where(size).mapInArrow(run, "a int, c int, part array<double>")
    told = parts.select("a", "c", F.posexplode("part").alias("at", "v")).groupBy("a", "c", "at").agg(F.sum("v").alias("v")).collect()
    head, full = np.zeros(d + 2), np.zeros((d, d))
    for r in told:
        if r["a"] < 0:
            head[r["at"]] = r["v"]
            continue
        width = min(block, d - r["c"])
        i, j = r["a"] + r["at"] // width, r["c"] + r["at"] % width
        full[i, j] = full[j, i] = r["v"]
    weight_sum = head[1]
    shift = head[2:] / weight_sum if weight_sum else np.zeros(d)
    return Moments(int(head[0]), float(weight_sum), reference + shift, full - weight_sum * np.outer(shift, shift))


def correlation_table(df: DataFrame, x: Column | str = "x", weight: Column | str | None = None) -> DataFrame:
    """feature_i < feature_j and their weighted correlation; null where one is constant."""
    c = moments(df, x, weight).correlations()
    rows = [(i, j, None if np.isnan(c[i, j]) else float(c[i, j])) for i in range(len(c)) for j in range(i + 1, len(c))]
    return df.sparkSession.createDataFrame(rows, "feature_i int, feature_j int, corr double")
