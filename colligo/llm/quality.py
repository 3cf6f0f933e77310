"""A generalised additive model with pairwise interactions for document quality.

Cyclic boosting: shallow trees are fitted to one feature after another, round after
round, and add up to one lookup table a feature; then to the pairs of features that
explain most of what is left.  A score is a sum of table entries, looked up for whole
batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm import kernels

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "upper", "digit", "symbol", "punctuation", "non_ascii", "line_feeds", "distinct_words",
    "top_word", "symbol_words", "upper_words", "short_words", "long_words", "bar_words", "repeated_words",
)
#: Rows that a fit may hold: the features of so many labelled rows are all the driver gets.
SAMPLE_ROWS = 20_000

CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91], CLASSES[48:58], CLASSES[97:123], CLASSES[128:] = 1, 2, 3, 4
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = 5
CLASSES[[c for c in range(33, 127) if CLASSES[c] == 0]] = 6


def text_features(column: pa.Array) -> np.ndarray:
    """features[row]: shares and sizes of the whole text; an empty or null text is all zeros."""
    data, offs = kernels.utf8(column)
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    for a, b in kernels.chunks(offs, 1 << 19):
        part, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, first = kernels.spans(part, at)
        hashes = kernels.hash_words(kernels.LOWER[part], starts, ends)
        size, words = np.diff(at), np.diff(first)
        kinds = CLASSES[part]
        upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
        per_text = lambda mask: np.diff(upto(mask)[at]) / np.maximum(size, 1)
        per_word = lambda mask: np.diff(upto(mask)[first]) / np.maximum(words, 1)
        length = ends - starts
        within = lambda kind: (c := upto(kinds == kind))[ends] - c[starts]
        owner = np.repeat(np.arange(b - a), words)
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(hashes[order]) != 0) | (np.diff(owner[order]) != 0)
        runs = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        run_owner = owner[order][new]
        top = np.zeros(b - a)
        np.maximum.at(top, run_owner, runs)
        repeated = np.bincount(run_owner, np.where(runs > 1, runs, 0), minlength=b - a)
        symbols, upper = within(6), within(1)
        out[a:b] = np.stack([
            np.log1p(size), np.log1p(words), size / np.maximum(words, 1), per_text(kinds == 1), per_text(kinds == 2), per_text(kinds == 6), per_text(kinds == 5),
            per_text(kinds == 4), per_text(part == 10), np.bincount(run_owner, minlength=b - a) / np.maximum(words, 1), top / np.maximum(words, 1),
            per_word(symbols >= 2), per_word((upper >= 2) & (2 * upper > length)), per_word(length <= 2), per_word(length >= 14), per_word((length == 1) & (symbols == 1)),
            repeated / np.maximum(words, 1),
        ], axis=1)
    return out


@dataclass
class Model:
    """edges[j]: bin limits of feature j; tables[j]: its values; pairs: (i, j, table over coarse bins)."""

    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.coarse)]
        for i, j, table in self.pairs:
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _quantiles(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="midpoint"))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Leaf value of every bin: up to ``leaves`` runs of bins, split where the gain is largest."""
    cuts = [0, len(g)]
    G, H = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = np.arange(a + 1, b)
            if len(m):
                gl, hl, gr, hr = G[m] - G[a], H[m] - H[a], G[b] - G[m], H[b] - H[m]
                gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1), 0)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), int(m[k])))
        if best[1] < 0:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _leaf(G[b] - G[a], H[b] - H[a])
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Depth two: the cut of the rows whose sides, each cut once along the columns, gain most."""
    best, out = -1.0, np.zeros(g.shape)
    for cut in range(1, len(g)):
        step, gain = np.empty(g.shape), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            sum_g, sum_h = g[rows].sum(axis=0), h[rows].sum(axis=0)
            step[rows] = leaf = _shallow_tree(sum_g, sum_h, 2, least)
            gain += float(2 * leaf @ sum_g - leaf**2 @ sum_h)
        if gain > best:
            best, out = gain, step
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, leaves: int = 3, pair_bins: int = 8, most_pairs: int = 6, least: float = 0.5) -> Model:
    """Fit tables to 0/1 labels. One label only, or no rows, gives the constant model of that share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_quantiles(x[:, j], bins) for j in range(d)]
    model.coarse = [_quantiles(x[:, j], pair_bins) for j in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(model.edges[j], x[:, j], "right") for j in range(d)]
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            n = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(binned[j], g, n), np.bincount(binned[j], h, n), leaves, least)
            model.tables[j] += step
            total += step[binned[j]]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], "right") for j in range(d)]
    shape = [len(e) + 1 for e in model.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = coarse[i] * shape[j] + coarse[j]
        return np.bincount(at, g, shape[i] * shape[j]), np.bincount(at, h, shape[i] * shape[j])

    gain = {(i, j): float((g**2 / (h + 1)).sum()) for i in range(d) for j in range(i) for g, h in [cells(i, j)]}
    for i, j in sorted(gain, key=lambda k: (-gain[k], k))[:most_pairs]:
        model.pairs.append((i, j, np.zeros((shape[i], shape[j]))))
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = cells(i, j)
            step = rate * _grid_tree(g.reshape(table.shape), h.reshape(table.shape), least)
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a sample of at most ``sample_rows`` labelled rows, the first in hash order.

    ``labels``: (doc_id, quality).  Only texts of the sample's documents are read into features.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(text_features(batch["text"]).tolist(), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    # the sample has sample_rows rows at most, so it can be broadcast whatever the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, f"doc_id {kind}, label double, x array<double>")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows).select("label", "x").collect()
    return np.array([r["x"] for r in got]).reshape(len(got), len(FEATURES)), np.array([r["label"] for r in got])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The columns of ``docs`` (text among them) with score and predicted, for every row.

    Null texts score as empty ones.  Columns of ``docs`` named score or predicted give way
    to the new ones.  Repeated rows score alike.  An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(text_features(batch["text"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)
