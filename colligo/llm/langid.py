"""Multilingual mixture inference over hashed byte trigrams.

A model holds each language's trigram probabilities.  Expectation-maximisation
estimates a document's language proportions from them; nested sets of languages, from
the largest proportion down, are refitted, and the set with the largest likelihood
less a penalty for each language is the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm import kernels

BUCKETS = 4096
LETTER = regex.compile(r"\p{L}")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def trigram_counts(column: pa.Array, limit: int = 512) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, counts[row, bucket]) of byte trigrams in lower case, with a space at both ends."""
    data, offs = kernels.utf8(column)
    low = kernels.LOWER[data]
    low[kernels.SEPARATOR[low]] = 32
    for a, b in kernels.chunks(offs, 1 << 20):
        for k in range(a, b, limit):
            end = min(b, k + limit)
            rows = np.repeat(np.arange(end - k), np.diff(offs[k : end + 1]) + 2)
            padded = np.full(len(rows), 32, np.uint32)
            at = np.arange(offs[end] - offs[k]) + 2 * rows_of(offs[k : end + 1]) + 1
            padded[at] = low[offs[k] : offs[end]]
            code = padded[:-2] | padded[1:-1] << np.uint32(8) | padded[2:] << np.uint32(16)
            bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - 12)
            same = rows[:-2] == rows[2:]
            n = end - k
            yield k, end, np.bincount(rows[:-2][same] * BUCKETS + bucket[same], minlength=n * BUCKETS).reshape(n, BUCKETS)


def rows_of(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


@dataclass(frozen=True)
class Model:
    """languages, and log-probability tables: rows are languages, columns are buckets."""

    languages: tuple[str, ...]
    probabilities: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams of every labelled document.

    Rows with null text or lang teach nothing.  Each task sends one count row for
    each language and bucket it saw, so the model's size is languages x 4096.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch["lang"].to_pylist(), object)
            for a, b, counts in trigram_counts(batch["text"]):
                for name in set(names[a:b]):
                    mine = counts[names[a:b] == name].sum(axis=0)
                    totals[name] = totals[name] + mine if name in totals else mine
        for name, mine in totals.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(mine[at], pa.int64())], names=["lang", "bucket", "n"])

    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in rows:
        table[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return Model(languages, table / table.sum(axis=1, keepdims=True))


def _em(weights: np.ndarray, share: np.ndarray, p: np.ndarray, steps: int) -> np.ndarray:
    """Proportions after expectation-maximisation; weights are the buckets' shares of the text."""
    for _ in range(steps):
        new = share * ((weights / (share @ p)) @ p.T)
        if np.abs(new - share).max() < 1e-3:
            return new
        share = new
    return share


def infer(counts: np.ndarray, p: np.ndarray, penalty: float = 3.0, steps: int = 30) -> np.ndarray:
    """Proportions of one document's languages.

    ``penalty`` x log(trigrams) log-likelihood units are charged for every language
    beyond the first.  Languages that hold less than one trigram after the fit of all
    are in no set.
    """
    seen = np.flatnonzero(counts)
    n = float(counts.sum())
    q, weights = p[:, seen], counts[seen] / n
    full = _em(weights, np.full(len(p), 1 / len(p)), q, steps)
    order = np.argsort(-full, kind="stable")
    best, value = full, -np.inf
    for k in range(1, len(p) + 1):
        if k > 1 and full[order[k - 1]] * n < 1:
            break
        pick = np.sort(order[:k])
        share = np.ones(1) if k == 1 else _em(weights, full[pick] / full[pick].sum(), q[pick], steps)
        score = n * float(weights @ np.log(share @ q[pick])) - (k - 1) * penalty * np.log(max(n, 2))
        if score > value:
            value, best = score, np.zeros(len(p))
            best[pick] = share
    return best / best.sum()


def predict(docs: DataFrame, model: Model, penalty: float = 3.0) -> DataFrame:
    """doc_id, lang_pred, score, mixture of every document, from its whole text.

    lang_pred has the largest proportion, which is the score (ties: the first name).
    Null texts, texts without a letter, and any text under a model without languages
    are ``und`` with score 0 and an empty mixture.  Repeated rows get equal answers; null
    doc_ids stay null.  Other columns, whatever their names, are not read.  An empty
    table gives an empty result.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.array([bool(t and LETTER.search(t)) for t in batch["text"].to_pylist()], bool)
            names, scores, mixtures = ["und"] * len(known), np.zeros(len(known)), [[] for _ in known]
            for a, b, counts in trigram_counts(batch["text"]) if model.languages else ():
                for k in np.flatnonzero(known[a:b]):
                    share = infer(counts[k], model.probabilities, penalty)
                    top = int(share.argmax())
                    names[a + k], scores[a + k] = model.languages[top], min(1.0, float(share[top]))
                    mixtures[a + k] = [(model.languages[j], float(share[j])) for j in np.flatnonzero(share)]
            mixed = pa.array(mixtures, pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(names, pa.string()), pa.array(scores), mixed], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, mixture map<string,double>")
