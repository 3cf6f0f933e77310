"""Declarative jobs: a dictionary names the task, the algorithm and its parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.operators import linear, metrics, mlp, tree
from colligo.operators.order import split_train_test
from colligo.operators.tables import align
from colligo.sources.scratch import materialize

#: Keys of other job files, in both spellings, that no trainer follows.
UNUSED = ("converge_threshold", "convergence_threshold")
ALGORITHMS = ("logistic_regression", "linear_regression", "decision_tree", "random_forest", "gbdt", "mlp")


@dataclass(frozen=True)
class Job:
    """One training job over aligned party tables."""

    name: str
    algorithm: str
    task: str = "classification"
    train_fraction: float = 0.8
    seed: int = 51
    params: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm}")
        if self.task not in ("classification", "regression"):
            raise ValueError(f"unknown task {self.task}")

    @classmethod
    def parse(cls, spec: Mapping[str, Any]) -> Job:
        params = dict(spec.get("params", {}))
        if set(params) & set(UNUSED):
            raise ValueError(f"training always runs all its iterations: {sorted(set(params) & set(UNUSED))} would not be used")
        return cls(spec["name"], spec["algorithm"], spec.get("task", "classification"), spec.get("train_fraction", 0.8), spec.get("seed", 51), params)


def train(job: Job, rows: DataFrame):
    """The fitted model of a job over (row_id, x, y); parameters that no trainer reads raise."""
    p = dict(job.params)
    features = len(rows.select("x").first()["x"])
    if job.algorithm in ("logistic_regression", "linear_regression"):
        return linear.fit(rows, job.algorithm.split("_")[0], features, **p)
    classes = p.pop("classes", 2) if job.task == "classification" else 0
    if job.algorithm == "decision_tree":
        return tree.grow(rows, classes, **p)
    if job.algorithm == "random_forest":
        return tree.forest(rows, p.pop("trees", 5), classes=classes, **p)
    if job.algorithm == "gbdt":
        return tree.boost(rows, "deviance" if classes else "ls", classes or 2, **p)
    outputs = 1 if classes <= 2 else classes
    last = "identity" if not classes else "logistic" if outputs == 1 else "softmax"
    hidden = p.pop("hidden", [8])
    start = mlp.Mlp.initial([features, *hidden, outputs], [*["relu"] * len(hidden), last], job.seed)
    return mlp.fit(rows, start, p.pop("iterations", 20), p.pop("rate", 0.1), **p)


def predict(job: Job, model, rows: DataFrame) -> DataFrame:
    if job.algorithm in ("logistic_regression", "mlp") and job.task == "classification":
        return rows.withColumn("prediction", model.label())
    if job.algorithm == "mlp":
        return rows.withColumn("prediction", F.get(model.output(), F.lit(0)))
    return rows.withColumn("prediction", model.predict())


def fit_and_report(job: Job, rows: DataFrame) -> tuple[Any, DataFrame]:
    """(model, report) of (row_id, x, y): split, train, and evaluate both halves; the report has a row for each half."""
    rows = materialize(split_train_test(rows, "row_id", job.train_fraction, job.seed), "split")
    model = train(job, rows.where("is_train"))
    report = None
    for part, condition in (("train", "is_train"), ("test", "not is_train")):
        scored = predict(job, model, rows.where(condition))
        one = metrics.classification_report(scored) if job.task == "classification" else metrics.regression_report(scored)
        one = one.withColumn("part", F.lit(part))
        report = one if report is None else report.union(one)
    return model, report


def run(job: Job, parties: list[DataFrame]) -> tuple[Any, DataFrame]:
    """Parties are aligned once, and the aligned rows saved: the split counts them, and all steps read them."""
    return fit_and_report(job, materialize(align(parties), "aligned"))
