"""Surrogates and Shapley values of all rows, staged jobs, files aligned by position, and a stream that is restarted."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligo.operators import explain, linear, tables, tree
from colligo.plans import stages
from colligo.sources import io
from colligo.streaming import users


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    x = rng.random((40, 4))
    y = (x[:, 0] + 0.5 * x[:, 2] > 0.7).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double").cache()


def test_samples(spark, rows):
    got = explain.samples_around(rows, [0.3] * 4, 50, low=0.0, high=1.0).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_id, []).append(r)
        assert r.sample or r.x == r.around
        assert all(0 <= v <= 1 for v in r.x)
    assert len(by) == 40 and all(len(v) == 50 for v in by.values())
    noise = np.array([np.subtract(r.x, r.around) for r in explain.samples_around(rows, [1.0] * 4, 200).collect() if r.sample])
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 1) < 0.02 and abs(np.corrcoef(noise.T) - np.eye(4)).max() < 0.05


@pytest.mark.parametrize("k", [2, 4])
def test_surrogates_against_a_solve_of_each_row(spark, rows, k):
    model = tree.boost(rows.withColumn("y", F.floor(F.get("x", F.lit(1)) * 3)), "deviance", 3, rounds=2, rate=0.5, max_depth=2)
    samples = explain.weigh_samples(explain.samples_around(rows, [0.3] * 4, 60), features=4).withColumn("y", model.probabilities()).cache()
    held = {}
    for r in samples.collect():
        held.setdefault(r.row_id, []).append((np.subtract(r.x, r.around), r.y, r.w))
    got = {}
    for r in explain.local_surrogates(samples.repartition(7), 4, 3, k).collect():  # a row's samples in many partitions
        got.setdefault((r.row_id, r.output), {})[r.feature] = (r.importance, r.intercept)
    assert set(got) == {(i, o) for i in held for o in range(3)}
    for (i, o), found in got.items():
        x, y, w = (np.array([s[c] for s in held[i]]) for c in range(3))
        y = y[:, o]
        center = lambda v: v - w @ v / w.sum()  # noqa: B023, E731
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = [abs((w * center(x[:, j])) @ center(y) / math.sqrt((w * center(x[:, j])) @ center(x[:, j]) * max((w * center(y)) @ center(y), 0))) for j in range(4)]
        if any(math.isnan(c) or (w * center(y)) @ center(y) < 1e-12 for c in corr):
            continue
        best = sorted(range(4), key=lambda j: (-round(corr[j], 9), j))[:k]
        assert set(found) == set(best)
        a = np.column_stack([np.ones(len(w)), x[:, best]]) * np.sqrt(w)[:, None]
        solved = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
        assert np.allclose([found[j][0] for j in best], solved[1:], atol=1e-7) and all(abs(v[1] - solved[0]) < 1e-7 for v in found.values())


def exact_shapley(f, x, background, d):
    v = {}
    for m in range(1 << d):
        v[m] = np.mean([f([x[j] if m >> j & 1 else b[j] for j in range(d)]) for b in background], axis=0)
    out = []
    for j in range(d):
        total = 0.0
        for m in range(1 << d):
            if not m >> j & 1:
                s = bin(m).count("1")
                total = total + math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) * (v[m | 1 << j] - v[m])
        out.append(total)
    return v[0], v[(1 << d) - 1], np.array(out)


@pytest.mark.parametrize("d", [1, 2, 4, 6])
def test_shap_values_are_the_shapley_values(spark, d):
    rng = np.random.default_rng(d)
    x, background = rng.random((8, d)), rng.random((5, d)).tolist()
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(x)], "row_id int, x array<double>")
    first = lambda c: F.get(c, F.lit(0))
    score = lambda c: F.array(first(c) * F.get(c, F.lit(d - 1)) + F.sin(F.aggregate(c, F.lit(0.0), lambda a, e: a + e)), first(c) * first(c))
    plain = lambda v: np.array([v[0] * v[-1] + math.sin(sum(v)), v[0] ** 2])
    for r in explain.shap_values(df, background, score, d, 2).collect():
        base, full, want = exact_shapley(plain, x[r.row_id], background, d)
        assert np.allclose(r["values"], want[:, r.output], atol=1e-9)
        assert abs(r.base - base[r.output]) < 1e-9 and abs(r.prediction - full[r.output]) < 1e-9


def test_shap_values_of_an_ensemble_add_up(spark, rows):
    model = tree.forest(rows, 5, 0.8, classes=2, max_depth=3)
    for r in explain.shap_values(rows, [[0.5] * 4, [0.1, 0.9, 0.2, 0.8]], model.probabilities, 4, 2).collect():
        assert abs(sum(r["values"]) - (r.prediction - r.base)) < 1e-9


def test_coalition_plans():
    masks, weights = explain.coalition_plan(5)
    assert sorted(masks) == list(range(1, 31)) and np.allclose(weights, [4 / (math.comb(5, bin(m).count("1")) * bin(m).count("1") * (5 - bin(m).count("1"))) for m in masks])
    masks, weights = explain.coalition_plan(12, budget=200)
    held = set(masks)
    assert len(masks) == len(held) <= 200 and all((1 << 12) - 1 - m in held for m in masks)
    assert all(1 << j in held for j in range(12)) and np.isclose(weights.sum(), sum(11 / (s * (12 - s)) for s in range(1, 12)))


SPEC = {"name": "j", "stages": [
    {"task": "selection", "params": {"features": 3}}, {"task": "training", "params": {"algorithm": "random_forest", "params": {"trees": 3, "max_depth": 2}}},
    {"task": "sampling", "params": {"samples": 30, "deviation": 0.2}}, {"task": "prediction"}, {"task": "weighting"}, {"task": "local_selection", "params": {"features": 2}}, {"task": "surrogate"},
]}


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_a_job_goes_on_where_it_stopped(spark, rows, tmp_path):
    class Killed(Exception):
        pass

    whole = rounded(stages.run(SPEC, rows, str(tmp_path / "whole")))
    assert {r[2] for r in whole} <= {0, 1, 2, 3} and len(whole) == 40 * 2 * 2
    for task in ("selection", "prediction", "weighting"):
        folder, seen = str(tmp_path / task), []

        def after(t, task=task, seen=seen):
            seen.append(t)
            if t == task and seen.count(t) == 1:
                raise Killed

        with pytest.raises(Killed):
            stages.run(SPEC, rows, folder, after)
        assert rounded(stages.run(SPEC, rows, folder, seen.append)) == whole
        assert seen == list(stages.STAGES)  # none is run twice
    spark.createDataFrame([(1,)], "x int").write.mode("overwrite").parquet(str(tmp_path / "whole" / "6-surrogate" / "done" / "_temporary" / "0"))
    assert rounded(stages.run(SPEC, rows, str(tmp_path / "whole"), pytest.fail)) == whole
    with pytest.raises(ValueError):
        stages.run(SPEC | {"name": "another"}, rows, str(tmp_path / "whole"))


QUICK = {"task": "training", "params": {"algorithm": "logistic_regression", "params": {"iterations": 2, "rate": 0.5}}}


def test_no_table_of_a_job_grows_with_its_samples(spark, rows, tmp_path):
    """Samples were saved by two stages, and products shuffled by two."""
    many = {"name": "j", "stages": [SPEC["stages"][0], QUICK, {"task": "sampling", "params": {"samples": 500, "deviation": 0.2}}, *SPEC["stages"][3:]]}
    stages.run(many, rows, str(tmp_path))
    held = {p.parent.name: spark.read.parquet(str(p)).count() for p in tmp_path.glob("*/table")}
    assert held == {"0-selection": 3, "1-training": 2, "2-sampling": 40, "5-local_selection": 40, "6-surrogate": 40 * 2 * 2}
    job = stages.Run(many, rows, str(tmp_path))
    for task in ("local_selection", "surrogate"):
        assert "hashpartitioning" not in getattr(job, task)(job.stages[task])._jdf.queryExecution().toString()


def test_a_job_may_end_with_any_stage(spark, rows, tmp_path):
    upto = lambda task: {"name": "j", "stages": [SPEC["stages"][0], QUICK, *SPEC["stages"][2 : list(stages.STAGES).index(task) + 1]]}
    got = {task: stages.run(upto(task), rows, str(tmp_path / task)) for task in ("sampling", "prediction", "weighting", "local_selection")}
    assert {t: df.columns for t, df in got.items()} == {
        "sampling": ["row_id", "sample", "around", "x"], "prediction": ["row_id", "sample", "around", "x", "y"], "weighting": ["row_id", "products"], "local_selection": ["row_id", "output", "chosen"],
    }
    samples = {(r.row_id, r.sample): r.x for r in got["sampling"].collect()}
    predicted = {(r.row_id, r.sample): (r.x, r.y) for r in got["prediction"].collect()}
    assert len(samples) == 40 * 30 and {k: x for k, (x, _) in predicted.items()} == samples
    for r in got["weighting"].collect():
        around = np.array(samples[r.row_id, 0])
        x, y = (np.array([predicted[r.row_id, s][c] for s in range(30)]) for c in (0, 1))
        z, w = np.column_stack([np.ones(30), x - around, y]), np.sqrt(np.exp(-((x - around) ** 2).sum(axis=1) / (0.5625 * 3)))
        assert np.allclose(np.reshape(r.products, (6, 6)), (z * w[:, None]).T @ z)
    chosen = {(r.row_id, r.output): set(r.chosen) for r in got["local_selection"].collect()}
    assert set(chosen) == {(i, o) for i in range(40) for o in range(2)} and all(len(c) == 2 and c <= {0, 1, 2} for c in chosen.values())


@pytest.mark.parametrize("k", [1, 2, 4, 9])
def test_selection_holds_what_models_need(spark, rows, k):
    """Outputs that choose different features: models from the selection are those from all products."""
    y = F.array(F.get("x", F.lit(0)) * 2, F.get("x", F.lit(3)) - F.get("x", F.lit(1)) * F.get("x", F.lit(1)), F.get("x", F.lit(2)) * F.get("x", F.lit(0)))
    samples = explain.weigh_samples(explain.samples_around(rows, [0.3] * 4, 60), features=4).withColumn("y", y)
    selected = explain.local_selection(explain.local_products(samples, 4, 3, together=True), 4, 3, k)
    got, want = (sorted(df.collect()) for df in (explain.local_models(selected, 3, 1e-6), explain.local_surrogates(samples, 4, 3, k, 1e-6, together=True)))
    assert [r[:3] for r in got] == [r[:3] for r in want] and len(got) == 40 * 3 * min(k, 4)
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-9)
    assert len({tuple(map(tuple, r.chosen)) for r in selected.collect()}) > 1


@pytest.mark.parametrize("change", [
    lambda s: s["stages"][0]["params"].update(more=1), lambda s: s["stages"][0]["params"].clear(), lambda s: s["stages"][3].update(task="other"), lambda s: s["stages"].pop(2),
    lambda s: s.update(more=1), lambda s: s["stages"][1].update(extra=1),
])
def test_wrong_specifications_raise(change):
    spec = {"name": "j", "stages": [{k: dict(v) if isinstance(v, dict) else v for k, v in s.items()} for s in SPEC["stages"]]}
    stages.parse(spec)
    change(spec)
    with pytest.raises(ValueError):
        stages.parse(spec)


@pytest.mark.parametrize("split", ["2k", "128m"])
def test_files_are_aligned_by_position(spark, tmp_path, split):
    rnd = random.Random(31)
    x = [[round(rnd.random(), 6) for _ in range(5)] for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "k int, a double, b double, c double, d double, e double")
    parts = [("a b", 2, False, 1), ("c d", 2, False, 3), ("e", 1, True, 4)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parties = []
        for names, n, label, files in parts:
            path = str(tmp_path / names.replace(" ", ""))
            io.write_csv_in_order(df.select("k", *names.split()).repartitionByRange(files, "k"), path, "k")
            parties.append(io.read_csv_party(spark, path, n, label))
        got = sorted((r.row_id, r.x, r.y) for r in tables.align_by_position(parties).collect())
        assert got == [(i, r[:4], r[4]) for i, r in enumerate(x)]
        with pytest.raises(ValueError):
            tables.align_by_position([parties[0], parties[1].where("row_id < 200")])
        assert io.read_csv_split(spark, str(tmp_path / "cd"), 2).where("is_train").count() == 240
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_a_restarted_stream_counts_once(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, value double"
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * m))
    batches = [[(1, 1, 0, 2.0), (2, 1, 5, 3.0), (2, 1, 5, 3.0), (3, 2, 1, None), (4, None, 1, 1.0)], [(2, 1, 5, 3.0), (5, 2, 30, 4.0), (3, 2, 1, 1.0)], [(6, 3, 200, 1.0)], [(7, 1, 100, 9.0), (8, 1, 199, 5.0), (6, 3, 200, 1.0)]]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for batch in batches:
        rows = spark.createDataFrame(batch, "event_id long, user_id long, m long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("m"))).drop("m").select("event_id", "user_id", "ts", "value")
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        users.write_updates(users.user_scores(stream, lambda v: v * 0 + 1.0, "1 hour"), out, check).awaitTermination()
    got = {r.user_id: (r.n, r.total, r.score) for r in users.latest(spark, out).collect()}
    # 7 came behind the watermark of 140 minutes; 2, 3 and 6 were sent again
    assert got == {1: (3, 10.0, 1.0), 2: (2, 4.0, 1.0), 3: (1, 1.0, 1.0)}


def test_reports_as_text(spark, tmp_path):
    report = spark.createDataFrame([("test", 0.5, None), ("train", 0.75, 1.0)], "part string, accuracy double, f1 double")
    io.save_report(report, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["training accuracy: 0.75, f1: 1.0", "test accuracy: 0.5, f1: -"]


def test_stream_inference_searches_and_saves_once(spark, sf, monkeypatch):
    """Thresholds are searched once for both kinds of trees, features are saved once, and no scores that nothing reads."""
    from colligo.operators import tree
    from colligo.plans import catalog

    calls = []
    search, save = tree.candidate_lists, tree.materialize
    monkeypatch.setattr(tree, "candidate_lists", lambda *a: calls.append("search") or search(*a))
    for module in (tree, catalog):
        monkeypatch.setattr(module, "materialize", lambda df, name="table": calls.append(name) or save(df, name))
    assert catalog.QUERIES["stream_inference"](spark, sf).count() > 0
    assert calls.count("search") == 1 and calls.count("scores") == 2
    assert calls.count("baskets") + calls.count("features") == 1
