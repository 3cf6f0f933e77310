"""Golden values, round trips and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligo.functions import vectors as V
from colligo.operators import explain, linear, matrix, metrics, mlp, order, quantiles, stats, tables, tree
from colligo.plans import jobs
from colligo.sources import io
from colligo.streaming import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_scalars(spark):
    assert value(spark, V.combinations(F.lit(20), F.lit(2))) == 190
    assert value(spark, V.combinations(F.lit(60), F.lit(20))) == 4191844505805495
    assert value(spark, V.logistic(F.lit(0.0))) == 0.5
    for x, m in ((0.123456, 8090), (-0.666666, -43690)):
        c = V.encode_fixed(F.lit(x))
        assert value(spark, c["mantissa"]) == m
        assert abs(value(spark, V.decode_fixed(c)) - x) < 2**-16
    assert value(spark, V.argmax(F.array(F.lit(-3.0), F.lit(-1.0), F.lit(-1.0)))) == 1
    assert value(spark, V.top_k_indices(F.array(*map(F.lit, (1.0, 5.0, 5.0, 2.0))), 3)) == [1, 2, 3]
    assert abs(sum(value(spark, V.softmax(F.array(*map(F.lit, (1.0, 2.0, 3.0)))))) - 1) < 1e-12


def test_shares_sum_back(spark):
    got = spark.range(100).select((F.col("id") * 0.37).alias("x"), V.join_shares(V.split_shares(F.col("id") * 0.37, F.col("id"), 4)).alias("y")).collect()
    assert all(abs(r.x - r.y) < 1e-6 for r in got)


def test_reports(spark):
    df = spark.createDataFrame(
        [(float(p), float(y)) for p, y in zip([0, 0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 1, 1], [1] * 8 + [0] * 5, strict=True)], "prediction double, y double")
    r = metrics.classification_report(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (5, 2, 3, 3)
    assert np.allclose([r.accuracy, r.sensitivity, r.specificity, r.balanced_accuracy, r.precision, r.npv, r.f1], [8 / 13, 5 / 8, 3 / 5, 0.6125, 5 / 7, 3 / 6, 10 / 15])
    empty = metrics.classification_report(df.limit(0)).first()
    assert empty.accuracy is None and empty.f1 is None
    e = metrics.regression_report(spark.createDataFrame([(3.0, 2.5), (5.0, 5.0), (2.5, 4.0), (7.0, 8.0)], "prediction double, y double")).first()
    assert abs(e.msle - 0.039) < 1e-3 and abs(e.rmsle - 0.199) < 1e-3


def test_global_rank_and_exact_splits(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 7 % 100).alias("v")).repartition(7)
    got = order.with_global_rank(df, "v", "k").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1000))
    assert [(r.v, r.k) for r in got] == sorted((k * 7 % 100, k) for k in range(1000))
    for n in (0, 1, 500, 999, 1000):
        assert df.where(order.first_in_hash_order(df, "k", n)).count() == n
    assert order.split_train_test(df, "k").where("is_train").count() == 800


def test_partitions(spark):
    got = {}
    for r in tables.balanced_partition(tables.feature_dimension(spark, [11, 10, 9]), 2).collect():
        got.setdefault(r.part, set()).add(r.global_idx)
    assert got == {0: {*range(6), *range(11, 16), *range(21, 26)}, 1: {*range(6, 11), *range(16, 21), *range(26, 30)}}


def test_split_candidates(spark):
    long = spark.createDataFrame([(k, 0, float(k)) for k in range(20)] + [(k, 1, float(k % 3)) for k in range(20)] + [(k, 2, 5.0) for k in range(20)], "row_id int, feature int, v double")
    got = {}
    for r in stats.split_candidates(long, 4).collect():
        got.setdefault(r.feature, []).append(r.threshold)
    assert {f: sorted(t) for f, t in got.items()} == {0: [5.5, 10.5, 15.5], 1: [0.0, 1.0], 2: [5.0]}


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(2)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double").cache()


def accuracy(df, prediction):
    return metrics.accuracy(df.withColumn("prediction", prediction)).first()["accuracy"]


def test_linear_models(spark, learnable, tmp_path):
    few = linear.fit(learnable, "logistic", 3, 5, 1.0)
    many = linear.fit(learnable, "logistic", 3, 30, 1.0, initial=few.weights)
    assert linear.loss(learnable, many).first()["loss"] < linear.loss(learnable, few).first()["loss"] < math.log(2)
    exact = linear.least_squares(learnable.withColumn("y", 2 * F.get("x", F.lit(0)) - F.get("x", F.lit(2)) + 0.5), 3)
    assert np.allclose(exact.weights, [0.5, 2, 0, -1], atol=1e-8)
    io.save_linear(spark, many, str(tmp_path / "m"))
    assert io.load_linear(spark, str(tmp_path / "m")) == many
    with pytest.raises(ValueError):
        linear.fit(learnable, "other", 3)


def test_trees(spark, learnable, tmp_path):
    model = tree.grow(learnable, 2, 3, 16)
    for (_, i), n in model.nodes.items():
        if not n.is_leaf:
            assert model.nodes[0, 2 * i + 1].n + model.nodes[0, 2 * i + 2].n == n.n
            assert 0 <= n.impurity <= 0.5 and n.gain > 0
    assert accuracy(learnable, model.predict()) > 0.93
    io.save_trees(spark, model, str(tmp_path / "t"))
    again = io.load_trees(spark, str(tmp_path / "t"))
    assert again.nodes == model.nodes and again.classes == 2
    assert max(model.importance(spark).collect(), key=lambda r: r.importance).feature == 0


def test_ensembles(learnable):
    assert accuracy(learnable, tree.forest(learnable, 3, 0.8, classes=2, max_depth=3, max_bins=16).predict()) > 0.9
    assert accuracy(learnable, tree.boost(learnable, "deviance", 2, rounds=2, rate=0.5, max_bins=16).predict()) > 0.9


def test_mlp_expressions_match_numpy(learnable):
    model = mlp.fit(learnable, mlp.Mlp.initial([3, 5, 2], ["relu", "softmax"]), 20, 1.0)
    rows = learnable.withColumn("out", model.output()).limit(50).collect()
    assert np.allclose([r.out for r in rows], model.forward(np.array([r.x for r in rows]))[-1])


def test_mlp_steps_match_numpy(learnable):
    start = mlp.Mlp.initial([3, 4, 1], ["logistic", "logistic"])
    got = mlp.fit(learnable, start, 3, 0.7, alpha=0.1)
    rows = learnable.collect()
    x, y = np.array([r.x for r in rows]), np.array([[r.y] for r in rows])
    (w1, w2), (b1, b2) = [w.copy() for w in start.weights], [b.copy() for b in start.biases]
    for _ in range(3):
        hidden = 1 / (1 + np.exp(-(x @ w1 + b1)))
        out = 1 / (1 + np.exp(-(hidden @ w2 + b2)))
        d2 = (out - y) / len(x)
        d1 = d2 @ w2.T * hidden * (1 - hidden)
        w1, w2 = w1 - 0.7 * (x.T @ d1 + 0.1 / len(x) * w1), w2 - 0.7 * (hidden.T @ d2 + 0.1 / len(x) * w2)
        b1, b2 = b1 - 0.7 * d1.sum(axis=0), b2 - 0.7 * d2.sum(axis=0)
    assert all(np.allclose(a, b) for a, b in zip([*got.weights, *got.biases], [w1, w2, b1, b2], strict=True))


def test_saved_models_and_tables(spark, learnable, tmp_path):
    for model in (tree.boost(learnable, "deviance", 2, rounds=2, max_depth=2), tree.Boosted("ls", 0.1, [0.5])):
        io.save_boosted(spark, model, str(tmp_path / "b"))
        assert io.load_boosted(spark, str(tmp_path / "b")) == model
    net = mlp.Mlp.initial([3, 4, 2], ["relu", "softmax"])
    io.save_mlp(spark, net, str(tmp_path / "n"))
    again = io.load_mlp(spark, str(tmp_path / "n"))
    assert again.activations == net.activations and all(np.array_equal(a, b) for a, b in zip([*again.weights, *again.biases], [*net.weights, *net.biases], strict=True))
    fixed = spark.range(20).select("id", V.encode_fixed(F.col("id") * 0.37 - 3).alias("v"))
    io.write_fixed(fixed, str(tmp_path / "f"))
    assert sorted(io.read_fixed(spark, str(tmp_path / "f")).collect()) == sorted(fixed.collect())
    assert all(abs(r.v - (r.id * 0.37 - 3)) < 2**-16 for r in io.read_fixed(spark, str(tmp_path / "f"), decode=True).collect())


def test_explanations(spark):
    row = [0.5, 0.5, 0.5]
    s = explain.distance_weights(explain.gaussian_samples(spark, row, [0.2] * 3, 800), row).withColumn("y", 3 * F.get("x", F.lit(1)) - F.get("x", F.lit(2))).cache()
    assert s.where("row_id = 0").first()["x"] == row and s.where("w > 1 or w <= 0").count() == 0
    assert explain.select_features(s, 2) == [1, 2]
    got = {r.feature: r.importance for r in explain.explain(s, [1, 2]).collect()}
    assert abs(got[1] - 3) < 0.05 and abs(got[2] + 1) < 0.05
    assert {r.w for r in explain.coalition_weights(explain.coalition_samples(spark, row, row, 10), 3).where("row_id = 0").collect()} == {1e-6}


def test_jobs(learnable):
    a, b = (learnable.select("row_id", F.slice("x", s, n).alias("x"), *extra) for s, n, extra in ((1, 2, ["y"]), (3, 1, [])))
    _, report = jobs.run(jobs.Job.parse({"name": "t", "algorithm": "decision_tree", "params": {"max_depth": 2}}), [a, b])
    got = {r.part: r for r in report.collect()}
    assert set(got) == {"train", "test"} and got["test"].accuracy > 0.85
    with pytest.raises(ValueError):
        jobs.Job("x", "unknown")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(i * 100 + 0.5, i * 100 + 10.5, i * 100 + 20.5) for i in range(2)], "c0 double, c1 double, c2 double")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(io.read_csv_matrix(spark, str(tmp_path / "c"), 3).collect()) == sorted(df.collect())
    (tmp_path / "bad.csv").write_text("1,x,3\n4,5\n")
    assert sorted(tuple(r) for r in io.read_csv_matrix(spark, str(tmp_path / "bad.csv"), 3, lenient=True).collect()) == [(1.0, 0.0, 3.0), (4.0, 5.0, 0.0)]
    with pytest.raises(Exception):
        io.read_csv_matrix(spark, str(tmp_path / "bad.csv"), 3).collect()


def test_stream_scoring(spark, tmp_path):
    features = spark.createDataFrame([(k, [k / 10.0]) for k in range(10)], "row_id long, x array<double>")
    src = spark.range(10).select(F.col("id").alias("row_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1200)).alias("at"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    scored = scoring.score_stream(stream, features, linear.LinearModel("linear", (1.0, 2.0)).predict())
    q = scoring.windowed_rate(scored, "at").writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rates").agg(F.sum("requests")).first()[0] == 10


def test_samples_under_two_seeds_are_independent(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "row_id")
    batches = [{r.row_id for r in tables.mini_batch(rows, "row_id", 2000, t).collect()} for t in range(3)]
    assert all(len(b) == 2000 for b in batches)
    assert all(abs(len(a & b) - 200) < 60 for i, a in enumerate(batches) for b in batches[:i])
    trees = {}
    for r in tables.tree_samples(rows, "row_id", 3, 0.5).collect():
        trees.setdefault(r.tree_id, set()).add(r.row_id)
    assert all(len(t) == 10_000 for t in trees.values())
    assert all(abs(len(trees[i] & trees[j]) - 5000) < 250 for i in trees for j in trees if j < i)


def test_parties_are_never_broadcast(spark):
    parties = [spark.range(5).select(F.col("id").alias("row_id"), F.array(F.col("id") * k).alias("x")) for k in (1, 2, 3)]
    plan = tables.align(parties)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and tables.align(parties).count() == 5


def test_product_of_elements_is_one_aggregation_and_of_blocks_shuffles_no_products(spark):
    m = spark.createDataFrame([(0, 1, 2.0), (0, 1, 1.0), (5, 7, -1.0)], "i long, j long, v double")
    both = matrix.beside(m, matrix.scale(m.where("i = 0"), 2.0))
    assert {tuple(r) for r in both.collect()} == {(0, 1, 3.0, 6.0), (5, 7, -1.0, None)} and "Join" not in both._jdf.queryExecution().toString()
    a = spark.createDataFrame([(-3, 0, -1.0), (10**12, 0, 0.0), (10**12, 4, 1.0), (10**12, 5, -1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 9, 0.0), (0, -600, 2.0), (4, 9, 1.0), (5, 9, 1.0)], "i long, j long, v double")
    out = matrix.product(a, b)
    assert {tuple(r) for r in out.collect()} == {(-3, 9, 0.0), (-3, -600, -2.0), (10**12, 9, 0.0), (10**12, -600, 0.0)}
    assert out._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].startswith("MapInArrow")


def test_keys_and_hashes_of_batches_are_those_of_columns(spark):
    values = [0.0, -0.0, 1.5, -1.5, 5e-324, -1e308, float("inf"), float("-inf"), float("nan"), 0.1]
    want = [r.k for r in spark.createDataFrame([(v,) for v in values], "v double").select(quantiles.order_key(F.col("v")).alias("k")).collect()]
    assert quantiles._keys(np.array(values)).tolist() == want
    assert [repr(quantiles._value(k)) for k in want] == [repr(v + 0.0) for v in values]
    keys = [0, 1, -1, 2**40 + 3, 12345]
    assert V.hashed(np.array(keys), 77).tolist() == [r.h for r in spark.createDataFrame([(k,) for k in keys], "k long").select(V.hash32(F.col("k"), 77).alias("h")).collect()]


def test_a_limit_is_searched_in_a_narrow_window(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    room = order._near(df, "k", [51, 52], 2**31, 2**31 + 2**24)
    assert 0 < room.where("v is not null").count() < 400
    same = spark.createDataFrame([(7,)] * 300, "k long")  # no even spread: all rows are searched
    assert order.hash_limits(same, "k", 100, [51])[0][1] == 7


def test_buckets_without_a_join(spark):
    long = spark.createDataFrame([(0, 1.0), (0, 1.5), (0, float("nan")), (0, None), (1, 5.0), (2, 1.0)], "feature int, v double")
    out = stats.bucketize(long, spark.createDataFrame([(0, 2.0), (0, 1.0), (1, 5.0)], "feature int, threshold double"))
    assert [r.bucket for r in out.collect()] == [0, 1, 2, 0, 0] and "Join" not in out._jdf.queryExecution().toString()


def test_rows_between_thresholds_are_summed_before_trees_grow(spark):
    df = spark.range(1000).select(F.lit(0).alias("tree_id"), F.array((F.col("id") % 10).cast("double"), F.when(F.col("id") % 7 > 0, F.lit(float("nan")))).alias("x"))
    got = {tuple(r.x): r.n for r in tree._combined(df, {0: [2.0, 5.0], 1: [1.0]}, {"n": F.lit(1.0)}).collect()}
    assert len(got) == 6 and sum(got.values()) == 1000 and {x[0] for x in got} == {2.0, 5.0, math.inf} and {x[1] for x in got} == {math.inf, None}


def test_samples_that_are_together_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, [0.1 * i, 1.0]) for i in range(30)], "row_id long, x array<double>").repartition(3)
    samples = explain.weigh_samples(explain.samples_around(rows, [0.2, 0.2], 700), features=2).withColumn("y", F.array(F.get("x", F.lit(0)) * 2))
    plan = explain.local_surrogates(samples, 2, 1, together=True)._jdf.queryExecution().toString()
    assert plan.count("Exchange") == explain.samples_around(rows, [0.2, 0.2], 700)._jdf.queryExecution().toString().count("Exchange")
    both = [sorted((r.row_id, r.feature, round(r.importance, 7)) for r in explain.local_surrogates(samples, 2, 1, together=t).collect()) for t in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 60
