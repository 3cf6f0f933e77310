"""Order statistics, ensembles as arrays, moments, tiles and planned batches against numpy and plain Python."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligo.operators import ensemble, linear, matrix, metrics, moments, order, quantiles, stats, tables, tree

INF, NAN = float("inf"), float("nan")
ODD = [0.0, -0.0, 1.0, -1.0, 0.5, 2.0, 1.9999999999999998, 2.0000000000000004, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, INF, -INF, NAN, 1 / 3, 1e-300, 1e300, 7.5, 7.5]


def bits(v):
    """The key that the double's own bits give."""
    if v != v:
        return 2**63 - 1
    m = struct.unpack(">q", struct.pack(">d", abs(v)))[0]
    return -m if v < 0 else m


def test_order_key_is_the_bits(spark):
    rnd = random.Random(1)
    values = ODD + [math.ldexp(rnd.uniform(-1, 1), rnd.randrange(-1074, 1024)) for _ in range(3000)] + [math.ldexp(1.0, e) for e in range(-1074, 1024, 7)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1000, 1024, 7)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.order_key(F.col("v")).alias("k")).collect()
    assert [r.k for r in got] == [bits(v) for v in values]
    assert spark.range(1).select(quantiles.order_key(F.lit(None).cast("double")).alias("k")).first().k is None


def test_ranks_with_ties_and_nan(spark):
    rnd = random.Random(2)
    columns = {0: [rnd.gauss(0, 1) for _ in range(1500)], 1: [float(rnd.randrange(3)) for _ in range(1500)], 2: [7.0] * 900 + [NAN] * 300 + ODD, 3: [rnd.random() * 1e-3 + 1e9 for _ in range(700)]}
    rows = [(f, v) for f, vs in columns.items() for v in vs] + [(0, None), (1, None)]
    rnd.shuffle(rows)
    long = spark.createDataFrame(rows, "feature int, v double").repartition(5).cache()
    ordered = {f: sorted(vs, key=lambda v: (v != v, v)) for f, vs in columns.items()}
    wanted = [(f, r) for f, vs in columns.items() for r in (0, 1, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs))]
    got = quantiles.select_ranks(long, wanted)
    assert set(got) == {(f, r) for f, r in wanted if r < len(columns[f])}
    assert all(repr(v + 0.0) == repr(ordered[f][r] + 0.0) for (f, r), v in got.items())
    told = quantiles.distinct_values(long, 16)
    assert told[0] == (1500, None) and told[1] == (1500, [0.0, 1.0, 2.0]) and told[2][1] is None and told[3] == (700, None)
    assert quantiles.distinct_values(long.where("feature = 2 and v = 7 or isnan(v)"), 4)[2][1][0] == 7.0
    assert quantiles.median(long.where("feature = 3"), "v") == np.median(columns[3]) and quantiles.median(long.limit(0), "v") is None
    assert quantiles.select_ranks(long.limit(0), [(0, 0)]) == {}


def test_grouped_medians_and_modes(spark):
    rows = [("a", 1, 5.0), ("a", 1, 3.0), ("a", 2, 3.0), ("b", 9, 1.0), ("b", 8, 2.0), ("b", None, None)]
    df = spark.createDataFrame(rows, "k string, m int, v double")
    assert {r.k: r.middle for r in quantiles.with_medians(df, ["k"], "v", "middle").collect()} == {"a": 3.0, "b": 1.5}
    assert {r.k: r["mode"] for r in quantiles.mode(df, ["k"], "m").collect()} == {"a": 1, "b": 8}


def test_no_sort_in_split_candidates(spark):
    long = spark.range(4000).select((F.col("id") % 2).cast("int").alias("feature"), (F.col("id") * 37 % 1009).cast("double").alias("v"))
    got = quantiles.quantile_midpoints(long, 8)
    for f in (0, 1):
        v = sorted(float(i * 37 % 1009) for i in range(4000) if i % 2 == f)
        b = len(v) // 8
        assert got[f] == [(v[(i + 1) * b] + v[(i + 1) * b + 1]) / 2 for i in range(7)]
    assert {r.feature for r in stats.split_candidates(long, 8).collect()} == {0, 1}


def nested(rnd, depth, features, node=0):
    """Nodes of a random tree, heap-numbered."""
    if depth == 0 or rnd.random() < 0.1:
        return [tree.Node(0, node, 0, True, None, None, rnd.uniform(-1, 1), 0.0, 1)]
    one = tree.Node(0, node, 0, False, rnd.randrange(features), rnd.uniform(-1, 1), 0.0, 0.0, 1)
    return [one, *nested(rnd, depth - 1, features, 2 * node + 1), *nested(rnd, depth - 1, features, 2 * node + 2)]


def walk(nodes, x):
    at = {n.node_id: n for n in nodes}
    n = at[0]
    while not n.is_leaf:
        v = x[n.feature] if x is not None and n.feature < len(x) else None
        n = at[2 * n.node_id + 1 + (v is None or not v <= n.threshold)]
    return n


def test_three_hundred_trees(spark):
    rnd = random.Random(3)
    trees = [nested(rnd, 6, 5) for _ in range(300)]
    rows = [(i, [rnd.uniform(-1.2, 1.2) for _ in range(5)]) for i in range(200)] + [(200, [NAN, 0.1, INF, -INF, 0.2]), (201, [0.1, None, 0.3, 0.4, 0.5]), (202, None), (203, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "row_id int, x array<double>").repartition(3)
    model = ensemble.Ensemble.of_nodes(trees, [0.5, -0.5, 0.0], lambda t, n: (t % 3, n.label))
    out = df.select("row_id", model.scores().alias("s"), model.leaves().alias("l"), model.votes().alias("v"), model.scores("x", "softmax").alias("p"))
    plan = out._jdf.queryExecution().toString()
    assert len(plan) < 20_000  # whatever the number of trees
    for r in out.collect():
        leaves = [walk(t, rows[r.row_id][1]) for t in trees]
        assert r.l == [n.node_id for n in leaves] and r.v == [n.label for n in leaves]
        want = [b + sum(n.label for k, n in enumerate(leaves) if k % 3 == o) for o, b in enumerate((0.5, -0.5, 0.0))]
        assert np.allclose(r.s, want) and np.allclose(r.p, np.exp(want) / np.exp(want).sum())
    again = ensemble.Ensemble.of_table(model.table(spark))
    assert all(np.array_equal(a, b) for a, b in zip(vars(again).values(), vars(model).values(), strict=True))
    assert [r.s for r in df.select(ensemble.Ensemble.of_nodes([], [1.0], None).scores().alias("s")).limit(2).collect()] == [[1.0], [1.0]]
    with pytest.raises(ValueError):
        model.scores("x", "other")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((500, 4))
    y = np.minimum(2, np.floor(3 * (0.8 * x[:, 0] + 0.2 * x[:, 1])))
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double").cache()


def test_ensembles_match_their_trees(rows):
    forest = tree.forest(rows, 7, 0.7, classes=3, max_depth=4)
    got = rows.select(forest.probabilities().alias("p"), forest.predict().alias("c"), F.array(*[forest.predict_tree(t) for t in forest.tree_ids()]).alias("v"), forest.votes().alias("w")).collect()
    for r in got:
        shares = [r.v.count(float(k)) / 7 for k in range(3)]
        assert r.w == r.v and np.allclose(r.p, shares) and r.c == shares.index(max(shares))
    model = tree.boost(rows, "deviance", 3, rounds=3, rate=0.4, max_depth=2)
    case = lambda k: sum((F.lit(0.4) * t[k].predict_tree(0) for t in model.trees), F.lit(model.prior[k]))
    for r in rows.select(model.raw().alias("raw"), F.array(*[case(k) for k in range(3)]).alias("want"), model.probabilities().alias("p"), model.predict().alias("c")).collect():
        assert np.allclose(r.raw, r.want) and abs(sum(r.p) - 1) < 1e-12 and r.c == r.p.index(max(r.p))


def test_jobs_of_a_round_do_not_grow_with_classes(spark, rows):
    counts = []
    status = spark.sparkContext.statusTracker()
    for classes in (2, 3):
        spark.sparkContext.setJobGroup(f"boost {classes}", "")
        tree.boost(rows.withColumn("y", F.least("y", F.lit(classes - 1.0))), "deviance", classes, rounds=1, max_depth=2, max_bins=4)
        counts.append(len(status.getJobIdsForGroup(f"boost {classes}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 2


def test_boosting_a_round_lowers_the_loss(rows):
    shares = [tree.boost(rows, "deviance", 3, rounds=n, rate=0.5, max_depth=2) for n in (1, 4)]
    got = [metrics.accuracy(rows.withColumn("prediction", m.predict())).first()[0] for m in shares]
    assert got[1] >= got[0] > 0.6


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 70)) @ rng.normal(size=(70, 70)) + 1e7  # a mean that would cancel everything
    w = rng.random(300)
    data = [([float(v) for v in a], float(b)) for a, b in zip(x, w, strict=True)]
    bad = [(None, 1.0), ([1.0] * 70, None), ([None] + [1.0] * 69, 1.0), ([NAN] + [1.0] * 69, 1.0), ([1.0], 1.0)]
    df = spark.createDataFrame(data + bad, "x array<double>, w double").repartition(4)
    for block in (16, 64):
        got = moments.moments(df, "x", "w", block)
        mean = w @ x / w.sum()
        want = (x - mean).T @ ((x - mean) * w[:, None])
        assert got.rows == 300 and np.allclose(got.mean, mean, rtol=1e-12) and np.allclose(got.scatter, want, rtol=1e-6, atol=1e-6 * np.abs(want).max())
    assert moments.moments(df.limit(0), "x").rows == 0
    constant = spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],)], "x array<double>")
    assert moments.correlation_table(constant).first().corr is None


def test_weighted_moments_do_not_cancel(spark):
    rnd = random.Random(9)
    rows = [(0, 1e9 + rnd.random(), 2e9 + rnd.random(), rnd.random()) for _ in range(400)]
    r = stats.weighted_moments(spark.createDataFrame(rows, "feature int, v double, y double, w double")).first()
    v, y, w = (np.array([q[k] for q in rows]) for k in (1, 2, 3))
    m = w @ v / w.sum()
    assert abs(r.variance - w @ (v - m) ** 2 / w.sum()) < 1e-9
    assert stats.weighted_moments(spark.createDataFrame(rows, "feature int, v double, y double, w double").limit(0)).count() == 0
    assert abs(stats.impurity(spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, w, strict=True)], "y double, w double"), "y", False, "w").first()[0] - w @ (v - m) ** 2 / w.sum()) < 1e-9


def test_least_squares_of_many_features(spark):
    rng = np.random.default_rng(11)
    x, beta = rng.normal(size=(400, 80)), rng.normal(size=80)
    df = spark.createDataFrame([(i, [float(v) for v in a], float(a @ beta + 3)) for i, a in enumerate(x)], "row_id long, x array<double>, y double")
    got = linear.least_squares(df, 80)
    assert np.allclose(got.weights, [3, *beta], atol=1e-8)
    corr = {r.feature: r["corr"] for r in stats.vector_correlations(df).collect()}
    assert np.allclose([corr[j] for j in range(80)], [abs(np.corrcoef(x[:, j], x @ beta)[0, 1]) for j in range(80)])


def test_tiles(spark):
    rnd = random.Random(13)
    a = [(rnd.randrange(300), 0 if k % 3 else rnd.randrange(200), float(rnd.randrange(-4, 5))) for k in range(1500)]  # most entries share an inner index
    b = [(0 if k % 2 else rnd.randrange(200), rnd.randrange(150), float(rnd.randrange(-4, 5))) for k in range(1500)] + [(None, 1, 1.0), (1, 1, None)]
    left, right = (spark.createDataFrame(m, "i long, j long, v double") for m in (a, b))
    dense = lambda m, shape: sum((_put(shape, i, j, v) for i, j, v in m if None not in (i, j, v)), np.zeros(shape))
    x, y = dense(a, (300, 200)), dense(b, (200, 150))
    px, py = dense([(i, j, 1.0) for i, j, _ in a], (300, 200)) > 0, dense([(i, j, 1.0) for i, j, v in b if v is not None and i is not None], (200, 150)) > 0
    for size, groups in ((64, 1), (32, 3)):
        got = {(r.i, r.j): r.v for r in matrix.product(left, right, size, groups).collect()}
        pattern = (px.astype(int) @ py.astype(int)) > 0
        assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero(pattern), strict=True)}
        assert all(abs(v - (x @ y)[k]) < 1e-9 for k, v in got.items())
    assert matrix.product(left.limit(0), right).count() == 0
    same = {(r.i, r.j): r.v for r in matrix.multiply_elements(left, matrix.transpose(matrix.transpose(left))).collect()}
    assert all(abs(v - x[k] ** 2) < 1e-9 for k, v in same.items()) and len(same) == px.sum()
    total = {(r.i, r.j): r.v for r in matrix.add(left, matrix.scale(left, -1.0)).collect()}
    assert set(total.values()) == {0.0} and len(total) == px.sum()


def _put(shape, i, j, v):
    m = np.zeros(shape)
    m[i, j] = v
    return m


def test_batches_are_planned_at_once(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    status = spark.sparkContext.statusTracker()
    jobs = []
    for n in (3, 30):
        spark.sparkContext.setJobGroup(f"plan {n}", "")
        conditions = tables.batch_conditions(df, "row_id", 100, range(n))
        jobs.append(len(status.getJobIdsForGroup(f"plan {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    counts = df.agg(*[F.count_if(c) for c in conditions]).first()
    assert set(counts) == {100} and {r.row_id for r in df.where(conditions[0]).collect()} != {r.row_id for r in df.where(conditions[1]).collect()}
    named = spark.range(1000).select(F.concat(F.lit("key "), "id").alias("k"))  # keys of other types
    assert [named.where(order.first_in_hash_order(named, "k", n)).count() for n in (0, 1, 400, 1000, 2000)] == [0, 1, 400, 1000, 1000]


def test_fits_leave_the_callers_cache(rows):
    assert rows.is_cached
    linear.fit(rows, "linear", 4, 1)
    tree.grow(rows.withColumn("tree_id", F.lit(0)), 3, 1)
    assert rows.is_cached


def test_starts_and_subsets(spark):
    start = linear.uniform_start(3)
    assert start == linear.uniform_start(3) != linear.uniform_start(3, seed=1) and all(abs(v) <= math.sqrt(2 / 4) for v in start)
    df = spark.range(50).withColumnRenamed("id", "row_id")
    got = [r.row_id for r in tables.subset_with_first(df, "row_id", 7, 10).collect()]
    assert len(got) == 11 and 7 in got
    with pytest.raises(ValueError):
        tables.check_sizes([df, df.limit(3)])


def test_losses_are_a_registry(spark, rows):
    rng = np.random.default_rng(17)
    x = rng.random((400, 2))
    y = rng.poisson(np.exp(1 + 2 * x[:, 0]))
    df = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, x array<double>, y double")
    model = tree.boost(df, "poisson", rounds=4, rate=0.5, max_depth=2)
    got = np.array([r.p for r in df.orderBy("row_id").select(model.predict().alias("p")).collect()])
    deviance = lambda rate: 2 * np.mean(np.where(y > 0, y * np.log(np.maximum(y, 1) / rate), 0) - (y - rate))
    assert (got > 0).all() and deviance(got) < 0.5 * deviance(np.full(400, y.mean()))
    with pytest.raises(ValueError):
        tree.boost(df, "other")
    with pytest.raises(ValueError):
        model.probabilities()
    # a loss of one's own: absolute errors, by their signs
    tree.LOSSES["signs"] = tree.Loss(lambda y, k: [y], lambda m, k: [m[0]], lambda raw, y, k: [(F.signum(y - F.get(raw, F.lit(0))), None)])
    try:
        own = tree.boost(df, "signs", rounds=6, rate=2.0, max_depth=2)
        errors = [df.agg(F.avg(F.abs(F.col("y") - p))).first()[0] for p in (F.lit(float(y.mean())),)] + [df.withColumn("p", own.predict()).agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0]]
        assert errors[1] < errors[0]
    finally:
        del tree.LOSSES["signs"]


def test_displays_walk_left_first(spark, rows):
    model = tree.grow(rows, 3, 2, 4)
    lines = [r.text for r in model.display(spark).orderBy("place").collect()]
    assert lines[0].startswith("x[") and len(lines) == len(model.nodes)
    for (_, i), n in model.nodes.items():
        if not n.is_leaf:
            texts = [r.node_id for r in model.display(spark).orderBy("place").collect()]
            assert texts.index(2 * i + 1) == texts.index(i) + 1 < texts.index(2 * i + 2)
