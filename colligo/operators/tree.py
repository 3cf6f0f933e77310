"""Decision trees, forests and gradient boosting, grown level by level.

One aggregation per level serves all open nodes of all trees, and all outputs of a boosting
round.  A model is a small list of nodes on the driver.  While trees grow, rows find their
node through a CASE expression of that tree; finished ensembles are walked as arrays
(``ensemble``).  No lineage grows from level to level or from tree to tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligo.functions.vectors import argmax, softmax
from colligo.operators.ensemble import Ensemble
from colligo.operators.quantiles import quantile_midpoints
from colligo.operators.tables import to_long, tree_samples
from colligo.sources.scratch import materialize

#: Combinations of buckets and missing values of all features up to which rows are summed before trees grow.
COMBINATIONS = 1 << 16
NODE = "tree_id int, node_id long, depth int, is_leaf boolean, feature int, threshold double, label double, impurity double, n long, gain double"


@dataclass
class Node:
    tree_id: int
    node_id: int
    depth: int
    is_leaf: bool
    feature: int | None
    threshold: float | None
    label: float
    impurity: float
    n: int
    gain: float = 0.0


@dataclass
class Trees:
    """Nodes by (tree_id, node_id); the children of node i are 2 i + 1 and 2 i + 2."""

    nodes: dict[tuple[int, int], Node] = field(default_factory=dict)
    classes: int = 0

    def tree_ids(self) -> list[int]:
        return sorted({t for t, _ in self.nodes})

    def _walk(self, tree: int, node: int, x: str, value) -> Column:
        at = self.nodes[tree, node]
        if at.is_leaf:
            return value(at)
        return F.when(F.get(x, F.lit(at.feature)) <= F.lit(at.threshold), self._walk(tree, 2 * node + 1, x, value)).otherwise(self._walk(tree, 2 * node + 2, x, value))

    def leaf(self, tree: int, x: str = "x") -> Column:
        return self._walk(tree, 0, x, lambda n: F.lit(n.node_id).cast("long"))

    def predict_tree(self, tree: int, x: str = "x") -> Column:
        return self._walk(tree, 0, x, lambda n: F.lit(float(n.label)))

    def ensemble(self) -> Ensemble:
        """The trees as arrays; outputs are the votes for each class, or the sum of all values."""
        trees = [[n for (t2, _), n in sorted(self.nodes.items()) if t2 == t] for t in self.tree_ids()]
        return Ensemble.of_nodes(trees, [0.0] * max(self.classes, 1), lambda _, n: (int(n.label), 1.0) if self.classes else (0, n.label))

    def votes(self, x: str = "x") -> Column:
        """Each tree's own value."""
        trees = [[n for (t2, _), n in sorted(self.nodes.items()) if t2 == t] for t in self.tree_ids()]
        return Ensemble.of_nodes(trees, [0.0], lambda _, n: (0, n.label)).votes(x)

    def predict(self, x: str = "x") -> Column:
        """One tree's value; of several, the most frequent class (ties: the lowest) or the mean."""
        trees = self.tree_ids()
        if len(trees) == 1:
            return self.predict_tree(trees[0], x)
        out = self.ensemble().scores(x, "mean")
        return argmax(out).cast("double") if self.classes else F.get(out, F.lit(0))

    def probabilities(self, x: str = "x") -> Column:
        """Share of the trees that vote for each class."""
        return self.ensemble().scores(x, "mean")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(vars(n).values()) for _, n in sorted(self.nodes.items())]
        return spark.createDataFrame(rows, NODE)

    @classmethod
    def of_table(cls, df: DataFrame, classes: int) -> Trees:
        return cls({(r["tree_id"], r["node_id"]): Node(**r.asDict()) for r in df.collect()}, classes)

    def display(self, spark: SparkSession) -> DataFrame:
        """tree_id, node_id, text: each node as a line, indented by its depth, in the order of a walk that goes left first."""

        def line(n: Node) -> str:
            what = f"leaf {n.label:.6f}" if n.is_leaf else f"x[{n.feature}] <= {n.threshold:.6f}"
            return "  " * n.depth + f"{what} (n {n.n}, impurity {n.impurity:.6f})"

        def walk(tree: int, node: int) -> list[int]:
            return [node] + ([] if self.nodes[tree, node].is_leaf else walk(tree, 2 * node + 1) + walk(tree, 2 * node + 2))

        rows = [(t, place, i, line(self.nodes[t, i])) for t in self.tree_ids() for place, i in enumerate(walk(t, 0))]
        return spark.createDataFrame(rows, "tree_id int, place int, node_id long, text string")

    def importance(self, spark: SparkSession) -> DataFrame:
        """feature, importance: summed n x gain over inner nodes, normalised to 1."""
        inner = self.table(spark).where("not is_leaf").groupBy("feature").agg(F.sum(F.col("n") * F.col("gain")).alias("g"))
        return inner.select("feature", F.try_divide(F.col("g"), F.sum("g").over(Window.partitionBy(F.lit(0)))).alias("importance"))


def _bucket(thresholds: Column, feature: int) -> Column:
    return F.size(F.filter(thresholds, lambda t: t < F.get("x", F.lit(feature))))


def _combined(df: DataFrame, splits: dict[int, list[float]], stats: dict[str, Column]) -> DataFrame:
    """(tree_id, x, statistics): one row for all rows of a tree between the same thresholds of every feature, which no split can part.

    x holds the upper threshold of each feature's bucket, infinity above all, or null.
    """
    features = sorted(splits)
    keys = [f"b{f}" for f in features]
    places = [F.coalesce(sum(((F.get("x", F.lit(f)) > t).cast("int") for t in splits[f]), F.lit(0)), F.lit(-1)).alias(k) for f, k in zip(features, keys, strict=True)]
    known = df.select("tree_id", *places, *[v.cast("double").alias(k) for k, v in stats.items()])
    sums = known.groupBy("tree_id", *keys).agg(*[F.sum(k).alias(k) for k in stats])
    ends = {f: F.get(F.array(*[F.lit(float(t)) for t in [*splits[f], math.inf]]), F.col(f"b{f}")) for f in features}
    x = F.array(*[ends.get(f, F.lit(None).cast("double")) for f in range(features[-1] + 1)])
    return sums.select("tree_id", x.alias("x"), *stats)


def _weighted_impurity(prefix: str, stats: Sequence[str], classes: int) -> Column:
    """n x impurity from statistics: n - sum c^2 / n for class counts, q - s^2 / n for moments."""
    n, *rest = (F.col(f"{prefix}{s}") for s in stats if s not in ("rows", "h"))
    if classes:
        squares = rest[0] * rest[0]
        for c in rest[1:]:
            squares = squares + c * c
        return n - F.try_divide(squares, n)
    return rest[1] - F.try_divide(rest[0] * rest[0], n)


def grow(
    df: DataFrame, classes: int = 0, max_depth: int = 3, max_bins: int = 8, min_samples_split: float = 2, min_samples_leaf: float = 1, min_impurity_decrease: float = 0.0,
    min_impurity_split: float = 0.0, label: str = "y", weight: str | None = None, splits: dict[int, list[float]] | None = None, curvature: str | None = None,
) -> Trees:
    """Trees for ``df`` (row_id, x, label, optionally tree_id): Gini of ``classes`` classes, or variance if 0.

    With few features, rows between the same thresholds are summed first, and levels read those sums.
    A split is x <= threshold over the quantile candidates; the largest decrease of
    impurity wins, ties to the lower feature and threshold.  A leaf is the most
    frequent class (ties: the lowest) or the mean; with ``curvature``, the sum of the label
    over the sum of that column, 0 for 0 / 0, from the same aggregation.
    """
    df = df if "tree_id" in df.columns else df.withColumn("tree_id", F.lit(0))
    if splits is None:
        splits = candidate_lists(df, max_bins)
    model = Trees(classes=classes)
    w = F.col(weight) if weight else F.lit(1.0)
    stats = {"n": w} | ({f"c{k}": F.when(F.col(label) == k, w).otherwise(0.0) for k in range(classes)} if classes else {"s": w * F.col(label), "q": w * F.col(label) * F.col(label)})
    stats["rows"] = F.lit(1)
    if curvature:
        stats["h"] = F.col(curvature)
    names = list(stats)
    if splits and math.prod(len(t) + 2 for t in splits.values()) <= COMBINATIONS:
        df = materialize(_combined(df, splits, stats), "combined")
        stats = {k: F.col(k) for k in names}
    mine = not df.is_cached
    if mine:
        df = df.persist()
    limits = F.create_map(*[e for f, ts in splits.items() for e in (F.lit(f), F.array(*[F.lit(float(t)) for t in ts]))])
    features = sorted(splits)
    node = F.lit(0).cast("long")
    for depth in range(max_depth + 1):
        at = df.withColumn("node", node).where("node >= 0") if depth else df.withColumn("node", node)
        at = at.select("tree_id", "node", "x", *[v.cast("double").alias(k) for k, v in stats.items()])
        totals = F.struct(*[F.col(f"t_{k}").alias(k) for k in names]).alias("whole")
        if depth < max_depth and features:
            # one job: the nodes' own totals are those of the first feature's cells
            entry = F.array(*[F.struct(F.lit(f).alias("feature"), _bucket(limits[F.lit(f)], f).alias("bucket")) for f in features])
            cells = at.select("tree_id", "node", *names, F.explode(entry).alias("e")).groupBy("tree_id", "node", "e.feature", "e.bucket").agg(*[F.sum(k).alias(k) for k in names])
            group = Window.partitionBy("tree_id", "node", "feature")
            upto = group.orderBy("bucket")
            cells = cells.withColumns({f"l_{k}": F.sum(k).over(upto) for k in names} | {f"t_{k}": F.sum(k).over(group) for k in names}).withColumns({f"r_{k}": F.col(f"t_{k}") - F.col(f"l_{k}") for k in names})
            gain = (_weighted_impurity("t_", names, classes) - _weighted_impurity("l_", names, classes) - _weighted_impurity("r_", names, classes)) / F.col("t_n")
            real = (F.col("bucket") < F.size(limits[F.col("feature")])) & (F.col("l_n") >= min_samples_leaf) & (F.col("r_n") >= min_samples_leaf) & (F.col("r_n") > 0)
            # rounding makes equal gains equal whatever the order of summation was
            best = F.max(F.when(real, F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bucket")).alias("b")))).alias("p")
            found = cells.groupBy("tree_id", "node").agg(F.max(F.when(F.col("feature") == features[0], totals)).alias("whole"), best)
        else:
            found = at.groupBy("tree_id", "node").agg(*[F.sum(k).alias(f"t_{k}") for k in names]).select("tree_id", "node", totals, F.lit(None).alias("p"))
        opened = False
        for row in found.collect():  # a row for each open node
            key, r, split = (row["tree_id"], row["node"]), row["whole"], row["p"]
            n = r["n"]
            heap = (n - sum(r[f"c{k}"] ** 2 for k in range(classes)) / n if classes else r["q"] - r["s"] ** 2 / n) if n else 0.0
            value = max(range(classes), key=lambda k: (r[f"c{k}"], -k)) if classes else (r["s"] / n if n else 0.0)
            if curvature:
                value = r["s"] / r["h"] if r["h"] else 0.0
            item = Node(key[0], key[1], depth, True, None, None, float(value), heap / n if n else 0.0, int(r["rows"]))
            if split and n >= min_samples_split and split["gain"] > max(0.0, min_impurity_decrease) and item.impurity > min_impurity_split:
                item.is_leaf, item.feature, item.gain = False, -split["f"], split["gain"]
                item.threshold = splits[item.feature][-split["b"]]
                opened = True
            model.nodes[key] = item
        if not opened:
            break
        node = _open_node(model)
    if mine:
        df.unpersist()
    return model


def _open_node(model: Trees) -> Column:
    """The node of the next level that a row belongs to, or -1 if its node is a leaf."""

    def walk(tree: int, node: int) -> Column:
        at = model.nodes.get((tree, node))
        if at is None:
            return F.lit(node).cast("long")
        if at.is_leaf:
            return F.lit(-1).cast("long")
        return F.when(F.get("x", F.lit(at.feature)) <= F.lit(at.threshold), walk(tree, 2 * node + 1)).otherwise(walk(tree, 2 * node + 2))

    out = F.lit(-1).cast("long")
    for t in model.tree_ids():
        out = F.when(F.col("tree_id") == t, walk(t, 0)).otherwise(out)
    return out


def candidate_lists(df: DataFrame, max_bins: int) -> dict[int, list[float]]:
    """Thresholds of every feature; as many as features times bins."""
    return {f: sorted(set(t)) for f, t in quantile_midpoints(to_long(df.select("row_id", "x")), max_bins).items()}


def forest(df: DataFrame, trees: int, rate: float = 0.8, seed: int = 51, **how) -> Trees:
    """All trees grow in the same jobs; tree t sees floor(rate * rows) rows of its own hash order."""
    bins, splits = how.pop("max_bins", 8), how.pop("splits", None)
    splits = candidate_lists(df, bins) if splits is None else splits
    return grow(tree_samples(df, "row_id", trees, rate, seed), splits=splits, **how)


@dataclass(frozen=True)
class Loss:
    """What boosting needs of a loss; ``k`` is the number of outputs, columns are raw ARRAY and y.

    ``prior(shares, k)``: start of each output from ``shares``, the means of the columns ``summary(y, k)``.
    ``gradient(raw, y, k)``: (residual, curvature) of each output; without curvature a leaf is
    the mean residual, else residuals over curvatures, times ``factor(k)``.  ``link`` turns raw
    outputs into predictions, see ``ensemble.LINKS``.
    """

    summary: Callable[[Column, int], list[Column]]
    prior: Callable[[Sequence[float], int], list[float]]
    gradient: Callable[[Column, Column, int], list[tuple[Column, Column | None]]]
    link: str = "identity"
    factor: Callable[[int], float] = lambda k: 1.0


def _clip(p: float) -> float:
    return min(max(p, 1e-3), 1 - 1e-3)


def _is(y: Column, k: int) -> Column:
    return F.when(y == k, 1.0).otherwise(0.0)


def _binomial(raw: Column, y: Column, _: int) -> list[tuple[Column, Column | None]]:
    r = y - 1 / (1 + F.exp(-F.get(raw, F.lit(0))))
    return [(r, (y - r) * (1 - y + r))]


def _multinomial(raw: Column, y: Column, k: int) -> list[tuple[Column, Column | None]]:
    shares = softmax(raw)
    r = [_is(y, c) - F.get(shares, F.lit(c)) for c in range(k)]
    return [(r[c], (_is(y, c) - r[c]) * (1 - _is(y, c) + r[c])) for c in range(k)]


def _poisson(raw: Column, y: Column, _: int) -> list[tuple[Column, Column | None]]:
    rate = F.exp(F.get(raw, F.lit(0)))
    return [(y - rate, rate)]


#: Losses by name; others are added here, or passed to ``boost`` as they are.
LOSSES = {
    "ls": Loss(lambda y, k: [y], lambda m, k: [m[0]], lambda raw, y, k: [(y - F.get(raw, F.lit(0)), None)]),
    "binomial": Loss(lambda y, k: [y], lambda m, k: [math.log(_clip(m[0]) / (1 - _clip(m[0])))], _binomial, "expit"),
    "multinomial": Loss(lambda y, k: [_is(y, c) for c in range(k)], lambda m, k: [math.log(_clip(s)) for s in m], _multinomial, "softmax", lambda k: (k - 1) / k),
    "poisson": Loss(lambda y, k: [y], lambda m, k: [math.log(max(m[0], 1e-9))], _poisson, "exp"),
}


@dataclass
class Boosted:
    """prior[k] + rate * sum of trees for each of the raw outputs k; trees[round][k]."""

    loss: str
    rate: float
    prior: list[float]
    trees: list[list[Trees]] = field(default_factory=list)

    def ensemble(self) -> Ensemble:
        trees = [[n for _, n in sorted(t.nodes.items())] for stage in self.trees for t in stage]
        outputs = [k for stage in self.trees for k in range(len(stage))]
        return Ensemble.of_nodes(trees, self.prior, lambda t, n: (outputs[t], self.rate * n.label))

    def raw(self, x: str = "x") -> Column:
        """ARRAY<DOUBLE>: the raw outputs."""
        return self.ensemble().scores(x)

    def fitted(self, x: str = "x") -> Column:
        """ARRAY<DOUBLE>: the outputs on the scale of the labels."""
        return self.ensemble().scores(x, LOSSES[self.loss].link)

    def probabilities(self, x: str = "x") -> Column:
        if LOSSES[self.loss].link not in ("expit", "softmax"):
            raise ValueError(f"{self.loss} has no classes")
        return self.fitted(x)

    def predict(self, x: str = "x") -> Column:
        """The value; or the class, 1 for probabilities strictly above 0.5, or the first largest."""
        p, link = self.fitted(x), LOSSES[self.loss].link
        if link == "expit":
            return F.when(F.get(p, F.lit(1)) > 0.5, 1.0).otherwise(0.0)
        return argmax(p).cast("double") if link == "softmax" else F.get(p, F.lit(0))


def boost(df: DataFrame, loss: str = "ls", classes: int = 2, rounds: int = 8, rate: float = 0.1, max_depth: int = 3, max_bins: int = 8, splits: dict[int, list[float]] | None = None) -> Boosted:
    """Gradient boosting with a loss of ``LOSSES``; ``deviance`` is binomial for two classes and multinomial for more.

    All outputs of a round grow together: a row stands once for each output in the same
    aggregations, which also sum what re-estimates the leaves, so a round takes as many jobs
    as its trees have levels, and one that saves the raw scores.  Only the round's own
    trees are evaluated, so a round costs the same however many came before.  Thresholds
    are those of ``splits``, or searched once.
    """
    name = {"deviance": "binomial" if classes == 2 else "multinomial"}.get(loss, loss)
    if name not in LOSSES:
        raise ValueError(f"unknown loss {loss}")
    how = LOSSES[name]
    k = classes if name == "multinomial" else 1
    means = df.agg(*[F.avg(c) for c in how.summary(F.col("y"), k)]).first()
    prior = how.prior([m or 0.0 for m in means], k)
    model = Boosted(name, rate, prior)
    splits = candidate_lists(df, max_bins) if splits is None else splits
    state = materialize(df.select("row_id", "x", "y", F.array(*map(F.lit, prior)).alias("raw")), "scores")
    for done in range(rounds):
        parts = how.gradient(F.col("raw"), F.col("y"), k)
        curved = parts[0][1] is not None
        outputs = [F.struct(F.lit(c).alias("tree_id"), r.alias("r"), (h if curved else F.lit(1.0)).alias("h")) for c, (r, h) in enumerate(parts)]
        grown = grow(state.select("row_id", "x", F.inline(F.array(*outputs))), 0, max_depth, label="r", splits=splits, curvature="h" if curved else None)
        stage = [Trees({(0, n): node for (t, n), node in grown.nodes.items() if t == c}) for c in range(len(prior))]
        for t in stage:
            for node in t.nodes.values():
                node.tree_id = 0
                node.label *= how.factor(k) if node.is_leaf else 1.0
        model.trees.append(stage)
        if done < rounds - 1:  # no round reads the last one's scores
            state = materialize(state.withColumn("raw", F.array(*[F.get("raw", F.lit(c)) + F.lit(rate) * t.predict_tree(0) for c, t in enumerate(stage)])), "scores")
    return model
