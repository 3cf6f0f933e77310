"""Connected components by star contraction; the graph never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import other_key, save


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Link the neighbours v of every u that ``keep`` names to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least.select(other_key("u").alias("k"), "m"), other_key("u") == F.col("k"))
    return joined.where(keep).select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).where("a > b")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is the least node reachable.

    Large and small stars alternate until nothing changes, O(log n) rounds; every round
    is written to the shared folder.  Nodes with null are ignored.  No edges: no rows.
    """
    edges = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(most):
        large = _star(_both(edges), F.col("v") > F.col("u")).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down.union(down.select("u", F.col("u").alias("v"))).distinct(), F.lit(True)).distinct()
        edges = save(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
