"""Registered queries: the library's operators over whole tables, with SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligo.functions import vectors as V
from colligo.operators import explain, linear, matrix, metrics, mlp, moments, order, quantiles, stats, tables, tree
from colligo.plans import jobs, stages
from colligo.sources import io
from colligo.sources.io import read_table
from colligo.sources.scratch import materialize, scratch_path
from colligo.streaming import users

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# data sets ---------------------------------------------------------------------------------------


def _month(c: str):
    return F.month(c).cast("double")


def order_party(s: SparkSession, d: str) -> DataFrame:
    """Party 0: order features and the label, a high total price."""
    o = read_table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.array((F.substring("o_orderpriority", 1, 1).cast("double") - 1) / 4, (_month("o_orderdate") - 1) / 11).alias("x"), F.when(F.col("o_totalprice") > 250000, 1.0).otherwise(0.0).alias("y"))


def customer_party(s: SparkSession, d: str) -> DataFrame:
    """Party 1: the customer of every order."""
    o, c = read_table(s, d, "orders"), read_table(s, d, "customer").hint("merge")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("row_id"), F.array(F.col("c_acctbal") / 10000, F.col("c_nationkey") / 24).alias("x"))


def aligned(s: SparkSession, d: str) -> DataFrame:
    return tables.align([order_party(s, d), customer_party(s, d)])


ALIGNED = """al as (select o_orderkey as row_id, (cast(substr(o_orderpriority, 1, 1) as double) - 1) / 4 as x0, (cast(month(o_orderdate) as double) - 1) / 11 as x1,
 c_acctbal / 10000 as x2, c_nationkey / 24.0::double as x3, case when o_totalprice > 250000 then 1.0::double else 0.0::double end as y
 from orders join customer on o_custkey = c_custkey)"""


def baskets(s: SparkSession, d: str) -> DataFrame:
    """One row an order: scaled quantity, lines and discount, and whether its revenue is large; saved, as all steps over it would add the lines up again."""
    per = read_table(s, d, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("c"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"),
    )
    rows = per.select(F.col("l_orderkey").alias("row_id"), F.array(F.col("q") / 100.0, F.col("n") / 4.0, F.col("c") / (F.col("n") * 10.0)).alias("x"), F.when(F.col("p") > 20000000, 1.0).otherwise(0.0).alias("y"), (F.col("p") / 10000000.0).alias("amount"))
    return materialize(rows, "baskets")


BASKETS = """pb as (select l_orderkey as row_id, sum(cast(l_quantity as bigint)) as q, count(*) as n, sum(cast(round(l_discount * 100) as bigint)) as c, sum(cast(round(l_extendedprice * 100) as bigint)) as p
 from lineitem group by l_orderkey),
bk as (select row_id, q / 100.0::double as x0, n / 4.0::double as x1, c / (n * 10.0::double) as x2, case when p > 20000000 then 1.0::double else 0.0::double end as y, p / 10000000.0::double as amount from pb)"""


def lines_long(s: SparkSession, d: str) -> DataFrame:
    """(feature, v, y, w) of line items: features quantity, discount and tax, label the price, weight the quantity."""
    li = read_table(s, d, "lineitem")
    return li.select(F.monotonically_increasing_id().alias("row_id"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("w"), F.posexplode(F.array("l_quantity", "l_discount", "l_tax")).alias("feature", "v"))


LONG = "lo as (select l_extendedprice as y, l_quantity as w, unnest([0, 1, 2]) as feature, unnest([l_quantity, l_discount, l_tax]) as v from lineitem)"


def _hash(key: str, seed: int = 51) -> str:
    """hash32 in SQL."""
    x = f"xor((({key})::bigint % 4294967296), {V.seed_mask(seed)}::bigint)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {V.MIX}) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


def r(c, digits: int = 6):
    return F.round(c, digits)


# projection, sampling, partition -------------------------------------------------------------------


@query(f"select o_orderkey as row_id, row_number() over (order by {_hash('o_orderkey')}, o_orderkey) <= floor(0.8 * (select count(*) from orders)) as is_train from orders")
def split_train_test(s, d):
    """PRJ-1: exact 80 % in hash order."""
    o = read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return order.split_train_test(o, "row_id")


@query("select o_orderkey as row_id, 1.0::double as x0, (cast(substr(o_orderpriority, 1, 1) as double) - 1) / 4 as x1 from orders")
def split_with_bias(s, d):
    """PRJ-2: a constant before the features."""
    return order_party(s, d).select("row_id", tables.add_bias(F.col("x")).alias("x")).select("row_id", F.get("x", F.lit(0)).alias("x0"), F.get("x", F.lit(1)).alias("x1"))


@query(" union all ".join(f"select {t}::int as iteration, o_orderkey as row_id from (select *, row_number() over (order by {_hash('o_orderkey', 51 + 7919 * (t + 1))}, o_orderkey) as n from orders) where n <= 64" for t in range(3)))
def mini_batches(s, d):
    """PRJ-3/4: a batch of 64 of its own order for each of three iterations."""
    o = read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    batches = F.array(*[F.when(c, F.lit(t)) for t, c in enumerate(tables.batch_conditions(o, "row_id", 64, range(3)))])
    return o.select(F.explode(F.filter(batches, lambda t: t.isNotNull())).alias("iteration"), "row_id")


@query(" union all ".join(f"select {t}::int as tree_id, o_orderkey as row_id from (select *, row_number() over (order by {_hash('o_orderkey', 51 + 104729 * (t + 1))}, o_orderkey) as n from orders) where n <= floor(0.6 * (select count(*) from orders))" for t in range(3)))
def tree_samples(s, d):
    """PRJ-5: 60 % of the rows for each tree, without replacement."""
    return tables.tree_samples(read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_id")), "row_id", 3, 0.6).select("tree_id", "row_id")


@query("select vec_id, embedding[4]::double as x0, embedding[18]::double as x1, embedding[64]::double as x2 from embeddings")
def feature_subset(s, d):
    """PRJ-7: chosen vector entries."""
    e = read_table(s, d, "embeddings").select("vec_id", V.take(F.transform("embedding", lambda v: v.cast("double")), [3, 17, 63]).alias("x"))
    return e.select("vec_id", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(3)])


@query("select party, local_idx, count(*) as n, round(sum(v), 4) as total from (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as i from embeddings) e join (select i, case when i < 21 then 0 when i < 42 then 1 else 2 end as party, (case when i < 42 then i % 21 else i - 42 end)::int as local_idx from range(64) t(i)) f using (i) group by party, local_idx")
def vertical_split(s, d):
    """PRJ-9/10: 64 features over three parties, the remainder to the last."""
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))
    parts = tables.vertical_split(e, tables.equal_sizes(64, 3), 0)
    out = None
    for p, t in enumerate(parts):
        one = t.select(F.lit(p).alias("party"), F.posexplode("x").alias("local_idx", "v"))
        out = one if out is None else out.union(one)
    return out.groupBy("party", "local_idx").agg(F.count("*").alias("n"), r(F.sum("v"), 4).alias("total"))


@query(f"with {LONG}, m as (select feature, sum(w*v)/sum(w) as mv, sum(w*y)/sum(w) as my from lo group by feature), c as (select l.feature, abs(sum(w*(v-mv)*(y-my))/sqrt(sum(w*(v-mv)*(v-mv)))/sqrt(sum(w*(y-my)*(y-my)))) as corr from lo l join m using (feature) group by l.feature) select feature::int as feature, ((row_number() over (order by corr desc, feature) - 1) % 2)::int as party from c")
def importance_split(s, d):
    """PRJ-11: features dealt in turn by weighted correlation."""
    scores = stats.feature_correlations(lines_long(s, d)).withColumnRenamed("corr", "score")
    return tables.importance_split(scores, 2).select("feature", "party")


@query(f"with k as (select c_custkey, row_number() over (order by c_custkey) - 1 as rank, count(*) over () as n from customer), g as (select i as draw, {_hash('i')} as h from range(2000) t(i)) select draw, c_custkey from g join k on k.rank = g.h % k.n")
def bootstrap(s, d):
    """PRJ-12: 2000 draws with replacement."""
    c = order.with_global_rank(read_table(s, d, "customer").select("c_custkey"), "c_custkey")
    return tables.bootstrap(c, "rank", c.count(), 2000).select("draw", "c_custkey")


@query(f"select o_orderkey, cast(floor(({_hash('o_orderkey')}) / 65536) % 2 as bigint) as label from orders")
def random_labels(s, d):
    """PRJ-13: a hash-derived 0/1 label."""
    return read_table(s, d, "orders").select("o_orderkey", tables.random_label(F.col("o_orderkey")).cast("long").alias("label"))


@query("select o_orderkey, cast(floor((row_number() over (order by o_totalprice, o_orderkey) - 1) / ceil((select count(*) from orders) / 7.0)) as int) as part from orders")
def even_partition(s, d):
    """PRJ-14: contiguous chunks of a total order."""
    return tables.partition_by_rank(read_table(s, d, "orders").select("o_orderkey", "o_totalprice"), 7, "o_totalprice", "o_orderkey").select("o_orderkey", "part")


@query(f"select o_orderkey, row_number() over (order by {_hash('o_orderkey')}, o_orderkey) - 1 as place from orders")
def shuffled_order(s, d):
    """SRC-4: the order that splits and samples are taken from, written and read again."""
    path = scratch_path(s, "order")
    order.shuffled(read_table(s, d, "orders").select("o_orderkey"), "o_orderkey").write.parquet(path)
    return s.read.parquet(path)


@query("with m as (select min(o_totalprice) as a, max(o_totalprice) as b, min(month(o_orderdate)) as c, max(month(o_orderdate)) as d from orders) select row_number() over (order by o_orderkey) - 1 as row_id, round((o_totalprice - a + 0.5) / (b - a + 0.5), 6) as x0, round((month(o_orderdate) - c + 0.5) / (d - c + 0.5), 6) as x1, (o_orderstatus = 'F')::int::double as y from orders, m")
def normalized_file(s, d):
    """SRC-15, PRE-2: a file without keys is scaled to another one, rows in their order, the label as it is."""
    source, target = scratch_path(s, "raw"), scratch_path(s, "scaled")
    o = read_table(s, d, "orders").select("o_orderkey", "o_totalprice", _month("o_orderdate").alias("m"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    io.write_csv_in_order(o, source, "o_orderkey", digits=None)
    io.normalize_csv(s, source, target, 3, 0.5, 1)
    rows = io.read_csv_party(s, target, 3, True)
    return rows.select("row_id", r(F.get("x", F.lit(0))).alias("x0"), r(F.get("x", F.lit(1))).alias("x1"), "y")


@query(f"select o_orderkey as row_id from orders where o_orderkey = (select min(o_orderkey) from orders) union all select o_orderkey from (select o_orderkey, row_number() over (order by {_hash('o_orderkey')}, o_orderkey) as n from orders where o_orderkey > (select min(o_orderkey) from orders)) where n <= 100")
def sample_with_first(s, d):
    """PRJ-6: the first row, and exactly 100 others."""
    o = read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"))
    return tables.subset_with_first(o, "row_id", o.agg(F.min("row_id")).first()[0], 100)


def supplier_dimension(s: SparkSession, d: str) -> DataFrame:
    """(global_idx, party, local_idx): suppliers as features that their nations own."""
    own = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return read_table(s, d, "supplier").select(F.col("s_suppkey").alias("global_idx"), F.col("s_nationkey").alias("party"), (F.row_number().over(own) - 1).alias("local_idx"))


@query("with l as (select s_suppkey as global_idx, s_nationkey as party, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as local_idx, count(*) over (partition by s_nationkey) as n from supplier) select global_idx, party, local_idx, cast(floor(local_idx / ceil(n / 3.0)) as int) as part from l")
def balanced_partition(s, d):
    """PRJ-15: every party's features over all partitions, in contiguous chunks."""
    return tables.balanced_partition(supplier_dimension(s, d), 3).select("global_idx", "party", "local_idx", "part")


# joins ---------------------------------------------------------------------------------------------


@query(f"with {ALIGNED} select row_id, round(x0, 6) as x0, round(x1, 6) as x1, round(x2, 6) as x2, round(x3, 6) as x3, y from al")
def align_parties(s, d):
    """JOIN-1/2: parties joined by row id, features side by side."""
    return aligned(s, d).select("row_id", *[r(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(4)], "y")


@query(f"with {ALIGNED}, z as (select n_name, o.o_orderkey from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey) select row_number() over (order by row_id) - 1 as row_id, round(x0, 4) as x0, round(x1, 4) as x1, round(x2, 4) as x2, round(x3, 4) as x3, length(n_name)::double as x4, y from al join z on z.o_orderkey = al.row_id")
def align_party_files(s, d):
    """JOIN-1, SRC-1/2/11: three parties' files without keys or headers, written in one order and aligned by position."""
    o, c, n = (read_table(s, d, t) for t in ("orders", "customer", "nation"))
    third = o.join(c.hint("merge"), o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(F.col("o_orderkey").alias("row_id"), F.length("n_name").cast("double").alias("c0"))
    flat = lambda t, *more: t.select("row_id", F.get("x", F.lit(0)).alias("c0"), F.get("x", F.lit(1)).alias("c1"), *more)
    parties = []
    for i, (t, columns) in enumerate(((flat(order_party(s, d), "y"), 3), (flat(customer_party(s, d)), 2), (third, 1))):
        path = scratch_path(s, f"party{i}")
        io.write_csv_in_order(t, path, "row_id", digits=None)
        parties.append(io.read_csv_party(s, path, columns, i == 0))
    rows = tables.align_by_position(parties)
    return rows.select("row_id", *[r(F.get("x", F.lit(i)), 4).alias(f"x{i}") for i in range(5)], "y")


@query("with z as (select s_nationkey as party, count(*) as size from supplier group by 1) select party, size, cast(coalesce(sum(size) over (order by party rows between unbounded preceding and 1 preceding), 0) as bigint) as start from z")
def party_offsets(s, d):
    """JOIN-3/4: global offsets of party-local features."""
    return tables.party_offsets(supplier_dimension(s, d).groupBy("party").agg(F.count("*").alias("size"))).select("party", "size", "start")


@query(f"with {LONG}, t as (select feature, v as threshold from (select distinct feature, v, lead(v) over (partition by feature order by v) as nx from (select distinct feature, v from lo)) where nx is not null) select t.feature::int as feature, round(threshold, 6) as threshold, count(*) filter (where v <= threshold) as n_left, count(*) filter (where v > threshold) as n_right from t join lo on lo.feature = t.feature group by t.feature, threshold")
def split_indicators(s, d):
    """JOIN-7: rows at or below each candidate, by buckets and prefix sums instead of a range join."""
    long = lines_long(s, d).withColumn("node", F.lit(0))
    splits = stats.split_candidates(long, 64)
    out = stats.split_statistics(stats.bucketize(long, splits), splits)
    return out.select("feature", r("threshold").alias("threshold"), F.col("left_n").alias("n_left"), F.col("right_n").alias("n_right"))


# aggregations ----------------------------------------------------------------------------------------


@query(f"with {BASKETS} select round((select 1 - sum(n * n) / pow(sum(n), 2) from (select count(*)::double as n from bk group by y)), 6) as gini, round(avg(amount * amount) - avg(amount) * avg(amount), 4) as variance, round(sum(x1 * amount * amount) / sum(x1) - pow(sum(x1 * amount) / sum(x1), 2), 4) as weighted_variance from bk")
def impurities(s, d):
    """AGG-1/2: Gini, variance and weighted variance of the root."""
    b = baskets(s, d).withColumn("w", F.get("x", F.lit(1)))
    one = lambda df, name, n: df.select(r("impurity", n).alias(name))
    return one(stats.impurity(b, "y", True), "gini", 6).join(one(stats.impurity(b, "amount", False), "variance", 4)).join(one(stats.impurity(b, "amount", False, "w"), "weighted_variance", 4))


@query(f"with {LONG}, m as (select feature, sum(w*v)/sum(w) as mv, sum(w*y)/sum(w) as my from lo group by feature) select l.feature::int as feature, round(any_value(mv), 6) as mean, round(sum(w*(v-mv)*(v-mv))/sum(w), 6) as variance, round(sum(w*(v-mv)*(y-my))/sum(w), 3) as covariance from lo l join m using (feature) group by l.feature")
def weighted_moments(s, d):
    """AGG-6/11/12/13."""
    return stats.weighted_moments(lines_long(s, d)).select("feature", r("mean").alias("mean"), r("variance").alias("variance"), r("covariance", 3).alias("covariance"))


@query(f"with {LONG}, m as (select feature, sum(w*v)/sum(w) as mv, sum(w*y)/sum(w) as my from lo group by feature) select l.feature::int as feature, round(abs(sum(w*(v-mv)*(y-my))/sqrt(sum(w*(v-mv)*(v-mv)))/sqrt(sum(w*(y-my)*(y-my)))), 6) as corr from lo l join m using (feature) group by l.feature")
def weighted_pearson(s, d):
    """AGG-7/8/9: absolute weighted correlations."""
    return stats.feature_correlations(lines_long(s, d)).select("feature", r("corr").alias("corr"))


@query(f"with {LONG} select feature::int as feature, round(corr(v, y), 6) as corr, round(covar_pop(v, y), 4) as covariance from lo group by feature")
def pearson(s, d):
    """AGG-10: unweighted correlation."""
    return lines_long(s, d).groupBy("feature").agg(r(F.corr("v", "y")).alias("corr"), r(F.covar_pop("v", "y"), 4).alias("covariance"))


@query("with c as (select l_linestatus, l_linenumber, count(*) as n from lineitem group by 1, 2), m as (select l_linestatus, l_linenumber, row_number() over (partition by l_linestatus order by n desc, l_linenumber) as k from c) select l.l_linestatus, any_value(m.l_linenumber) as most, round(median(l_quantity), 6) as middle, round(avg(l_quantity), 6) as mean, max(l_quantity) as largest from lineitem l join m on m.l_linestatus = l.l_linestatus and m.k = 1 group by l.l_linestatus")
def mode_median_mean(s, d):
    """AGG-14/15/16: the lowest of equal modes, and the mean of two middles."""
    li = read_table(s, d, "lineitem")
    means = li.groupBy("l_linestatus").agg(r(F.avg("l_quantity")).alias("mean"), F.max("l_quantity").alias("largest"))
    middles = quantiles.with_medians(li, ["l_linestatus"], "l_quantity", "middle").withColumn("middle", r("middle"))
    return means.join(middles, "l_linestatus").join(quantiles.mode(li, ["l_linestatus"], "l_linenumber", "most"), "l_linestatus")


RULE = f"ru as (select row_id, y, amount, case when x0 > 0.9 then 1.0 else 0.0 end as p, x0 * 1.5 as guess from bk)"
#: The reports of ru (y, p) and of ru (amount, guess).
CELLS = """c as (select count(*) filter (where p = 1 and y = 1) as tp, count(*) filter (where p = 1 and y = 0) as fp, count(*) filter (where p = 0 and y = 1) as fn, count(*) filter (where p = 0 and y = 0) as tn from ru) select tp, fp, fn, tn
, round((tp + tn)::double / nullif(tp + fp + fn + tn, 0), 6) as accuracy, round(tp::double / nullif(tp + fn, 0), 6) as sensitivity, round(tn::double / nullif(tn + fp, 0), 6) as specificity, round((tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)) / 2, 6) as balanced_accuracy, round(tp::double / nullif(tp + fp, 0), 6) as "precision", round(tn::double / nullif(tn + fn, 0), 6) as npv, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c"""
ERRORS = """select round(avg(pow(guess - amount, 2)), 5) as mse, round(sqrt(avg(pow(guess - amount, 2))), 5) as rmse, round(avg(pow(ln(1 + guess) - ln(1 + amount), 2)), 5) as msle, round(sqrt(avg(pow(ln(1 + guess) - ln(1 + amount), 2))), 5) as rmsle, round(median(abs(guess - amount)), 5) as median_abs_error, round(avg(abs(guess - amount)), 5) as mean_abs_error, round(max(abs(guess - amount)), 5) as max_error from ru"""


def ruled(s, d):
    b = baskets(s, d)
    return b.select("row_id", "y", "amount", F.when(F.get("x", F.lit(0)) > 0.9, 1.0).otherwise(0.0).alias("prediction"), (F.get("x", F.lit(0)) * 1.5).alias("guess"), F.get("x", F.lit(1)).alias("w"))


@query(f"with {BASKETS}, {RULE}, {CELLS}")
def classification_report(s, d):
    """AGG-18, MET-1/8/9: confusion cells and rates."""
    out = metrics.classification_report(ruled(s, d))
    return out.select(*[r(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"with {BASKETS}, {RULE} select y::int as label, count(*) filter (where p = 0) as predicted_0, count(*) filter (where p = 1) as predicted_1 from ru group by y")
def confusion_matrix(s, d):
    """MET-8: the matrix as rows."""
    return metrics.confusion_matrix(ruled(s, d))


@query(f"with {BASKETS}, {RULE} {ERRORS}")
def regression_report(s, d):
    """AGG-19, MET-2/10, MTH-4/5/6."""
    out = metrics.regression_report(ruled(s, d), "guess", "amount")
    return out.select(*[r(c, 5).alias(c) for c in out.columns])


@query(f"with {BASKETS} select round(sum(x1 * pow(x0 * 1.5 - amount, 2)) / sum(x1), 5) as mse, round(sqrt(sum(x1 * pow(x0 * 1.5 - amount, 2)) / sum(x1)), 5) as rmse from bk")
def weighted_regression_report(s, d):
    """MTH-4 with weights."""
    return metrics.regression_report(ruled(s, d), "guess", "amount", "w").select(r("mse", 5).alias("mse"), r("rmse", 5).alias("rmse"))


@query(f"with {BASKETS}, {RULE} select round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss from (select y, least(greatest(case when p = 1 then 0.9 else 0.0 end, 1e-15), 1 - 1e-15) as q from ru)")
def log_loss(s, d):
    """MTH-2: clipped log loss."""
    return metrics.log_loss(ruled(s, d).withColumn("probability", F.col("prediction") * 0.9)).select(r("log_loss").alias("log_loss"))


@query(f"with {BASKETS}, v as (select row_id, [case when x0 > 0.8 then 1 else 0 end, case when x1 > 1 then 1 else 0 end, case when x2 > 0.5 then 1 else 0 end] as votes from bk) select row_id, round(len(list_filter(votes, lambda e: e = 0)) / 3.0::double, 6) as p0, round(len(list_filter(votes, lambda e: e = 1)) / 3.0::double, 6) as p1 from v")
def vote_probabilities(s, d):
    """AGG-20/21: votes to class shares."""
    b = baskets(s, d)
    votes = b.select("row_id", F.explode(F.array(*[F.when(F.get("x", F.lit(i)) > t, 1).otherwise(0) for i, t in enumerate((0.8, 1.0, 0.5))])).alias("prediction"))
    return metrics.vote_probabilities(votes, 2).select("row_id", r(F.get("probabilities", F.lit(0))).alias("p0"), r(F.get("probabilities", F.lit(1))).alias("p1"))


@query(f"with {LONG} select feature::int as feature, min(v) as low, max(v) as high, round(avg(v), 6) as mean, round(var_pop(v), 6) as variance, round(stddev_pop(v), 6) as deviation, count(*) as n from lo group by feature")
def column_statistics(s, d):
    """AGG-25/26."""
    out = stats.column_statistics(lines_long(s, d))
    return out.select("feature", "low", "high", r("mean").alias("mean"), r("variance").alias("variance"), r("deviation").alias("deviation"), "n")


@query("select label, round(ln(p / (1 - p)), 6) as log_odds, round(ln(p), 6) as log_share from (select label, least(greatest(count(*)::double / (select count(*) from embeddings), 1e-3), 1 - 1e-3) as p from embeddings group by label)")
def class_priors(s, d):
    """AGG-27/28: clipped priors of boosting."""
    e = read_table(s, d, "embeddings")
    shares = e.groupBy("label").agg((F.count("*") / F.lit(e.count())).alias("p")).withColumn("p", F.least(F.greatest("p", F.lit(1e-3)), F.lit(1 - 1e-3)))
    return shares.select("label", r(F.ln(F.col("p") / (1 - F.col("p")))).alias("log_odds"), r(F.ln("p")).alias("log_share"))


# sort and top-k ---------------------------------------------------------------------------------------


@query("select event_id, row_number() over (order by value, event_id) - 1 as rank from events")
def global_rank(s, d):
    """SRT-1: a total order without one sorting task."""
    return order.with_global_rank(read_table(s, d, "events").select("event_id", "value"), "value", "event_id").select("event_id", "rank")


@query("with k as (select value as v, row_number() over (order by value) - 1 as i, count(*) over () as n from events), c as (select t.i::int as split_id, least((t.i + 1) * (n // 16), n - 1) as a, least((t.i + 1) * (n // 16) + 1, n - 1) as b from range(15) t(i), (select distinct n from k)) select split_id, round((x.v + y.v) / 2, 6) as threshold from c join k x on x.i = c.a join k y on y.i = c.b")
def quantile_splits(s, d):
    """SRT-3: midpoints at equal rank steps."""
    long = read_table(s, d, "events").select(F.col("event_id").alias("row_id"), F.lit(0).alias("feature"), F.col("value").alias("v"))
    return stats.split_candidates(long, 16).select("split_id", r("threshold").alias("threshold"))


@query("select feature::int as feature, (row_number() over (partition by feature order by v) - 1)::int as split_id, v as threshold from (select feature, v, lead(v) over (partition by feature order by v) as nx from (select distinct unnest([0, 1]) as feature, unnest([l_discount, l_tax]) as v from lineitem)) where nx is not null")
def distinct_splits(s, d):
    """SRT-2/3: few distinct values are their own candidates."""
    li = read_table(s, d, "lineitem").select(F.monotonically_increasing_id().alias("row_id"), F.posexplode(F.array("l_discount", "l_tax")).alias("feature", "v"))
    return stats.split_candidates(li, 64).select("feature", "split_id", "threshold")


@query("select vec_id, rank, i from (select vec_id, (i - 1)::int as i, (row_number() over (partition by vec_id order by v desc, i))::int as rank from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)) where rank <= 5")
def top_k_entries(s, d):
    """SRT-4/5: indices of the five largest entries."""
    e = read_table(s, d, "embeddings").select("vec_id", F.posexplode(V.top_k_indices(F.col("embedding"), 5)).alias("p", "i"))
    return e.select("vec_id", (F.col("p") + 1).alias("rank"), "i")


@query(f"with {LONG}, m as (select feature, sum(w*v)/sum(w) as mv, sum(w*y)/sum(w) as my from lo group by feature), c as (select l.feature, abs(sum(w*(v-mv)*(y-my))/sqrt(sum(w*(v-mv)*(v-mv)))/sqrt(sum(w*(y-my)*(y-my)))) as corr from lo l join m using (feature) group by l.feature) select feature::int as feature, round(corr, 6) as corr from c order by c.corr desc, feature limit 2")
def top_features(s, d):
    """SRT-6/7, PRE-3/5: the two most correlated features."""
    return stats.top_features(stats.feature_correlations(lines_long(s, d)), 2).select("feature", r("corr").alias("corr"))


@query("select vec_id, (list_position(embedding, list_max(embedding)) - 1)::bigint as best, coalesce(list_position(embedding, embedding[7]) - 1, -1)::bigint as at, round(list_max(embedding)::double, 6) as top from embeddings")
def argmax_and_search(s, d):
    """SRT-8/9/10."""
    e = F.col("embedding")
    return read_table(s, d, "embeddings").select("vec_id", V.argmax(e).cast("long").alias("best"), V.index_of(e, F.get(e, F.lit(6))).cast("long").alias("at"), r(F.array_max(e).cast("double")).alias("top"))


# scalar and vector functions ----------------------------------------------------------------------------


@query("select event_id, round(1 / (1 + exp(-(value - 10) / 5)), 6) as p, abs(value - round(value, 2)) <= 1e-3 as close from events")
def logistic_values(s, d):
    """MTH-1/7."""
    v = F.col("value")
    return read_table(s, d, "events").select("event_id", r(V.logistic((v - 10) / 5)).alias("p"), V.close_to(v, F.round(v, 2)).alias("close"))


_E = "list_transform(embedding, lambda e: e::double)"


@query(f"select vec_id, round(list_dot_product({_E}, {_E}), 5) as dot, round(list_sum({_E}), 5) as total, round(list_sum(list_transform({_E}, lambda e: (e - e * 2) * (e - e * 2))), 5) as distance, round(exp(embedding[1]::double) / list_sum(list_transform({_E}, lambda e: exp(e))), 6) as soft, round(embedding[1]::double / nullif(list_sum({_E}), 0), 3) as share from embeddings")
def vector_algebra(s, d):
    """MTH-3, AGG-17, LA-4..12, LA-16, LA-19."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    e = read_table(s, d, "embeddings").select("vec_id", v.alias("v"))
    first = lambda c: F.get(c, F.lit(0))
    v = F.col("v")
    return e.select("vec_id", r(V.dot(v, v), 5).alias("dot"), r(V.vector_sum(v), 5).alias("total"), r(V.squared_distance(v, V.add(v, v)), 5).alias("distance"), r(first(V.softmax(v))).alias("soft"), r(first(V.sum_normalize(v)), 3).alias("share"))


@query("with n as (select l_linenumber + 4 as d, cast(l_quantity as bigint) % (l_linenumber + 5) as z, count(*) as n from lineitem group by 1, 2) select d::int as d, z::bigint as z, n, round(case when z in (0, d) then 1e-6 else greatest(1e-6, (d - 1) / ((factorial(d::int) / (factorial(z::int) * factorial((d - z)::int))) * z * (d - z))::double) end, 9) as w from n")
def kernel_shap_weights(s, d):
    """MTH-8/9: coalitions by feature count and size, with their kernel weights."""
    n = read_table(s, d, "lineitem").groupBy((F.col("l_linenumber") + 4).alias("d"), F.pmod(F.col("l_quantity").cast("long"), F.col("l_linenumber") + 5).alias("z")).agg(F.count("*").alias("n"))
    return n.select("d", "z", "n", r(V.kernel_shap_weight(F.col("d"), F.col("z")), 9).alias("w"))


@query("select event_id, cast(trunc(value * 65536) as double) as mantissa, round(trunc(value * 65536) / 65536, 6) as decoded, cast(trunc(trunc(value * 65536) / 256) as double) as shorter, round(2 * trunc(value * 65536) / 65536, 6) as doubled from events")
def fixed_point(s, d):
    """MTH-11..15/17, LA-5/7/25: encode, decode, add and shorten."""
    e = read_table(s, d, "events").select("event_id", V.encode_fixed(F.col("value")).alias("c"))
    c = F.col("c")
    return e.select("event_id", c["mantissa"].cast("double").alias("mantissa"), r(V.decode_fixed(c)).alias("decoded"), V.rescale_fixed(c, -8)["mantissa"].cast("double").alias("shorter"), r(V.decode_fixed(V.add_fixed(c, c))).alias("doubled"))


@query("select event_id, case when h < 0 or h >= 30000 then 'invalid' when 3 * h <= 30000 then 'positive' when 3 * h >= 60000 then 'negative' else 'overflow' end as state from (select event_id, event_id % 31000 as h from events)")
def residue_states(s, d):
    """MTH-16."""
    return read_table(s, d, "events").select("event_id", V.residue_sign(F.col("event_id") % 31000, 30000).alias("state"))


@query(f"select event_id, round(value, 6) as value, cast(({_hash('event_id', 52)}) % 32767 as double) as share1, cast(({_hash('event_id', 53)}) % 32767 as double) as share2 from events")
def additive_shares(s, d):
    """LA-22/23/24: shares that sum to the value."""
    e = read_table(s, d, "events").select("event_id", V.split_shares(F.col("value"), F.col("event_id"), 3).alias("s"))
    return e.select("event_id", r(V.join_shares(F.col("s"))).alias("value"), F.get("s", F.lit(1)).alias("share1"), F.get("s", F.lit(2)).alias("share2"))


@query("with a as (select l_returnflag, l_linestatus, sum(l_quantity) as v from lineitem group by 1, 2), b as (select l_linestatus, l_linenumber, sum(l_quantity) as v from lineitem group by 1, 2) select l_returnflag, l_linenumber, round(sum(a.v * b.v), 2) as v from a join b using (l_linestatus) group by 1, 2")
def matrix_product(s, d):
    """LA-14/18: a product of small coordinate matrices, by a join."""
    li = read_table(s, d, "lineitem")
    a = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("a"))
    b = li.groupBy("l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("b"))
    return a.join(b, "l_linestatus").groupBy("l_returnflag", "l_linenumber").agg(r(F.sum(F.col("a") * F.col("b")), 2).alias("v"))


#: Parts by suppliers, and suppliers by ship months; inner index 0 holds all first lines.
SPARSE = """a as (select l_partkey as i, case when l_linenumber = 1 then 0 else l_suppkey + 1 end as j, sum(l_quantity) as v from lineitem group by 1, 2),
b as (select case when l_linenumber = 1 then 0 else l_suppkey + 1 end as i, month(l_shipdate) + 12 * (l_partkey % 40) as j, sum(l_quantity) as v from lineitem group by 1, 2)"""


def sparse_matrices(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = read_table(s, d, "lineitem").withColumn("k", F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_suppkey") + 1))
    a = li.select(F.col("l_partkey").alias("i"), F.col("k").alias("j"), F.col("l_quantity").alias("v"))
    return a, li.select(F.col("k").alias("i"), (F.month("l_shipdate") + 12 * (F.col("l_partkey") % 40)).alias("j"), F.col("l_quantity").alias("v"))


@query(f"with {SPARSE} select a.i::bigint as i, b.j::bigint as j, round(sum(a.v * b.v), 2) as v from a join b on a.j = b.i group by 1, 2")
def tile_product(s, d):
    """LA-14/18: a product of sparse matrices by blocks of the result; a third of the entries share an inner index."""
    return matrix.product(*sparse_matrices(s, d)).select("i", "j", r("v", 2).alias("v"))


@query(f"with {SPARSE}, x as (select * from a where j % 2 = 0), y as (select i, j, 2 * v as v from a where j % 3 = 0) select coalesce(x.i, y.i)::bigint as i, coalesce(x.j, y.j)::bigint as j, round(coalesce(x.v, 0) + coalesce(y.v, 0), 2) as total, round(x.v * y.v, 2) as product from x full join y on x.i = y.i and x.j = y.j")
def elementwise_algebra(s, d):
    """LA-13/15: sum and product of two sparse matrices, entry by entry."""
    a, _ = sparse_matrices(s, d)
    both = matrix.beside(a.where("j % 2 = 0"), matrix.scale(a.where("j % 3 = 0"), 2.0))
    return both.select("i", "j", r(F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0)), 2).alias("total"), r(F.col("x") * F.col("y"), 2).alias("product"))


_PRODUCTS = """e as (select vec_id, label::double as y, (label + 1)::double as w, unnest(list_append(embedding::double[], label::double)) as v, unnest(range(65)) as i from embeddings),
m as (select i, sum(w * v) / sum(w) as m from e group by i), z as (select vec_id, e.i, w, v - m as d from e join m using (i)),
p as materialized (select a.i, b.i as j, sum(a.w * a.d * b.d) as s from z a join z b on a.vec_id = b.vec_id group by 1, 2)"""


@query(f"with {_PRODUCTS} select p.i::int as feature_i, p.j::int as feature_j, round(p.s / sqrt(x.s * y.s), 6) as corr from p join p x on x.i = p.i and x.j = p.i join p y on y.i = p.j and y.j = p.j where p.i < p.j and p.j < 64")
def embedding_correlations(s, d):
    """AGG-7/9, PRE-5: weighted correlations of all pairs of 64 features, from one pass."""
    return moments.correlation_table(read_table(s, d, "embeddings"), "embedding", F.col("label") + 1).select("feature_i", "feature_j", r("corr").alias("corr"))


@query(f"""with recursive {_PRODUCTS}, g as (select 0 as k, i, j, s as v from p where i < 64 union all
 select k + 1, i, j, case when i = k then v / piv else v - beside * above / piv end from (select k, i, j, v, max(case when i = k and j = k then v end) over () as piv,
 max(case when j = k then v end) over (partition by i) as beside, max(case when i = k then v end) over (partition by j) as above from g where k < 64)),
b as (select i, v from g where k = 64 and j = 64)
select (i + 1)::int as global_idx, round(v, 5) as w from b union all select 0::int, round((select m from m where i = 64) - (select sum(v * m) from b join m using (i)), 5)""")
def embedding_least_squares(s, d):
    """TRN-7/54, LIM-12: exact weighted least squares over 64 features; the SQL eliminates column by column."""
    e = read_table(s, d, "embeddings").select(F.col("embedding").alias("x"), F.col("label").cast("double").alias("y"), (F.col("label") + 1).alias("w"))
    return linear.least_squares(e, 64, "w").table(s).select("global_idx", r("w", 5).alias("w"))


@query("select vec_id, round(embedding[1]::double, 6) as a, round(embedding[9]::double, 6) as b, round(0.5 * embedding[1]::double - embedding[2]::double + 0.25, 6) as z, 8 as width from embeddings")
def reshape_and_affine(s, d):
    """MTH-10, LA-17, LA-27: rows of eight, transposed, and an affine layer."""
    e = read_table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    m = V.transpose(V.reshape(F.col("v"), 8))
    z = V.affine(F.slice("v", 1, 2), [[0.5, -1.0]], [0.25])
    return e.select("vec_id", m.alias("m"), z.alias("z")).select("vec_id", r(F.get(F.get("m", F.lit(0)), F.lit(0))).alias("a"), r(F.get(F.get("m", F.lit(0)), F.lit(1))).alias("b"), r(F.get("z", F.lit(0))).alias("z"), F.size("m").alias("width"))


# preprocessing ------------------------------------------------------------------------------------------


@query("select event_id, round((value - lo + 0.5) / (hi - lo + 0.5), 6) as scaled, round((value - mean) / dev, 6) as z from events, (select min(value) as lo, max(value) as hi, avg(value) as mean, stddev_pop(value) as dev from events)")
def scaling(s, d):
    """PRE-1/2/15: min-max with a smoother, and population z-scores."""
    long = read_table(s, d, "events").select(F.col("event_id").alias("row_id"), F.lit(0).alias("feature"), F.col("value").alias("v"))
    a, b = stats.min_max(long, 0.5).select("row_id", F.col("v").alias("a")), stats.standardize(long).select("row_id", F.col("v").alias("b"))
    return a.join(b, "row_id").select(F.col("row_id").alias("event_id"), r("a").alias("scaled"), r("b").alias("z"))


@query("select c_custkey, dense_rank() over (order by c_mktsegment) - 1 as code from customer")
def label_codes(s, d):
    """PRE-14: labels numbered in their order."""
    return stats.label_encode(read_table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", F.col("c_mktsegment_code").alias("code"))


@query("select label, count(*) as n, sum(case when label = 3 then 1.0 else 0.0 end)::double as three, sum(label * label)::double as squares from embeddings group by label")
def label_helpers(s, d):
    """PRE-11/13: one-hot labels and label moments."""
    e = read_table(s, d, "embeddings").select("label", V.one_hot(F.col("label"), 10).alias("o"), V.label_moments(F.col("label").cast("double")).alias("m"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.get("o", F.lit(3))).alias("three"), F.sum(F.get("m", F.lit(1))).alias("squares"))


# training -------------------------------------------------------------------------------------------------


def _steps(source: str, features: int, kind: str, steps: int, rate: float, penalty: float = 0.0, weight: str = "1.0", label: str = "y", l1: float = 0.0) -> str:
    """Unrolled gradient steps in SQL: one CTE a step."""
    names = [f"w{j}" for j in range(features + 1)]
    inputs = ["1.0"] + [f"x{j}" for j in range(features)]
    extra = lambda w: f"{l1} * sign({w})" if l1 else f"{2 * penalty} * {w}"
    ctes = ["s0 as (select " + ", ".join(f"0.0::double as {w}" for w in names) + ")"]
    for t in range(steps):
        z = " + ".join(f"{w} * {i}" for w, i in zip(names, inputs, strict=True))
        p = f"1 / (1 + exp(-({z})))" if kind == "logistic" else z
        c = 1.0 if kind == "logistic" else 2.0
        sums = ", ".join(f"any_value({w}) - {rate} * ({c} * sum({weight} * (({p}) - {label}) * {i}) / count(*) + {extra(f"any_value({w})")}) as {w}" for w, i in zip(names, inputs, strict=True))
        ctes.append(f"s{t + 1} as (select {sums} from {source}, s{t})")
    return ", ".join(ctes)


@query(f"with {BASKETS}, {_steps('bk', 3, 'logistic', 4, 0.5, 0.01)} select " + " union all select ".join(f"{j}::int as global_idx, round(w{j}, 6) as w from s4" for j in range(4)))
def logistic_regression(s, d):
    """TRN-1..6: four full steps with an L2 penalty."""
    return linear.fit(baskets(s, d), "logistic", 3, 4, 0.5, "l2", 0.01).table(s).select("global_idx", r("w").alias("w"))


@query(f"with {BASKETS}, {_steps('bk', 3, 'linear', 4, 0.1, label='amount')} select " + " union all select ".join(f"{j}::int as global_idx, round(w{j}, 6) as w from s4" for j in range(4)))
def linear_regression(s, d):
    """TRN-7/8/10."""
    b = baskets(s, d).withColumn("y", F.col("amount"))
    return linear.fit(b, "linear", 3, 4, 0.1).table(s).select("global_idx", r("w").alias("w"))


@query(f"with {BASKETS}, {_steps('bk', 3, 'logistic', 4, 0.5, label='y', l1=0.02)} " + " union all ".join(f"select {j}::int as global_idx, round(w{j}, 6) as w from s4" for j in range(4)))
def logistic_l1(s, d):
    """TRN-3, UDF-8: four full steps with an L1 penalty."""
    return linear.fit(baskets(s, d), "logistic", 3, 4, 0.5, "l1", 0.02).table(s).select("global_idx", r("w").alias("w"))


@query(f"with {BASKETS}, {_steps('bk', 3, 'linear', 4, 0.1, label='amount', l1=0.02)} " + " union all ".join(f"select {j}::int as global_idx, round(w{j}, 6) as w from s4" for j in range(4)))
def linear_l1(s, d):
    """TRN-10, UDF-9: the same for squared loss."""
    return linear.fit(baskets(s, d).withColumn("y", F.col("amount")), "linear", 3, 4, 0.1, "l1", 0.02).table(s).select("global_idx", r("w").alias("w"))


@query(f"with {BASKETS}, {_steps('bk', 3, 'linear', 3, 0.05, weight='x1', label='amount')} select " + " union all select ".join(f"{j}::int as global_idx, round(w{j}, 6) as w from s3" for j in range(4)))
def weighted_linear_regression(s, d):
    """TRN-9/11/12: sample weights."""
    b = baskets(s, d).withColumns({"y": F.col("amount"), "w": F.get("x", F.lit(1))})
    return linear.fit(b, "linear", 3, 3, 0.05, weight="w").table(s).select("global_idx", r("w").alias("w"))


def _batch_steps(steps: int, rate: float, size: int) -> str:
    """Unrolled logistic steps on bk (three features), each on a batch of its own hash order."""
    names, inputs = [f"w{j}" for j in range(4)], ["1.0", "x0", "x1", "x2"]
    z = " + ".join(f"{w} * {i}" for w, i in zip(names, inputs, strict=True))
    ctes = ["s0 as (select " + ", ".join(f"0.0::double as {w}" for w in names) + ")"]
    for t in range(steps):
        batch = f"(select * from bk qualify row_number() over (order by {_hash('row_id', 51 + 7919 * (t + 1))}, row_id) <= {size})"
        sums = ", ".join(f"any_value({w}) - {rate} * (sum((1 / (1 + exp(-({z}))) - y) * {i}) / count(*)) as {w}" for w, i in zip(names, inputs, strict=True))
        ctes.append(f"s{t + 1} as materialized (select {sums} from {batch}, s{t})")
    return ", ".join(ctes)


@query(f"with {BASKETS.replace('bk as', 'bk as materialized')}, {_batch_steps(20, 0.5, 256)} " + " union all ".join(f"select {j}::int as global_idx, round(w{j}, 6) as w from s20" for j in range(4)))
def stochastic_logistic(s, d):
    """TRN-1/53, PRJ-3: twenty steps on batches of 256, all planned by the same few counts."""
    return linear.fit(baskets(s, d), "logistic", 3, 20, 0.5, batch=256).table(s).select("global_idx", r("w").alias("w"))


@query(f"with {BASKETS} select round(regr_slope(amount, x0), 5) as slope, round(regr_intercept(amount, x0), 5) as intercept from bk")
def least_squares(s, d):
    """TRN-7/54: one pass over products, solved on the driver."""
    b = baskets(s, d).select("row_id", F.slice("x", 1, 1).alias("x"), F.col("amount").alias("y"))
    w = linear.least_squares(b, 1).weights
    return s.createDataFrame([(w[1], w[0])], "slope double, intercept double").select(r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"))


@query(f"with {BASKETS}, {_steps('bk', 3, 'logistic', 3, 0.5)}, p as (select row_id, y, 1 / (1 + exp(-(w0 + w1 * x0 + w2 * x1 + w3 * x2))) as p from bk, s3) select row_id, round(p, 5) as p1, round(1 - p, 5) as p0, round(p - y, 5) as residual from p")
def logistic_scores(s, d):
    """PRD-1..4/20, TRN-14."""
    b = baskets(s, d)
    model = linear.fit(b, "logistic", 3, 3, 0.5)
    p = b.select("row_id", "y", model.probabilities().alias("p"))
    return p.select("row_id", r(F.get("p", F.lit(1)), 5).alias("p1"), r(F.get("p", F.lit(0)), 5).alias("p0"), r(F.get("p", F.lit(1)) - F.col("y"), 5).alias("residual"))


@query(f"with {ALIGNED}, tr as (select *, row_number() over (order by {_hash('row_id')}, row_id) <= floor(0.8 * count(*) over ()) as is_train from al), tt as (select * from tr where is_train), {_steps('tt', 4, 'logistic', 5, 0.5)}, p as (select y, case when 1 / (1 + exp(-(w0 + w1 * x0 + w2 * x1 + w3 * x2 + w4 * x3))) >= 0.5 then 1.0 else 0.0 end as p from tr, s5 where not is_train), c as (select count(*) filter (where p = 1 and y = 1) as tp, count(*) filter (where p = 1 and y = 0) as fp, count(*) filter (where p = 0 and y = 1) as fn, count(*) filter (where p = 0 and y = 0) as tn from p) select tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 6) as accuracy from c")
def flagship_order_value(s, d):
    """Align two parties, split, train logistic regression, and evaluate on the held-out rows."""
    rows = order.split_train_test(materialize(aligned(s, d), "aligned"), "row_id")
    model = linear.fit(rows.where("is_train"), "logistic", 4, 5, 0.5)
    scored = rows.where("not is_train").withColumn("prediction", model.label())
    return metrics.classification_report(scored).select("tp", "fp", "fn", "tn", r("accuracy").alias("accuracy"))


def _candidates(bins: int = 8) -> str:
    """q (f, t): the quantile candidates of every feature of bk."""
    return (
        "k as (select unnest([0, 1, 2]) as f, unnest([x0, x1, x2]) as v from bk), dn as (select f, list_sort(list(v)) as o, count(distinct v) as d, count(*) as n from k group by f), "
        f"q as materialized (select distinct f, (o[least((j + 1) * (n // {bins}), n - 1) + 1] + o[least((j + 1) * (n // {bins}) + 1, n - 1) + 1]) / 2 as t from dn, range({bins - 1}) g(j) where d >= {bins} "
        f"union select k.f, k.v from k join dn using (f) where dn.d < {bins} and k.v < dn.o[dn.n])"
    )


def _tree(p: str, source: str, value: str, kind: str, depth: int, used: str = "true", weight: str = "1") -> str:
    """CTEs of a tree that grows on the rows of ``source`` (row_id, x0..x2, value) where ``used`` holds.

    {p}nodes (node, depth, n, s, q, f, t, gain) are its nodes; {p}leaf are all rows with their leaf's node and mean.
    """
    whole = lambda n, s, q: f"({n} - ({s} * {s} + ({n} - {s}) * ({n} - {s})) / {n})" if kind == "gini" else f"({q} - {s} * {s} / {n})"
    right = whole("(t.n - l.n)", "(t.s - l.s)", "(t.q - l.q)")
    sums = f"sum({weight})::double as n, sum({weight} * {value})::double as s, sum({weight} * {value} * {value})::double as q, count(*) as c"
    also = "" if weight == "1" else f"{weight}, "
    out = [f"{p}a0 as materialized (select *, 0 as node from {source})"]
    for d in range(depth + 1):
        out.append(f"{p}t{d} as materialized (select node, {sums} from {p}a{d} where {used} group by node)")
        if d == depth:
            out.append(f"{p}b{d} as (select 0 as node, 0 as f, 0.0::double as t, 0.0::double as gain where false)")
            break
        each = f"(select node, {also}{value}, unnest([0, 1, 2]) as f, unnest([x0, x1, x2]) as x from {p}a{d} where {used})"
        out += [
            f"{p}l{d} as (select z.node, c.f, c.t, {sums} from {each} z join q c on z.f = c.f and z.x <= c.t group by z.node, c.f, c.t)",
            f"{p}g{d} as (select l.node, l.f, l.t, round(({whole('t.n', 't.s', 't.q')} - {whole('l.n', 'l.s', 'l.q')} - {right}) / t.n, 9) as gain from {p}l{d} l join {p}t{d} t on t.node = l.node where l.c < t.c)",
            f"{p}b{d} as materialized (select node, f, t, gain from {p}g{d} where gain > 0 qualify row_number() over (partition by node order by gain desc, f, t) = 1)",
            f"{p}a{d + 1} as materialized (select a.* exclude (node), 2 * a.node + case when (case b.f when 0 then a.x0 when 1 then a.x1 else a.x2 end) <= b.t then 1 else 2 end as node from {p}a{d} a join {p}b{d} b on a.node = b.node)",
        ]
    levels = range(depth + 1)
    out.append(f"{p}nodes as (" + " union all ".join(f"select t.*, {d} as depth, b.f, b.t, b.gain from {p}t{d} t left join {p}b{d} b on t.node = b.node" for d in levels) + ")")
    out.append(f"{p}leaf as materialized (" + " union all ".join(f"select a.*, t.s / t.n as mean from {p}a{d} a join {p}t{d} t on a.node = t.node where a.node not in (select node from {p}b{d})" for d in levels) + ")")
    return ", ".join(out)


def _boost(label: str, classes: int, rounds: int, rate: float, depth: int) -> str:
    """CTEs of gradient boosting on bk; ``fin`` (row_id, y, raw0, ...) has the raw outputs. Squared loss if ``classes`` is 0, Poisson if it is -1."""
    outputs = range(classes if classes > 2 else 1)
    clip = lambda v: f"least(greatest({v}, 1e-3), 1 - 1e-3)"
    is_class = lambda k: f"(y = {k})::int::double" if classes > 2 else "y"
    share = lambda k: f"avg({is_class(k)}) over ()"
    prior = {-1: lambda k: f"ln({share(k)})", 0: lambda k: share(k), 2: lambda k: f"ln({clip(share(k))} / (1 - {clip(share(k))}))"}.get(classes, lambda k: f"ln({clip(share(k))})")
    total = " + ".join(f"exp(raw{k})" for k in outputs)
    fitted = {-1: lambda k: f"exp(raw{k})", 0: lambda k: f"raw{k}", 2: lambda k: f"1 / (1 + exp(-raw{k}))"}.get(classes, lambda k: f"exp(raw{k}) / ({total})")
    out = [f"m0 as materialized (select *, {', '.join(f'{prior(k)} as raw{k}' for k in outputs)} from (select row_id, x0, x1, x2, {label} as y from bk))"]
    for i in range(rounds):
        out.append(f"e{i} as materialized (select *, {', '.join(f'{is_class(k)} - {fitted(k)} as r{k}' for k in outputs)} from m{i})")
        for k in outputs:
            p = f"s{i}_{k}_"
            newton = f"coalesce(sum(r{k}) over n / nullif(sum(({is_class(k)} - r{k}) * (1 - {is_class(k)} + r{k})) over n, 0), 0) * {1.0 if classes == 2 else (classes - 1) / max(classes, 1)}"
            if classes < 0:
                newton = f"coalesce(sum(r{k}) over n / nullif(sum(exp(raw{k})) over n, 0), 0)"
            out += [_tree(p, f"e{i}", f"r{k}", "variance", depth), f"{p}v as materialized (select row_id, {newton if classes else 'mean'} as v from {p}leaf window n as (partition by node))"]
        joins = " ".join(f"join s{i}_{k}_v v{k} on v{k}.row_id = e.row_id" for k in outputs)
        out.append(f"m{i + 1} as materialized (select e.row_id, x0, x1, x2, y, {', '.join(f'raw{k} + {rate} * v{k}.v as raw{k}' for k in outputs)} from e{i} e {joins})")
    return ", ".join([*out, f"fin as (select * from m{rounds})"])


def _forest(trees: int, rate: float, depth: int) -> str:
    """CTEs of a forest's votes on bk: ru (y, p)."""
    flags = ", ".join(f"row_number() over (order by {_hash('row_id', 51 + 104729 * (t + 1))}, row_id) <= floor({rate}::double * count(*) over ()) as u{t}" for t in range(trees))
    grown = ", ".join(_tree(f"t{t}_", "sb", "y", "gini", depth, f"u{t}") for t in range(trees))
    votes = " union all ".join(f"select row_id, y, (mean > 0.5)::int as v from t{t}_leaf" for t in range(trees))
    return f"sb as materialized (select *, {flags} from bk), {grown}, ru as (select y, (2 * sum(v) > {trees})::int as p from ({votes}) group by row_id, y)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _stump(value: str, kind: str) -> str:
    """Best first split over quantile candidates, in SQL."""
    cand = _candidates()
    w = "n - (s * s + (n - s) * (n - s)) / n" if kind == "gini" else "q - s * s / n"
    f = lambda p: w.replace("n", f"{p}n").replace("s", f"{p}s").replace("q", f"{p}q")
    return f"""with {BASKETS}, {cand},
l as (select q.f, q.t, count(*)::double as an, sum({value}) as "as", sum({value} * {value}) as aq from q join (select unnest([0, 1, 2]) as f, unnest([x0, x1, x2]) as v, unnest([{value}, {value}, {value}]) as {value} from bk) z on z.f = q.f and z.v <= q.t group by q.f, q.t),
a as (select count(*)::double as tn, sum({value}) as ts, sum({value} * {value}) as tq from bk),
g as (select f, t, ({f('t')} - ({f('a').replace('as', '"as"')}) - ({f('(t').replace('(tn', '(tn - an)').replace('(ts', '(ts - "as")').replace('(tq', '(tq - aq)')})) / tn as gain from l, a where an < tn)
select f::int as feature, round(t, 6) as threshold, round(gain, 6) as gain from g order by round(gain, 9) desc, f, t limit 1"""


@query(_stump("y", "gini"))
def best_split_gini(s, d):
    """TRN-18, AGG-3/24/30: the root's best split for classes."""
    root = tree.grow(baskets(s, d), 2, 1, 8).nodes[0, 0]
    return s.createDataFrame([(root.feature, root.threshold, root.gain)], "feature int, threshold double, gain double").select("feature", r("threshold").alias("threshold"), r("gain").alias("gain"))


@query(_stump("amount", "variance"))
def best_split_variance(s, d):
    """TRN-15/18: the root's best split for values."""
    root = tree.grow(baskets(s, d).withColumn("y", F.col("amount")), 0, 1, 8).nodes[0, 0]
    return s.createDataFrame([(root.feature, root.threshold, root.gain)], "feature int, threshold double, gain double").select("feature", r("threshold").alias("threshold"), r("gain").alias("gain"))


@query(f"with {BASKETS}, {_candidates()}, {_tree('d_', 'bk', 'y', 'gini', 3)} select 0 as tree_id, node::bigint as node_id, depth, f is null as is_leaf, coalesce(f, -1)::int as feature, round(coalesce(t, 0), 6) as threshold, case when s > n - s then 1.0::double else 0.0::double end as label, round(1 - (s * s + (n - s) * (n - s)) / (n * n), 6) as impurity, n::bigint as n, round(coalesce(gain, 0), 6) as gain from d_nodes")
def decision_tree(s, d):
    """TRN-15/17/20, PRD-6..8, MET-4: the node table of a tree of depth three; a leaf has feature -1 and threshold 0."""
    return _rounded(tree.grow(baskets(s, d), 2, 3, 8).table(s).fillna({"feature": -1, "threshold": 0.0}))


@query(f"with {BASKETS}, {_candidates()}, {_tree('d_', 'bk', 'y', 'gini', 3)} select f::int as feature, round(sum(n * gain) / sum(sum(n * gain)) over (), 6) as importance from d_nodes where f is not null group by f")
def tree_importance(s, d):
    """AGG-29."""
    return _rounded(tree.grow(baskets(s, d), 2, 3, 8).importance(s))


@query(f"with {BASKETS}, {_candidates()}, {_forest(5, 0.7, 3)}, {CELLS}")
def random_forest(s, d):
    """TRN-23/48, PRD-9, MET-5: a forest's report."""
    b = baskets(s, d)
    model = tree.forest(b, 5, 0.7, classes=2, max_depth=3)
    return _rounded(metrics.classification_report(b.withColumn("prediction", model.predict())))


@query(f"with {BASKETS}, {_candidates()}, {_boost('amount', 0, 3, 0.3, 3)}, ru as (select y as amount, raw0 as guess from fin) {ERRORS}")
def gbdt_regression(s, d):
    """TRN-25/28/29/33, PRD-10."""
    b = baskets(s, d).withColumn("y", F.col("amount"))
    return _rounded(metrics.regression_report(b.withColumn("prediction", tree.boost(b, "ls", rounds=3, rate=0.3).predict())), 5)


@query(f"with {BASKETS}, {_candidates()}, {_boost('y', 2, 2, 0.3, 3)}, ru as (select y, (1 / (1 + exp(-raw0)) > 0.5)::int as p from fin), {CELLS}")
def gbdt_binary(s, d):
    """TRN-26/30/32/34, MET-6."""
    b = baskets(s, d)
    return _rounded(metrics.classification_report(b.withColumn("prediction", tree.boost(b, "deviance", 2, rounds=2, rate=0.3).predict())))


@query(f"with {BASKETS}, {_candidates()}, {_boost('least(floor(amount / 1.2), 2.0)', 3, 2, 0.3, 2)} select round(avg((list_position([raw0, raw1, raw2], greatest(raw0, raw1, raw2)) - 1 = y)::int), 6) as accuracy from fin")
def gbdt_multiclass(s, d):
    """TRN-26/31, PRD-11: three classes of revenue."""
    b = baskets(s, d).withColumn("y", F.least(F.floor(F.col("amount") / 1.2), F.lit(2)).cast("double"))
    return _rounded(metrics.accuracy(b.withColumn("prediction", tree.boost(b, "deviance", 3, rounds=2, rate=0.3, max_depth=2).predict())))


@query(f"with {BASKETS}, {_candidates()}, {_forest(5, 0.7, 3).replace('select y, (2 * sum(v) > 5)::int as p', 'select row_id, y, sum(v) / 5.0::double as p')} select row_id, round(p, 6) as p1, round(1 - p, 6) as p0 from ru")
def forest_probabilities(s, d):
    """PRD-9, AGG-20: each row's share of a forest's votes, from trees as arrays."""
    b = baskets(s, d)
    p = b.select("row_id", tree.forest(b, 5, 0.7, classes=2, max_depth=3).probabilities().alias("p"))
    return p.select("row_id", r(F.get("p", F.lit(1))).alias("p1"), r(F.get("p", F.lit(0))).alias("p0"))


@query(f"with {BASKETS}, {_candidates()}, {_boost('x1 * 4', -1, 3, 0.5, 2)} select row_id, round(exp(raw0), 5) as rate from fin")
def boosted_counts(s, d):
    """UDF-1/3/4: a loss from the registry that is neither squared nor a deviance: Poisson rates of the lines of an order."""
    b = baskets(s, d).withColumn("y", F.get("x", F.lit(1)) * 4)
    return b.select("row_id", r(tree.boost(b, "poisson", rounds=3, rate=0.5, max_depth=2).predict(), 5).alias("rate"))


@query(f"with {BASKETS}, {_candidates()}, {_tree('d_', 'bk', 'y', 'gini', 2)} select node::bigint as node_id, repeat('  ', depth) || (case when f is null then 'leaf ' || format('{{:.6f}}', (s > n - s)::int::double) else 'x[' || f || '] <= ' || format('{{:.6f}}', t) end) || ' (n ' || c || ', impurity ' || format('{{:.6f}}', 1 - (s * s + (n - s) * (n - s)) / (n * n)) || ')' as text from d_nodes")
def tree_display(s, d):
    """MET-14: a tree as lines of text."""
    return tree.grow(baskets(s, d), 2, 2, 8).display(s).select("node_id", "text")


@query(f"with {BASKETS}, {_candidates()}, {_boost('least(floor(amount / 1.2), 2.0)', 3, 2, 0.3, 2)} select row_id, round(raw0, 5) as raw0, round(raw1, 5) as raw1, round(raw2, 5) as raw2, round(exp(raw0) / (exp(raw0) + exp(raw1) + exp(raw2)), 5) as p0 from fin")
def boosted_scores(s, d):
    """PRD-10/11: each row's raw outputs and share of the first class under a boosted model."""
    b = baskets(s, d).withColumn("y", F.least(F.floor(F.col("amount") / 1.2), F.lit(2)).cast("double"))
    model = tree.boost(b, "deviance", 3, rounds=2, rate=0.3, max_depth=2)
    out = b.select("row_id", model.raw().alias("raw"), model.probabilities().alias("p"))
    return out.select("row_id", *[r(F.get("raw", F.lit(k)), 5).alias(f"raw{k}") for k in range(3)], r(F.get("p", F.lit(0)), 5).alias("p0"))


@query(f"with {BASKETS}, {_candidates()}, {_forest(5, 0.7, 3)}, {_tree('d_', 'bk', 'y', 'gini', 3)} select (select round(avg((y = p)::int), 6) from ru) as forest, (select round(avg((y = (mean > 0.5)::int)::int), 6) from d_leaf) as tree")
def tree_accuracies(s, d):
    """MET-4/5: accuracy of a tree by equality, and of a forest within a tolerance."""
    b = baskets(s, d)
    one = metrics.accuracy(b.withColumn("prediction", tree.grow(b, 2, 3, 8).predict())).first()[0]
    return metrics.accuracy(b.withColumn("prediction", tree.forest(b, 5, 0.7, classes=2, max_depth=3).predict()), tolerance=True).select(r("accuracy").alias("forest"), r(F.lit(one)).alias("tree"))


_NET = mlp.Mlp.initial([3, 2, 1], ["logistic", "logistic"])


def _mlp_steps(steps: int, rate: float, alpha: float) -> str:
    """Unrolled full steps of a 3-2-1 perceptron on bk."""
    (w1, w2), (b1, b2) = _NET.weights, _NET.biases
    start = {f"u{i}{h}": w1[i][h] for i in range(3) for h in range(2)} | {f"c{h}": b1[h] for h in range(2)} | {f"v{h}": w2[h][0] for h in range(2)} | {"k": b2[0]}
    ctes = ["n0 as (select " + ", ".join(f"{float(v)!r}::double as {name}" for name, v in start.items()) + ")"]
    for t in range(steps):
        hidden = ", ".join(f"1 / (1 + exp(-({' + '.join(f'u{i}{h} * x{i}' for i in range(3))} + c{h}))) as h{h}" for h in range(2))
        out = f"(select *, 1 / (1 + exp(-(v0 * h0 + v1 * h1 + k))) - y as e from (select *, {hidden} from bk, n{t}))"
        back = lambda h: f"e * v{h} * h{h} * (1 - h{h})"
        grads = {f"u{i}{h}": f"{back(h)} * x{i}" for i in range(3) for h in range(2)} | {f"c{h}": back(h) for h in range(2)} | {f"v{h}": f"e * h{h}" for h in range(2)} | {"k": "e"}
        decay = lambda name: f" + {alpha} * any_value({name})" if name[0] in "uv" else ""
        ctes.append(f"n{t + 1} as (select " + ", ".join(f"any_value({name}) - {rate} / count(*) * (sum({g}){decay(name)}) as {name}" for name, g in grads.items()) + f" from {out})")
    return ", ".join(ctes) + " " + " union all ".join(f"select '{name}' as name, round({name}, 6) as w from n{steps}" for name in start)


@query(f"with {BASKETS}, {_mlp_steps(3, 0.7, 0.1)}")
def mlp_steps(s, d):
    """TRN-35..42, PRD-14: three full steps of a perceptron with two hidden units, all its weights."""
    m = mlp.fit(baskets(s, d), _NET, 3, 0.7, alpha=0.1)
    (w1, w2), (b1, b2) = m.weights, m.biases
    rows = [(f"u{i}{h}", float(w1[i][h])) for i in range(3) for h in range(2)] + [(f"c{h}", float(b1[h])) for h in range(2)] + [(f"v{h}", float(w2[h][0])) for h in range(2)] + [("k", float(b2[0]))]
    return s.createDataFrame(rows, "name string, w double").select("name", r("w").alias("w"))


@query()
def mlp_classifier(s, d):
    """TRN-35..42, PRD-12..14, MET-7."""
    b = baskets(s, d)
    model = mlp.fit(b, mlp.Mlp.initial([3, 6, 1], ["relu", "logistic"]), 15, 0.5)
    return metrics.classification_report(b.withColumn("prediction", model.label()))


# explanations ---------------------------------------------------------------------------------------------


_SAMPLES, _DEVIATION = 24, 0.2


def _noise_sql(j: int) -> str:
    """explain's noise of feature j in SQL."""
    cell = f"(({_hash('row_id', 49)}) + (sample * 3 + {j}) * {explain.CELL_STEP})"
    u, v = (f"((({_hash(cell, 51 + k)}) + 1) / 4294967297.0::double)" for k in (0, 1))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def _local_sql() -> str:
    """Weighted linear surrogates of both class probabilities around every row, on the two features that correlate most."""
    cells = ", ".join(f"case when sample = 0 then x{j} else x{j} + {_DEVIATION} * {_noise_sql(j)} end as a{j}" for j in range(3))
    z = "w0 + w1 * a0 + w2 * a1 + w3 * a2"
    moments_ = [f"sum(w * d{i}) / sum(w) as m{i}, sum(w * d{i} * p) as p{i}, " + ", ".join(f"sum(w * d{i} * d{j}) as q{i}{j}" for j in range(i, 3)) for i in range(3)]
    picks = " union all ".join(f"select row_id, output, {i} as f, c{i} as c from cr" for i in range(3))
    pair = lambda name: f"case when f = 0 and g = 1 then {name}01 when f = 0 then {name}02 else {name}12 end"
    of = lambda name, f: f"case {f} when 0 then {name}0 when 1 then {name}1 else {name}2 end"
    diag = lambda f: f"case {f} when 0 then s00 when 1 then s11 else s22 end"
    return f"""with {BASKETS}, {_steps('bk', 3, 'logistic', 3, 0.5)},
sa as materialized (select row_id, x0, x1, x2, sample, {cells} from bk, range({_SAMPLES}) t(sample)),
sw as (select row_id, a0 - x0 as d0, a1 - x1 as d1, a2 - x2 as d2, sqrt(exp(-(pow(a0 - x0, 2) + pow(a1 - x1, 2) + pow(a2 - x2, 2)) / (0.5625 * 3))) as w, 1 / (1 + exp(-({z}))) as p1 from sa, s3),
so as (select *, o as output, case when o = 1 then p1 else 1 - p1 end as p from sw, range(2) t(o)),
mo as (select row_id, output, sum(w) as w, sum(w * p) / sum(w) as mp, sum(w * p * p) - sum(w * p) * sum(w * p) / sum(w) as spp, {', '.join(moments_)} from so group by 1, 2),
ce as (select row_id, output, w, mp, spp, m0, m1, m2, {', '.join(f'p{i} - w * m{i} * mp as t{i}' for i in range(3))}, {', '.join(f'q{i}{j} - w * m{i} * m{j} as s{i}{j}' for i in range(3) for j in range(i, 3))} from mo),
cr as materialized (select *, {', '.join(f'round(abs(t{i} / sqrt(s{i}{i} * spp)), 9) as c{i}' for i in range(3))} from ce),
rk as (select row_id, output, f, row_number() over (partition by row_id, output order by c desc, f) as n from ({picks})),
ch as (select row_id, output, min(f) as f, max(f) as g from rk where n <= 2 group by 1, 2),
sy as (select row_id, output, f, g, mp, {of('t', 'f')} as tf, {of('t', 'g')} as tg, {of('m', 'f')} as mf, {of('m', 'g')} as mg, {diag('f')} as a, {diag('g')} as b, {pair('s')} as c from cr join ch using (row_id, output)),
be as (select *, (tf * b - tg * c) / (a * b - c * c) as wf, (tg * a - tf * c) / (a * b - c * c) as wg from sy)
select row_id, output::int as output, f::int as feature, round(wf, 5) as importance, round(mp - wf * mf - wg * mg, 5) as intercept from be
union all select row_id, output::int, g::int, round(wg, 5), round(mp - wf * mf - wg * mg, 5) from be"""


@query(_local_sql())
def lime_explanation(s, d):
    """LIM-1..4/6/7/9..13/15: every row is explained for both classes, in one job: samples, scores, weights, selection and surrogates."""
    b = baskets(s, d)
    model = linear.fit(b, "logistic", 3, 3, 0.5)
    samples = explain.weigh_samples(explain.samples_around(b.select("row_id", "x"), [_DEVIATION] * 3, _SAMPLES), features=3)
    out = explain.local_surrogates(samples.withColumn("y", model.probabilities()), 3, 2, 2, together=True)
    return out.select("row_id", "output", "feature", r("importance", 5).alias("importance"), r("intercept", 5).alias("intercept"))


@query(_local_sql().split("sw as (select")[0].rstrip(",\n ") + " select row_id, sample::int as sample, round(a0, 6) as x0, round(a1, 6) as x1, round(a2, 6) as x2, round(1 - 1 / (1 + exp(-(w0 + w1 * a0 + w2 * a1 + w3 * a2))), 6) as y0, round(1 / (1 + exp(-(w0 + w1 * a0 + w2 * a1 + w3 * a2))), 6) as y1 from sa, s3")
def sample_dump(s, d):
    """LIM-16: all samples with the model's outputs, side by side."""
    b = baskets(s, d)
    model = linear.fit(b, "logistic", 3, 3, 0.5)
    samples = explain.samples_around(b.select("row_id", "x"), [_DEVIATION] * 3, _SAMPLES).withColumn("y", model.probabilities())
    return _rounded(explain.flat_samples(samples, 3, 2))


def _shap_sql(background: int) -> str:
    """Shapley values of three features by all subsets, against the first rows in hash order."""
    pick = lambda m, j: f"x.x{j}" if m >> j & 1 else f"b.x{j}"
    v = [f"avg(1 / (1 + exp(-(w0 + w1 * {pick(m, 0)} + w2 * {pick(m, 1)} + w3 * {pick(m, 2)})))) as v{m}" for m in range(8)]
    value = lambda j: " + ".join(f"(v{m | 1 << j} - v{m}) * {1 / 3 if bin(m).count('1') in (0, 2) else 1 / 6}" for m in range(8) if not m >> j & 1)
    return f"""with {BASKETS}, {_steps('bk', 3, 'logistic', 3, 0.5)}, bg as materialized (select * from bk qualify row_number() over (order by {_hash('row_id')}, row_id) <= {background}),
v as (select x.row_id, {', '.join(v)} from bk x, bg b, s3 group by x.row_id)
select row_id, round(v0, 6) as base, round(v7, 6) as prediction, {', '.join(f'round({value(j)}, 6) as value{j}' for j in range(3))} from v"""


@query(_shap_sql(8))
def shap_values(s, d):
    """LIM-1/8, MTH-9, UDF-6: KernelSHAP values of every row against background rows of the table."""
    b = baskets(s, d)
    model = linear.fit(b, "logistic", 3, 3, 0.5)
    background = [row["x"] for row in b.where(order.first_in_hash_order(b, "row_id", 8)).select("x").collect()]
    out = explain.shap_values(b.select("row_id", "x"), background, lambda x: F.array(model.predict(x)), 3)
    return out.select("row_id", r("base").alias("base"), r("prediction").alias("prediction"), *[r(F.get("values", F.lit(j))).alias(f"value{j}") for j in range(3)])


@query("with z as (select o_orderkey as row_id, (o_totalprice > 250000)::int + (month(o_orderdate) > 6)::int + (o_orderstatus = 'F')::int + (substr(o_orderpriority, 1, 1) = '1')::int as z from orders) select row_id, round(case when z in (0, 4) then 1e-6 else 3 / ((factorial(4) / (factorial(z) * factorial(4 - z))) * z * (4 - z))::double end, 9) as w from z")
def shap_weights(s, d):
    """LIM-8: rows of four flags as coalitions, with their kernel weights."""
    flags = [F.col("o_totalprice") > 250000, F.month("o_orderdate") > 6, F.col("o_orderstatus") == "F", F.substring("o_orderpriority", 1, 1) == "1"]
    z = read_table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(*[f.cast("int") for f in flags]).alias("z"))
    return explain.coalition_weights(z, 4).select("row_id", r("w", 9).alias("w"))


@query(f"with {BASKETS} select row_id, round(sqrt(exp(-(pow(x0 - 0.4, 2) + pow(x1 - 0.5, 2) + pow(x2 - 0.5, 2)) / pow(0.75 * sqrt(3), 2))), 6) as w from bk")
def distance_weights(s, d):
    """LIM-6/7: exponential kernel weights of all rows."""
    return explain.distance_weights(baskets(s, d), [0.4, 0.5, 0.5]).select("row_id", r("w").alias("w"))


@query(f"with {BASKETS}, bw as (select row_id, x0, x1, x2, amount, sqrt(exp(-(pow(x0 - 0.4, 2) + pow(x1 - 0.5, 2) + pow(x2 - 0.5, 2)) / pow(0.75 * sqrt(3), 2))) as w from bk), {_candidates()}, {_tree('d_', 'bw', 'amount', 'variance', 3, weight='w')}, im as (select f, sum(c * gain) as g from d_nodes where f is not null group by f) select t.f::int as feature, round(coalesce(g / sum(g) over (), 0), 6) as importance from range(3) t(f) left join im on im.f = t.f")
def tree_surrogate(s, d):
    """LIM-12/14: importance of a weighted regression tree."""
    row = [0.4, 0.5, 0.5]
    samples = explain.distance_weights(baskets(s, d), row).select("row_id", "x", "w", F.col("amount").alias("y"))
    return _rounded(explain.explain(samples, [0, 1, 2], "tree"))


@query(_local_sql())
def explanation_job(s, d):
    """API-1/4, TRN-49, LIM-4/9/11/15: selection, training, sampling, prediction, weighting, local selection and surrogates as stages of one job."""
    spec = {"name": "orders", "stages": [
        {"task": "selection", "params": {"features": 3}}, {"task": "training", "params": {"algorithm": "logistic_regression", "train_fraction": 1.0, "params": {"iterations": 3, "rate": 0.5}}},
        {"task": "sampling", "params": {"samples": _SAMPLES, "deviation": _DEVIATION}}, {"task": "prediction"}, {"task": "weighting"}, {"task": "local_selection", "params": {"features": 2}}, {"task": "surrogate"},
    ]}
    out = stages.run(spec, materialize(baskets(s, d).select("row_id", "x", "y"), "rows"), scratch_path(s, "job"))
    return out.select("row_id", "output", "feature", r("importance", 5).alias("importance"), r("intercept", 5).alias("intercept"))


_VOTES = _forest(5, 0.7, 3).replace("select y, (2 * sum(v) > 5)::int as p", "select row_id, y, sum(v) / 5.0::double as p")


@query(f"with {BASKETS}, {_candidates()}, {_steps('bk', 3, 'logistic', 3, 0.5)}, {_VOTES}, {_boost('y', 2, 2, 0.3, 3)} select b.row_id, round(1 / (1 + exp(-(w0 + w1 * b.x0 + w2 * b.x1 + w3 * b.x2))), 5) as logistic, round(ru.p, 5) as forest, round(1 / (1 + exp(-fin.raw0)), 5) as boosted from bk b join ru on ru.row_id = b.row_id join fin on fin.row_id = b.row_id, s3")
def stream_inference(s, d):
    """PRD-15..18: requests for orders as a stream, answered by a logistic model, a forest and a boosted model."""
    b = baskets(s, d)
    splits = tree.candidate_lists(b, 8)
    models = {
        "logistic": linear.fit(b, "logistic", 3, 3, 0.5), "forest": tree.forest(b, 5, 0.7, splits=splits, classes=2, max_depth=3), "boosted": tree.boost(b, "deviance", 2, rounds=2, rate=0.3, splits=splits),
    }
    requests = read_table(s, d, "lineitem").select(F.col("l_orderkey").alias("row_id")).distinct()
    source, out, checkpoint = (scratch_path(s, n) for n in ("requests", "answers", "checkpoint"))
    requests.write.parquet(source)
    scored = s.readStream.schema(requests.schema).parquet(source).join(b.select("row_id", "x"), "row_id")
    answers = scored.select("row_id", *[F.get(m.probabilities(), F.lit(1)).alias(name) for name, m in models.items()])
    users.write_updates(answers, out, checkpoint).awaitTermination()
    return _rounded(s.read.parquet(out).drop("batch"), 5)


@query("select user_id, count(*) as n, round(sum(value), 4) as total, round(avg(1 / (1 + exp(-(value - 10) / 5))), 6) as score, max(ts) as last from events group by user_id")
def stream_user_scores(s, d):
    """SRC-14, PRD-15..18: every event as a stream, then all of them sent again to the restarted query; each counts once."""
    e = read_table(s, d, "events").select("event_id", "user_id", "ts", "value")
    source, out, checkpoint = (scratch_path(s, n) for n in ("events", "scores", "checkpoint"))
    for _ in range(2):
        e.write.mode("append").parquet(source)
        stream = s.readStream.schema(e.schema).parquet(source)
        users.write_updates(users.user_scores(stream, lambda v: 1 / (1 + np.exp(-(v - 10) / 5))), out, checkpoint).awaitTermination()
    return users.latest(s, out).select("user_id", "n", r("total", 4).alias("total"), r("score").alias("score"), F.col("last").cast("timestamp_ntz").alias("last"))


_PARTS = CELLS.replace("c as (select ", "c as (select part, ").replace("from ru)", "from ru group by part)").replace("select tp, fp, fn, tn", "select part, tp, fp, fn, tn")


@query(f"with {ALIGNED}, tr as (select *, row_number() over (order by {_hash('row_id')}, row_id) <= floor(0.8 * count(*) over ()) as is_train from al), tt as (select * from tr where is_train), {_steps('tt', 4, 'logistic', 3, 0.5)}, ru as (select case when is_train then 'train' else 'test' end as part, y, case when 1 / (1 + exp(-(w0 + w1 * x0 + w2 * x1 + w3 * x2 + w4 * x3))) >= 0.5 then 1.0 else 0.0 end as p from tr, s3), {_PARTS}")
def job_run(s, d):
    """API-1/2/3/9, TRN-49: a declarative specification over two parties, with a report for both halves."""
    spec = {"name": "orders", "algorithm": "logistic_regression", "params": {"iterations": 3, "rate": 0.5}}
    return _rounded(jobs.run(jobs.Job.parse(spec), [order_party(s, d), customer_party(s, d)])[1])


@query("select round(avg(pow(a.value - b.value, 2)), 4) as mse from events a join events b on b.event_id = (a.event_id + 1) % (select count(*) from events)")
def table_mse(s, d):
    """MET-11: two tables compared cell by cell."""
    e = read_table(s, d, "events")
    n = e.count()
    a = e.select(F.col("event_id").alias("k"), F.col("value").alias("v"))
    b = e.select(F.pmod(F.col("event_id") - 1, F.lit(n)).alias("k"), F.col("value").alias("v"))
    return metrics.table_mse(a, b, ["k"]).select(r("mse", 4).alias("mse"))
