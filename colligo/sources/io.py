"""Reading and writing party tables, fixed-point tables, models and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from colligo.functions.vectors import decode_fixed
from colligo.operators.linear import LinearModel
from colligo.operators.mlp import Mlp
from colligo.operators.order import split_train_test
from colligo.operators.tree import NODE, Boosted, Node, Trees
from colligo.sources.scratch import materialize


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_matrix(spark: SparkSession, path: str, columns: int, delimiter: str = ",", lenient: bool = False) -> DataFrame:
    """A header-less numeric file as c0, c1, ...

    A field that is no number fails the read; with ``lenient`` it is 0, as are missing fields.
    """
    names = [f"c{i}" for i in range(columns)]
    kind = StringType() if lenient else DoubleType()
    df = spark.read.csv(path, schema=StructType([StructField(n, kind) for n in names]), sep=delimiter, mode="PERMISSIVE" if lenient else "FAILFAST")
    return df.select(*[F.coalesce(F.expr(f"try_cast({n} as double)"), F.lit(0.0)).alias(n) for n in names]) if lenient else df


def number_rows(df: DataFrame) -> DataFrame:
    """``df``, straight from files, with row_id: positions from 0 in the order of file names and of rows in them.

    A split of a file is read by one task in its order.  So rows are saved with their split and
    place, splits are counted, and a split's rows start where the ones before it end.  The
    numbers do not depend on how files are cut into splits, or splits dealt to tasks.
    """
    where = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__place": F.monotonically_increasing_id()}
    rows = materialize(df.select("*", *[c.alias(n) for n, c in where.items()]), "lines")
    splits = rows.groupBy("__file", "__block").agg(F.min("__place").alias("__first"), F.count("*").alias("__n"))
    before = Window.orderBy("__f2", "__b2").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = splits.select(F.col("__file").alias("__f2"), F.col("__block").alias("__b2"), "__first", "__n").withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    found = rows.join(splits, (F.col("__file") == F.col("__f2")) & (F.col("__block") == F.col("__b2")))
    return found.select((F.col("__start") + F.col("__place") - F.col("__first")).alias("row_id"), *df.columns)


def read_csv_party(spark: SparkSession, path: str, columns: int, has_label: bool, delimiter: str = ",", lenient: bool = False) -> DataFrame:
    """(row_id, x, y) of a header-less file or folder whose rows have no key: a row is known by its position."""
    return party_table(number_rows(read_csv_matrix(spark, path, columns, delimiter, lenient)), "row_id", has_label)


def write_csv_in_order(df: DataFrame, path: str, *order: str, digits: int | None = 6) -> None:
    """Files without header or key, whose rows are in a total order: ``order`` columns are left out."""
    rows = df.sort(*order)
    write_csv(rows.drop(*order), path, digits=digits)


def read_csv_split(spark: SparkSession, path: str, columns: int, fraction: float = 0.8, seed: int = 51) -> DataFrame:
    """A party file with its label in the last column, and is_train for exactly floor(fraction * rows) of its rows."""
    return split_train_test(read_csv_party(spark, path, columns, True), "row_id", fraction, seed)


def normalize_csv(spark: SparkSession, source: str, target: str, columns: int, smoother: float = 0.0, labels: int = 0) -> None:
    """A header-less file with every column scaled to (v - min + s) / (max - min + s), the last ``labels`` left as they are; row order is kept.

    A constant column without a smoother becomes empty.
    """
    rows = number_rows(read_csv_matrix(spark, source, columns))
    names = [f"c{i}" for i in range(columns - labels)]
    ends = rows.agg(*[f(n).alias(f"{k}{n}") for n in names for k, f in (("low", F.min), ("high", F.max))]).first()
    scaled = {n: F.try_divide(F.col(n) - F.lit(ends[f"low{n}"]) + F.lit(float(smoother)), F.lit(ends[f"high{n}"]) - F.lit(ends[f"low{n}"]) + F.lit(float(smoother))) for n in names if ends[f"low{n}"] is not None}
    write_csv_in_order(rows.withColumns(scaled), target, "row_id", digits=None)


def save_report(report: DataFrame, path: str) -> None:
    """A report of two parts as one file of lines ``part measure: value``, training first."""
    parts = [c for c in report.columns if c != "part"]
    order = F.when(F.col("part") == "train", 0).otherwise(1)
    line = F.concat_ws(" ", F.when(F.col("part") == "train", F.lit("training")).otherwise(F.lit("test")), F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in parts]))
    report.select(line.alias("value"), order.alias("o")).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)  # two rows


def party_table(matrix: DataFrame, row_id: str, has_label: bool) -> DataFrame:
    """(row_id, x, y): of the party that owns the label, the last column is the label."""
    names = [c for c in matrix.columns if c != row_id]
    features = names[:-1] if has_label else names
    return matrix.select(F.col(row_id).alias("row_id"), F.array(*features).alias("x"), *([F.col(names[-1]).alias("y")] if has_label else []))


def write_csv(df: DataFrame, path: str, append: bool = False, digits: int | None = 6) -> None:
    """Doubles are rounded to ``digits`` decimals, unless None."""
    columns = [F.round(c, digits).alias(c) if t == "double" and digits is not None else F.col(c) for c, t in df.dtypes]
    df.select(*columns).write.mode("append" if append else "overwrite").csv(path)


def write_fixed(df: DataFrame, path: str) -> None:
    """Fixed-point columns STRUCT<mantissa DECIMAL(38,0), exponent INT> as parquet."""
    df.write.mode("overwrite").parquet(path)


def read_fixed(spark: SparkSession, path: str, decode: bool = False) -> DataFrame:
    """What ``write_fixed`` wrote; with ``decode``, fixed-point columns as doubles."""
    df = spark.read.parquet(path)
    fixed = [f.name for f in df.schema if isinstance(f.dataType, StructType) and set(f.dataType.names) == {"mantissa", "exponent"}]
    return df.withColumns({c: decode_fixed(F.col(c)) for c in fixed}) if decode and fixed else df


def save_linear(spark: SparkSession, model: LinearModel, path: str) -> None:
    model.table(spark).select("global_idx", "w", F.lit(model.kind).alias("kind"), F.lit(model.bias).alias("bias")).write.mode("overwrite").parquet(path)


def load_linear(spark: SparkSession, path: str) -> LinearModel:
    rows = spark.read.parquet(path).orderBy("global_idx").collect()  # a row for each weight
    return LinearModel(rows[0]["kind"], tuple(r["w"] for r in rows), rows[0]["bias"])


def save_trees(spark: SparkSession, model: Trees, path: str) -> None:
    model.table(spark).withColumn("classes", F.lit(model.classes)).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> Trees:
    df = spark.read.parquet(path)
    return Trees.of_table(df.drop("classes"), df.first()["classes"])


def save_boosted(spark: SparkSession, model: Boosted, path: str) -> None:
    """Two tables: the loss with its rate and priors, and the nodes of all trees by round and output."""
    spark.createDataFrame([(model.loss, model.rate, model.prior)], "loss string, rate double, prior array<double>").write.mode("overwrite").parquet(f"{path}/model")
    nodes = [(i, k, *vars(n).values()) for i, stage in enumerate(model.trees) for k, t in enumerate(stage) for n in t.nodes.values()]
    spark.createDataFrame(nodes, f"round int, output int, {NODE}").write.mode("overwrite").parquet(f"{path}/trees")


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    head = spark.read.parquet(f"{path}/model").first()
    model = Boosted(head["loss"], head["rate"], list(head["prior"]))
    for r in spark.read.parquet(f"{path}/trees").orderBy("round", "output", "node_id").collect():  # a row for each node
        at = r.asDict()
        i, k = at.pop("round"), at.pop("output")
        while len(model.trees) <= i:
            model.trees.append([Trees() for _ in model.prior])
        model.trees[i][k].nodes[at["tree_id"], at["node_id"]] = Node(**at)
    return model


def save_mlp(spark: SparkSession, model: Mlp, path: str) -> None:
    rows = [(i, w.tolist(), b.tolist(), a) for i, (w, b, a) in enumerate(zip(model.weights, model.biases, model.activations, strict=True))]
    spark.createDataFrame(rows, "layer int, weights array<array<double>>, biases array<double>, activation string").write.mode("overwrite").parquet(path)


def load_mlp(spark: SparkSession, path: str) -> Mlp:
    rows = spark.read.parquet(path).orderBy("layer").collect()  # a row for each layer
    return Mlp([np.array(r["weights"]) for r in rows], [np.array(r["biases"]) for r in rows], [r["activation"] for r in rows])
