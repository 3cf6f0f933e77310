"""Tables, shared scratch space and small relational helpers for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    go without; it gets a temporary folder, which every thread of it can see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="colligo-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back; with ``release`` Spark deletes the write's shuffle files at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    try:
        spark.conf.set(CLEANUP, str(release or before == "true").lower())
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def other_key(column: str):
    """``column`` under a fresh expression.

    An aggregate grouped by a key and then joined on it needs no second shuffle, but
    then adaptive execution cannot split a hot key of the join.  Joining on this
    expression makes Spark shuffle both sides for the join, and hot keys are split.
    """
    return F.col(column).bitwiseXOR(F.lit(1))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound the rows that the JVM and a Python worker hold at once; whole texts are long, and both sides copy a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
