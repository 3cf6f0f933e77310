"""A corpus-cleaning pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.llm import bpe, decontaminate, langid, minhash, quality, substrings
from colligo.llm.common import read_table, save, scratch_path, small_batches
from colligo.llm.queries import tokenizer_path

#: Documents at or above this score are kept.
QUALITY = 0.7
#: Near copies share at least so many hundredths of their five-word shingles.
SIMILAR = 80
WINDOW = 50

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality model rejects; it learns from labels outside the fold.

    Null and empty texts score as empty ones.  Repeated rows share their fate.  Without
    labels, the model's constant score decides for all.  Columns of any name are kept.
    """
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels").where(langid.remainder(F.col("doc_id"), 4) != 2)
    model = quality.boost(*quality.labelled_features(docs, labels))
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("document")
    scored = quality.score(docs.select(others, "text"), model, QUALITY).where("predicted = 1")
    return scored.select(*[F.col("text") if c == "text" else F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies, and one of rows that repeat an id and a text.

    Each row is judged by its own text, also where rows share an id.  Null and wordless
    texts are no copies of others.  Rows without an id stay.  Columns of any name are kept.
    """
    small_batches(spark)
    groups = minhash.near_duplicates(docs, percent=SIMILAR).groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count("*").alias("copies"))
    told = save(groups.where("doc_id is not null and (not kept or copies > 1)").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "kept"), "verdicts")
    rows = docs.select(F.struct("*").alias("document"), "doc_id", F.xxhash64("text").alias("text_key"))
    named = lambda df: (F.col("doc_id") == df["id"]) & (F.col("text_key") == df["key"])
    drop, repeated = told.where("not kept"), told.where("kept")
    out = rows.join(drop, named(drop), "left_anti")
    if not repeated.isEmpty():
        one = out.join(repeated, named(repeated), "left_semi").dropDuplicates(["doc_id", "text_key"])
        out = out.join(repeated, named(repeated), "left_anti").union(one)
    return out.select("document.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words that long passages of earlier documents already hold; documents left without words go.

    A text that keeps all words is unchanged, null, empty and wordless ones among them; a
    changed text's n_chars, if there is such a column, is its own.  Rows without an id, or
    that repeat one, are as the operator defines.  Columns of any name are kept.
    """
    small_batches(spark)
    rows = docs.select("doc_id", "text", F.struct("*").alias("document"))
    done = substrings.remove_repeats(rows, WINDOW, keep=["document"]).where("n_words > n_removed or n_words = 0")
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    fields = [F.col(f"document.`{c}`").alias(c) for c in docs.columns]
    return done.select(*[F.when(F.col("n_removed") > 0, changed[c]).otherwise(f).alias(c) if c in changed else f for c, f in zip(docs.columns, fields, strict=True)])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null, wordless and repeated rows are as the operator defines."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), SIMILAR)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of what is left, row by row; the ids decode to ``decoded``. Null and empty texts have no ids.

    The ids are a table of their own, so that no task holds the encoder's and the decoder's Python worker at once.
    """
    small_batches(spark)
    path = tokenizer_path()
    encoded = save(bpe.encode(docs, path), "ids")
    return bpe.decode(encoded, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_filter),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_filter),
    ("BPE encoding", tokens),
]

#: Learned scores and iterative grouping have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
