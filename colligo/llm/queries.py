"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.llm import bpe, decontaminate, filter_audit, html, jaccard, langid, merkle, minhash, ngram_lm, quality, substrings, topk, warc
from colligo.llm.common import read_table, scratch_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and report each record."""
    path = scratch_path(spark, "warc")
    warc.write_warc(warc.plan_records(read_table(spark, sf_dir, "pages")), path)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    records = warc.read_warc(spark, path).where("kind = 'record'")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at 0.85."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the fold."""
    docs = read_table(spark, sf_dir, "documents")
    fold = langid.remainder(F.col("doc_id"), 5)
    model = langid.fit(docs.where(fold != 0))
    return langid.predict(docs, model).select("doc_id", F.coalesce(langid.remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the best window of each pair."""
    docs, benchmark = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.contaminated(docs, benchmark).drop("doc_key")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat 50-word windows of earlier ones."""
    done = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under counts of all documents."""
    done = ngram_lm.score(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 3).alias("mean_log_score"))


def op6_ngram_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under counts of the documents whose crc32 of the id, modulo 5, is not 0: a fifth of the documents backs off."""
    docs = read_table(spark, sf_dir, "documents")
    done = ngram_lm.score(docs, docs.where(langid.remainder(F.col("doc_id"), 5) != 0))
    return done.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 3).alias("mean_log_score"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to, as digests."""
    path = tokenizer_path()
    done = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0).drop("exact_score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the fold."""
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    model = quality.boost(*quality.labelled_features(docs, labels.where(langid.remainder(F.col("doc_id"), 4) != 2)))
    held_out = F.coalesce(langid.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over all documents, for each language."""
    return filter_audit.audit(filter_audit.failures(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingles have a Jaccard similarity of 0.85."""
    return jaccard.join(read_table(spark, sf_dir, "documents"), 85).drop("text_key")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents; every path is checked against a row that may be tampered with."""
    docs = read_table(spark, sf_dir, "documents")
    of = lambda n: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = langid.remainder(F.col("doc_id"), 7) == 0
    rows = docs.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), F.when(tampered, of(F.try_add("n_chars", F.lit(1).cast("long")))).alias("tampered"))
    done = merkle.manifest(rows, "lang", "doc_id").withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_minhash": op2_minhash,
    "op3_langid": op3_langid,
    "op4_decontaminate": op4_decontaminate,
    "op5_substrings": op5_substrings,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_bpe": op7_bpe,
    "op8_html": op8_html,
    "op9_topk": op9_topk,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_jaccard": op12_jaccard,
    "op13_merkle": op13_merkle,
    "op6_ngram_backoff": op6_ngram_backoff,
}

ORACLES: dict[str, str] = {
    "op6_ngram_lm": ngram_lm.oracle_sql(),
    "op6_ngram_backoff": ngram_lm.backoff_sql(f"({merkle.crc32_sql('doc_id::varchar')}) % 5 <> 0"),
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op13_merkle": merkle.oracle_sql(),
}
