"""Every operator and every stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colligo.llm import bpe, decontaminate, html, langid, minhash, ngram_lm, quality, queries, substrings, topk, warc

#: Names that the operators use for outputs and inside.
CLASH = (
    "doc_key text_key kept n_words n_removed score predicted decoded ids document others spans lang_pred mixture component_id n_shingles set_id bands row head gram "
    "base place item me w h pos key n n_tokens payload record_type rank vec"
).split()
GOOD = " ".join(f"The word number {k} is a plain word of a plain text." for k in range(30))
TEXTS = [(1, GOOD), (2, GOOD + " With an end."), (2, GOOD + " With an end."), (3, None), (4, ""), (5, " \n\t "), (6, "long text of words " * 60_000), (None, GOOD), (None, None), (7, "½ ²"), (1, "Another text under the same id, of ten words in all.")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def same(got, texts=TEXTS):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in texts)


def operators(spark):
    path = queries.tokenizer_path()
    items = spark.createDataFrame([(1, "a benchmark item that no text of these holds at all", "x")], "item_id long, text string, doc_key string")
    return {
        "minhash": minhash.near_duplicates, "langid": lambda d: langid.predict(d, langid.fit(d)), "decontaminate": lambda d: decontaminate.decontaminate(d, items),
        "substrings": lambda d: substrings.remove_repeats(d, keep=[c for c in d.columns if c not in ("doc_id", "text")]), "ngram_lm": ngram_lm.score,
        "bpe": lambda d: bpe.decode(bpe.encode(d, path).withColumn("decoded", F.lit(0)), path),
        "quality": lambda d: quality.score(d, quality.boost(*quality.labelled_features(d, d.select("doc_id", F.lit(1).alias("quality"))))),
    }


@pytest.mark.parametrize("name", "minhash langid decontaminate substrings ngram_lm bpe quality".split())
def test_operators(spark, odd, name):
    run = operators(spark)[name]
    got = run(odd)
    assert len(set(got.columns)) == len(got.columns) and same(got.collect())
    assert run(odd.limit(0)).count() == 0
    if name == "minhash":
        assert sorted((r.doc_id, r.component_id) for r in got.where("doc_id < 3").collect()) == [(1, 1), (1, 1), (2, 1), (2, 1)]
    if name == "langid":
        assert [r.lang_pred for r in got.where("doc_id = 7 or doc_id = 4").collect()] == ["und", "und"]


def test_stages(spark, odd, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[1:]:
        after = stage(spark, docs, sf)
        ids = sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in after.collect()) if "text" in after.columns else None
        if name == "near-duplicates":
            # one of the repeated rows' group stays, and both texts of id 1
            assert ids == sorted((i is None, i or 0, len(t or "")) for i, t in TEXTS if i != 2)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns and {r[c] for c in CLASH for r in after.collect()} == {f"own {c}" for c in CLASH}
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = corpus_pipeline.quality_filter(spark, odd, sf)
    assert kept.columns == odd.columns and kept.count() <= len(TEXTS)


def test_repeated_rows_keep_one(spark, sf):
    rows = [(5, "x y z unique words here of this one"), (1, GOOD), (5, GOOD), (8, GOOD + " more"), (9, "a b c d e f"), (9, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert got == sorted([rows[0], rows[1], rows[4]])


def test_pages_and_vectors(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, None, "<p>a b</p>", "x"), (1, None, "<p>a b</p>", "x"), (2, "u", None, "x"), (None, "u", "", "x"), (3, "u", "<b>" * 20_000 + "</i>" * 20_000 + "<svg/>" * 20_000 + "words", "x")],
        "page_id long, url string, html string, text string",
    )
    assert html.extract_pages(pages).count() == 5 and html.extract_pages(pages.limit(0)).count() == 0
    warc.write_warc(warc.plan_records(pages), f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").where("kind = 'record'").count() == 5
    vectors = spark.createDataFrame([(1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [0.25, 1.0], 1), (None, [1.0, 1.0], 1)], "vec_id long, e array<double>, score int")
    got = topk.top_k(topk.integer_vectors(vectors, "vec_id", "e"), F.col("vec_id") <= 2, k=2)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == [(1, 1, 2), (1, 2, 6), (2, 1, 1), (2, 2, 6)]
    assert topk.top_k(topk.integer_vectors(vectors.limit(0), "vec_id", "e"), F.col("vec_id") <= 2).count() == 0
