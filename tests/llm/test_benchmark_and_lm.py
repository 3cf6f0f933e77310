import math
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from colligo.llm import decontaminate, ngram_lm, queries
from colligo.llm.common import CLEANUP, read_table

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, item_id int, h string, n int"
ITEMS = "item_id long, text string, doc_id int, w string"


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items, percent=80, k=5):
    out = {}
    for d, text in docs:
        words = WORD.findall((text or "").lower())
        for i, item in items:
            want = WORD.findall((item or "").lower())
            if not want:
                continue
            width = min(k, len(want))
            theirs = shingles(want, width)
            best = None
            for s in range(len(words) - width + 1):
                mine = shingles(words[s : s + len(want)], width)
                both = sum((mine & theirs).values())
                total = sum((mine | theirs).values())
                if 100 * both >= percent * total and (best is None or both / total > best[1]):
                    best = (s, both / total)
            if best:
                out[d, i] = (best[0], round(best[1], 9))
    return out


def found(df):
    return {(r.doc_id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in df.collect()}


def test_decontamination_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, sf, "benchmark").collect()]
    got = queries.op4_decontaminate(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    want = brute(docs, items)
    assert want and found(got) == want


def test_decontamination_odd_rows(spark):
    item = " ".join(f"i{k}" for k in range(30))
    loop = "a b c d e f g " * 5
    items = [(1, item), (2, "Two Words"), (3, None), (4, " "), (5, loop), (6, "one two three four five six"), (1, item)]
    words = item.split()
    cut, put = [*words[:12], *words[13:]], [*words[:20], "new", *words[20:]]
    docs = [
        (1, "start " + item.upper() + " end"), (2, " ".join(["x"] * 40 + cut + ["y"] * 3)), (3, " ".join(put)), (4, " ".join(words[:27])), (5, "see two words here"),
        (6, loop + loop), (7, None), (8, ""), (9, "q " * 20000 + item), (None, item), (10, "one two three four five"), (11, "one two three four five six seven"), (1, "clean text of no use"),
    ]
    d = spark.createDataFrame([(i, t, 1, "h", 1) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 1, "w") for i, t in items], ITEMS)
    assert found(decontaminate.contaminated(d, b)) == brute(docs, items)
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    bad = {i for i, _ in brute(docs, items)}
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t in docs if i not in bad or t == "clean text of no use")
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


TEXTS = ["the cat sat on the mat", "the cat sat", "a dog", "dog", "", None, "the " * 3000, "the cat sat on the mat", "rare unseen words only here", "x y x y x y x z", "the cat saw the dog", "a b c", "a b c"]


def stupid_backoff(texts, corpus, order):
    split, learned = ([WORD.findall(t or "") for t in x] for x in (texts, corpus))
    seen = Counter(tuple(t[i : i + k]) for t in learned for k in range(1, order + 1) for i in range(len(t) - k + 1))
    seen[()] = max(1, sum(len(t) for t in learned))

    def s(gram):
        if len(gram) == 1:
            return max(seen[gram], 1) / seen[()]
        return seen[gram] / seen[gram[:-1]] if seen[gram] else 0.4 * s(gram[1:])

    return [(len(t), round(sum(math.log(s(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(len(t))), 6)) for t in split]


def scored(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.log_score, 6)) for r in df.collect())


@pytest.mark.parametrize(("order", "heavy"), [(2, 4), (3, 512), (4, 4)])
def test_lm_scores_under_own_counts(spark, monkeypatch, order, heavy):
    monkeypatch.setattr(ngram_lm, "HEAVY", heavy)
    ids = [None if k == 3 else min(k, 11) for k in range(len(TEXTS))]  # a null id, and a row that repeats id and text
    got = ngram_lm.score(spark.createDataFrame([(i, t, 1, "h", 1) for i, t in zip(ids, TEXTS, strict=True)], DOCS), order=order)
    want = stupid_backoff(TEXTS, TEXTS, order)
    assert scored(got) == sorted((i is None, i or 0, *w) for i, w in zip(ids, want, strict=True))
    assert ngram_lm.score(spark.createDataFrame([], DOCS), order=order).count() == 0


def test_lm_passes_share_the_rows_and_leave_no_shuffle_files(spark, sf):
    docs = read_table(spark, sf, "documents").selectExpr("doc_id as row", "doc_id", "text")
    counts = ngram_lm.word_counts(docs)
    known = ngram_lm.frequent(docs, counts, counts.agg({"n": "sum"}).first()[0], 3)
    rows = lambda turn, turns: Counter(tuple(r) for r in ngram_lm.exploded(docs, 3, known, turn, turns).collect())
    whole, passes = rows(0, 1), [rows(turn, 4) for turn in range(4)]
    assert sum(passes, Counter()) == whole and max(p.total() for p in passes) < 0.3 * whole.total()
    assert all(len({r[1] for r in p} & {r[1] for r in q}) == 0 for p, q in zip(passes, passes[1:], strict=False))

    # no setting of the session stays changed, and the passes' files, at least 16 bytes a row, are gone
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [f.getPath() for f in disk.localDirs()]
    left = lambda: sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))
    before, setting = left(), spark.conf.get(CLEANUP)
    done = ngram_lm.score(docs)
    assert left() - before < 4 * whole.total() and spark.conf.get(CLEANUP) == setting
    assert done.count() == docs.count()


@pytest.mark.parametrize("order", [3])
def test_lm_backs_off_under_another_corpus(spark, order):
    corpus = ["the cat sat on a mat", "a dog sat", None, "the dog", "x y x z"]
    docs = spark.createDataFrame([(k, t, 1, "h", 1) for k, t in enumerate(TEXTS)], DOCS)
    for learned in (corpus, []):
        got = ngram_lm.score(docs, spark.createDataFrame([(t, 1) for t in learned], "text string, row int"), order)
        assert scored(got) == sorted((False, k, *w) for k, w in enumerate(stupid_backoff(TEXTS, learned, order)))


def test_lm_whole_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(ngram_lm.oracle_sql()).fetchall()}
    got = queries.op6_ngram_lm(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        n, s, m = want[r.doc_id]
        assert r.n_words == n and abs(r.log_score - s) < 2e-3 and abs(r.mean_log_score - m) < 2e-3


def test_decontaminate_branches_and_radius(spark, sf):
    """A benchmark that is not broadcast gives the same rows, and the radius loses no pair of the table."""
    docs, items = (read_table(spark, sf, name) for name in ("documents", "benchmark"))
    rows = lambda **how: sorted(map(tuple, decontaminate.contaminated(docs, items, **how).collect()))
    want = rows()
    assert want and rows(broadcast_shingles=0) == want
    assert rows(radius=63) == want
