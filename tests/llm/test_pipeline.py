import re

import pytest

import corpus_pipeline
from colligo.llm.common import read_table, save

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def stages(spark):
    folder = "/root/testdata/sf0.001"
    docs, out = read_table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = save(stage(spark, docs, folder), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        assert 0 < after.count() <= before.count(), name
    assert stages[-1][1].count() == stages[-1][2].count()


def test_duplicates_keep_one_of_each_group(stages):
    _, before, after = stages[1]
    shingled = {}
    for r in before.collect():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingled[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    kept = {r.doc_id for r in after.collect()}
    close = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    for i in sorted(kept):
        assert not any(close(shingled[i], shingled[j]) for j in kept if j < i)
    for i in set(shingled) - kept:
        assert any(close(shingled[i], shingled[j]) for j in shingled if j != i)


def test_substrings_leave_no_window_twice(stages):
    _, before, after = stages[2]
    texts = {r.doc_id: r for r in before.collect()}
    first: dict = {}
    for i in sorted(texts):
        w = WORD.findall(texts[i].text or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    rows = {r.doc_id: r for r in after.collect()}
    for i, r in texts.items():
        w = WORD.findall(r.text or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        if all(keep):
            assert rows[i] == r
        elif any(keep):
            text = " ".join(x for x, y in zip(w, keep, strict=True) if y)
            assert (rows[i].text, rows[i].n_chars, rows[i].lang) == (text, len(text), r.lang)
        else:
            assert i not in rows


def test_clean_documents_stay(stages):
    _, before, after = stages[0]
    labels = {r.doc_id: r.quality for r in read_table(before.sparkSession, "/root/testdata/sf0.001", "labels").collect()}
    kept = {r.doc_id for r in after.collect()}
    good = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 1]
    bad = [r.doc_id for r in before.collect() if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)
