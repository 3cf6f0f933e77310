import hashlib
import random
import re

import numpy as np
import pytest

from colligo.llm import kernels, queries, substrings
from colligo.llm.common import read_table
from colligo.llm.fmindex import FMIndex

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, spans int, doc_key string, words string"


def brute(rows, n):
    first: dict = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                keep[k : k + n] = [False] * n
        out.append((i, len(w), keep.count(False), " ".join(x for x, y in zip(w, keep, strict=True) if y)))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0], r[3]))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_table(spark, folder):
    rows = [(r.doc_id, r.text) for r in read_table(spark, folder, "documents").collect()]
    want = {i: (i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows, 50)}
    got = queries.op5_substrings(spark, folder).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r) for r in got} == want


def corpus():
    rng = random.Random(5)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(10, 40))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 15))] + rng.choice(passages)
        rows.append((i // 2 if i % 7 == 0 else i, " \n".join(words)))
    rows += [(None, rows[4][1]), (None, None), (70, None), (71, ""), (72, "x " * 5000), (73, "x " * 70), (3, rows[5][1]), rows[9]]
    return rows


@pytest.mark.parametrize("tuning", [{}, {"shard_words": 50}, {"anchor_segments": 1}])
def test_odd_rows(spark, tuning):
    rows = corpus()
    got = substrings.remove_repeats(spark.createDataFrame([(i, t, 1, "k", "w") for i, t in rows], SCHEMA), 12, k=3, **tuning).collect()
    assert by_id((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == by_id(brute(rows, 12))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_matching_statistics():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64) for _ in range(30)]
    asked = [rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64) for _ in range(20)] + texts[:5]
    index = FMIndex(texts, 6)
    inside = {tuple(t[a : a + m]) for t in texts for m in range(1, 7) for a in range(len(t) - m + 1)}
    groups: dict = {}
    for q, group in zip(asked, index.stream(asked), strict=True):
        for a in range(len(q)):
            assert (group[a] >= 0) == (tuple(q[a : a + 6]) in inside and a + 6 <= len(q))
            if group[a] >= 0:
                assert groups.setdefault(tuple(q[a : a + 6]), group[a]) == group[a]
    assert len(set(groups.values())) == len(groups)


def test_a_common_passage_goes_on_once_a_task(spark):
    """Its segments in later documents are settled where they are made, one row for all in a row, and are no rows of the join."""
    passage = " ".join(f"w{j}" for j in range(400))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as doc_key").coalesce(1)
    made = substrings.segments(docs, 50, 8).collect()
    one = len(substrings.anchors(np.arange(400, dtype=np.uint64) * kernels.BASE, 50, 8)[0])
    assert one > 3 and sum(r.anchor is None for r in made) == 39 and len(made) < 40 * one / 2
    for held in (1, 30, 200_000):
        parts = substrings.segments(docs, 50, 8, held).collect()
        assert sum(r.windows for r in parts) == 40 * (403 - 49)
    got = substrings.remove_repeats(docs.select("doc_id", "text")).collect()
    assert by_id(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in got) == by_id(brute(rows, 50))


def test_anchor_segments_cover_windows():
    words = kernels.mix(np.arange(500, dtype=np.uint64) % np.uint64(37))
    begins, count, _ = substrings.anchors(words, 50, 8)
    assert begins[0] == 0 and (begins[1:] == (begins + count)[:-1]).all() and begins[-1] + count[-1] == 451


def test_search_decides(monkeypatch):
    """The streamed segments are not in the index: without its answers nothing is found."""
    rng = np.random.default_rng(1)
    one = kernels.mix(rng.integers(0, 2**60, 30).astype(np.uint64))
    other = np.concatenate([kernels.mix(rng.integers(0, 2**60, 9).astype(np.uint64)), one[5:25], one[:3]])
    rows = ([(7, 1), (7, 2), (7, 3), (8, 4), (8, 5)], [3, 8, 9, 1, 1], [one, other, one[2:20], one, other])
    got = {tuple(r.values())[:2]: r["runs"] for r in substrings.search_shard(*rows, 12, 3).to_pylist()}
    assert got == {(7, 2): [{"a": 9, "b": 18}], (7, 3): [{"a": 0, "b": 7}]}
    monkeypatch.setattr(FMIndex, "step", lambda self, code, at: np.zeros_like(at))
    assert substrings.search_shard(*rows, 12, 3).num_rows == 0


def test_repeated_rows_have_distinct_spans(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), *[(2, text + " own")] * 40]
    keyed = spark.createDataFrame([(hash(r) % 2**40, *r) for r in rows], "doc_key long, doc_id long, text string")
    assert [len(r.spans) for r in substrings.repeated_spans(keyed, 12, 3).collect()] == [len({(x.a, x.b) for x in r.spans}) for r in substrings.repeated_spans(keyed, 12, 3).collect()]
