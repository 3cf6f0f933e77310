"""The n-gram Jaccard join against all pairs in plain Python, over families, chains and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligo.llm import jaccard, queries
from colligo.llm.common import read_table

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, percent):
    """{row number: (n, component)} by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kinds = {}
    for i, s in sets:
        if s and i is not None:
            if s in kinds:
                parent[max(find(i), find(kinds[s]))] = min(find(i), find(kinds[s]))
            kinds.setdefault(s, i)
    flat = sorted(kinds.items(), key=lambda e: len(e[0]))
    for n, (a, i) in enumerate(flat):
        for b, j in flat[n + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    # a row has the component of its own set
    return [(i, len(s), None if i is None else find(kinds[s]) if s else i) for i, s in sets]


def joined(spark, rows, percent, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, jaccard.join(docs, percent, **how).drop("text_key").collect()), key=repr)


def words(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


def edited(rnd, w, edits):
    w = list(w)
    for _ in range(edits):
        at = rnd.randrange(len(w))
        w[at : at + rnd.randrange(2)] = [f"e{rnd.randrange(10**6)}"] * rnd.randrange(2)
    return w


@pytest.mark.parametrize("percent, few, many", [(80, jaccard.FEW, 2), (85, 0, 10**9), (85, jaccard.FEW, jaccard.MANY)])
def test_families_chains_and_passages(spark, percent, few, many):
    rnd = random.Random(percent)
    rows = []
    for size, edits in ((60, 2), (40, 5), (40, 6)):  # families around the threshold
        base = words(rnd, 120)
        rows += [" ".join(edited(rnd, base, rnd.randrange(edits + 1))) for _ in range(size)]
    chain = words(rnd, 150)
    for _ in range(25):  # each like the one before only
        rows.append(" ".join(chain))
        chain = edited(rnd, chain, 3)
    passage = words(rnd, 60)
    rows += [" ".join(words(rnd, rnd.randrange(60)) + passage + words(rnd, rnd.randrange(200))) for _ in range(40)]
    rows += [" ".join(passage + words(rnd, n)) for n in range(12)]
    rows += [" ".join(words(rnd, n)) for n in (1, 2, 3, 4, 5, 6, 7)] + ["a b c d e", "a b c d e f", "A b C d", "a b c d", "a b", "a B"]
    ids = rnd.sample(range(10**6), len(rows))
    rows = list(zip(ids, rows, strict=True))
    assert joined(spark, rows, percent, few=few, many=many) == sorted(brute(rows, percent), key=repr)


def test_odd_rows(spark):
    long = " ".join(f"x{i % 30_000}" for i in range(60_000))
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (2, text + " end"), (2, text + " end"), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, long + " more"), (None, text), (None, None), (1, "other text under this id"), (8, "Other TEXT under this ID")]
    got = joined(spark, rows, 85)
    want = sorted(brute(rows, 85), key=repr)
    assert got == want
    clash = "text_key n_shingles set_id rep n gram grams pos size c component_id piece counts kept".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in clash})
    assert sorted(map(tuple, jaccard.join(docs, 85).drop("text_key").collect()), key=repr) == want
    assert jaccard.join(docs.limit(0), 85).count() == 0


def test_indexed_grams_suffice():
    for percent in (80, 85):
        for n in range(1, 300):
            for m in range(n, 300):
                if 100 * n >= percent * m:
                    least = -(-percent * (n + m) // (100 + percent))
                    # what is not indexed of either is less than the overlap
                    assert least > max(n - jaccard.prefix_size(n, percent), m - jaccard.prefix_size(m, percent))


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_shares_of_similar_sets_are_near(percent):
    high = max(jaccard.NEAR, 10000 // (100 + percent) + 2)
    for n in range(1, 120):
        for m in range(-(-percent * n // 100), 100 * n // percent + 1):
            both = -(-percent * (n + m) // (100 + percent))
            for held in range(-(-high * n // 100), n + 1):  # the lead holds this much of the first
                assert 10000 * (max(0, held - (n - both)) + 1) >= high * percent * m


def test_levels_grow_with_counts():
    got = jaccard._level(np.array([0, 1, 2, 3, 100, 10**9]))
    assert got[0] == 0 and (np.diff(got.astype(int)) > 0).all()


def test_the_table(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    want = sorted(brute([(r.doc_id, r.text) for r in docs], 85), key=repr)
    got = queries.op12_jaccard(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(i != c for i, _, c in want)
