"""The filter audit and the Merkle manifest against plain Python, and over odd inputs."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from colligo.llm import filter_audit, merkle, queries
from colligo.llm.common import read_table

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "part mask good toxic n step letter bit hit earlier first copies digest key id leaf pos path root subroot tree keep order block up row place".split()
LONG = "word after word of a long text " * 40_000
ODD = [
    (1, "en", "Plain text."), (2, "en", "Plain text."), (2, "en", "Plain text."), (1, "en", "Plain text."), (3, None, None), (4, None, ""), (5, "", "ALL CAPITALS"), (None, "de", "Plain text."), (None, "de", None),
    (6, "de", "a | b"), (7, "de", LONG), (8, "fr", " \t\n "), (9, "fr", "nbsp is no space " * 80), (10, "ünï", "grün " * 250), (11, "z", "x y " * 150), (12, "en", "Àé" * 10 + "A"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, None), (6, 1, 1), (7, 1, None), (None, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame([(i, g, t, "s", len(t or "")) for i, g, t in ODD], "doc_id long, lang string, text string, source string, n_chars long")
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def masks(rows):
    """Failing letters of every (doc_id, lang, text)."""
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, g, t in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        yield i, g or "", fails + "E" * (i is not None and least[t] < i)


def brute_audit(rows, labels):
    out = {}
    told = list(masks(rows))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    total = Counter()
    for part in {p for _, p, _ in told}:
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in told if p == part]
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                every = [f for _, p, f in told if p == part and letter in f]
                out[part, order, step] = [len(left), len(here), len(every) - len(here), every.count(letter), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here)]
                total[part, letter] += len(here)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    rows = filter_audit.audit(filter_audit.failures(docs, labels)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}


def test_audit_of_odd_rows(spark, odd):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))
    assert audited(odd, labels) == brute_audit(ODD, LABELS)
    assert audited(odd.limit(0), labels) == {}
    none = audited(odd, labels.limit(0))
    assert len(none) == len(brute_audit(ODD, [])) and all(v[4] == v[5] == 0 for v in none.values())


def test_audit_of_the_table(spark, sf):
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    want = brute_audit([(r.doc_id, r.lang, r.text) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in queries.op11_filter_audit(spark, sf).collect()}
    assert got == want and any(v[2] for v in want.values()) and any(v[5] for v in want.values())


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", 0, True, False), ("p", 3, True, True), ("p", 2, False, False)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(rows, "XY").collect()}
    assert got == {("XY", 1): (2, 1, 0, 0, 1), ("XY", 2): (1, 1, 1, 1, 3), ("YX", 1): (1, 2, 0, 1, 3), ("YX", 2): (1, 0, 1, 0, 1)}
    with pytest.raises(ValueError):
        filter_audit.audit(rows, "XX")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(root, path of every node): all levels are kept."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            paths[k].append("" if a ^ 1 >= len(nodes) else ("L" if a & 1 else "R") + nodes[a ^ 1])
        nodes = [h(*nodes[a : a + 2]) for a in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16])
def test_traversal_of_a_block(n):
    leaves = [h(str(i)) for i in range(n)]
    root, paths = brute_tree(leaves)
    height = (n - 1).bit_length()
    assert merkle.block_root(leaves, height) == root and list(merkle.block_paths(leaves, height)) == paths


def test_traversal_holds_few_nodes():
    leaves = [h(str(i)) for i in range(256)]
    stack = merkle._TreeHash(leaves, 0, 8)
    most = 0
    while not stack.done():
        stack.step()
        most = max(most, len(stack.stack))
    assert most <= 9


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_of_trees_of_many_sizes(spark, levels):
    rnd = random.Random(levels)
    sizes = {None: 1, "": 2, "a": 3, "b": 33, "ü": 7, "Z": 16, "hot": 90}
    rows = [(g, rnd.randrange(40), h(g or "-", str(k))) for g, n in sizes.items() for k in range(n)]
    rows += rows[-3:]
    rnd.shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, "lang string, doc_id int, leaf string").repartition(5), "lang", "doc_id", levels=levels).collect()
    trees = {g: sorted((d, x) for g2, d, x in rows if g2 == g) for g in sizes}
    names = sorted(sizes, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: brute_tree([x for _, x in trees[g]]) for g in names}
    root, over = brute_tree([built[g][0] for g in names])
    want = sorted((repr(g), d, x, k, built[g][0], root, tuple(built[g][1][k] + over[names.index(g)])) for g in names for k, (d, x) in enumerate(trees[g]))
    assert sorted((repr(r.lang), r.doc_id, r.leaf, r.pos, r.subroot, r.root, tuple(r.path)) for r in got) == want


def test_manifest_of_odd_rows(spark, odd):
    rows = odd.withColumn("leaf", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    got = merkle.manifest(rows, "lang", "doc_id")
    found = got.withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).select("doc_id", "leaf", "again", "root").collect()
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    assert sorted(r.leaf for r in found) == sorted(h(f(i), f("s"), f(g), f(len(t or "")), f(t)) for i, g, t in ODD)
    assert all(r.again == r.root for r in found) and len({r.root for r in found}) == 1
    assert merkle.manifest(rows.limit(0), "lang", "doc_id").count() == 0


def test_tampered_rows_are_found(spark, sf):
    docs = {r.doc_id: r for r in read_table(spark, sf, "documents").collect()}
    got = queries.op13_merkle(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and docs[r.doc_id].n_chars is not None))
        assert (r.folded_root == r.root) == r.verified
