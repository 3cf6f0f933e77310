import base64
import gzip
import hashlib
import html as entities
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colligo.llm import html, queries, topk, warc
from colligo.llm.common import read_table, scratch_path

PAGES = "page_id long, url string, html string, kind string"


def archive(spark, rows):
    path = scratch_path(spark, "test-warc")
    warc.write_warc(warc.plan_records(spark.createDataFrame(rows, PAGES)), path)
    return path


def test_warc_round_trip(spark, sf):
    pages = read_table(spark, sf, "pages").collect()
    first: dict = {}
    for p in pages:
        d = base64.b32encode(hashlib.sha1((p.html or "").encode()).digest()).decode()
        first[d] = min(first.get(d, p.page_id), p.page_id)
    got = {r.page_id: r for r in queries.op1_warc(spark, sf).collect()}
    assert len(got) == len(pages)
    for p in pages:
        data = (p.html or "").encode()
        d = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first[d] != p.page_id
        assert tuple(got[p.page_id]) == (p.page_id, len(data), d, "revisit" if revisit else "response", first[d] if revisit else None)


def test_warc_nulls_repeats_and_odd_payloads(spark):
    rows = [(3, None, None, "x"), (1, "u", "", "x"), (None, "u", "", "y"), (4, "a\r\nb", "x\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\ny", "z"), (5, "u", "ü" * 70000, "z"), (5, "u", "ü" * 70000, "z")]
    got = warc.read_warc(spark, archive(spark, rows)).collect()
    assert not [r for r in got if r.kind == "gap"]
    seen = sorted((r.record_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert seen == [
        ("urn:page:1", "response", None, 0), ("urn:page:3", "revisit", "urn:page:1", 0), ("urn:page:4", "response", None, len(rows[3][2])),
        ("urn:page:5", "response", None, 140000), ("urn:page:5", "response", None, 140000), ("urn:page:none", "revisit", "urn:page:1", 0),
    ]
    assert warc.read_warc(spark, archive(spark, [])).count() == 0


def member(k, body=b"hello", extra=b""):
    d = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{d}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + extra + b"\r\n\r\n"


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_covers_every_byte(zipped):
    pack = gzip.compress if zipped else bytes
    good = [pack(member(k, b"body %d" % k * 50)) for k in range(6)]
    broken = bytearray(good[2])
    broken[len(broken) // 2] ^= 255
    data = good[0] + b"junk \x1f\x8b\x08 junk" + good[1] + bytes(broken) + good[3] + good[4][:-9] + good[5] + b"tail"
    out = list(warc.parse_archive("a", data))
    # a truncated member's record is whole if only the gzip trailer is gone
    assert [r["record_id"] for r in out if r["kind"] == "record" and r["record_id"] != "urn:page:4"] == [f"urn:page:{k}" for k in (0, 1, 3, 5)]
    covered = sorted((r["offset"], r["length"]) for r in out if r["length"])
    at = 0
    for start, length in covered:
        assert start >= at
        at = start + length
    assert at == len(data) and covered[0][0] == 0
    gaps = [r for r in out if r["kind"] == "gap"]
    assert gaps and all(r["reason"] for r in gaps)
    assert list(warc.parse_archive("a", b"")) == []


def test_salvage_inside_one_member():
    records = [member(k, bytes([65 + k]) * 90000) for k in range(8)]
    records[3] = records[3].replace(b"D" * 10, b"x" * 10, 1)
    whole = gzip.compress(b"".join(records), 1)
    out = list(warc.parse_archive("a", whole))
    assert [r["record_id"] for r in out if r["kind"] == "record"] == [f"urn:page:{k}" for k in range(8) if k != 3]
    assert [r["reason"] for r in out if r["kind"] == "gap"] == ["inside member: payload digest"]
    import random

    noise = [member(k, random.Random(k).randbytes(90000)) for k in range(8)]
    cut = bytearray(gzip.compress(b"".join(noise), 1))
    cut = cut[: len(cut) * 9 // 16]
    out = list(warc.parse_archive("a", bytes(cut) + gzip.compress(member(9))))
    assert [r["record_id"] for r in out if r["kind"] == "record"] == [f"urn:page:{k}" for k in (0, 1, 2, 3, 9)]
    assert [r["kind"] for r in out].count("gap") == 1


def test_warc_damage_stays_in_its_record(spark):
    rows = [(k, f"u{k}", f"page {k} " * 400, "x") for k in range(40)]
    path = scratch_path(spark, "test-warc")
    warc.write_warc(warc.plan_records(spark.createDataFrame(rows, PAGES).coalesce(1)).coalesce(1), path)
    (file,) = [r.content for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    whole = list(warc.parse_archive("a", bytes(file)))
    assert [r["kind"] for r in whole] == ["record"] * 40 and sum(r["length"] for r in whole) == len(file)
    assert len(gzip.decompress(bytes(file))) > sum(len(r[2]) for r in rows)
    hit = whole[10]
    for at in (0, hit["length"] // 2, hit["length"] - 6):  # magic, compressed data, checksum
        broken = bytearray(file)
        broken[hit["offset"] + at] ^= 255
        out = list(warc.parse_archive("a", bytes(broken)))
        assert [r["record_id"] for r in out if r["kind"] == "record"] == [r["record_id"] for r in whole if r is not hit]
        assert [(r["offset"], r["length"]) for r in out if r["kind"] == "gap"] == [(hit["offset"], hit["length"])]


def test_warc_member_of_a_long_record():
    for size in (10, 1 << 24):
        record = member(1, b"a" * size)
        data = (warc.gzip_member(record) + warc.LAST.encode()) * 2
        assert gzip.decompress(data) == record * 2
        assert [(r["kind"], r["payload_bytes"]) for r in warc.parse_archive("a", data)] == [("record", size)] * 2


def article(page):
    body = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    clean = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x) if "<" in x else x).split()) for x in parts]
    return "\n\n".join(x for x in clean if x)


def test_html_articles(spark, sf):
    got = {r.page_id: r for r in queries.op8_html(spark, sf).collect()}
    pages = read_table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article(p.html)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_html_odd_pages():
    w = {"word": 1.0, "marked word": -1.0, "": -1.0}
    page = (
        "<html><head><title>Site</title></head><body><header>Top words here</header><div class='cookie-notice'>We use many cookies on this site, accept</div>"
        "<main><h1>Title &amp; more</h1><p>One  two\nthree<br>four five six seven eight<p>Next &lt;b&gt; par <b>bold</b>agraph goes on for long</p>"
        "<aside>Not this one at all</aside><form>Name <input> </form><section class=comments><p>I am a reader and I say much here</p></section></main>"
        "<footer>Foot words</footer><script>if (a<b) {}</script>"
    )
    assert html.extract(page, w) == "Title & more\n\nOne two three four five six seven eight\n\nNext <b> par boldagraph goes on for long"
    for empty in (None, "", "<", "<p", "<!-- x", "<script>var a", "< ><"):
        assert html.extract(empty, w) in ("", "< ><", "<")
    assert html.extract("plain words only", w) == "plain words only"
    assert html.extract("<p>" + "w " * 100000, w) == " ".join(["w"] * 100000)


WORDY = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize(
    "page",
    [
        f"<body class='single right-sidebar'><p>{WORDY}</p></body>",
        f"<html class=modal><body id=form><main class='content no-sidebar comments'><p>{WORDY}</p></main></body></html>",
        f"<article class='post comments-open widget' role=search><p>{WORDY}</p></article>",
        f"<div class=widget><p>{WORDY}</p></div>",
        f"<div class=modal><main><p>{WORDY}</p></main></div><div class=comments><p>{WORDY} {WORDY}</p></div>",
        f"<p data-post-id='comment' data-grid=ad title='a class=ad'>{WORDY}</p>",
        "<article><p>one two three four five six <span class=notice>seven</span> eight nine ten eleven twelve</p></article>",
        f"<div class=search-result>{WORDY}</div>",
        f"<div class='cookie-notice'>we bake them here</div><p>{WORDY}</p><div id=related>more to read</div>",
    ],
)
def test_html_names_only_lower_scores(page):
    assert html.extract(page, {"word": 1.0, "marked word": -1.0, "": -1.0}) == WORDY
    assert sum(n for f, n, _ in html.features(page) if f == "word") >= 11


VARIANTS = {
    "heading": (lambda a: a.replace("<h1>", "<h1><em>", 1).replace("</h1>", "</em></h1>", 1), None),
    "list": (lambda a: a.replace("</article>", "<ul><li>ab cd</li><li>ef gh</li></ul></article>"), "\n\nab cd\n\nef gh"),
    "code": (lambda a: a.replace("</article>", "<p>Run <code>make</code> twice.</p></article>"), "\n\nRun make twice."),
    "table": (lambda a: a.replace("</article>", "<table><tr><td>ab</td><td>cd</td></tr></table></article>"), "\n\nab\n\ncd"),
    "quote": (lambda a: a.replace("<article>", "<article><blockquote>As they said.</blockquote>"), ("As they said.\n\n",)),
    "names": (lambda a: re.sub(r' (?:class|id|role)="[^"]*"', "", a), None),
}


@pytest.fixture(scope="module")
def learned(spark):
    pages = read_table(spark, "/root/testdata/sf0.01", "pages")
    return html.learn_weights(pages), pages.collect()


@pytest.mark.parametrize("name", sorted(VARIANTS))
def test_html_keeps_ordinary_markup(learned, name):
    weights, pages = learned
    change, more = VARIANTS[name]
    for p in pages:
        plain = article(p.html)
        want = plain if more is None else more[0] + plain if isinstance(more, tuple) else plain + more
        assert html.extract(change(p.html), weights) == want.strip()


def test_html_without_main_elements(learned):
    """The same pages with a plain block around the text: names and tags bound it, and none of its text is lost."""
    weights, pages = learned
    exact = 0
    for p in pages:
        got, want = html.extract(re.sub(r"<(/?)article>", r"<\1div>", p.html), weights), article(p.html)
        exact += got == want
        assert want in got
    assert exact >= 0.98 * len(pages)


def test_html_best_region_is_the_best():
    rnd = random.Random(4)
    for _ in range(400):
        scores = [rnd.choice([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]) for _ in range(rnd.randrange(14))]
        every = [(sum(scores[a:b]), -b, -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        a, b = html.best_region(scores)
        top = max((e[0] for e in every), default=0.0)
        if top <= 0:
            assert (a, b) == (0, 0)
        else:
            assert sum(scores[a:b]) == top and b == -max(e for e in every if e[0] == top)[1]


def test_html_many_nested_names():
    page = "<div class=ad>" * 20000 + "x " * 30000 + "</div>" * 20000
    assert html.extract(page, {"word": 1.0, "marked word": -1.0, "": -1.0}) == " ".join(["x"] * 30000)


def test_html_tables(spark):
    schema = "page_id long, url string, html string, text string"
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x"), (None, "u", "<p>a b", "y"), (2, "u", "<p>a b", "y"), (2, "u", "<p>a b", "y")]
    assert sorted(r.n_chars for r in html.extract_pages(spark.createDataFrame(rows, schema)).collect()) == [0, 3, 3, 3]


def brute(rows, is_query, k):
    out = set()
    rows = sorted({(i, tuple(v)) for i, v in rows})
    for q, a in rows:
        if is_query(q):
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(near)}
    return out


def test_topk_whole_table(spark, sf):
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in read_table(spark, sf, "embeddings").collect()]
    got = queries.op9_topk(spark, sf).collect()
    assert {tuple(r) for r in got} == brute(rows, lambda q: q % 50 == 0, 5)


def test_topk_ties_nulls_and_copies(spark):
    schema = "vec_id long, embedding array<float>, label int"
    raw = [(i, [0.5, 0.25, -0.5], 0) for i in range(0, 30)] + [(i, [float(i % 7), -1.0, 0.125 * i], 1) for i in range(30, 60)]
    bad = [(60, None, 0), (61, [1.0, None, 0.0], 0), (62, [float("nan"), 0.0, 0.0], 0), (63, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (64, [1.0], 0), (65, [], 0)]
    table = spark.createDataFrame(raw + bad + raw[:3], schema)
    vectors = topk.integer_vectors(table, "vec_id", "embedding")
    got = {tuple(r)[:4] for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, 4).collect()}
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in raw + bad[5:]]
    assert got == brute(rows, lambda q: q % 10 == 0, 4)
    assert topk.top_k(topk.integer_vectors(spark.createDataFrame([], schema), "vec_id", "embedding"), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [2e7, 1e17, 1e200])
def test_topk_of_large_components(spark, size):
    rnd = random.Random(6)
    raw = [(i, [rnd.choice([-1.0, 1.0, 0.0, rnd.uniform(-1, 1), 1e-9]) * size for _ in range(6)]) for i in range(120)] + [(120 + i, [rnd.uniform(-2, 2) for _ in range(6)]) for i in range(60)]
    table = spark.createDataFrame(raw, "vec_id long, embedding array<double>")
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in raw]
    got = topk.top_k(topk.integer_vectors(table, "vec_id", "embedding"), F.col("vec_id") % 7 == 0, 5).collect()
    want = brute(rows, lambda q: q % 7 == 0, 5)
    assert {(r.query_id, r["rank"], r.vec_id, int(r.exact_score)) for r in got} == want
    held = lambda s: max(-(2**63), min(2**63 - 1, s))
    assert {(r.query_id, r["rank"], r.score) for r in got} == {(q, n, held(s)) for q, n, _, s in want}


def test_topk_bounds_hold():
    rng = np.random.default_rng(8)
    v, q = np.floor(rng.normal(size=(500, 9)) * 10.0 ** rng.integers(0, 15, 9)), np.floor(rng.normal(size=(20, 9)) * 1000)
    low = v.min(axis=0)
    width = (v.max(axis=0) - low) / 256
    lower, upper = topk.bounds(q, low, width, np.clip(np.floor((v - low) / width), 0, 255).astype(np.uint8))
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]
    assert all(lower[i, j] <= exact[i][j] <= upper[i, j] for i in range(20) for j in range(500))


def test_topk_keeps_few_bounds(spark, sf, monkeypatch):
    """Groups and blocks of any size give the same rows; candidates do not grow with the blocks of a group."""
    vectors = topk.integer_vectors(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    want = {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()}
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(topk, "BLOCK_GROUP", 4)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    assert {tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()} == want
