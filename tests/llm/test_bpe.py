import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from colligo.llm import bpe, queries
from colligo.llm.common import read_table

PATH = queries.tokenizer_path()
SCHEMA = "doc_id long, text string, ids string, word string, n int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table_matches_library(spark, sf, library):
    want = {}
    for r in read_table(spark, sf, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
    got = queries.op7_bpe(spark, sf).collect()
    assert len(got) == len(want) and {r.doc_id: tuple(r) for r in got} == want


def test_odd_texts(spark, library):
    texts = [
        None, "", " \n", "I'll say it's 1234 x's!!", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "Ünïcödé é é İ ſ", "ΑΣ Σίσυφος 漢字 हिन्दी 👩‍👩‍👧 ՘",
        "nbsp x y\u0085z\x1cq", "x" * 70000, "same same " * 20000, "​ zero", "ﬁ ǅ ẞ", "<|endoftext|>",
    ]
    rows = [(None if k == 5 else k // 2, t, "i", "w", k) for k, t in enumerate(texts)]
    for most in (10, bpe.TABLE_WORDS):
        got = bpe.decode(bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, most), PATH).collect()
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        key = lambda pair: (str(pair[0]), pair[1])
        assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((r[0], w) for r, w in zip(rows, want, strict=True)), key=key)
        assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in got)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    unknown = spark.createDataFrame([(1, [1, 10**6, -1, 2]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(unknown, PATH).orderBy("doc_id").collect()][:2] == [library.decode([1, 2]), ""]


def ids_of(rules, texts):
    """Ids through the split of a block, without tables."""
    b = bpe.split(rules, pa.array(texts, pa.string()))
    words = [rules.ids(w) for w in b.words.to_pylist()]
    runs = [[i for w in part for i in words[w]] for part in np.split(b.run_words, b.run_ends[:-1])]
    return [[i for r in part for i in runs[r]] for part in np.split(b.text_runs, b.text_ends[:-1])]


def test_split_agrees_with_library_on_characters(library):
    rules = bpe.codec(PATH)
    usual = [c for c in map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x20AC]) if not re.search(r"\s", c)]
    rest = [*map(chr, [*range(0x250, 0x3100, 7), *range(0xA640, 0xFFFE, 501), *range(0x10000, 0x30000, 4001)]), *" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0  　"]
    texts = [f"a{c}b {c} {c}{c}'{c}s 'S{c}1{c}2\v{c}́x{c}'LL I'D{c} \x0c" for c in usual + [c for c in rest if not "\ud800" <= c <= "\udfff"]]
    assert ids_of(rules, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_run_is_split_once_a_block(monkeypatch):
    """The library splits a block's distinct other runs, once each; the rest pass one pattern search, and no text is split word by word."""
    rules, split, encoded = bpe.codec(PATH), [], []
    words, ids = bpe.Codec.words, bpe.Codec.ids
    monkeypatch.setattr(bpe.Codec, "words", lambda self, t: split.append(t) or words(self, t))
    monkeypatch.setattr(bpe.Codec, "ids", lambda self, w: encoded.append(w) or ids(self, w))
    texts = ["The cat, the CAT; καὶ ΣΑΣ cat<|endoftext|> " * 50, "καὶ the  cat,\n" * 70, None, ""]
    b = bpe.split(rules, pa.array(texts))
    assert sorted(split) == sorted(["", "cat<|endoftext|>", "καὶ", "ΣΑΣ"])
    assert sorted(b.words.to_pylist()) == sorted(["the", "cat", ",", ";", "καὶ", "σασ", "\n<|endoftext|>"])
    assert len(b.run_ends) == 8 and len(b.text_ends) == 4 and not encoded


def test_counts_of_distinct_words(spark):
    """Counts weigh a run by all its occurrences, in plain runs and others, over several blocks."""
    texts = ["It's it's IT, καὶ 12 x" * 3, "καὶ,  it", None, "<|endoftext|>it"] * 40
    rules = bpe.codec(PATH)
    want = Counter(w for t in texts for w in rules.words(t or ""))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = bpe.distinct_words(docs, PATH).collect()
    assert len(got) == len(want) and {r.word: r.n for r in got} == want
