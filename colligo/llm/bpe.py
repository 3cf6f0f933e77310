"""Byte-pair encoding through a distinct-word table, and decoding through an id-to-piece table.

Texts are split into words in Spark tasks.  No word crosses ASCII white space, so a task
numbers the distinct runs between white space of a block of texts and splits each of those
once.  All distinct words are counted; those of the table, the most frequent up to a stated
bound, are encoded once for the whole corpus and sent to every task.  A task encodes each
further word of its block once, and joins ids back by position: words become row numbers of
a table of id lists, and one gather puts the lists in the order of a run, a second one
those of runs in the order of the text.  Decoding gathers pieces by id.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.kernels import slices

#: Bounds of the table that every task gets: so many words, each of so many characters at most.
TABLE_WORDS, TABLE_CHARS = 1 << 16, 64
#: Bytes of texts that a task splits at a time.
BLOCK = 4 << 20
#: Runs that the library splits: empty ones, those that may hold a special token, and those with a
#: character on which Arrow's Unicode tables might differ, or that is white space beyond ASCII.
OTHER = r"\A\z|<\||[^\x00-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{20ac}]"


@dataclass
class Codec:
    """The rules of one tokenizer file: a BPE model with word ends over a splitting pattern."""

    path: str

    def __post_init__(self) -> None:
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split

        with open(self.path, encoding="utf-8") as f:
            rules = json.load(f)
        split, byte_level = rules["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in rules["normalizer"]["normalizers"]], split["type"], byte_level["type"], rules["decoder"], rules["post_processor"]
        if kinds != (["NFC", "Replace", "Lowercase"], "Split", "ByteLevel", None, None):
            raise ValueError(f"{self.path} is no lower-case word BPE: {kinds}")
        self.pattern = split["pattern"]["Regex"]
        self.library = Tokenizer.from_file(self.path)
        self.model, self.normalizer = self.library.model, self.library.normalizer
        self.bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = Split(Regex(self.pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.apart = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        pieces = self.library.get_vocab(with_added_tokens=True)
        self.pieces: list[str | None] = [None] * (max(pieces.values()) + 1)
        for piece, i in pieces.items():
            self.pieces[i] = piece

    def _plain_words(self, text: str) -> list[str]:
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        """Words in order; a special token's own string is a word of its own kind, marked by a leading line feed."""
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append("\n" + m[0])
            at = m.end()
        return out + self._plain_words(text[at:])

    def ids(self, word: str) -> list[int]:
        if word[0] == "\n":
            return [self.special[word[1:]]]
        if word.isascii() and word.isprintable():  # each byte stands for itself
            return [t.id for t in self.model.tokenize(word)]
        return [t.id for raw, _ in self.bytes.pre_tokenize_str(word) for t in self.model.tokenize(raw)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


class Block(NamedTuple):
    """Texts as row numbers: of the distinct runs in each text, and of the distinct words in each run."""

    words: pa.Array
    run_words: np.ndarray
    run_ends: np.ndarray
    text_runs: np.ndarray
    text_ends: np.ndarray


def _ends(lists: pa.ListArray) -> np.ndarray:
    return np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)


def split(rules: Codec, texts: pa.Array) -> Block:
    """Words of all texts, each distinct run between ASCII white space split once; null counts as empty."""
    per_text = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    runs = per_text.flatten().dictionary_encode()
    other = pc.match_substring_regex(runs.dictionary, OTHER)
    lower = pc.utf8_lower(runs.dictionary.filter(pc.invert(other)))
    plain = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(lower, rules.pattern, r"\0 ")))
    rest = pa.array([rules.words(r) for r in runs.dictionary.filter(other).to_pylist()], plain.type)
    mask = other.to_numpy(zero_copy_only=False)
    place = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
    per_run = pa.concat_arrays([plain, rest])
    words = per_run.flatten().dictionary_encode()
    return Block(words.dictionary, words.indices.to_numpy(), _ends(per_run), place[runs.indices.to_numpy()], _ends(per_text))


def gather(lists: pa.ListArray, rows: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The lists that ``rows`` name, joined in order; ``ends`` says after how many of them each joined list ends."""
    placed = lists.take(pa.array(rows, pa.int32()))
    offs = np.concatenate([[0], _ends(placed)])[np.concatenate([[0], ends])]
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), placed.flatten())


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = codec(path)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                b = split(rules, part["text"])
                times = np.repeat(np.bincount(b.text_runs, minlength=len(b.run_ends)), np.diff(b.run_ends, prepend=0))
                n = np.bincount(b.run_words, times, len(b.words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, most: int = TABLE_WORDS) -> pa.Table:
    """(word, ids): the ``most`` frequent distinct words with their ids (ties: the word itself), each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array([rules.ids(w) for w in batch["word"].to_pylist()], pa.list_(pa.int32()))], names=["word", "ids"])

    head = distinct_words(docs, path).where(F.length("word") <= TABLE_CHARS).orderBy(F.desc("n"), "word").limit(most)
    return head.select("word").mapInArrow(run, "word string, ids array<int>").toArrow().combine_chunks()


def encode(docs: DataFrame, path: str, most: int = TABLE_WORDS) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text); a null or empty text has no ids.

    Repeated rows are encoded alike; null doc_ids stay null.  Other columns, whatever their
    names, are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(word_table(docs, path, most))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = codec(path)
        shared = {w: k for k, w in enumerate(table.value["word"].to_pylist())}
        shared_ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(c.cast(pa.list_(pa.int32())) for c in table.value["ids"].chunks)])
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                b = split(rules, part["text"])
                new: list[list[int]] = []
                rows = np.empty(len(b.words), np.int32)
                for i, w in enumerate(b.words.to_numpy(zero_copy_only=False)):
                    k = shared.get(w)
                    if k is None:
                        k = len(shared) + len(new)
                        new.append(rules.ids(w))
                    rows[i] = k
                by_word = pa.concat_arrays([shared_ids, pa.array(new, pa.list_(pa.int32()))])
                by_run = gather(by_word, rows[b.run_words], b.run_ends)
                yield pa.RecordBatch.from_arrays([part["doc_id"], gather(by_run, b.text_runs, b.text_ends)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` and decoded: pieces joined by one space; ids without a piece are left out.

    Null ids give an empty text.  A column of ``encoded`` named decoded gives way.
    """
    encoded = encoded.drop("decoded")
    columns = encoded.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded string"
    table = encoded.sparkSession.sparkContext.broadcast(pa.array(codec(path).pieces, pa.string()))  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table.value
        for batch in batches:
            lists = batch["ids"]
            step = max(1, int(1_000_000 * len(lists) / max(1, len(lists.flatten()))))
            for a in range(0, len(lists), step):
                part = batch.slice(a, step)
                ids = pc.fill_null(pc.list_value_length(part["ids"]), 0).to_numpy(zero_copy_only=False)
                flat = part["ids"].flatten()
                known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
                placed = pieces.take(pc.if_else(pc.fill_null(known, False), flat, pa.scalar(None, pa.int32())))
                there = pc.is_valid(placed).to_numpy(zero_copy_only=False)
                offs = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(ids)]).astype(np.int64)].astype(np.int32)
                text = pc.binary_join(pa.ListArray.from_arrays(offs, placed.drop_null()), " ")
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*columns, "decoded"])

    return encoded.mapInArrow(run, schema)
