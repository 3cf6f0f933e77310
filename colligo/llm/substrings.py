"""Removal of long word sequences that an earlier document already holds.

Every window of ``window`` words has an anchor, the least hash of its short word
n-grams (the leftmost, in ties); windows in a row with the same anchor position form
a segment.  Equal windows have equal anchors, so a repeated window lies in segments
whose anchor occurs in two documents.  Only those go on.  Equal segments become one,
with the smallest doc_id.  Segments are dealt to shards by anchor.  Each shard builds an
FM-index of its earlier documents' segments and streams those of the later ones through
backward search: where the match reaches ``window`` words, the interval's group of
suffixes has the smallest doc_id of the earlier documents that hold the window.
A segment of which the same task has an equal one with a smaller doc_id is repeated as a
whole, and no window's earliest holder.  So it is settled where it is made, one row for those
in a row, and a common passage goes on once a task, not once a document.
Anchors with very many different segments would make one shard large; their windows
are compared as rows of an ordinary aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm import kernels
from colligo.llm.common import save
from colligo.llm.fmindex import FMIndex

U64 = kernels.U64
ANCHOR_WORDS = 8
#: Words that a shard's index holds before it is searched and dropped, and segments of one anchor beyond which windows are aggregated.
SHARD_WORDS, ANCHOR_SEGMENTS = 1_500_000, 5_000
#: Segments that a task holds to find equal ones among them.
HELD_SEGMENTS = 200_000
#: A row without an anchor stands for windows that an earlier document of the same task has too.
SEGMENT = "doc_key long, doc_id long, start int, windows int, anchor long, content long"


def anchors(words: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of every segment."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    grams = kernels.ngrams(words, k, 23)
    width = window - k + 1
    place = np.empty(len(words) - window + 1, np.int64)
    for a in range(0, len(place), 1 << 16):
        b = min(len(place), a + (1 << 16))
        place[a:b] = np.lib.stride_tricks.sliding_window_view(grams[a : b + width - 1], width).argmin(axis=1) + np.arange(a, b)
    begins = np.flatnonzero(np.diff(place, prepend=-1))
    return begins, np.diff(begins, append=len(place)), grams[place[begins]]


def content_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of words[begins[i]:ends[i]] for all i, from prefix sums."""
    power, inverse = kernels._power_tables(len(words) + 1)
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(words * power[: len(words)], dtype=U64)])
    return kernels.mix((prefix[ends] - prefix[begins]) * inverse[begins] ^ kernels.mix((ends - begins).astype(U64)))


def settled(key: np.ndarray, ids: np.ndarray, start: np.ndarray, windows: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
    """``SEGMENT`` rows: segments with a smaller doc_id's equal one among them become rows without an anchor, those in a row one."""
    by = np.lexsort((ids, anchor, content))
    new = np.flatnonzero(np.concatenate([[True], (content[by][1:] != content[by][:-1]) | (anchor[by][1:] != anchor[by][:-1])])) if len(by) else by
    least = np.empty(len(ids), np.int64)
    least[by] = np.repeat(ids[by][new], np.diff(np.append(new, len(by))))
    copied, stays = np.flatnonzero(ids > least), np.flatnonzero(ids <= least)
    end = start + windows
    head = np.ones(len(copied), bool)
    head[1:] = (np.diff(copied) != 1) | (key[copied][1:] != key[copied][:-1]) | (start[copied][1:] != end[copied][:-1])
    first, last = copied[head], copied[np.append(head[1:], True)] if len(copied) else copied
    rows = np.concatenate([stays, first])
    gone = np.arange(len(rows)) >= len(stays)
    size = np.concatenate([windows[stays], end[last] - start[first]])
    columns = [pa.array(key[rows]), pa.array(ids[rows]), pa.array(start[rows], pa.int32()), pa.array(size, pa.int32()), *(pa.array(x[rows].view(np.int64), mask=gone) for x in (anchor, content))]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SEGMENT.split(", ")])


def segments(docs: DataFrame, window: int, k: int, held_segments: int = HELD_SEGMENTS) -> DataFrame:
    """Segments of all rows of ``docs`` (doc_key, doc_id, text), see ``settled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        size = 0
        for batch in batches:
            key, ids = batch["doc_key"].to_numpy(), batch["doc_id"].to_numpy()
            for a, b, words, first in kernels.documents(batch["text"]):
                for r in range(b - a):
                    mine = words[first[r] : first[r + 1]]
                    begins, count, anchor = anchors(mine, window, k)
                    size += len(begins)
                    row = (np.full(len(begins), key[a + r]), np.full(len(begins), ids[a + r]), begins, count, anchor, content_hashes(mine, begins, begins + count + window - 1))
                    for have, new in zip(held, row, strict=True):
                        have.append(new)
                if size >= held_segments:
                    yield settled(*map(np.concatenate, held))
                    held, size = [[] for _ in range(6)], 0
        if size:
            yield settled(*map(np.concatenate, held))

    return docs.where("doc_id is not null").select("doc_key", "doc_id", "text").mapInArrow(run, SEGMENT)


def segment_words(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The word hashes of segments, from one document that holds each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["places"].to_pylist()
            for a, b, words, first in kernels.documents(batch["text"]):
                rows = []
                for r in range(b - a):
                    for p in lists[a + r]:
                        at = first[r] + p["start"]
                        rows.append((p["anchor"], p["content"], p["first_id"], p["hot"], words[at : at + p["windows"] + window - 1].tobytes()))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "content", "first_id", "hot", "words"])

    return docs.join(places, "doc_key").select("text", "places").mapInArrow(run, "anchor long, content long, first_id long, hot boolean, words binary")


def _runs(flags: np.ndarray) -> list[dict]:
    """Intervals [a, b) of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


RUNS = "anchor long, content long, runs array<struct<a:int,b:int>>"
RUNS_ARROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def _regions(sequences: list[np.ndarray], grams: np.ndarray, window: int, k: int) -> list[tuple[int, int, np.ndarray]]:
    """(sequence, first window, words) of the runs of windows whose k-word n-grams are all among ``grams``."""
    flat, sizes = np.concatenate(sequences), np.array([len(s) for s in sequences])
    owner, begins = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    count = np.concatenate([[0], np.cumsum(np.isin(kernels.ngrams(flat, k, 23), grams))])
    width, n = window - k + 1, len(flat) - window + 1
    whole = (count[width : width + n] - count[:n] == width) & (owner[:n] == owner[window - 1 :])
    return [(int(owner[r["a"]]), int(r["a"] - begins[owner[r["a"]]]), flat[r["a"] : r["b"] + window - 1]) for r in _runs(whole)]


def search_shard(keys: list[tuple[int, int]], first_ids: list[int], sequences: list[np.ndarray], window: int, k: int = ANCHOR_WORDS) -> pa.RecordBatch:
    """Runs of windows of each segment that a segment with a smaller doc_id has too.

    Segments stand by anchor and, within one, by doc_id.  The earlier half of each
    anchor's segments is indexed, and the later half is streamed against it; then both
    halves are halved in turn, until every pair of one anchor was on the two sides once.
    Where a short n-gram is on one side only, no window can be on both: such parts are
    neither indexed nor streamed.
    """
    seen = [np.zeros(len(s) - window + 1, bool) for s in sequences]
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i][0] != keys[i - 1][0]), len(keys)]
    parts = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
    while parts:
        sides = [[i for a, b in parts for i in range(a, (a + b) // 2)], [i for a, b in parts for i in range((a + b) // 2, b)]]
        texts = [[sequences[i] for i in side] for side in sides]
        grams = [np.unique(kernels.ngrams(np.concatenate(t), k, 23)) for t in texts]
        earlier, later = (_regions(t, g, window, k) for t, g in zip(texts, grams[::-1], strict=True))
        if earlier and later:
            index = FMIndex([w for _, _, w in earlier], window, [first_ids[sides[0][i]] for i, _, _ in earlier])
            for (i, at, words), groups in zip(later, index.stream([w for _, _, w in later]), strict=True):
                groups = groups[: len(words) - window + 1]
                seen[sides[1][i]][at : at + len(groups)] |= (groups >= 0) & (index.least[groups] < first_ids[sides[1][i]])
        parts = [(a, b) for x, y in parts for a, b in ((x, (x + y) // 2), ((x + y) // 2, y)) if b - a > 1]
    out = [{"anchor": anchor, "content": content, "runs": runs} for (anchor, content), flags in zip(keys, seen, strict=True) if (runs := _runs(flags))]
    return pa.RecordBatch.from_pylist(out, RUNS_ARROW)


def indexed_runs(rows: DataFrame, window: int, k: int, shard_words: int) -> DataFrame:
    """Runs of repeated windows from an index per shard; rows of an anchor are in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        ids: list[int] = []
        sequences: list[np.ndarray] = []
        held, anchor = 0, None
        for batch in batches:
            for a, c, i, w in zip(*(batch[n].to_pylist() for n in ("anchor", "content", "first_id", "words")), strict=True):
                if a != anchor and held >= shard_words:
                    yield search_shard(keys, ids, sequences, window, k)
                    keys, ids, sequences, held = [], [], [], 0
                anchor = a
                keys.append((a, c))
                ids.append(i)
                sequences.append(np.frombuffer(w, U64))
                held += len(sequences[-1])
        if keys:
            yield search_shard(keys, ids, sequences, window, k)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "first_id", "content").select("anchor", "content", "first_id", "words").mapInArrow(run, RUNS)


def aggregated_runs(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments, window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for w in batch["words"].to_pylist():
                words = np.frombuffer(w, U64)
                begins = np.arange(len(words) - window + 1)
                lists.append(content_hashes(words, begins, begins + window).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["anchor"], batch["content"], batch["first_id"], pa.array(lists, pa.list_(pa.int64()))], names=["anchor", "content", "first_id", "hashes"])

    each = rows.select("anchor", "content", "first_id", "words").mapInArrow(run, "anchor long, content long, first_id long, hashes array<long>")
    each = each.select("anchor", "content", "first_id", F.posexplode("hashes").alias("a", "window"))
    least = each.groupBy("anchor", "window").agg(F.min("first_id").alias("least")).select(F.col("anchor").alias("anchor2"), F.col("window").bitwiseXOR(F.lit(1)).alias("window2"), "least")
    seen = each.join(least, (F.col("anchor") == F.col("anchor2")) & (F.col("window").bitwiseXOR(F.lit(1)) == F.col("window2"))).where("least < first_id")
    one = F.struct(F.col("a").cast("int").alias("a"), (F.col("a") + 1).cast("int").alias("b"))
    return seen.groupBy("anchor", "content").agg(F.collect_list(one).alias("runs"))


def repeated_spans(docs: DataFrame, window: int = 50, k: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS, anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """(doc_key, spans array<struct<a,b>>): words [a, b) of a row that repeated windows cover. ``docs``: (doc_key, doc_id, text)."""
    made = save(segments(docs, window, k), "segments")
    copies = made.where("anchor is null").select("doc_key", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows") + (window - 1)).alias("b"))).alias("spans"))
    found = made.where("anchor is not null")
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    found = save(found.join(shared.select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("anchor2")), F.col("anchor").bitwiseXOR(F.lit(1)) == F.col("anchor2"), "left_semi"), "segments")
    kinds = save(found.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_key", "start", "windows")).alias("at")), "segments")
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("n")).select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("anchor2"), (F.col("n") > anchor_segments).alias("hot"), F.col("n").alias("kinds"))
    # the words of a segment whose anchor has no other are not needed: only equal copies repeat it
    placed = kinds.join(hot.where("kinds > 1"), F.col("anchor").bitwiseXOR(F.lit(1)) == F.col("anchor2"))
    places = placed.groupBy("at.doc_key").agg(F.collect_list(F.struct("at.start", "at.windows", "anchor", "content", "first_id", "hot")).alias("places"))
    rows = save(segment_words(docs, places, window), "words")
    runs = indexed_runs(rows.where("not hot"), window, k, shard_words).union(aggregated_runs(rows.where("hot"), window))
    named = kinds.join(runs, ["anchor", "content"], "left").select(F.col("anchor").alias("anchor2"), F.col("content").bitwiseXOR(F.lit(1)).alias("content2"), "first_id", "runs")
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("windows").alias("b")))
    spans = found.join(named, (F.col("anchor") == F.col("anchor2")) & (F.col("content").bitwiseXOR(F.lit(1)) == F.col("content2")))
    spans = spans.select("doc_key", "start", F.when(F.col("doc_id") > F.col("first_id"), whole).otherwise(F.col("runs")).alias("runs")).where("runs is not null")
    placed_runs = F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"] + (window - 1)).alias("b")))
    return spans.select("doc_key", placed_runs.alias("spans")).union(copies).groupBy("doc_key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 50, keep: list[str] | None = None, **tuning: int) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept of every row of ``docs`` (doc_id, text).

    A word is removed if a window of ``window`` words that covers it starts in a
    document with a smaller doc_id too; ``kept`` is what is left, joined by one space.
    Windows are judged on the input.  Null and empty texts have no words.  Rows with a null
    doc_id keep all words and are no source; rows that repeat a doc_id are no source to
    each other.  The columns named in ``keep`` are passed on, but for those named like an
    output, which give way to it.  An empty table gives an empty result.
    """
    keep = [c for c in keep or [] if c not in ("doc_id", "text", "n_words", "n_removed", "kept")]
    others = {f"other_{n}": F.col(c) for n, c in enumerate(keep or [])}
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("doc_key"), F.struct(*[c.alias(n) for n, c in others.items()] or [F.lit(0).alias("none")]).alias("others"))
    spans = repeated_spans(keyed.select("doc_id", "text", "doc_key"), window, **tuning)
    space = bytes([32])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.slices(batch, "text"):
                data, offs = kernels.utf8(part["text"])
                starts, ends, first = kernels.spans(data, offs)
                raw = data.tobytes()
                total, removed, kept = [], [], []
                for r, mine in enumerate(part["spans"].to_pylist()):
                    s, e = starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]]
                    gone = np.zeros(len(s) + 1, np.int64)
                    for x in mine or ():
                        gone[x["a"]] += 1
                        gone[x["b"]] -= 1
                    keep = np.cumsum(gone)[:-1] <= 0
                    total.append(len(s))
                    removed.append(len(s) - int(keep.sum()))
                    kept.append(space.join([raw[x:y] for x, y in zip(s[keep], e[keep], strict=True)]).decode())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), part["others"]], names=["doc_id", "text", "n_words", "n_removed", "kept", "others"]
                )

    joined = keyed.join(spans, "doc_key", "left").select("doc_id", "text", "spans", "others")
    done = joined.mapInArrow(run, f"doc_id long, text string, n_words long, n_removed long, kept string, others {dict(keyed.dtypes)['others']}")
    return done.select("doc_id", "text", "n_words", "n_removed", "kept", *[F.col(f"others.other_{n}").alias(c) for n, c in enumerate(keep or [])])
