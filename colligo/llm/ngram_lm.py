"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

S(w | context) is count(context w) / count(context) where the n-gram was seen, else 0.4
times S with the context less its first word; a word alone has count(w) / N.  A
document's score is the sum of the logarithms.

Documents scored under their own counts have seen all of their n-grams.  Their score is
the sum over n-grams of log count(n-gram) - log count(head), the head being all words but
the last; of the lower orders at the start, only log count(first head) - log N is left.
So one table will do: n-grams are exploded per document with their heads and shuffled by
the head's hash.  There lie all rows of a head and of its n-grams: the counts are sums
over the partition, they join the rows where both lie, and the logarithms are summed per
document.  A document's last head, which begins no n-gram, is a row too, so that
count(head) is whole.  A row whose two counts are equal adds nothing and goes no further.
These rows are several times the input.  So heads are dealt by their hash to ``PASSES``
passes, and a pass takes the rows of its heads, all of them, and leaves a sum per document;
its shuffle files are deleted before the next pass writes its own.  Passes read the texts again.

Documents scored under another corpus back off.  As an n-gram is never seen more often
than its parts, a seen x1..xk changes the score by the same amount wherever it stands:
log of count(x1..xk) count(x2..xk-1) / (count(x1..xk-1) count(x2..xk) 0.4), above
0.4^(order - 1) count(w) / N for each word.  So every order is a table of the corpus' n-grams
with that amount, made from count tables by joins, and joined to the exploded n-grams.

A head with 1/512 of all n-grams would make one task large.  Its words have such a share
too, so there are 512 such words, heads and n-grams at most: they are counted first, in
tables of 512^2 rows at most, and every task gets those that pass.  Rows of such a head
are shuffled by the n-gram instead, and such n-grams not at all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colligo.llm import kernels
from colligo.llm.common import other_key, save

U64 = kernels.U64
BACKOFF, HEAVY, PASSES = 0.4, 512, 4
#: What a row of the exploded table stands for: an n-gram under its head, a last head, a first head, an n-gram of a frequent head.
GRAM, LAST, FIRST, ALONE = range(4)
COUNTED = "key long, n long, head long, tail long, inner long"
EXPLODED = "row long, head long, gram long, n int, kind int"
DOCUMENTS = "row long, doc_id long, n_words long, base double, short long"
Table = tuple[np.ndarray, np.ndarray]


def _batch(schema: str, size: int, **columns: object) -> pa.RecordBatch:
    """Columns that are not given are null."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in schema.split(", "))])
    signed = lambda x: x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == U64 else x
    return pa.RecordBatch.from_arrays([pa.array(signed(columns[f.name]), f.type) if f.name in columns else pa.nulls(size, f.type) for f in fields], schema=fields)


def _hashes(words: np.ndarray, k: int) -> np.ndarray:
    return words if k == 1 else kernels.ngrams(words, k, 31)


def _blocks(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, first word of each row, positions of k-grams, their rows) of blocks of documents."""
    for a, b, words, first in kernels.documents(column):
        owner = np.repeat(np.arange(b - a), np.diff(first))
        at = np.flatnonzero(owner[: len(owner) - k + 1] == owner[k - 1 :]) if len(owner) >= k else np.zeros(0, np.int64)
        yield a, words, first, at, owner[at]


def _tally(parts: Iterator[np.ndarray], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """(key, n) of the values of all parts, added up while they fit."""
    held: list[np.ndarray] = []
    size = 0

    def emit() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held or [np.zeros(0, U64)]), return_counts=True)
        return _batch("key long, n long", len(n), key=keys, n=n)

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= most:
            yield emit()
            held, size = [], 0
    yield emit()


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n): occurrences of each word, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _tally(words for batch in batches for _, _, words, _ in kernels.documents(batch["text"]))

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _table(df: DataFrame) -> Table:
    """At most ``HEAVY`` keys, in order, with their counts."""
    got = sorted((r["key"] & kernels.MASK, r["n"]) for r in df.collect())
    return np.array([k for k, _ in got], U64), np.array([n for _, n in got], np.int64)


def _find(table: Table, keys: np.ndarray) -> np.ndarray:
    """Counts of the keys, 0 for those not in the table."""
    if not len(table[0]):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def frequent(docs: DataFrame, counts: DataFrame, total: int, order: int) -> dict[int, Table]:
    """For each k up to ``order``, the k-grams with at least 1 / ``HEAVY`` of all words, and their counts."""
    often = F.col("n") * HEAVY >= max(total, 1)
    tables = {1: _table(counts.where(often))}
    for k in range(2, order + 1):
        shared = docs.sparkSession.sparkContext.broadcast((tables[1], tables[k - 1]))

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[np.ndarray]:
                one, less = shared.value
                for batch in batches:
                    for _, words, _, at, _ in _blocks(batch["text"], k):
                        at = at[_find(one, words[at + k - 1]) > 0]
                        at = at[_find(less, _hashes(words, k - 1)[at]) > 0]
                        yield _hashes(words, k)[at]

            yield from _tally(parts())

        tables[k] = _table(docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(often))
    return tables


def _documents(docs: DataFrame, order: int, total: int, known: dict[int, Table]) -> DataFrame:
    """The columns of ``DOCUMENTS``, and ``copies``, once for each row name of ``docs`` (row, doc_id, text).

    ``base`` is what needs no count from other rows, ``short`` names a text that is shorter than a head.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known[order - 1], known[order]))
    h = order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_grams = shared.value
        for batch in batches:
            names = batch["row"].to_numpy()
            for a, words, first, at, owner in _blocks(batch["text"], order):
                size = np.diff(first)
                heads = _hashes(words, h)
                of_head = _find(often, heads)
                # an n-gram as frequent has a head as frequent
                at, owner = at[of_head[at] > 0], owner[of_head[at] > 0]
                of_gram = _find(often_grams, _hashes(words, order)[at])
                base = np.where(size > 0, -np.log(max(total, 1)), 0.0)
                base += np.bincount(owner, np.log(np.maximum(of_gram, 1)) - np.log(of_head[at]), len(size))
                whole = np.flatnonzero(size >= h)
                base[whole] += np.log(np.maximum(of_head[first[whole]], 1))
                short = np.zeros(len(size), U64)
                for r in np.flatnonzero((size > 0) & (size < h)):
                    short[r] = _hashes(words[first[r] : first[r + 1]], int(size[r]))[0]
                yield _batch(DOCUMENTS, len(size), row=names[a : a + len(size)], doc_id=batch["doc_id"].slice(a, len(size)), n_words=size, base=base, short=short)

    rows = docs.mapInArrow(run, DOCUMENTS)
    return rows.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words", "base", "short")), F.count("*").alias("copies"))


def exploded(docs: DataFrame, order: int, known: dict[int, Table], turn: int, turns: int) -> DataFrame:
    """The rows of ``EXPLODED`` for ``docs`` (row, text) whose head leaves ``turn`` when divided by ``turns``."""
    shared = docs.sparkSession.sparkContext.broadcast((known[order - 1], known[order]))
    h = order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, often_grams = shared.value
        mine = lambda keys: keys % U64(turns) == U64(turn)
        for batch in batches:
            names = batch["row"].to_numpy()
            for a, words, first, at, owner in _blocks(batch["text"], order):
                size = np.diff(first)
                row = names[a : a + len(size)]
                heads, grams = _hashes(words, h), _hashes(words, order)
                alone = _find(often, heads)[at] > 0
                key = np.where(alone, grams[at], heads[at])
                taken = mine(key)
                taken[alone] &= _find(often_grams, key[alone]) == 0
                at, owner, key, alone = at[taken], owner[taken], key[taken], alone[taken]
                gram = grams[at]
                by = np.lexsort((gram, owner))
                owner, key, gram, alone = owner[by], key[by], gram[by], alone[by]
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])])) if len(by) else by
                whole = np.flatnonzero(size >= h)
                start, end = heads[first[whole]], heads[first[whole + 1] - h]
                starts, ends = (mine(x) & (_find(often, x) == 0) for x in (start, end))
                parts = [
                    (row[owner[new]], key[new], gram[new], np.diff(np.append(new, len(by))), np.where(alone[new], ALONE, GRAM)),
                    (row[whole[starts]], start[starts], start[starts], np.zeros(int(starts.sum()), np.int64), np.full(int(starts.sum()), FIRST)),
                    (row[whole[ends]], end[ends], end[ends], np.ones(int(ends.sum()), np.int64), np.full(int(ends.sum()), LAST)),
                ]
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield _batch(EXPLODED, len(columns[0]), **dict(zip(("row", "head", "gram", "n", "kind"), columns, strict=True)))

    return docs.select("row", "text").mapInArrow(run, EXPLODED)


def gram_counts(docs: DataFrame, k: int) -> DataFrame:
    """(key, n, head, tail, inner): occurrences of each k-gram, and the hashes of its words but the last, but the first, and but both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, _, at, _ in _blocks(batch["text"], k):
                keys, first, n = np.unique(_hashes(words, k)[at], return_index=True, return_counts=True)
                at, less = at[first], _hashes(words, max(k - 1, 1))
                inner = _hashes(words, k - 2)[at + 1] if k > 2 else np.zeros(len(at), U64)
                yield _batch(COUNTED, len(n), n=n, key=keys, head=less[at], tail=less[at + min(k - 1, 1)], inner=inner)

    parts = docs.select("text").mapInArrow(run, COUNTED)
    return parts.groupBy("key").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("head", "tail", "inner")))


def _own_scores(keyed: DataFrame, order: int) -> DataFrame:
    """row, doc_id, n_words, log_score, copies: documents under their own counts."""
    counts = save(word_counts(keyed), "words", release=True)
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = frequent(keyed, counts, total, order)
    own = save(_documents(keyed, order, total, known), "documents", release=True)
    part = F.when(F.col("kind") == GRAM, F.col("n") * (F.log("of_gram") - F.log("of_head"))).when(F.col("kind") == ALONE, F.col("n") * F.log("of_head"))
    # a first head counts in its last or its n-grams' rows, so of_head is 1 at least
    part = part.when(F.col("kind") == FIRST, F.log("of_head")).otherwise(0.0)
    sums = []
    for turn in range(PASSES):
        rows = exploded(keyed, order, known, turn, PASSES).repartition("head")
        # in this order one sort serves both windows
        rows = rows.withColumn("of_gram", F.sum("n").over(Window.partitionBy("head", "gram"))).withColumn("of_head", F.sum("n").over(Window.partitionBy("head")))
        # sums within the tasks of heads would hardly meet two rows of a document, so rows cross as they are
        rows = rows.select("row", part.alias("part")).where("part != 0").repartition("row")
        sums.append(save(rows.groupBy("row").agg(F.sum("part").alias("part")), f"sums{turn}", release=True))
    summed = functools.reduce(DataFrame.union, sums).groupBy("row").agg(F.sum("part").alias("part"))
    done = own.join(summed, "row", "left").withColumn("log_score", F.col("base") + F.coalesce(F.col("part") / F.col("copies"), F.lit(0.0)))
    done = save(done.select("row", "log_score", "n_words", "doc_id", "short", "copies"), "scores", release=True)
    out = done.where(f"n_words = 0 or n_words >= {order - 1}").drop("short")
    for m in range(1, order - 1):  # texts shorter than a head are one m-gram
        table = (counts if m == 1 else gram_counts(keyed, m)).select(F.col("key").alias("short"), "n")
        mine = done.where(F.col("n_words") == m).join(table, "short").withColumn("log_score", F.col("log_score") + F.log("n"))
        out = out.unionByName(mine.drop("short", "n"))
    return out


def _exploded_grams(keyed: DataFrame, k: int) -> DataFrame:
    """(row, key, times) of each document's k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch["row"].to_numpy()
            for a, words, _, at, owner in _blocks(batch["text"], k):
                keys = _hashes(words, k)[at]
                by = np.lexsort((keys, owner))
                keys, owner = keys[by], owner[by]
                new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])) if len(keys) else by
                yield _batch("row long, key long, times long", len(new), row=row[a + owner[new]], key=keys[new], times=np.diff(np.append(new, len(keys))))

    return keyed.mapInArrow(run, "row long, key long, times long")


def _backed_scores(keyed: DataFrame, corpus: DataFrame, order: int) -> DataFrame:
    """The same under the counts of ``corpus``; a word that it lacks counts as seen once."""
    counts = [save(gram_counts(corpus, k), f"grams{k}") for k in range(1, order + 1)]
    total = counts[0].agg(F.sum("n")).first()[0] or 0
    log_total = F.log(F.lit(float(max(total, 1))))
    parts = None
    for k, table in enumerate(counts, 1):
        gains = table
        for name, size in (("head", k - 1), ("tail", k - 1), ("inner", k - 2)):
            if size > 0:
                gains = gains.join(counts[size - 1].select(other_key("key").alias("k2"), F.col("n").alias(f"n_{name}")), other_key(name) == F.col("k2")).drop("k2")
        known = lambda c: F.log(c) if c in gains.columns else log_total  # noqa: B023, E731
        gain = F.log("n") if k == 1 else F.log("n") + known("n_inner") - F.log("n_head") - F.log("n_tail") - F.log(F.lit(BACKOFF))
        seen = _exploded_grams(keyed, k).join(gains.select(other_key("key").alias("k2"), gain.alias("gain")), other_key("key") == F.col("k2"))
        one = seen.select("row", (F.col("times") * F.col("gain")).alias("part"))
        parts = one if parts is None else parts.union(one)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(first) for _, _, _, first in kernels.documents(batch["text"])]
            yield _batch("row long, doc_id long, n_words long", batch.num_rows, row=batch["row"], doc_id=batch["doc_id"], n_words=np.concatenate(n or [np.zeros(0, np.int64)]))

    own = keyed.mapInArrow(sizes, "row long, doc_id long, n_words long").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    floor = F.col("n_words") * ((order - 1) * F.log(F.lit(BACKOFF)) - log_total) - F.greatest(F.lit(0), *_missing(order)) * F.log(F.lit(BACKOFF))
    sums = parts.groupBy("row").agg(F.sum("part").alias("part"))
    scored = own.join(sums, "row", "left").withColumn("log_score", floor + F.coalesce(F.col("part") / F.col("copies"), F.lit(0.0)))
    return scored.drop("part")


def _missing(order: int) -> list:
    """How many factors 0.4 the words at a text's start, which have less context, do not take."""
    return [functools.reduce(lambda a, b: a + b, [F.least(F.col("n_words"), F.lit(k)) for k in range(1, order)])]


def score(docs: DataFrame, corpus: DataFrame | None = None, order: int = 3) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of every row of ``docs`` (doc_id, text).

    The counts are those of all rows of ``corpus`` (text), or of ``docs`` itself.  N-grams have
    ``order`` words at most, and two at least.  Words are those between white space,
    unchanged.  A null or wordless text has 0 words, log_score 0 and a null mean.  Rows
    that repeat an id and a text all count, and get the same score.  Null ids stay
    null.  Other columns, whatever their names, are not read.  An empty table gives an
    empty result; an empty corpus scores every word as seen once.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    # rows are named by content, so that a task that runs again names them alike
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = _own_scores(keyed, order) if corpus is None else _backed_scores(keyed, corpus, order)
    done = done.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.drop("col")


def oracle_sql() -> str:
    return r"""
with t as (select row_number() over (order by doc_id) as r, doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w from documents),
e as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from t),
p as (select r, i, w, lag(w) over (partition by r order by i) as v, lag(w, 2) over (partition by r order by i) as u from e),
c1 as (select w, count(*) as c from e group by w),
c2 as (select v, w, count(*) as c from p where v is not null group by v, w),
c3 as (select u, v, w, count(*) as c from p where u is not null group by u, v, w),
n as (select count(*) as n from e),
s as (select p.r, case when p.v is null then ln(a.c / n.n) when p.u is null then ln(b.c / h.c) else ln(g.c / k.c) end as s
      from p cross join n join c1 a on a.w = p.w left join c1 h on h.w = p.v left join c2 b on b.v = p.v and b.w = p.w
      left join c2 k on k.v = p.u and k.w = p.v left join c3 g on g.u = p.u and g.v = p.v and g.w = p.w),
d as (select r, sum(s) as s from s group by r)
select t.doc_id, cast(len(t.w) as bigint) as n_words, round(coalesce(d.s, 0.0), 3) as log_score, round(d.s / nullif(len(t.w), 0), 3) as mean_log_score
from t left join d on d.r = t.r"""


def backoff_sql(learned: str) -> str:
    """Order 3 under the counts of the documents for which ``learned`` holds; a word that they lack counts as seen once."""
    return rf"""
with t as (select row_number() over (order by doc_id) as r, doc_id, {learned} as learned, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) as w from documents),
e as (select r, learned, unnest(w) as w, generate_subscripts(w, 1) as i from t),
p as (select r, learned, i, w, lag(w) over (partition by r order by i) as v, lag(w, 2) over (partition by r order by i) as u from e),
c1 as (select w, count(*) as c from e where learned group by w), c2 as (select v, w, count(*) as c from p where learned and v is not null group by v, w),
c3 as (select u, v, w, count(*) as c from p where learned and u is not null group by u, v, w), n as (select greatest(count(*), 1) as n from e where learned),
s as (select p.r, case when g.c is not null then ln(g.c / k.c) when b.c is not null then ln(b.c / h.c) + (case when p.u is null then 0 else ln({BACKOFF}) end)
      else ln(coalesce(a.c, 1) / n.n) + (case when p.v is null then 0 when p.u is null then 1 else 2 end) * ln({BACKOFF}) end as s
      from p cross join n left join c1 a on a.w = p.w left join c1 h on h.w = p.v left join c2 b on b.v = p.v and b.w = p.w
      left join c2 k on k.v = p.u and k.w = p.v left join c3 g on g.u = p.u and g.v = p.v and g.w = p.w),
d as (select r, sum(s) as s from s group by r)
select t.doc_id, cast(len(t.w) as bigint) as n_words, round(coalesce(d.s, 0.0), 3) as log_score, round(d.s / nullif(len(t.w), 0), 3) as mean_log_score
from t left join d on d.r = t.r"""
