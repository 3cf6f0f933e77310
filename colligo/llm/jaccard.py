"""Set similarity join over word n-grams: index lists, block skips by position, answers from similar sets.

All n-grams have one global order, from buckets that few n-grams fall into to full ones.
Two sets of Jaccard similarity s share an n-gram among the first (1 - s) |set| + 1 of
each, so only these are indexed.

* Sets that are equal are one class.  Every list of an n-gram has a leading class, and
  the others are compared with it; those that are similar enough are of its component.
* What is left must link different components.  In a list of many components, what is near the
  leading set is left to the last step.  The rest becomes blocks of one component, one
  size band and the bounds of sizes and positions in it.  Blocks of other bands are
  never met, and a pair of blocks is skipped if its positions leave too few n-grams
  for a similar pair, or if its components share too few indexed n-grams in all.
* Components that stay open against each other are compared by their members: few of
  them one by one.  Of many, and of sets near a leading one, each member's answers come from
  what its set differs in from that set, as pairs in which both differ too much elsewhere
  cannot be similar.

Every bound is exact: no link is lost, whatever the order of n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm import kernels
from colligo.llm.common import other_key, save
from colligo.llm.graph import components
from colligo.llm.minhash import _lists, _set_id, _sets, full_sets, links_by_difference, similar

U64 = kernels.U64
#: Buckets that count n-grams for their order: one byte each is sent to all tasks, at any size of input.
BUCKET_BITS = 20
#: A task's counts are written in pieces of so many buckets.
PIECE = 1 << 16
#: Pairs of components with more pairs of members than this are compared by differences.
FEW = 64
#: Lists of more components than this are split by how near their sets are to the leading one.
MANY = 16
#: Hundredths of a set that a leading set must hold for it to be near.
NEAR = 60


def _bucket(items: np.ndarray) -> np.ndarray:
    return (items >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _level(counts: np.ndarray) -> np.ndarray:
    """One byte that grows with the logarithm of a count; 0 for none."""
    return np.where(counts > 0, 1 + np.floor(4 * np.log2(np.maximum(counts, 1))), 0).astype(np.uint8)


def prefix_size(n: int, percent: int) -> int:
    """n-grams of a set of n of which a similar set shares one at least."""
    return n - -(-percent * n // 100) + 1


def scan(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id of every row; and rows with a piece of each task's bucket counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << BUCKET_BITS, np.int64), [], 0
        names = ["doc_id", "text_key", "n_shingles", "set_id", "piece", "counts"]
        for part in (p for batch in batches for p in kernels.slices(batch, "text")):
            n, ids = [], []
            for items in _sets(part["text"], k):
                n.append(len(items))
                ids.append(_set_id(items))
                held.append(_bucket(items))
                size += len(items)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held, size = [], 0
            none = [pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), *none], names=names)
        if size:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        for piece in range(len(counts) // PIECE if counts.any() else 0):
            raw = counts[piece * PIECE : (piece + 1) * PIECE].astype(np.uint32).tobytes()
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([piece], pa.int32()), pa.array([raw], pa.binary())], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_id binary, piece int, counts binary")


def bucket_levels(scanned: DataFrame) -> np.ndarray:
    """A byte for each bucket: how full it is over all rows. As large at any size of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, raw in zip(b["piece"], b["counts"], strict=True):
                total.setdefault(piece.as_py(), np.zeros(PIECE, np.int64))[:] += np.frombuffer(raw.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_level(t).tobytes() for t in total.values()], pa.binary())], names=["piece", "levels"])

    pieces = scanned.where("piece is not null").select("piece", "counts").repartition((1 << BUCKET_BITS) // PIECE, "piece")
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in pieces.mapInArrow(run, "piece int, levels binary").collect():
        out[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """doc_id, set_id, n and the indexed n-grams of every row with words, first in the order first."""
    told = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in kernels.slices(batch, "text")):
            n, ids, grams = [], [], []
            for items in _sets(part["text"], k):
                n.append(len(items))
                ids.append(_set_id(items))
                order = np.argsort(told.value[_bucket(items)], kind="stable")  # items ascend already
                grams.append(items[order[: prefix_size(len(items), percent)]].view(np.int64) if len(items) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary()), pa.array(n, pa.int64()), _lists(grams)], names=["doc_id", "set_id", "n", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, set_id binary, n long, grams array<long>").where("n > 0")


def _overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Least overlap of similar sets of these sizes."""
    return F.ceil(percent * (n1 + n2) / (100 + percent))


def _must_share(n1: Column, n2: Column, most: Column, percent: int) -> Column:
    """Indexed n-grams that similar sets of at least n1 and n2 items, of at most ``most``, share at least."""
    return F.greatest(_overlap(n1, n2, percent) - F.ceil(percent * most / 100) + 1, F.lit(1))


def _open_components(lists: DataFrame, percent: int) -> DataFrame:
    """(c1, c2), c1 < c2: components whose blocks leave room for a similar pair.

    ``lists``: (gram, rep, n, pos, c), pos from 0.  A common n-gram of two similar sets has
    at most min(pos) common ones before it and min(n - pos) from it on; their first
    common one has none before it.
    """
    band = F.floor(F.ln("n") / math.log(100 / percent) + 1e-9).cast("int")  # similar sizes are of the same or neighbouring bands
    blocks = lists.groupBy("gram", "c", band.alias("band")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("pos").alias("pos"), F.max(F.col("n") - F.col("pos")).alias("rest"),
    )
    side = lambda i, b: blocks.select(F.col("gram").alias(f"g{i}"), F.col("c").alias(f"c{i}"), b.alias(f"b{i}"), *[F.col(x).alias(f"{x}{i}") for x in ("low", "high", "pos", "rest")])
    larger = side(2, F.col("band")).withColumn("same", F.lit(True)).union(side(2, F.col("band") - 1).withColumn("same", F.lit(False)))
    least = _overlap(F.col("low1"), F.col("low2"), percent)
    meet = (F.col("g1") == F.col("g2")) & (F.col("b1") == F.col("b2")) & (F.col("c1") != F.col("c2")) & (~F.col("same") | (F.col("c1") < F.col("c2")))
    meet &= 100 * F.col("high1") >= percent * F.col("low2")
    meet &= F.least("pos1", "pos2") + F.least("rest1", "rest2") >= least
    met = side(1, F.col("band")).join(larger, meet).select(
        F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), (F.least("rest1", "rest2") >= least).alias("first"),
        _must_share(F.col("low1"), F.col("low2"), F.greatest("high1", "high2"), percent).alias("need"),
    )
    return met.groupBy("c1", "c2").agg(F.count("*").alias("shared"), F.max("first").alias("first"), F.min("need").alias("need")).where("first and shared >= need").select("c1", "c2")


def _split_lists(named: DataFrame, fame: DataFrame, overlaps, percent: int, many: int) -> tuple[DataFrame, DataFrame | None]:
    """Entries whose pairs are still to be met, and (lead, rep, n, c): members near the leading set of a list of over ``many`` components.

    Let f be the share of a set that the lead holds.  A set similar to it has a share of
    percent / 100 * f at least, if f is over 1 / (1 + percent / 100).  So of a similar pair either both
    shares reach that bound of ``NEAR``, and both are members, or both are below ``NEAR``, and both stay entries.
    """
    high = max(NEAR, 10000 // (100 + percent) + 2)
    crowded = named.select("gram", "c").distinct().groupBy("gram").agg(F.count("*").alias("parts")).where(F.col("parts") > many)
    crowded = save(crowded.select("gram"), "crowded")
    if crowded.isEmpty():
        return named, None
    of = crowded.select(other_key("gram").alias("g2"))
    hot = save(named.join(of, other_key("gram") == F.col("g2"), "left_semi"), "crowded")
    famous = hot.join(fame.select(other_key("rep").alias("r2"), "fame"), other_key("rep") == F.col("r2"))
    leads = famous.groupBy("gram").agg(F.max(F.struct("fame", (-F.col("rep")).alias("r"))).alias("l")).select(other_key("gram").alias("g2"), (-F.col("l.r")).alias("lead"))
    hot = save(hot.join(leads, other_key("gram") == F.col("g2")).drop("g2").where("rep != lead"), "crowded")
    told = overlaps(hot.select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct())
    # an id may stand for two sets; it is near if one of them is, and no longer met only if both are
    share = told.groupBy("a", "b").agg(F.max(10000 * (F.col("both") + 1) - high * percent * F.col("n")).alias("most"), F.min(100 * F.col("both") - high * F.col("n")).alias("least"))
    share = save(share, "shares")
    pair = lambda df: (F.col("rep") == df["a"]) & (F.col("lead") == df["b"])
    near, gone = share.where("most >= 0"), share.where("least >= 0")
    group = hot.select("lead", "rep", "n", "c").distinct().join(near, pair(near), "left_semi")
    rest = named.join(of, other_key("gram") == F.col("g2"), "left_anti").union(hot.join(gone, pair(gone), "left_anti").drop("lead"))
    return save(rest, "named"), save(group, "members")


def join(docs: DataFrame, percent: int = 80, k: int = 4, few: int = FEW, many: int = MANY) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key of every row of ``docs`` (doc_id, text).

    Two documents link if 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles (A-Z lower-cased; with fewer words, the whole sequence as one).  component_id is
    the smallest doc_id reachable.  Texts that are null or wordless link with nothing and are
    their own components.  Rows with a null doc_id link with nothing and have a null component.
    Rows that repeat a doc_id are one node of the links, but each has the component of its own
    text's class; ``text_key``, xxhash64 of the text, tells them apart.  Texts of any length are
    read whole.  Other columns, whatever their names, are not read.  An empty table gives no rows.
    """
    scanned = save(scan(docs, k), "scan")
    sig = scanned.where("piece is null").drop("piece", "counts")
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    classes = save(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    indexed = prefixes(docs, bucket_levels(scanned), k, percent).withColumnRenamed("set_id", "set")
    indexed = indexed.join(classes.select("set_id", "rep"), (F.col("doc_id") == F.col("rep")) & (F.col("set") == F.col("set_id"))).select("rep", "set_id", "n", "grams")
    repeated = not usable.groupBy("doc_id", "set_id").count().where("count > 1").isEmpty()
    indexed = save(indexed.dropDuplicates(["rep", "set_id"]) if repeated else indexed, "indexed")

    entries = indexed.select("rep", "n", F.posexplode("grams").alias("pos", "gram"))
    shared = entries.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1")
    lists = save(entries.join(shared.select(other_key("gram").alias("g2"), "size"), other_key("gram") == F.col("g2")).select("gram", "rep", "n", "pos", "size"), "lists")
    # the original of many copies shares more lists with them than they do with each other: it leads
    fame = save(lists.groupBy("rep").agg(F.sum("size").alias("fame")), "fame")
    famous = lists.join(fame.select(other_key("rep").alias("r2"), "fame"), other_key("rep") == F.col("r2"))
    leaders = famous.groupBy("gram").agg(F.max(F.struct("fame", (-F.col("rep")).alias("r"), "n")).alias("l")).select(other_key("gram").alias("g2"), (-F.col("l.r")).alias("lead"), F.col("l.n").alias("lead_n"))
    sized = lambda a, b: similar(F.least(a, b), F.greatest(a, b), percent)
    tried = lists.join(leaders, other_key("gram") == F.col("g2")).where((F.col("rep") != F.col("lead")) & sized(F.col("n"), F.col("lead_n")))
    tried = tried.select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()

    def beside(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
        left, right = rows.select(other_key("rep").alias("r1"), F.col(value).alias("x")), rows.select(other_key("rep").alias("r2"), F.col(value).alias("y"))
        return pairs.join(left, other_key("a") == F.col("r1")).join(right, other_key("b") == F.col("r2")).drop("r1", "r2")

    def screened(pairs: DataFrame) -> DataFrame:
        """Pairs that share as many indexed n-grams as similar sets must."""
        both = beside(pairs, indexed.withColumn("v", F.struct("n", "grams")), "v").select("a", "b", F.col("x.n").alias("n1"), F.col("y.n").alias("n2"), F.size(F.array_intersect("x.grams", "y.grams")).alias("both"))
        return both.where(F.col("both") >= _must_share(F.col("n1"), F.col("n2"), F.greatest("n1", "n2"), percent)).select("a", "b").distinct()

    known: list[DataFrame] = []

    def with_sets(pairs: DataFrame) -> DataFrame:
        sets = known[0]
        for more in known[1:]:
            sets = sets.union(more)
        return beside(pairs, sets, "items")

    def read_sets(reps: DataFrame) -> None:
        """Sets of the classes ``reps`` (rep) that are not read yet."""
        reps = reps.distinct()
        for have in known:
            reps = reps.join(have.select(F.col("rep").alias("r")).distinct(), F.col("rep") == F.col("r"), "left_anti")
        wanted = save(classes.join(reps.select(F.col("rep").alias("w")), F.col("rep") == F.col("w"), "left_semi").select("rep", "set_id"), "wanted")
        sets = full_sets(docs, wanted, k)
        known.append(save(sets.dropDuplicates() if repeated else sets, "sets"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = with_sets(pairs).select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
        return both.where(similar(F.col("both"), F.col("nx") + F.col("ny") - F.col("both"), percent)).select("a", "b")

    tried = save(screened(tried), "tried")
    read_sets(tried.select(F.col("a").alias("rep")).union(tried.select("b")))
    links = save(verified(tried), "links")
    groups = components(links)

    named = lists.join(groups.select(other_key("node").alias("r2"), F.col("component").alias("c")), other_key("rep") == F.col("r2"), "left").select("gram", "rep", "n", "pos", F.coalesce("c", "rep").alias("c"))
    named = save(named, "named")
    mixed = named.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    named = save(named.join(mixed.select(other_key("gram").alias("g2")), other_key("gram") == F.col("g2"), "left_semi"), "named")

    def overlaps(pairs: DataFrame) -> DataFrame:
        pairs = save(pairs, "tried")
        read_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")))
        return with_sets(pairs).select("a", "b", F.size("x").alias("n"), F.size(F.array_intersect("x", "y")).alias("both"))

    rest, group = _split_lists(named, fame, overlaps, percent, many)
    open_ = save(_open_components(rest, percent), "open")
    more = None
    if not open_.isEmpty():
        member = save(rest.select("c", "rep", "n").distinct(), "members")
        most = member.join(fame, "rep").groupBy("c").agg(F.count("*").alias("m"), F.max(F.struct("fame", (-F.col("rep")).alias("r"))).alias("l")).select("c", "m", (-F.col("l.r")).alias("head"))
        one, two = (most.select(F.col("c").alias(f"k{i}"), F.col("m").alias(f"m{i}"), F.col("head").alias(f"head{i}")) for i in (1, 2))
        open_ = save(open_.join(one, F.col("c1") == F.col("k1")).join(two, F.col("c2") == F.col("k2")), "open")
        part = lambda i: member.select(F.col("c").alias(f"k{i}"), F.col("rep").alias("ab"[i - 1]), F.col("n").alias(f"n{i}"))
        small = open_.where(F.col("m1") * F.col("m2") <= few).select("c1", "c2")
        pairs = small.join(part(1), F.col("c1") == F.col("k1")).join(part(2), F.col("c2") == F.col("k2")).where(sized(F.col("n1"), F.col("n2"))).select("a", "b")
        pairs = save(screened(pairs), "tried")
        large = open_.where(F.col("m1") * F.col("m2") > few).withColumn("lead", F.when(F.col("m1") >= F.col("m2"), F.col("head1")).otherwise(F.col("head2")))
        sides = large.select("lead", F.col("c1").alias("k")).union(large.select("lead", "c2")).distinct()
        wide = sides.join(member, F.col("k") == F.col("c")).where("rep != lead").select("lead", "rep", "n", "c")
        group = save(wide if group is None else wide.union(group).distinct(), "members")
        read_sets(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(group.select("rep")).union(group.select("lead")))
        more = verified(pairs)
    if group is not None and not group.isEmpty():
        # a centre is a member too, and meets the other components by itself
        heads = verified(screened(group.select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()))
        found = heads.union(links_by_difference(group, with_sets, percent))
        more = found if more is None else more.union(found)
    if more is not None:
        more = save(more, "links")
        if not more.isEmpty():
            groups = components(links.union(more))
    told = save(classes.select("set_id", "rep").join(groups, F.col("rep") == F.col("node"), "left").select(F.col("set_id").alias("set"), F.coalesce("component", "rep").alias("c")), "classes")
    out = sig.select("doc_id", "text_key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    return out.join(told, F.col("set_id") == F.col("set"), "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), "text_key")
