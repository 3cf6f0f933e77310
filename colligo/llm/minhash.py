"""Near-duplicate groups: fast similarity sketching, banding, exact verification.

A sketch has T bins.  In round i every shingle is hashed to one bin with a value in
[i, i + 1); a bin keeps its least value.  Rounds go on until all bins are full, and
rounds T to 2T - 1 put all shingles into one bin each, so every bin fills.  The first
rounds spread a set over the bins without replacement, which concentrates the share
of equal bins around the Jaccard similarity at least as well as T independent
minima, at a cost near |set| + T log T.

Documents with equal sets are one class.  Classes that share a band are candidates.
Each band's classes are compared with the band's leader, on full sets; a band whose
members this connects costs no pairs.  In the other bands, the members' differences
from a common centre tell which pairs can be similar at all, and those are compared.
So no candidate pair of different components that could be similar goes without an
exact check.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm import kernels
from colligo.llm.common import other_key, save
from colligo.llm.graph import components

U64 = kernels.U64
#: 40 bands of 6: two sets of similarity 0.85 share no band with a chance of 6e-9, of 0.8 with one of 5e-6.
BANDS, ROWS = 40, 6
#: Bits of the filter that texts pass before they are shuffled to the classes that need them: 2^19 rows of 64 at most are broadcast, at any size of input.
FILTER_BITS = 1 << 25


def sketch(items: np.ndarray, bins: int, seed: int = 11) -> np.ndarray:
    """Sketch of a non-empty set of 64-bit hashes: round << 40 | least value, for each bin."""
    out = np.full(bins, ~U64(0))
    salt = U64(seed * int(kernels.BASE) & kernels.MASK)
    i = 0
    while i < bins:
        # as many rounds at once as usually fill all bins; later rounds never lower a full bin
        rounds = np.arange(i, min(bins, i + max(1, math.ceil((bins * math.log(bins) + 2 * bins) / len(items)))), dtype=U64)
        h = kernels.mix(items[None, :] ^ kernels.mix(rounds + salt)[:, None])
        at = ((h >> U64(40)) * U64(bins)) >> U64(24)
        np.minimum.at(out, at.ravel(), ((rounds[:, None] << U64(40)) | (h & U64((1 << 40) - 1))).ravel())
        if out.max() < ~U64(0):
            return out
        i = int(rounds[-1]) + 1
    for j in np.flatnonzero(out == ~U64(0)):
        h = kernels.mix(items ^ kernels.mix(np.array([bins + j], U64) + salt))
        out[j] = (U64(bins + j) << U64(40)) | (h & U64((1 << 40) - 1)).min()
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values.reshape(bands, rows) * kernels.odd_constants(rows, 3)
    return kernels.mix(kernels.mix(grid).sum(axis=1, dtype=U64) + kernels.odd_constants(bands, 5))


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for a, b, words, first in kernels.documents(column, lower=True):
        for r in range(b - a):
            yield kernels.shingle_set(words[first[r] : first[r + 1]], k)


def _set_id(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32), np.concatenate(values or [np.zeros(0, np.int64)]))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_id (equal for equal sets) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in kernels.slices(batch, "text")):
            n, ids, keys = [], [], []
            for items in _sets(part["text"], k):
                n.append(len(items))
                ids.append(_set_id(items))
                keys.append(band_keys(sketch(items, bands * rows), bands, rows).view(np.int64) if len(items) else np.zeros(0, np.int64))
            columns = [part["doc_id"], part["text_key"], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_id", "bands"])

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows_of.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_id binary, bands array<long>")


def _may_have(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not a ``rep`` of ``wanted``; never without one that is."""
    word = lambda c: F.shiftright(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)), 6)
    # the hash's low six bits name one of the word's 64 bits
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))
    bits = wanted.groupBy(word(F.col("rep")).alias("word")).agg(F.bit_or(bit(F.col("rep"))).alias("bits"))
    near = rows.join(F.broadcast(bits), word(key) == F.col("word"))
    return near.where(F.col("bits").bitwiseAND(bit(key)) != 0).select(*[rows[c] for c in rows.columns])


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, items) for the classes in ``wanted`` (rep, set_id), from their representatives' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in kernels.slices(batch, "text")):
            keep, items = [], []
            for r, (one, sid) in enumerate(zip(_sets(part["text"], k), part["set_id"].to_pylist(), strict=True)):
                if _set_id(one) == sid:
                    keep.append(r)
                    items.append(one.view(np.int64))
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(keep, pa.int64())), _lists(items)], names=["rep", "items"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _may_have(texts, F.col("doc_id"), wanted).join(wanted, F.col("doc_id") == F.col("rep"))
    return texts.select("doc_id", "text", "set_id").mapInArrow(run, "rep long, items array<long>")


def similar(shared: Column, total: Column, percent: int) -> Column:
    return 100 * shared >= percent * total


def _placed(rows: DataFrame, items: str, size: str) -> DataFrame:
    """(lead, item, me, place): items that two members of a lead have, placed from rare to frequent among all of the member's items.

    ``me`` is the member's row without its items.  Items that one member has alone come first; they meet nobody and are left out.
    """
    me = F.struct(*[c for c in rows.columns if c not in ("lead", "added", "missing")])
    each = rows.select("lead", me.alias("me"), F.explode(items).alias("item"))
    times = each.groupBy("lead", "item").agg(F.count("*").alias("times")).where("times > 1").select(F.col("lead").alias("l2"), other_key("item").alias("i2"), "times")
    each = each.join(times, (F.col("lead") == F.col("l2")) & (other_key("item") == F.col("i2"))).drop("l2", "i2")
    mine = Window.partitionBy("lead", "me.rep", "me.n", "me.na", "me.nr")
    place = F.col(f"me.{size}") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("times", "item"))
    return each.select("lead", "item", "me", place.alias("place"))


def _meet(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs (lead, x, y) of members of different components that share an item, of sizes that allow a similar pair."""
    right = right.select(F.col("lead").alias("l2"), F.col("item").alias("i2"), F.col("me").alias("y"), F.col("place").alias("place2"))
    met = left.withColumnRenamed("me", "x").join(right, (F.col("lead") == F.col("l2")) & (F.col("item") == F.col("i2")) & (F.col("x.c") != F.col("y.c")) & condition)
    return met.select("lead", F.col("x.rep").alias("r1"), F.col("y.rep").alias("r2"))


def links_by_difference(members: DataFrame, with_sets, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of each lead; pairs that cannot be similar are not made.

    ``members``: (lead, rep, n, c).  With p = 100 + percent and q = 100 - percent, x and y
    are similar if p |x xor y| <= q (n_x + n_y).  The lead's set is a centre: A = x - centre
    and R = centre - x.  Let excess = p (|A| + |R|) - q n and slack = 2 p |R| - excess.

    1. excess_x + excess_y <= 0: the pair is similar, and both are similar to the member with the least excess.
    2. Else the differences overlap: 2 p (|A_x and A_y| + |R_x and R_y|) >= excess_x + excess_y.
       If they share an added item, they share (excess_x - slack_y) / 2p of them at least, as |R_x and R_y| <= |R_y|.
    3. If they share none, they share (excess_x + excess_y) / 2p missing ones; so excess_x <= slack_y and excess_y <= slack_x.

    Two sets that share m items meet at an item that is in both among the rarest
    size - m + 1.  In 2 the slack of most members bounds m; the odd ones beyond it meet
    others by all of their items.  Members of a lead's largest component meet others only.
    """
    p, q = 100 + percent, 100 - percent
    diff = with_sets(members.select("lead", "rep", "n", "c", F.col("rep").alias("a"), F.col("lead").alias("b")))
    diff = diff.select("lead", "rep", "n", "c", F.array_except("x", "y").alias("added"), F.array_except("y", "x").alias("missing"))
    diff = diff.withColumns({"na": F.size("added"), "nr": F.size("missing")}).withColumn("excess", p * (F.col("na") + F.col("nr")) - q * F.col("n"))
    diff = save(diff.withColumn("slack", 2 * p * F.col("nr") - F.col("excess")), "differences")
    centre = diff.groupBy("lead").agg(F.min(F.struct("excess", "rep", "c")).alias("core"), F.max("slack").alias("top"), (F.percentile_approx("slack", 0.9) + 4 * p).alias("usual"))
    main = diff.groupBy("lead", "c").agg(F.count("*").alias("m")).groupBy("lead").agg(F.max_by("c", F.struct("m", "c")).alias("main"), F.count("*").alias("parts"))
    centre = centre.join(main.where("parts > 1").drop("parts"), "lead").select(other_key("lead").alias("l2"), "core", "top", "usual", "main")
    known = diff.join(centre, other_key("lead") == F.col("l2")).drop("l2")
    # one of the two is outside the largest component, and a pair is met once
    once = (F.col("x.c") != F.col("x.main")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    sized = similar(F.least("x.n", "y.n"), F.greatest("x.n", "y.n"), percent)
    enough = F.col("x.excess") + F.col("y.excess") <= 2 * p * (F.least("x.na", "y.na") + F.least("x.nr", "y.nr"))
    least = lambda need: F.greatest(F.ceil(need / (2 * p)), F.lit(1))

    known = save(known.withColumn("low", F.col("core.excess")), "differences")
    core = known.where("excess + low <= 0 and c != core.c").select("lead", F.col("core.rep").alias("r1"), F.col("rep").alias("r2"))
    known = known.drop("core")
    added = save(_placed(known.withColumn("far", F.col("na") - least(F.col("excess") - F.col("usual")) + 1), "added", "na"), "items")
    early, odd = added.where(F.col("place") <= F.col("me.far")), F.col("me.slack") > F.col("me.usual")
    pairs = _meet(early, early, once & sized & enough)
    reach = ((F.col("place") <= F.col("x.far")) | (F.col("y.slack") > F.col("y.usual"))) & ((F.col("place2") <= F.col("y.far")) | (F.col("x.slack") > F.col("x.usual")))
    pairs = pairs.union(_meet(added.where(odd), added, sized & enough & reach & ((F.col("x.c") != F.col("x.main")) | (F.col("y.c") != F.col("y.main")))))

    asks = known.where("c != main and excess <= top").groupBy("lead").agg(F.max("slack").alias("reach")).select(other_key("lead").alias("l2"), "reach")
    meets = known.join(asks, other_key("lead") == F.col("l2")).where("excess <= greatest(top, reach)").drop("l2", "reach")
    missing = _placed(meets.withColumn("far", F.col("nr") - least(F.col("excess") + F.col("low")) + 1), "missing", "nr")
    missing = save(missing.where(F.col("place") <= F.col("me.far")), "items")
    fits = (F.col("x.excess") <= F.col("y.slack")) & (F.col("y.excess") <= F.col("x.slack"))
    pairs = pairs.union(_meet(missing, missing, once & sized & enough & fits)).union(core)
    pairs = pairs.select("lead", F.least("r1", "r2").alias("r1"), F.greatest("r1", "r2").alias("r2")).distinct()

    # sizes of the differences give the exact similarity
    side = lambda i: known.select(F.col("lead").alias(f"l{i}"), F.col("rep").alias(f"rep{i}"), F.col("n").alias(f"n{i}"), F.col("added").alias(f"a{i}"), F.col("missing").alias(f"m{i}"))
    both = pairs.join(side(1), (F.col("lead") == F.col("l1")) & (F.col("r1") == F.col("rep1"))).join(side(2), (F.col("lead") == F.col("l2")) & (F.col("r2") == F.col("rep2")))
    apart = sum((F.size(F.array_except(x, y)) + F.size(F.array_except(y, x)) for x, y in (("a1", "a2"), ("m1", "m2"))), F.lit(0))
    return both.where(p * apart <= q * (F.col("n1") + F.col("n2"))).select(F.col("r1").alias("a"), F.col("r2").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key of every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of k-word shingles (A-Z lower-cased; with fewer words, the whole sequence as
    one shingle).  component_id is the smallest doc_id reachable.  Texts that are null
    or have no word link with nothing.  Rows with a null doc_id link with nothing, have
    a null component and are kept.  Rows that repeat a doc_id are one node of the links,
    but each row has the component of its own text's class; ``text_key`` is xxhash64 of the
    text and tells them apart.  Other columns, whatever their names, are not read.  An
    empty table gives an empty result.
    """
    sig = save(signatures(docs, k, bands, rows), "signatures")
    usable = sig.where("n_shingles > 0 and doc_id is not null")
    classes = save(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    member = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    # only bands of two classes or more go on
    buckets = save(member.join(shared.select(other_key("key").alias("k2"), "size"), other_key("key") == F.col("k2")).select("key", "rep", "n", "size"), "buckets")
    # the original of many copies shares more bands with them than they do with each other: it leads
    fame = buckets.groupBy("rep").agg(F.sum("size").alias("fame"), F.first("n").alias("n")).join(classes.select("rep", "set_id"), "rep")
    fame = save(fame, "fame")
    famous = buckets.join(fame.select("rep", "fame"), "rep")
    leaders = famous.groupBy("key").agg(F.max(F.struct("fame", (-F.col("rep")).alias("r"), "n")).alias("l"))
    leaders = leaders.select(other_key("key").alias("k2"), (-F.col("l.r")).alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.fame").alias("lead_fame"))
    buckets = save(buckets.join(leaders, other_key("key") == F.col("k2")).drop("k2"), "buckets")
    sized = lambda a, b: similar(F.least(a, b), F.greatest(a, b), percent)
    tried = buckets.where((F.col("rep") != F.col("lead")) & sized(F.col("n"), F.col("lead_n"))).select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    tried = save(tried, "tried")
    # only members of bands that may hold a link need their sets
    wanted = tried.select(F.col("a").alias("w")).union(tried.select("b")).union(buckets.where("size > 2").select("rep")).distinct()
    wanted = save(fame.join(wanted, F.col("rep") == F.col("w"), "left_semi").select("rep", "set_id"), "wanted")
    sets = full_sets(docs, wanted, k)
    if not usable.groupBy("doc_id", "set_id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates()  # rows that repeat an id and a set
    sets = save(sets, "sets")

    def with_sets(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
        return pairs.join(left, "a").join(right, "b")

    def verified(pairs: DataFrame) -> DataFrame:
        both = with_sets(pairs).select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("both"))
        return both.where(similar(F.col("both"), F.col("nx") + F.col("ny") - F.col("both"), percent)).select("a", "b")

    links = save(verified(tried), "links")
    groups = components(links)
    # members of the bands that hold more than one component; a band of two was settled with its leader
    named = buckets.where("size > 2").join(groups.withColumnRenamed("component", "c"), F.col("rep") == F.col("node"), "left").select("key", "rep", "n", "size", "lead", F.coalesce("c", "rep").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low != high")
    left = save(named.join(mixed.select(other_key("key").alias("k2")), other_key("key") == F.col("k2"), "left_semi").where("rep != lead"), "open")
    # leads of one family are led by the most famous lead that they share a band with, so that a member has few centres
    up = buckets.join(left.select(F.col("lead").alias("l2")).distinct(), F.col("rep") == F.col("l2"), "left_semi")
    up = save(up.groupBy("rep").agg(F.max(F.struct("lead_fame", (-F.col("lead")).alias("r"))).alias("u")).select("rep", (-F.col("u.r")).alias("up")), "leads")
    for _ in range(2):
        left = left.join(up.select(F.col("rep").alias("l2"), "up"), F.col("lead") == F.col("l2"), "left").withColumn("lead", F.coalesce("up", "lead")).drop("l2", "up")
    members = left.where("rep != lead").select("lead", "rep", "n", "c").distinct()
    more = save(links_by_difference(members, with_sets, percent), "links")
    if not more.isEmpty():
        groups = components(links.union(more))
    named = save(classes.select("set_id", "rep").join(groups, F.col("rep") == F.col("node"), "left").select(F.col("set_id").alias("set"), F.coalesce("component", "rep").alias("c")), "classes")
    out = sig.select("doc_id", "text_key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_id")).alias("set_id"))
    out = out.join(named, F.col("set_id") == F.col("set"), "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), "text_key")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")
