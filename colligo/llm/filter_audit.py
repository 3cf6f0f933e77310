"""Filter interaction audit: what every filter removes in every order of the filters.

Documents become cells (part, failure mask, good, toxic) with a count, so everything
after the first aggregation is as small as the number of parts.  Cells are unpivoted
against the steps of all orders; a running bit-or window over a cell's steps tells
which failures came earlier, conditional sums give the counts of a step, and a window
over a filter's rows gives its total over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import other_key, save

#: The filters, in the order of their bits: short, repetitive, capitals, symbols, copy.
FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions of A to D on a text (not null) and its words."""
    n = F.size(words)
    return {
        "A": n < 200, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic of every row of ``docs`` (doc_id, lang, text).

    Bit i of ``mask`` is set where filter i of ``FILTERS`` fails.  Null texts count as
    empty, null languages as the empty string, whole texts are read at any length.  E fails
    where a row with a smaller doc_id has the same text; rows that repeat the smallest id
    all pass it, and rows without an id neither fail it nor make others fail.  good and
    toxic hold if any label row of the doc_id says so; no label says no.  Equal texts are
    found by digests: counts are added up before the shuffle, and a text that many rows
    share is joined under a key that Spark can split.  Other columns are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = read.select("*", F.array_remove(F.split("text", SPACES), "").alias("words"))
    told = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in told.items()), F.lit(0))
    rows = save(read.select("doc_id", "part", F.sha2("text", 256).alias("digest"), mask.alias("mask")), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(first.select(F.reverse("digest").alias("key"), "first"), F.reverse("digest") == F.col("key"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    said = said.select(other_key("doc_id").alias("id"), "good", "toxic")
    rows = rows.join(said, other_key("doc_id") == F.col("id"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("part", (F.col("mask") + copy).alias("mask"), flag("good"), flag("toxic"))


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and counts for every part, order of ``filters`` and step.

    ``rows``: (part, mask, good, toxic).  kept: rows that pass up to this step; removed:
    fail here and passed before; redundant: fail here, removed before; unique_fails: fail
    this filter only; good_lost, toxic_lost: of those removed; shapley: removed by this
    filter over all orders.  Orders grow as the factorial of the filters, seven at most.
    """
    if not 1 <= len(set(filters)) == len(filters) <= 7:
        raise ValueError("one to seven different filters")
    orders = ["".join(p) for p in permutations(filters)]
    cells = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(len(filters))), lambda i: F.struct(i.alias("step"), F.substring("filter_order", i, F.lit(1)).alias("letter")))
    long = cells.select("*", F.explode(F.array(*map(F.lit, orders))).alias("filter_order")).select("*", F.inline(steps))
    long = long.withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', letter) - 1)")).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))
    fails, open_ = F.col("hit") != 0, F.col("earlier") == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = long.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & open_).alias("kept"), total(fails & open_).alias("removed"), total(fails & ~open_).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & open_ & F.col("good")).alias("good_lost"), total(fails & open_ & F.col("toxic")).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def oracle_sql() -> str:
    orders = ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS))
    lost = "contains(fails, letter) and not earlier"
    return rf"""with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first from d),
l as (select doc_id, max(quality) = 1 as good, max(toxic) = 1 as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
 (case when len(ws) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end)
 || (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end)
 || (case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end) || (case when first < w.doc_id then 'E' else '' end) as fails
 from w left join l on l.doc_id = w.doc_id),
c as (select part, good, toxic, fails, count(*) as n from f group by all),
o as (select filter_order, step::int as step, substr(filter_order, step::int, 1) as letter, substr(filter_order, 1, step::int - 1) as before from (select unnest([{orders}]) as filter_order), range(1, 6) r(step)),
x as (select *, length(translate(before, fails, '')) < length(before) as earlier from c, o),
g as (select part, filter_order, step, letter, sum(case when not contains(fails, letter) and not earlier then n else 0 end)::bigint as kept, sum(case when {lost} then n else 0 end)::bigint as removed,
 sum(case when contains(fails, letter) and earlier then n else 0 end)::bigint as redundant, sum(case when fails = letter then n else 0 end)::bigint as unique_fails,
 sum(case when {lost} and good then n else 0 end)::bigint as good_lost, sum(case when {lost} and toxic then n else 0 end)::bigint as toxic_lost from x group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from g"""
