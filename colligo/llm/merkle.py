"""Merkle manifest of a table: a leaf a row, a tree a group, and a tree over the groups' roots.

Every two neighbours of a level, or what is left of them, become the hash of their hex
digests, until one node remains.  Leaves are dealt in aligned blocks of 2^LEVELS; a
block is one bounded row.  Block roots are the leaves of the next round, so a tree of n
leaves takes log n / LEVELS rounds.  Then, from the top down, each block is traversed
leaf by leaf: one treehash stack a height prepares the sibling that the path needs next,
so a traversal holds as many nodes as the block has heights, squared at most, besides
the leaves that it reads.  The path above a block is shared by its leaves and appended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import save

#: Heights of a block: 256 leaves.
LEVELS = 8
_PLACE = 33  # bits of a row's place in its partition, as monotonically_increasing_id has them


def field(value: Column) -> Column:
    """A value so that no two rows of fields read alike: ``-`` for null, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Lower-case hex SHA-256 of all fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give; a step is ``L`` or ``R`` and the sibling on that side, or empty."""

    def step(node: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(s.startswith("L"), F.concat(other, node)).when(s.startswith("R"), F.concat(node, other)).otherwise(node), 256)

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, from the leaf up."""
    return F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), "")


# one block ------------------------------------------------------------------------------------------


def _parent(left: str | None, right: str | None) -> str | None:
    """A missing right child leaves the left one alone; nothing is above nothing."""
    return None if left is None else sha256((left + (right or "")).encode()).hexdigest()


class _TreeHash:
    """The node of some height above the leaves from ``at`` on, built by single steps on a stack of at most a node a height."""

    def __init__(self, leaves: Sequence[str], at: int, height: int) -> None:
        self.leaves, self.at, self.height, self.stack = leaves, at, height, []

    def done(self) -> bool:
        return len(self.stack) == 1 and self.stack[0][0] == self.height

    def step(self) -> None:
        if self.done():
            return
        if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
            (h, right), (_, left) = self.stack.pop(), self.stack.pop()
            self.stack.append((h + 1, _parent(left, right)))
        else:
            self.stack.append((0, self.leaves[self.at] if self.at < len(self.leaves) else None))
            self.at += 1

    def node(self) -> str | None:
        while not self.done():
            self.step()
        return self.stack[0][1]


def block_root(leaves: Sequence[str], height: int) -> str:
    return _TreeHash(leaves, 0, height).node()


def block_paths(leaves: Sequence[str], height: int) -> Iterator[list[str]]:
    """The path inside the block of one leaf after the other."""
    beside = [_TreeHash(leaves, 1 << h, h).node() for h in range(height)]
    coming = [_TreeHash(leaves, 0, h) for h in range(height)]
    for c in coming:
        c.node()
    for i in range(len(leaves)):
        yield ["" if s is None else ("L" if i >> h & 1 else "R") + s for h, s in enumerate(beside)]
        for h in range(height):
            if (i + 1) % (1 << h) == 0:
                beside[h] = coming[h].node()
                coming[h] = _TreeHash(leaves, (i + 1 + (1 << h)) ^ (1 << h), h)
            # two steps a leaf finish a stack of 2^h leaves before its node is due
            coming[h].step()
            coming[h].step()


def _height(n: int, levels: int) -> int:
    """Heights of a block of a tree of n leaves."""
    return levels if n > 1 << levels else (n - 1).bit_length()


# trees over blocks ------------------------------------------------------------------------------------


def _positions(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with pos, from 0 within each tree, and n, the tree's rows: one range sort, and counts a partition and tree."""
    ids = rows.withColumn("row", F.monotonically_increasing_id())  # parts equal rows, so that they need not meet in one task
    placed = save(ids.sort(tree, *order, "row").drop("row").withColumn("row", F.monotonically_increasing_id()), "sorted")
    placed = placed.select("*", F.shiftright("row", _PLACE).alias("part"), F.col("row").bitwiseAND((1 << _PLACE) - 1).alias("place"))
    runs = placed.groupBy("part", tree).agg(F.min("place").alias("from"), F.count("*").alias("size"))
    whole = Window.partitionBy(tree)  # a row for each partition of the sort at most
    before = F.coalesce(F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("part").alias("part2"), F.col(tree).alias("tree2"), (before - F.col("from")).alias("shift"), F.sum("size").over(whole).alias("n"))
    found = placed.join(runs, (F.col("part") == F.col("part2")) & (F.col(tree) == F.col("tree2")))
    return found.select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "n")


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, block, n, nodes (pos, digest, keep) in order, and root: a row for each block of 2^levels nodes."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                found = [block_root(d, _height(n, levels)) for d, n in zip(part["digests"].to_pylist(), part["n"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("tree", "block", "n", "nodes")), pa.array(found, pa.string())], names=["tree", "block", "n", "nodes", "root"])

    one = nodes.groupBy("tree", F.shiftright("pos", levels).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "digest", "keep"))).alias("nodes"))
    one = one.select("tree", "block", "n", "nodes", F.col("nodes.digest").alias("digests"))
    kind = dict(one.dtypes)["nodes"]
    return save(one.mapInArrow(roots, f"tree string, block long, n long, nodes {kind}, root string"), "blocks")


def _traverse(blocks: DataFrame, levels: int) -> DataFrame:
    """tree, pos, n, digest, keep, path, and the columns above: ``blocks`` have the path above each block as ``up``."""
    above = [c for c in blocks.columns if c not in ("block", "nodes", "root", "up")]

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 8):
                part = b.slice(k, 8)
                found = [[p + up for p in block_paths(d, _height(n, levels))] for d, n, up in zip(part["digests"].to_pylist(), part["n"].to_pylist(), part["up"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in (*above, "nodes")), pa.array(found, pa.list_(pa.list_(pa.string())))], names=[*above, "nodes", "paths"])

    rows = blocks.select(*above, "nodes", F.col("nodes.digest").alias("digests"), "up")
    types = dict(rows.dtypes)
    found = rows.mapInArrow(paths, ", ".join(f"{c} {types[c]}" for c in (*above, "nodes")) + ", paths array<array<string>>")
    found = found.select(*above, F.explode(F.arrays_zip("nodes", "paths")).alias("e"))
    return found.select(*above, F.col("e.nodes.pos").alias("pos"), F.col("e.nodes.digest").alias("digest"), F.col("e.nodes.keep").alias("keep"), F.col("e.paths").alias("path"))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The blocks of every round, from the leaves up."""
    out = []
    while True:
        blocks = _blocks(nodes, levels)
        out.append(blocks)
        more = blocks.where(F.col("n") > 1 << levels)
        if more.isEmpty():
            return out
        n = F.shiftright(F.col("n") + ((1 << levels) - 1), levels)
        nodes = more.select("tree", F.col("block").alias("pos"), n.alias("n"), F.col("root").alias("digest"), F.lit(None).cast("int").alias("keep"))


def _down(rounds: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Paths of the first round's nodes; ``tops`` (tree, up and more columns) has what is above each tree's root."""
    more = [c for c in tops.columns if c not in ("tree", "up")]
    tops = tops.select(F.col("tree").alias("tree2"), F.lit(0).cast("long").alias("block2"), "up", *more)
    upper = None
    for i, blocks in enumerate(reversed(rounds)):
        # a tree that ends in this round has one block
        ends = blocks.where(F.col("n") <= 1 << levels).select("tree", "block").join(tops, (F.col("tree") == F.col("tree2")) & (F.col("block") == F.col("block2"))).select("tree2", "block2", "up", *more)
        upper = ends if upper is None else ends.union(upper)
        joined = blocks.join(upper, (F.col("tree") == F.col("tree2")) & (F.col("block") == F.col("block2"))).drop("tree2", "block2")
        nodes = _traverse(joined, levels)
        upper = nodes.select(F.col("tree").alias("tree2"), F.col("pos").alias("block2"), F.col("path").alias("up"), *more) if i + 1 < len(rounds) else nodes
    return upper


def _roots(rounds: list[DataFrame], levels: int) -> DataFrame:
    ends = [b.where(F.col("n") <= 1 << levels).select("tree", "root") for b in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def manifest(rows: DataFrame, group: str, order: str, digest: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """``rows`` with pos (in its group), subroot, root and path, which leads from the row's leaf to the root.

    Within a group rows ascend by ``order`` (nulls first), those that tie by ``digest``; equal rows
    are as many leaves.  Groups ascend as UTF-8 bytes, the null group first.  The leaf is column
    ``digest``, hex text and not null; ``field`` makes nulls part of it.  A group of one row is its
    own subroot, and a lone group's subroot is the root.  Columns of any name are kept, but
    for those named like the four new ones.  Long values are read whole; only digests are
    shuffled.  An empty table has no rows and no root.
    """
    made = ("pos", "subroot", "root", "path")
    tree = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(order).alias("order"), F.col(digest).alias("digest"), F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in made]).alias("keep"))
    rounds = _rounds(_positions(leaves, "tree", ["order", "digest"]).drop("order"), levels)
    subroots = _roots(rounds, levels).select(F.lit("").alias("tree"), F.col("tree").alias("keep"), F.col("root").alias("digest"))
    over = _rounds(_positions(subroots, "tree", ["keep"]), levels)
    whole = _roots(over, levels).select("tree", F.array().cast("array<string>").alias("up"), F.col("root").alias("whole"))
    tops = save(_down(over, whole, levels).select(F.col("keep").alias("tree"), F.col("path").alias("up"), F.col("digest").alias("subroot"), F.col("whole").alias("top")), "tops")
    out = _down(rounds, tops, levels)
    return out.select("keep.*", F.col("pos"), "subroot", F.col("top").alias("root"), "path")


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII text in SQL."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)::ubigint[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::ubigint)), lambda c, b: {byte}), 4294967295::ubigint)"


def oracle_sql() -> str:
    f = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    line = lambda n: f"sha256({f('doc_id')} || {f('source')} || {f('lang')} || {n} || {f('text')})"
    tampered = f"case when ({crc32_sql('doc_id::varchar')}) % 7 = 0 then {f('(n_chars + 1)')} else {f('n_chars')} end"
    tree = lambda name, source: f"""{name} as (select 0 as level, g, pos, n, digest from {source} union all
 select level + 1, g, pos // 2, any_value(n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by level, g, pos // 2)"""  # noqa: E731
    path = lambda name, tree: f"""{name} as (select a.g, a.pos, list({{'node': s.digest, 'left': s.pos < b.pos}} order by b.level) as path from {tree} a join {tree} b on a.level = 0 and b.n > 1 and b.g = a.g and b.pos = a.pos >> b.level
 left join {tree} s on s.level = b.level and s.g = b.g and s.pos = xor(b.pos, 1) group by a.g, a.pos)"""  # noqa: E731
    step = "case when s.node is null then sha256(a.node) when s.left then sha256(s.node || a.node) else sha256(a.node || s.node) end"
    return f"""with recursive d as (select doc_id, coalesce('v' || lang, '') as g, {line(f('n_chars'))} as digest, {line(tampered)} as told from documents),
r as materialized (select *, row_number() over (partition by g order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by g) as n from d),
{tree('t', 'r')}, sub as (select g, digest from t where n = 1),
q as (select 'all' as g, g as name, digest, row_number() over (order by g) - 1 as pos, count(*) over () as n from sub),
{tree('u', 'q')}, {path('pt', 't')}, {path('pu', 'u')},
e as (select r.doc_id, r.digest as leaf, q.digest as subroot, (select digest from u where n = 1) as root, list_concat(coalesce(pt.path, []), coalesce(pu.path, [])) as path, r.told
 from r join q on q.name = r.g left join pt on pt.g = r.g and pt.pos = r.pos left join pu on pu.pos = q.pos),
z as (select *, list_reduce(list_prepend({{'node': told, 'left': false}}, path), lambda a, s: {{'node': {step}, 'left': false}}).node as folded_root from e)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: coalesce(s.node, '')), '')) as proof_sha256, folded_root, folded_root = root as verified from z"""
