"""Exact top-k inner products with a vector-approximation file.

Every vector is cut into cells of one byte a dimension.  Phase one scans only those
cells: each group of queries meets each group of cell blocks once, and a running kth
bound of the inner product tells which vectors of the group can still be among the
best k.  Phase two reads exact vectors in the order of their upper bounds, in rounds of
twice as many for each query.  The kth exact score so far drops all whose upper bound
is below it; a query ends when none is left, which makes its kth result certain.

Components are whole numbers of any size that a double holds.  Bounds are computed on
values scaled by a power of two and widened by their rounding error.  Scores are exact:
as longs where no sum can leave 62 bits, else as integers of as many digits as needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import save

#: Queries of a group, vectors of a block of cells, and blocks of a group.
QUERY_GROUP, VECTOR_BLOCK, BLOCK_GROUP = 256, 4096, 64
#: Bits of a limb of a long score.
LIMB = 62
#: Relative rounding error that bounds are widened by, a multiple of what sums of products can have.
SLACK = 2.0**-44


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>) with v = floor(scale * x), x as double: whole numbers, exact at any size.

    Null vectors, vectors with a null, NaN or infinite component and null ids are left out, and so
    are those with a component that ``scale`` takes beyond the range of doubles (over 7e305 for 256).
    """
    scaled = lambda x: x.cast("double") * scale
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < float("inf")))
    # from 2^53 on a double is whole already
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: whole(scaled(x))).alias("v"))


def _packer(block: int, shift: int):
    """Rows (vec_id, v) to rows of up to ``block`` vectors of one dimension each; values are scaled by 2^-shift."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary()), ("low", pa.binary()), ("width", pa.binary())])

    def emit(ids: list[int], rows: list) -> pa.RecordBatch:
        v = np.ldexp(np.array(rows, np.float64).reshape(len(rows), -1), -shift)
        low = v.min(axis=0)
        width = (v.max(axis=0) - low) / 256
        cells = np.clip(np.floor((v - low) / np.where(width > 0, width, 1.0)), 0, 255).astype(np.uint8)
        one = [[v.shape[1]], [np.array(ids, np.int64).tobytes()], [cells.tobytes()], [low.tobytes()], [width.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(one, schema.types, strict=True)], schema=schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= block:
                    yield emit(*held.pop(len(v)))
        for ids, rows in held.values():
            yield emit(ids, rows)

    return pack, "dim int, ids binary, cells binary, low binary, width binary"


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of each query with each vector of the cells, rounding included."""
    corner = low + cells * width  # the least vector of the cell, up to rounding
    blur = (np.abs(low) + 256 * width) * SLACK  # cells are half open up to this much
    base, size = q @ corner.T, np.abs(q)
    error = (size @ (np.abs(corner) + width).T) * SLACK + (size @ blur)[:, None] + 1e-290
    return base + (np.minimum(q, 0) @ width)[:, None] - error, base + (np.maximum(q, 0) @ width)[:, None] + error


def _scan(k: int, shift: int):
    """Candidates of a group of queries among a group of cell blocks: a query keeps a running kth lower bound."""
    names = ["query_id", "vec_id", "lower", "upper"]

    def scan(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        sizes = asked["v"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if asked.num_rows else np.zeros(0, int)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for dim in np.unique(sizes).tolist():
            mine = asked.filter(pa.array(sizes == dim))
            qids = mine["vec_id"].to_numpy()
            q = np.ldexp(mine["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qids), dim), -shift)
            best, held = np.full((len(qids), k), -np.inf), []
            for b in blocks.to_batches():
                for r in range(b.num_rows):
                    if b["dim"][r].as_py() != dim:
                        continue
                    get = lambda name, kind: np.frombuffer(b[name][r].as_buffer(), kind)  # noqa: B023, E731
                    ids = get("ids", np.int64)
                    lower, upper = bounds(q, get("low", np.float64), get("width", np.float64), get("cells", np.uint8).reshape(len(ids), dim))
                    own = qids[:, None] == ids[None, :]
                    lower[own] = -np.inf
                    both = np.concatenate([best, lower], axis=1)
                    best = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                    i, j = np.nonzero((upper >= best.min(axis=1)[:, None]) & ~own)
                    held.append((i, ids[j], lower[i, j], upper[i, j]))
            for i, ids, lower, upper in held:
                open_ = upper >= best.min(axis=1)[i]
                for column, values in zip(found, (qids[i], ids, lower, upper), strict=True):
                    column.append(values[open_])
        return pa.table([pa.array(np.concatenate(c)) for c in found], names=names)

    return scan, "query_id long, vec_id long, lower double, upper double"


def _exact(limbs: int, shift: int):
    """Scores of (q, v) as limbs that order like the integers, as text, and about as scaled doubles."""
    names = ["query_id", "vec_id", "key", "text", "about"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, about = [], [], []
            for q, v in zip(b["q"].to_pylist(), b["v"].to_pylist(), strict=True):
                total = sum(int(x) * int(y) for x, y in zip(q, v, strict=True))
                lifted = total + (1 << (LIMB * limbs - 1))
                keys.append([lifted >> (LIMB * (limbs - 1 - i)) & ((1 << LIMB) - 1) for i in range(limbs)])
                texts.append(str(total))
                about.append(total / (1 << 2 * shift))
            yield pa.RecordBatch.from_arrays([b["query_id"], b["vec_id"], pa.array(keys, pa.list_(pa.int64())), pa.array(texts, pa.string()), pa.array(about, pa.float64())], names=names)

    return run, "query_id long, vec_id long, key array<long>, text string, about double"


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, exact_score: the k highest inner products of each query row.

    ``vectors``: (vec_id, v array<double> of whole numbers); ``is_query``: a condition on
    vec_id.  The candidates are all rows but those of the query's own id; ties go to the
    smaller id.  Vectors of another dimension than the query's are not comparable and take
    no part; those without components score 0.  Rows repeated with the same id and vector
    count once.  Of equal vectors only the k + 1 smallest ids can be among any query's best
    k, so only they are scanned.  exact_score is the score as text; score is a long, and
    its largest or smallest value where the score is beyond it.  An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = save(rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v"), "vectors")
    asked = save(rows.where(is_query).select("vec_id", "v"), "queries")
    told = kept.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.max(F.size("v")).alias("dim")).first()
    largest, dim = int(told["largest"] or 0), told["dim"] or 0
    bits = 2 * largest.bit_length() + dim.bit_length() + 1
    wide = bits > LIMB
    shift = largest.bit_length() if wide else 0
    pack, schema = _packer(VECTOR_BLOCK, shift)
    blocks = save(kept.mapInArrow(pack, schema).withColumn("block", F.monotonically_increasing_id()), "cells")
    groups, q_groups = -(-blocks.count() // BLOCK_GROUP) or 1, -(-asked.count() // QUERY_GROUP) or 1
    # every group of queries goes to every group of cells, as the search is stated
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "v", dealt("vec_id", q_groups).alias("qg"), every(groups).alias("g"))
    right = blocks.select("dim", "ids", "cells", "low", "width", every(q_groups).alias("qg"), dealt("block", groups).alias("g"))
    scan, out = _scan(k, shift)
    near = save(left.groupBy("qg", "g").cogroup(right.groupBy("qg", "g")).applyInArrow(scan, out), "near")
    best = Window.partitionBy("query_id").orderBy(F.desc("lower"), "vec_id")
    kth = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("lower").alias("kth"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))
    open_ = near.join(kth, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth"))).select("query_id", "vec_id", "upper")
    left = save(open_.withColumn("place", place), "bounds")
    whole = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("long") * b.cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    exact, read = None, 0
    while not left.isEmpty():
        reach = max(2 * k, 2 * read)
        now = left.where(F.col("place") <= reach).join(kept.select("vec_id", "v"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
        now = now.where(F.size("v") == F.size("q")).select("query_id", "vec_id", "q", "v")
        if wide:
            scored = now.mapInArrow(*_exact(-(-bits // LIMB) + 1, shift))
        else:
            scored = now.select("query_id", "vec_id", whole.alias("score")).select("query_id", "vec_id", F.array("score").alias("key"), F.col("score").cast("string").alias("text"), F.col("score").cast("double").alias("about"))
        scored = save(scored, "exact")
        exact, read = (scored if exact is None else exact.union(scored)), reach
        rest = left.where(F.col("place") > reach)
        if rest.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
        certain = exact.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", (F.col("about") - F.abs("about") * SLACK).alias("least"))
        # an upper bound that equals the kth score may still win by its smaller id
        left = save(rest.join(certain, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).drop("least"), "bounds")
    if exact is None:
        exact = spark.createDataFrame([], "query_id long, vec_id long, key array<long>, text string, about double")
    order = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    ranked = exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    beyond = F.when(F.col("text").startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.coalesce(F.expr("try_cast(text as bigint)"), beyond).alias("score"), F.col("text").alias("exact_score"))
