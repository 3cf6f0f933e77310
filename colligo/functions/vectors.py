"""Column functions over scalars and ARRAY<DOUBLE> vectors; all stay in Spark's expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_LOSS_EPSILON = 1e-15
TOLERANCE = 1e-3


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, e: a + e)


# scalars


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss_term(p: Column, y: Column) -> Column:
    """-(y ln p + (1 - y) ln(1 - p)) with p clipped away from 0 and 1."""
    clipped = F.least(F.greatest(p, F.lit(LOG_LOSS_EPSILON)), F.lit(1 - LOG_LOSS_EPSILON))
    return -(y * F.ln(clipped) + (1 - y) * F.ln(1 - clipped))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE


def combinations(n: Column, r: Column) -> Column:
    """n over r as a long; 0 for r < 0 or r > n."""
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(r.cast("long"), F.lit(1).cast("long")))
    value = F.aggregate(steps, F.lit(1).cast("long"), lambda f, i: F.call_function("div", f * (n.cast("long") - i + 1), i))
    return F.when((r < 0) | (r > n), F.lit(0).cast("long")).when(r == 0, F.lit(1).cast("long")).otherwise(value)


def kernel_shap_weight(d: Column, z: Column) -> Column:
    """(d - 1) / (C(d, z) z (d - z)), at least 1e-6, and 1e-6 for empty and full coalitions."""
    floor = F.lit(1e-6)
    inner = (d - 1) / (combinations(d, z) * z * (d - z))
    return F.when((z == 0) | (z == d), floor).otherwise(F.greatest(floor, inner))


# vectors


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda p, q: p * q))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda e: e * by)


def negate(v: Column) -> Column:
    return F.transform(v, lambda e: -e)


def vector_sum(v: Column) -> Column:
    return _sum(v)


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def sum_normalize(v: Column) -> Column:
    return F.transform(v, lambda e: e / _sum(v))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    return sum_normalize(F.transform(v, lambda e: F.exp(e - top)))


def argmax(v: Column) -> Column:
    """Index of the first maximum, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def index_of(v: Column, e: Column | float) -> Column:
    """First index of a value, or -1."""
    return F.array_position(v, e) - 1


def top_k_indices(v: Column, k: int) -> Column:
    """Indices of the k largest entries, largest first; ties to the lower index."""
    numbered = F.transform(v, lambda e, i: F.struct((-e).alias("e"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(numbered), 1, k), lambda s: s["i"])


def take(v: Column, indices: Sequence[int]) -> Column:
    return F.array(*[F.get(v, F.lit(i)) for i in indices])


def one_hot(y: Column, classes: int) -> Column:
    return F.array(*[F.when(y == c, 1.0).otherwise(0.0) for c in range(classes)])


def label_moments(y: Column) -> Column:
    return F.array(y, y * y)


def affine(v: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """One entry for each row of ``weights``: dot(row, v) + bias."""
    rows = [dot(F.array(*[F.lit(float(w)) for w in row]), v) + F.lit(float(b)) for row, b in zip(weights, bias, strict=True)]
    return F.array(*rows)


def transpose(m: Column) -> Column:
    """ARRAY<ARRAY>: rows to columns."""
    return F.transform(F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def reshape(v: Column, width: int) -> Column:
    """A flat vector as rows of ``width``; the last one may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda r: F.slice(v, r * width + 1, width))


# fixed point


def encode_fixed(x: Column, bits: int = 16) -> Column:
    """STRUCT<mantissa, exponent>: x * 2^bits, truncated toward zero."""
    scaled = x * F.lit(float(2**bits))
    return F.struct(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("decimal(38,0)").alias("mantissa"), F.lit(-bits).alias("exponent"))


def decode_fixed(c: Column) -> Column:
    return c["mantissa"].cast("double") * F.pow(F.lit(2.0), c["exponent"].cast("double"))


def rescale_fixed(c: Column, exponent: int) -> Column:
    """The number with another exponent; lost bits are truncated toward zero."""
    scaled = c["mantissa"].cast("double") * F.pow(F.lit(2.0), (c["exponent"] - exponent).cast("double"))
    return F.struct(F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("decimal(38,0)").alias("mantissa"), F.lit(exponent).alias("exponent"))


def add_fixed(a: Column, b: Column, exponent: int = -16) -> Column:
    x, y = rescale_fixed(a, exponent), rescale_fixed(b, exponent)
    return F.struct((x["mantissa"] + y["mantissa"]).cast("decimal(38,0)").alias("mantissa"), F.lit(exponent).alias("exponent"))


def residue_sign(v: Column, n: int) -> Column:
    """State of a residue modulo n: positive below n/3, negative above 2n/3, else overflow."""
    return F.when((v < 0) | (v >= n), "invalid").when(3 * v <= n, "positive").when(3 * v >= 2 * n, "negative").otherwise("overflow")


# additive shares and hashing


#: The multiplier of both mixing steps, below 2^27 so that products stay below 2^59, and the step between seeds.
MIX, SEED_STEP = 73244475, 40503


def seed_mask(seed: int) -> int:
    """32 mixed bits of a seed."""
    x = (seed * SEED_STEP + 1) % 2**32
    for _ in range(3):
        x = (x ^ (x >> 16)) * MIX % 2**32
    return x ^ (x >> 16)


def hash32(key: Column, seed: int = 51) -> Column:
    """32 mixed bits of (key, seed) that any engine can compute; orders under two seeds are independent.

    x = (key mod 2^32) xor mask(seed), then twice x = (x xor x / 2^16) * MIX mod 2^32, and a last xor.
    """
    x = F.pmod(key.cast("long"), F.lit(2**32)).bitwiseXOR(F.lit(seed_mask(seed)).cast("long"))
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX).cast("long")).bitwiseAND(F.lit(2**32 - 1))
    return x.bitwiseXOR(F.shiftright(x, 16))


def hashed(key: np.ndarray, seed: int = 51) -> np.ndarray:
    """``hash32`` of a batch of longs."""
    x = (key & (2**32 - 1)) ^ seed_mask(seed)
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) & (2**32 - 1)
    return x ^ (x >> 16)


def split_shares(value: Column, key: Column, parties: int, seed: int = 51) -> Column:
    """One share for each party; all but the first are masks derived from the key, and they sum to the value."""
    masks = [(hash32(key, seed + p) % 32767).cast("double") for p in range(1, parties)]
    total = sum(masks[1:], masks[0]) if masks else F.lit(0.0)
    return F.array(value - total, *masks)


def join_shares(shares: Column) -> Column:
    return F.round(_sum(shares), 9)
