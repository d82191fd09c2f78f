"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scale(v: str | Column, by: float) -> Column:
    return F.transform(col(v), lambda x: x * by)


def weighted_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: str | Column, b: str | Column) -> Column:
    """H1: inner product; 0 for lengths that differ or are 0."""
    a, b = col(a), col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: str | Column) -> Column:
    """H2: divide by the norm plus 1e-10."""
    return divided(v, lambda w: norm(w) + 1e-10)


def unit(v: str | Column) -> Column:
    return divided(v, norm)


def divided(v: str | Column, by: Callable[[Column], Column]) -> Column:
    """A vector over a number made of it. Both are bound to a variable, so they are made once and not anew for each component."""
    both = F.transform(F.array(col(v)), lambda w: F.struct(w.alias("w"), by(w).alias("n")))
    return F.transform(both, lambda s: F.transform(s["w"], lambda x: x / s["n"]))[0]


def cosine(a: str | Column, b: str | Column) -> Column:
    """H3: cosine of vectors of any length; null if one is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def mean_renormalised(frames: str | Column) -> Column:
    """H4: mean of the non-empty vectors of a list, normalised; null without any."""
    full = F.filter(col(frames), lambda f: F.size(f) > 0)
    total = F.aggregate(F.slice(full, F.lit(2), F.size(full)), F.element_at(full, 1), lambda s, f: F.zip_with(s, f, lambda x, y: x + y))
    return F.when(F.size(full) > 0, l2_normalize(F.transform(total, lambda x: x / F.size(full))))


def hamming(a: str | Column, b: str | Column) -> Column:
    """H6: bits in which two 64-bit hashes differ."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def sign_hash(v: str | Column) -> Column:
    """A 64-bit hash of the signs of all components, most significant first; of longer vectors each bit is the parity of the signs 64 apart. Null for a null vector."""
    v = col(v)
    bit = lambda x: (x > 0).cast("long")
    turn = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    # Bits go round: after 64 components the first one's place is met again.
    signs = F.aggregate(v, F.lit(0).cast("long"), lambda h, x: turn(h).bitwiseXOR(F.coalesce(bit(x), F.lit(0).cast("long"))))
    return F.when(v.isNotNull(), signs)


def best_of(frames: Column, query: Column) -> Column:
    """I8: the largest inner product of a query with any of a list of vectors; null without one."""
    return F.array_max(F.transform(F.filter(frames, lambda f: F.size(f) > 0), lambda f: dot(f, query)))


def difference_hash(pixels: str | Column) -> Column:
    """H7: 64 bits from 8 rows of 9 grey values: is a pixel below the one to its right, row by row, first bit highest."""
    p = col(pixels)
    places = F.sequence(F.lit(0), F.lit(63))
    bit = lambda k: (F.element_at(p, (k + F.floor(k / 8) + 2).cast("int")) > F.element_at(p, (k + F.floor(k / 8) + 1).cast("int"))).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, k: F.shiftleft(h, 1).bitwiseOR(bit(k)))
