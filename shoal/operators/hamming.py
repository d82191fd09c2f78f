"""Hamming joins of 64-bit hashes by a multi-index whose bands fit the number of hashes, and first-come deduplication on top.

Limits so wide that a band's value is near many hashes, or so many lookups that comparing
is less work, are met by blocks of hashes: all pairs of them, a word's operation a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import hamming
from shoal.sources.shared import checkpointed

#: A band's value that more hashes than this hold is looked up by the other bits too.
HOT = 512
#: Hot values that are sent to all tasks at most; more of them are joined by a shuffle.
BROADCAST_VALUES = 500_000
#: Pairs that blocks compare in the time of one lookup or candidate of the bands.
RATIO = 250
#: Hashes of a block, pairs of blocks of a task once there are many, and results of a step that compares.
BLOCK, PAIRS, STEP = 32_768, 64, 1 << 18

#: Pairs that are compared in the time in which one row goes to a group, keys a hash has and rows of a bucket of groups, at most or about.
COPY, KEYS, BUCKET = 500, 256, 65_536
#: Buckets of groups that a task compares, about, and sets of groups that are counted as one to see that none is large.
BUCKETS, SETS = 4, 65_536
#: Rounds after which what they kept is written anew as one table.
TABLES = 16

#: (first bit, width, radius) of a band.
Band = tuple[int, int, int]


def bands(most: int, n: int, bits: int = 64) -> list[Band]:
    """Bands of a hash such that hashes at most `most` bits apart nearly agree in one of them, within its radius.

    Of m bands one differs in most // m bits or fewer, and all but the first most % m + 1
    of them need one bit less. The number of bands is the one with the fewest lookups and
    candidates a hash among n hashes: bands are about log2(n) bits wide, so that a value
    is held by few. None if comparing all pairs is less work.
    """
    best, least = [], float(n)
    for m in range(1, min(most + 1, bits) + 1):
        cuts = [round(k * bits / m) for k in range(m + 1)]
        some = [(lo, hi - lo, most // m - (k > most % m)) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        some = [b for b in some if b[2] >= 0]
        cost = sum(probes(w, r) * (1 + n / 2**w) for _, w, r in some)
        if cost < least:
            best, least = some, cost
    return best


def probes(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(min(radius, width) + 1))


def masks(width: int, radius: int) -> list[int]:
    """What a band's value may be changed by."""
    return [sum(1 << b for b in some) for r in range(min(radius, width) + 1) for some in combinations(range(width), r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def indexed(hashes: DataFrame, h: str, plan: list[Band], ask: bool, name: str) -> DataFrame:
    """Rows with a band and its value (`name`_band, `name`): each band's own, or all values within its radius."""
    said = ", ".join(f"struct({k} AS band, {lo} AS lo, {signed((1 << w) - 1)}L AS keep, array({', '.join(f'{signed(m)}L' for m in (masks(w, r) if ask else [0]))}) AS masks)" for k, (lo, w, r) in enumerate(plan))
    rows = hashes.select("*", F.explode(F.expr(f"array({said})")).alias("p"))
    own = F.expr(f"shiftrightunsigned({h}, p.lo) & p.keep")
    return rows.select(*hashes.columns, F.col("p.band").alias(f"{name}_band"), own.alias("own"), F.explode("p.masks").alias("mask")).select(*hashes.columns, f"{name}_band", F.col("own").bitwiseXOR(F.col("mask")).alias(name))


def other_bits(h: str, band: str, plan: list[Band]) -> Column:
    """A hash turned so that a band's bits come last (highest), and the others first."""
    turned = F.lit(None).cast("long")
    for k, (lo, w, _) in enumerate(plan):
        hi = (lo + w) % 64
        turned = F.when(F.col(band) == k, F.col(h) if not hi else F.expr(f"shiftrightunsigned({h}, {hi}) | shiftleft({h}, {64 - hi})")).otherwise(turned)
    return turned


def compared(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(h, g) of all near pairs of two tables of distinct hashes (h,) and (g,): each block of one meets each of the other, a pair of blocks about a task."""
    many = [max(1, -(-df.count() // BLOCK)) for df in (left, right)]
    one, two = (df.groupBy(F.pmod(F.xxhash64(c), F.lit(k)).alias(f"_{c}")).agg(F.collect_list(c).alias(c)) for df, c, k in zip((left, right), "hg", many, strict=True))
    met = one.crossJoin(two).select("h", "g")
    pairs = many[0] * many[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = (c.values.to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y))
                rows = max(1, STEP // len(y))
                for s in range(0, len(x), rows):
                    part = x[s : s + rows]
                    i, j = np.divmod(np.flatnonzero(np.bitwise_count((part[:, None] ^ y).view(np.uint64)) <= most), len(y))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(part[i]), pa.array(y[j])], names=["h", "g"])

    return met.repartition(max(min(pairs, 4096), -(-pairs // PAIRS))).mapInArrow(run, "h long, g long")


def candidates(left: DataFrame, right: DataFrame, most: int, n: int) -> DataFrame:
    """Pairs (h, g) of distinct hashes of two tables (h,) and (g,) that may be near; all that are, some several times."""
    plan = bands(most, n)
    if not plan or RATIO * sum(probes(w, r) * (1 + n / 2**w) for _, w, r in plan) > n:
        return compared(left, right, most)
    asked, held = indexed(left, "h", plan, True, "v"), indexed(right, "g", plan, False, "v")
    key = ["v_band", "v"]
    hot = checkpointed(held.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > HOT))
    values, largest = hot.agg(F.count("*"), F.max("c")).first()
    if not values:
        return asked.join(held, key).select("h", "g")
    near = F.broadcast(hot.select(*key)) if values <= BROADCAST_VALUES else hot.select(*key)
    cold = asked.join(near, key, "left_anti").join(held.join(near, key, "left_anti"), key).select("h", "g")
    # Within a hot value the other bits are no further apart than all are, and are indexed again.
    rest = 64 - max(w for _, w, _ in plan)
    plan_2 = bands(most, largest, rest)
    if not plan_2:
        return cold.unionByName(asked.join(near, key, "left_semi").join(held, key).select("h", "g"))
    deeper = lambda df, h, ask: indexed(df.join(near, key, "left_semi").withColumn("rest", other_bits(h, "v_band", plan)), "rest", plan_2, ask, "w").drop("rest")
    return cold.unionByName(deeper(asked, "h", True).join(deeper(held, "g", False), [*key, "w_band", "w"]).select("h", "g"))


def agreeing(most: int, n: int, varying: int) -> list[int]:
    """Masks of which hashes at most `most` bits apart agree in one at least, by the bits that vary; those with the fewest copies and comparisons a hash. None if comparing all pairs is less work.

    Of m segments at least m - most are alike, so each choice of as many is a mask.
    """
    at = [b for b in range(64) if varying >> b & 1]
    best, least = [], float(n)
    for m in range(most + 1, len(at) + 1):
        keys = comb(m, most)
        if keys > KEYS:
            break
        cost = keys * (COPY + n / 2 ** (len(at) * (m - most) / m))
        if cost < least:
            cuts = [round(k * len(at) / m) for k in range(m + 1)]
            parts = [sum(1 << b for b in at[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            best, least = [sum(some) for some in combinations(parts, m - most)], cost
    return best


def grouped(left: DataFrame, right: DataFrame | None, most: int, n: int, varying: int) -> DataFrame | None:
    """(h, g) of near pairs of two tables (h,) and (g,), or of one (h < g): hashes that agree in a mask meet in arrays; some pairs several times. None where that is more work than other ways, or a group is larger than a block."""
    plan = agreeing(most, n, varying)
    if not plan:
        return None
    sides = left.select("h", F.lit(0).alias("side"))
    if right is not None:
        sides = sides.unionByName(right.select(F.col("g").alias("h"), F.lit(1).alias("side")))
    mask = F.explode(F.expr(f"array({', '.join(f'struct({k} AS k, {signed(m)}L AS m)' for k, m in enumerate(plan))})"))
    tasks = max(1, -(-n * len(plan) // (64 * BUCKET)))
    rows = sides.repartition(tasks).select("h", "side", mask.alias("p")).select("h", "side", F.xxhash64("p.k", F.col("h").bitwiseAND(F.col("p.m"))).alias("key"))
    # Few rows of sums a task, whatever the number of hashes; a set of groups is seldom larger than a block, else its groups are counted.
    for some in (F.pmod("key", F.lit(SETS)), F.col("key")):
        largest = rows.groupBy(some.alias("some"), "side").count().agg(F.max("count")).first()[0] or 0
        if largest <= BLOCK:
            break
    else:
        return None
    alone = right is None

    def meet(table: pa.Table) -> pa.Table:
        h, side, key = (table.column(c).to_numpy() for c in ("h", "side", "key"))
        order = np.lexsort((side, key))
        h, side, key = h[order], side[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        some = []
        for start, end in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            two = start + int(np.searchsorted(side[start:end], 1))
            x, y = (h[start:end],) * 2 if alone else (h[start:two], h[two:end])
            step = max(1, STEP // max(1, len(y)))
            for s in range(0, len(x), step):
                part, rest = x[s : s + step], y[s:] if alone else y
                near = np.flatnonzero(np.bitwise_count((part[:, None] ^ rest).view(np.uint64)) <= most)
                i, j = np.divmod(near, max(1, len(rest)))
                if alone:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    some.append((part[i], rest[j]))
        one, two = (np.concatenate([p[k] for p in some]) if some else np.zeros(0, np.int64) for k in range(2))
        return pa.table({"h": np.minimum(one, two), "g": np.maximum(one, two)} if alone else {"h": one, "g": two})

    # Rows are few bytes and much work: a number of tasks is said, as tasks by size would be one or two.
    buckets = max(1, -(-n * len(plan) // BUCKET))
    dealt = rows.withColumn("bucket", F.pmod("key", F.lit(buckets))).repartition(-(-buckets // BUCKETS), "bucket")
    return dealt.groupBy("bucket").applyInArrow(meet, "h long, g long")


def near_hashes(left: DataFrame, most: int, right: DataFrame | None = None) -> DataFrame:
    """(h, g, dist) of distinct hashes at most `most` bits apart: h < g within one table (h,), or h of it and g of the other (g,). Nulls never join."""
    left = checkpointed(left.where("h is not null").select("h").distinct())
    other = left.select(F.col("h").alias("g")) if right is None else checkpointed(right.where("g is not null").select("g").distinct())
    dist = hamming("h", "g")
    ones = [df.agg(F.count("*"), F.bit_or(c), F.bit_and(c)).first() for df, c in ((left, "h"), (other, "g"))]
    n = ones[1][0]
    if not n or not ones[0][0]:
        return left.crossJoin(other).where("false").select("h", "g", dist.alias("dist"))
    varying = (ones[0][1] | ones[1][1]) & ~(ones[0][2] & ones[1][2]) & (1 << 64) - 1
    met = grouped(left, None if right is None else other, most, max(n, ones[0][0]), varying)
    if met is None:
        met = candidates(left, other, most, n)
    return met.where((dist <= most) & (F.col("h") < F.col("g") if right is None else F.lit(True))).select("h", "g", dist.alias("dist")).distinct()


def hamming_join(hashes: DataFrame, most: int, other: DataFrame | None = None) -> DataFrame:
    """(a, b, dist) of ids (id, h) whose 64-bit hashes differ in at most `most` bits: a < b within one table, or a of it and b of the other.

    Null hashes never join. All pairs of equal hashes are pairs; hash_links and first_come
    don't need them.
    """
    if other is not None:
        pairs = near_hashes(hashes, most, other.select(F.col("h").alias("g")))
        return pairs.join(hashes.select(F.col("id").alias("a"), "h"), "h").join(other.select(F.col("id").alias("b"), F.col("h").alias("g")), "g").select("a", "b", "dist")
    pairs = near_hashes(hashes, most)
    same = hashes.where("h is not null").select("h").distinct().select("h", F.col("h").alias("g"), F.lit(0).alias("dist"))
    one, two = hashes.select(F.col("id").alias("a"), "h"), hashes.select(F.col("id").alias("b"), F.col("h").alias("g"))
    met = pairs.unionByName(same).join(one, "h").join(two, "g").where("h <> g or a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "dist")


def hash_links(hashes: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that connect what hamming_join would, with one row for each further copy of a hash."""
    reps = checkpointed(hashes.where("h is not null").groupBy("h").agg(F.min("id").alias("rep")))
    copies = hashes.join(reps, "h").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    pairs = near_hashes(reps, most).join(reps, "h").select(F.col("rep").alias("a"), "g")
    return copies.unionByName(pairs.join(reps.select(F.col("h").alias("g"), F.col("rep").alias("b")), "g").select("a", "b"))


def first_come(hashes: DataFrame, most: int, known: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(id,) of the rows (id, h) that are kept when rows come in the order of their ids and one is kept unless it is within `most` bits of a kept one, or of a known hash (h,).

    Copies of a hash share the lot of the first one, which alone goes on: of an equal pair
    the later is near the earlier, or both are near what dropped it. Then rounds: a row all
    of whose earlier neighbours are dropped is kept, and drops its later ones. Each round
    settles the first row left and whatever doesn't hang on others, so there are as many
    as the longest chain of doubt, of which near duplicates have few. Rows without a hash are kept.
    """
    blank = hashes.where("h is null").select("id")
    first = checkpointed(hashes.where("h is not null").groupBy("h").agg(F.min("id").alias("id")))
    if known is not None:
        there = near_hashes(first, most, known.select(F.col("h").alias("g"))).select("h").distinct()
        first = checkpointed(first.join(there, "h", "left_anti"))
    ids = first.select("h", F.col("id").alias("x"))
    pairs = near_hashes(first, most).join(ids, "h").join(first.select(F.col("h").alias("g"), F.col("id").alias("y")), "g")
    edges = checkpointed(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    settled = checkpointed(first.join(edges.select(F.col("b").alias("id")), "id", "left_anti").select("id"))  # no earlier neighbour
    kept = [settled]
    for _ in range(rounds):
        # What the rows settled last are near to is dropped, with its edges; who has no earlier neighbour left is kept.
        gone = edges.join(settled.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        gone = checkpointed(gone)
        if gone.isEmpty():
            return reduce(DataFrame.unionByName, kept, blank)
        waiting = edges.join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        left = checkpointed(waiting.join(gone.select(F.col("id").alias("a")), "a", "left_anti"))
        was = edges.select("b").union(edges.select("a")).distinct().toDF("id")
        settled = checkpointed(was.join(gone, "id", "left_anti").join(settled, "id", "left_anti").join(left.select(F.col("b").alias("id")), "id", "left_anti"))
        # Rows that were settled before have no edges left but to what is gone.
        kept, edges = [*kept, settled], left
        if len(kept) > TABLES:
            kept = [checkpointed(reduce(DataFrame.unionByName, kept))]
    raise RuntimeError(f"first-come deduplication didn't settle in {rounds} rounds")
