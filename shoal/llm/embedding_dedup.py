"""Near-duplicate vectors by collision counting on one-dimensional projections.

Unit vectors are projected on many random directions. Two of them collide in a
projection when one lies in the window around the other; near pairs collide in most
projections, others in few. The order of the first projection cuts the vectors into
blocks, and blocks further apart than a wide window on it never meet. Where two blocks
meet, collisions of all their pairs are counted projection by projection (small
whole numbers, a comparison each), and only pairs with enough of them are verified by
their cosine in double precision.

The count asked for is calibrated: it is the largest that a pair exactly at the
threshold reaches with probability `recall`. Equal vectors are one class beforehand.
A block pair yields sums and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop, global_rank, table

#: Vectors of a block.
BLOCK = 4096
#: Rows of a block compared with another block at once.
TILE = 256


class Plan(NamedTuple):
    """Directions (projections x dimensions), half width of a window, collisions asked for, gap of blocks."""

    directions: np.ndarray
    window: float
    count: int
    gap: float


def tail(m: int, p: float, k: int) -> float:
    """P(at least k of m) at chance p."""
    return sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k, m + 1))


def calibrate(dimensions: int, threshold: float, projections: int = 32, recall: float = 0.9995, width: float = 1.35, seed: int = 11) -> Plan:
    """Window `width` and gap in units of the distance of a pair at the threshold; the count follows from `recall`."""
    distance = math.sqrt(max(0.0, 2 - 2 * threshold)) or 1e-6
    chance = math.erf(width / math.sqrt(2))
    count = max(k for k in range(projections + 1) if tail(projections, chance, k) >= recall)
    directions = np.random.default_rng(seed).standard_normal((projections, dimensions))
    return Plan(directions, width * distance, count, 4.0 * distance)


def quantised(p: np.ndarray, window: float) -> np.ndarray:
    """Projections as bytes, 16 steps a half window, so a collision is |difference| <= 16 in whole numbers.

    Beyond +-7 half windows they are clamped; only pairs further out there meet more often than they should.
    """
    return (np.clip(np.rint(p * (16 / window)), -112, 112) + 128).astype(np.uint8)


def collisions(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of x and y (both projections x vectors) that collide at least `count` times."""
    met = np.zeros((x.shape[1], y.shape[1]), np.uint8)
    for a, b in zip(x, y, strict=True):
        # a difference of -17..17 (one more for rounding) lands in 0..34, all others above, modulo 256
        met += (a[:, None] + np.uint8(17) - b[None, :]) <= np.uint8(34)
    return np.nonzero(met >= count)


def links_of(ids: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray], vectors: tuple[np.ndarray, np.ndarray], codes: tuple[np.ndarray, np.ndarray], same: bool, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of two blocks: (id, how many vectors it links to, smallest id met with it here)."""
    (ia, ib), (sa, sb), (va, vb), (ca, cb) = ids, sizes, vectors, codes
    n_a, n_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    root = np.arange(len(ia) + len(ib))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def top(r: np.ndarray) -> np.ndarray:
        while (r[r] != r).any():
            r = r[r]
        return r

    for start in range(0, len(ia), TILE):
        i, j = collisions(ca[:, start : start + TILE], cb, count)
        i += start
        if same:
            i, j = i[j > i], j[j > i]
        for cut in range(0, len(i), 100_000):
            a, b = i[cut : cut + 100_000], j[cut : cut + 100_000]
            near = np.einsum("ij,ij->i", va[a], vb[b]) >= threshold
            a, b = a[near], b[near]
            n_a += np.bincount(a, weights=sb[b], minlength=len(ia)).astype(np.int64)
            n_b += np.bincount(b, weights=sa[a], minlength=len(ib)).astype(np.int64)
            root, q = top(root), b if same else b + len(ia)
            apart = root[a] != root[q]  # most links of a large group join what is joined already
            for p, q in zip(a[apart].tolist(), q[apart].tolist(), strict=True):
                p, q = find(p), find(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
    every, n = np.concatenate([ia, ib]), np.concatenate([n_a, n_b])
    if same:
        every, n, root = ia, n_a + n_b, root[: len(ia)]
    tops = top(root)
    least = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(least, tops, every)
    some = n > 0
    return every[some], n[some], least[tops][some]


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", projections: int = 32, recall: float = 0.9995) -> DataFrame:
    """(id_col long, n_links long, component_id long, kept boolean) of each row of df.

    Rows link at a cosine of `threshold` or more in double precision. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and only
    vectors of one length link with each other. Ids are whole numbers; a repeated id is
    one vector more that others link to, and its rows each have the links and component
    of their own vector; a row without an id links with nothing. n_links counts other
    rows. Other columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    short = dict(df.dtypes)[vector] == "array<float>"  # then blocks carry the vectors as they are, in four bytes a component
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("id").isNotNull()
    rows = rows.withColumn("fine", fine)
    alone = rows.where(~F.col("fine")).select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    good = rows.where("fine")
    classes = table(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("size")).withColumn("d", F.size("v")), "vectors")
    widest = classes.agg(F.max("d")).first()[0]
    if not widest:
        return alone.withColumn("kept", F.col(id_col).isNotNull())
    # The first d components of a random direction are one for vectors of length d.
    plan = calibrate(widest, threshold, projections, recall)
    sent = classes.sparkSession.sparkContext.broadcast(tuple(plan))
    window, count, gap = plan.window, plan.count, plan.gap

    @F.pandas_udf("double")
    def along(v: pd.Series) -> pd.Series:
        first = sent.value[0][0]
        return pd.Series([x @ first[: len(x)] / np.linalg.norm(x) for x in v.to_numpy()])

    # A class goes by its rank; equal places are told apart by the vector itself.
    ranked = global_rank(classes.withColumn("at", along("v")), ["d", "at", "rep", "v"], "class", "by-projection")
    widths = ranked.groupBy("d").agg(F.min("class").alias("_from"), F.count("*").alias("_n"))
    blocked = ranked.join(widths, "d").withColumn("block", (F.col("class") - F.col("_from")) * F.ceil(F.col("_n") / BLOCK) / F.col("_n"))
    blocked = blocked.withColumn("block", F.floor("block").cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        codes = quantised(x / np.linalg.norm(x, axis=1)[:, None] @ sent.value[0][:, : x.shape[1]].T, window).T
        return pd.DataFrame({"d": [x.shape[1]], "block": [pdf["block"].iloc[0]], "lo": [pdf["at"].min()], "hi": [pdf["at"].max()], "ids": [pdf["class"].to_numpy(np.int64).tobytes()],
                             "sizes": [pdf["size"].to_numpy(np.int64).tobytes()], "vectors": [x.astype(np.float32 if short else np.float64).tobytes()], "codes": [np.ascontiguousarray(codes).tobytes()]})

    blocks = table(blocked.select("d", "block", "at", "class", "size", "v").groupBy("d", "block").applyInPandas(pack, "d int, block int, lo double, hi double, ids binary, sizes binary, vectors binary, codes binary"), "blocks")
    # How far each block reaches: the last one of its width that begins within the gap. One row a block.
    ends = blocks.select("d", F.col("lo").alias("x"), F.lit(1).alias("begins"), F.lit(None).cast("int").alias("block")).unionByName(
        blocks.select("d", (F.col("hi") + gap).alias("x"), F.lit(0).alias("begins"), "block"))
    reach = F.sum("begins").over(Window.partitionBy("d").orderBy("x", F.desc("begins")).rowsBetween(Window.unboundedPreceding, 0))
    pairs = (ends.withColumn("last", reach.cast("int") - 1).where("block is not null")
             .select("d", F.col("block").alias("a"), F.explode(F.expr("sequence(block, greatest(block, last))")).alias("b")))
    left = blocks.select("d", F.col("block").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("ids", "sizes", "vectors", "codes")])
    right = blocks.select("d", F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("ids", "sizes", "vectors", "codes")])
    met = pairs.join(left, ["d", "a"]).join(right, ["d", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                sides = []
                for s in "ab":
                    ids = np.frombuffer(row[f"ids_{s}"], np.int64)
                    x = np.frombuffer(row[f"vectors_{s}"], np.float32 if short else np.float64).reshape(len(ids), -1).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    sides.append((ids, np.frombuffer(row[f"sizes_{s}"], np.int64), x, np.frombuffer(row[f"codes_{s}"], np.uint8).reshape(-1, len(ids))))
                out = links_of(*zip(*sides, strict=True), row["a"] == row["b"], count, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "n", "least"])

    links = table(met.mapInArrow(meet, "id long, n long, least long"), "vector-links")
    drop(blocks)
    labels = connected_components(links.select(F.col("id").alias("a"), F.col("least").alias("b")))
    sums = links.groupBy(F.col("id").alias("class")).agg(F.sum("n").alias("n"))
    labels = labels.toDF("class", "label")
    least = labels.join(ranked.select("class", "rep"), "class").groupBy("label").agg(F.min("rep").alias("component"))
    found = ranked.select("class", "v", "rep", "size").join(sums, "class", "left").join(labels.join(least, "label"), "class", "left")
    found = found.select("v", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(found, "v").select(F.col("id").alias(id_col), "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
