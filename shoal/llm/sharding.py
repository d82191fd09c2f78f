"""Sharding along a Hilbert curve over several metadata columns.

Each dimension is quantised to `bits` levels, a Hilbert index orders the rows so that
neighbours on the curve are near in every dimension, and the order is cut into equal
runs. A reader that filters on any of the dimensions can then skip most shards by
their minima and maxima.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .common import global_rank


def hilbert(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points given by rows of `axes`, each below 2**bits.

    Skilling's transform: from the highest bit down, undo the reflection or the swap
    that each axis causes, Gray-code the result and interleave the bits.
    """
    x = axes.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[:, i] & q) != 0
            t = np.where(set_, low, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= t
            x[:, i] ^= np.where(set_, 0, t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[:, i] >> b) & 1)
    return out


def quantiles(df: DataFrame, column: str, bits: int) -> list[float]:
    """Cuts of a number column into 2**bits levels of about equal counts, from all rows (a bounded sketch)."""
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(F.percentile_approx(column, at, 10_000)).first()[0]
    return sorted(set(cuts or []))


def named_levels(df: DataFrame, column: str, bits: int) -> dict[str, int]:
    """Level of each of the most frequent 2**bits names, in the order of the names; all others take the level below."""
    top = df.groupBy(column).count().where(F.col(column).isNotNull()).orderBy(F.desc("count"), column).limit(1 << bits)
    names = sorted(r[0] for r in top.collect())
    return {n: i * (1 << bits) // len(names) for i, n in enumerate(names)}


def shard(df: DataFrame, shards: int, numbers: Sequence[str], names: Sequence[str], id_col: str, bits: int = 8) -> DataFrame:
    """Add shard (int), slot (long) and curve (long) to each row of df.

    numbers, names: columns that become dimensions. Numbers are cut at their quantiles,
    nulls taking the lowest level; names take a level each (the 2**bits most frequent
    ones), nulls and the rest the one of the name before them. Rows are ordered by
    (curve, id, hash of all columns); run s of the order is the rows of ranks floor(s n / shards)
    and on, so counts differ by one at most, however heavy a value is. Repeated ids are
    rows of their own. An empty table gives an empty result; fewer rows than shards
    leave some shards empty. Columns named shard, slot or curve are replaced (they may
    be dimensions); all others stay as they are, whatever their names.
    """
    if (len(numbers) + len(names)) * bits > 62:
        raise ValueError("dimensions times bits must be 62 at most")
    cuts = {c: quantiles(df, c, bits) for c in numbers}
    tops = {c: named_levels(df, c, bits) for c in names}
    dims = list(numbers) + list(names)

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        axes = []
        for name, s in zip(dims, columns, strict=True):
            if name in cuts:
                axes.append(np.searchsorted(np.array(cuts[name], float), s.astype(float).fillna(-np.inf).to_numpy(), side="left"))
            else:
                known = sorted(tops[name])
                at = np.searchsorted(np.array(known, object), s.fillna("").to_numpy(object), side="right") if known else np.zeros(len(s), int)
                level = np.array([0, *(tops[name][k] for k in known)])
                axes.append(level[at])
        return pd.Series(hilbert(np.minimum(np.stack(axes, 1), (1 << bits) - 1), bits))

    rest = [c for c in df.columns if c not in ("shard", "slot", "curve")]
    # The row goes as one value: its columns can't clash with those that place it. Long texts stay out of the sort key, whose samples go to the driver.
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c) for c in rest])
    rows = df.select(F.struct(*rest).alias("row"), F.col(id_col).alias("id"), curve(*[F.col(c) for c in dims]).alias("curve"), tie.alias("tie"))
    ranked = global_rank(rows, ["curve", "id", "tie"], "rank", "shards")
    n = max(1, ranked.count())
    shard_of = F.expr(f"cast((({shards} * (rank + 1)) - 1) div {n} as int)")
    return ranked.withColumn("shard", shard_of).select("row.*", "curve", "shard", F.expr(f"rank - (cast(shard as long) * {n}) div {shards}").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Write shard()'s rows as one folder a shard, in slot order within files; a large shard is several files of consecutive slots."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
