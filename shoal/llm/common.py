"""Shared pieces: written tables, exact global ranks, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal.sources.shared import shared_dir


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/shoal/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shoal_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table() that no later plan reads."""
    drop_path(df.sparkSession, df.shoal_path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now: the driver's collector tells Spark's cleaner what no plan holds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def share(spark: SparkSession, made: Any) -> Broadcast:
    """Broadcast the state of an object of this package; shared() makes it anew in a task."""
    return spark.sparkContext.broadcast(vars(made))


def shared(sent: Broadcast, kind: type) -> Any:
    out = kind.__new__(kind)
    vars(out).update(sent.value)
    return out


def global_rank(df: DataFrame, order: Sequence[str | Column], rank: str, name: str = "ranked") -> DataFrame:
    """Add the exact 0-based rank of each row under `order` (which must be a total order).

    Rows are range-partitioned and sorted, so a heavy prefix of the key is split by
    the rest of it; ranks come from per-partition counts, one row a partition.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The row goes as one value, so none of its columns can clash with those added here.
    placed = table(ranged.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), name)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    # One row a partition of the sort: bounded by the number of partitions.
    return placed.join(F.broadcast(starts), part == F.col("part")).select("row.*", (F.col("start") + place).alias(rank))


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Components of undirected `edges` (a long, b long): one row (node, component = smallest node).

    Large-star and small-star steps alternate until no edge changes; every step is a
    partial aggregation of minima and a join that Spark may split on hot nodes.
    Self-loops and repeated edges are allowed. Raises if `rounds` don't suffice.
    """
    current = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        step = table(small, "edges")
        was, now = sign, step.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        drop(current)
        current, sign = step, tuple(now)
        if sign == was:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
