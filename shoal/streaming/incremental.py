"""Streams whose batches meet stored tables: assignment, duplicates, reclustering, library changes."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators.hamming import first_come
from shoal.operators.maintain import change_feed
from shoal.operators.simjoin import nearest_prototype
from shoal.operators.timeline import cell
from shoal.sources.shared import checkpointed, listed, touch


def located_cells(uploads: DataFrame, by: int = 100) -> DataFrame:
    """(cell, lat, lon) of located uploads."""
    return uploads.where("lat is not null and lon is not null").select(cell("lat", "lon", by).alias("cell"), "lat", "lon")


def appended(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch to a folder of its own, which a batch run again overwrites."""

    def do(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return do


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last batch's row of each key, of what appended() wrote."""
    held = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*held), "batch").alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in held])


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run `do` on each micro-batch of what there is, then stop. Timers of keyed state wait for a run that stays."""
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")  # else timers call for one batch after the other, without an end
    try:
        return stream.writeStream.outputMode("update").foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, was)


def assign_and_append(protos: DataFrame, path: str, least: float = 0.42) -> Callable[[DataFrame, int], None]:
    """Each batch (vec_id, v) to existing prototypes and appended, with its counts a person; no new people. A batch run again overwrites its own folders."""

    def do(batch: DataFrame, number: int) -> None:
        at = f"{path}/faces/batch={number}"
        nearest_prototype(batch, protos, least).write.mode("overwrite").parquet(at)
        new = batch.sparkSession.read.parquet(at)
        new.where("proto >= 0").groupBy("proto").agg(F.countDistinct("vec_id").alias("n")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return do


def refreshed_counts(spark: SparkSession, path: str) -> DataFrame:
    """(proto, n) over all batches that assign_and_append wrote: sums of the batches' counts, so no face is read again."""
    return spark.read.schema("proto long, n long, batch long").parquet(f"{path}/counts").groupBy("proto").agg(F.sum("n").alias("n"))


class Reclustering:
    """Full runs on request, one at a time; requests during a run cause one more run.

    Requests and runs are kept as empty files below a path, so a restart knows what is
    still wanted. A request has a name, and naming it again asks for nothing new: a batch
    that Spark runs twice asks once. Each run has an epoch of its own (from 1), which
    guards the numbering that it makes (see maintain.matched_epoch).
    """

    def __init__(self, spark: SparkSession, path: str, run: Callable[[int], None]):
        self.spark, self.path, self.run, self.busy = spark, path, run, threading.Lock()

    def request(self, name: str) -> None:
        touch(self.spark, f"{self.path}/requested/{name}")

    def pending(self) -> set[str]:
        return set(listed(self.spark, f"{self.path}/requested")) - set(listed(self.spark, f"{self.path}/served"))

    def epoch(self) -> int:
        """The last run that was finished, 0 before the first."""
        return max((int(n) for n in listed(self.spark, f"{self.path}/epochs")), default=0)

    def settle(self) -> int:
        """Run while there are requests, unless another thread does already and will see them; how many runs that took."""
        runs = 0
        while self.pending() and self.busy.acquire(blocking=False):
            try:
                while wanted := self.pending():
                    epoch = self.epoch() + 1
                    self.run(epoch)
                    touch(self.spark, f"{self.path}/epochs/{epoch}")
                    for name in wanted:
                        touch(self.spark, f"{self.path}/served/{name}")
                    runs += 1
            finally:
                self.busy.release()
        return runs

    def after(self, enough: int) -> Callable[[DataFrame, int], None]:
        """For each_batch: a request for each batch of at least `enough` new rows."""

        def do(batch: DataFrame, number: int) -> None:
            if batch.limit(enough).count() >= enough:
                self.request(f"batch-{number}")
            self.settle()

        return do


def library_changes(path: str) -> Callable[[DataFrame, int], None]:
    """What changes from snapshot to snapshot of a stream (snapshot long, id): (snapshot, id, change) below path/changes.

    Each snapshot is whole and comes in one batch; the last one of a batch is stored and
    met by the next batch, so inserted rows come as they appear and removed ones as they
    are missed. A batch run again overwrites its own folders.
    """

    def do(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = checkpointed(batch.select("snapshot", "id").where("id is not null").distinct())
        before = known_snapshot(spark, path, number)
        changes = spark.createDataFrame([], "snapshot long, id long, change string")
        for (snapshot,) in rows.select("snapshot").distinct().orderBy("snapshot").collect():  # the snapshots of a batch: a few
            after = rows.where(F.col("snapshot") == snapshot).select("id")
            changes = changes.unionByName(change_feed(before, after).select(F.lit(snapshot).cast("long").alias("snapshot"), "id", "change"))
            before = after
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        before.write.mode("overwrite").parquet(f"{path}/known/batch={number}")

    return do


def known_snapshot(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The snapshot that the last batch before one has stored."""
    earlier = [int(n.removeprefix("batch=")) for n in listed(spark, f"{path}/known") if n.startswith("batch=")]
    last = max((n for n in earlier if n < number), default=None)
    return spark.createDataFrame([], "id long") if last is None else spark.read.schema("id long").parquet(f"{path}/known/batch={last}")


def stored(spark: SparkSession, path: str, number: int, schema: str) -> DataFrame:
    """What batches other than one have written below a path."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(path).where(F.col("batch") != number).drop("batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def skip_duplicates(hashed: Callable[[DataFrame], DataFrame], path: str, most: int = 7) -> Callable[[DataFrame, int], None]:
    """Append (id, h) of the rows of a batch that are within `most` bits of no stored row and of no row of the batch stored before them.

    `hashed` makes (id, h) of a batch, whose rows come in the order of their ids. What is
    stored is what taking rows in turn would store, however they are cut into batches:
    a row near one that was dropped itself is kept. A batch run again overwrites its own
    folder.
    """

    def do(batch: DataFrame, number: int) -> None:
        rows = checkpointed(hashed(batch).select("id", "h"))
        known = stored(batch.sparkSession, path, number, "id long, h long").where("h is not null")
        rows.join(first_come(rows, most, known.select("h")), "id", "left_semi").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return do
