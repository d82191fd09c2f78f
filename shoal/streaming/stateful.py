"""Streams with state of their own: debounced batches, failure ledgers, lookups that are tried again, clusters that grow.

Each is a StatefulProcessor over keyed state that Spark keeps, checkpoints and restores;
a run that stops goes on from its checkpoint. State needs the RocksDB provider, which
keep_state() sets for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shoal.operators.online import Clusters

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = False) -> DataFrame:
    keep_state(rows.sparkSession)
    return rows.groupBy(key).transformWithState(processor, schema, "Update", "ProcessingTime" if timers else "None")


class Debounce(StatefulProcessor):
    """Open and closed batches of a device: runs of uploads with pauses shorter than the gap."""

    def __init__(self, gap: float, late: float, idle: float | None):
        self.gap, self.late, self.idle = gap, late, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "number int", "first double, last double, n long")
        self.seen = handle.getValueState("seen", "high double, next int, due long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        high, following, due = self.seen.get() if self.seen.exists() else (float("-inf"), 0, -1)
        found = [(*v, k[0]) for k, v in self.open.iterator()] + [(r["ts"], r["ts"], 1, None) for r in rows]
        high = max(high, *(last for _, last, _, _ in found))
        spans: dict[int, tuple[float, float, int]] = {}
        changed: set[int] = set()
        run: list[tuple] = []

        def ended() -> Iterator[Row]:
            """One batch of a run: of the numbers that it ties together the least stays, and the others are none any more."""
            nonlocal following
            numbers = sorted(r[3] for r in run if r[3] is not None)
            number, following = (numbers[0], following) if numbers else (following, following + 1)
            spans[number] = run[0][0], max(r[1] for r in run), sum(r[2] for r in run)
            if len(run) > 1 or not numbers:
                changed.add(number)
            for k in numbers[1:]:
                yield Row(device=key[0], number=k, first=None, last=None, n=0, closed=True)

        last = float("-inf")
        for r in sorted(found, key=lambda r: r[0]):
            if run and r[0] - last >= self.gap:
                yield from ended()
                run, last = [], float("-inf")
            run.append(r)
            last = max(last, r[1])
        yield from ended()
        if self.idle is not None:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle)
            self.handle.registerTimer(due)
        self.seen.update((high, following, due))
        yield from self.told(key[0], spans, changed, high)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        high, following, _ = self.seen.get()
        self.seen.update((high, following, -1))
        yield from self.told(key[0], {k[0]: list(v) for k, v in self.open.iterator()}, set(), float("inf"))

    def told(self, device: Any, spans: dict[int, list], changed: set[int], high: float) -> Iterator[Row]:
        """Batches that have changed or are complete now; a complete one leaves the state."""
        for k in [k[0] for k in self.open.keys()]:
            if k not in spans:
                self.open.removeKey((k,))
        for k, (first, last, n) in spans.items():
            closed = last + self.gap <= high - self.late
            if closed and self.open.containsKey((k,)):
                self.open.removeKey((k,))
            elif not closed and k in changed:
                self.open.updateValue((k,), (first, last, n))
            if closed or k in changed:
                yield Row(device=device, number=k, first=first, last=last, n=n, closed=closed)

    def close(self) -> None:
        pass


def debounced(uploads: DataFrame, device: str, gap: float = 45, late: float = 600, idle: float | None = None, ts: str = "ts") -> DataFrame:
    """(device, number, first, last, n, closed): the batches of a device as they change; the last row of a (device, number) holds.

    Uploads less than `gap` seconds apart are one batch, in whatever order they come. A
    batch closes when an upload of its device is `late` seconds past its end (and the gap),
    or when none has arrived for `idle` seconds; an upload that comes later still opens a
    batch of its own, so every upload is in one batch. n = 0 takes back a number whose
    batch has become part of another.
    """
    rows = uploads.select(F.col(device).alias("device"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("ts"))
    kind = dict(rows.dtypes)["device"]
    return stateful(rows.where("ts is not null"), "device", Debounce(gap, late, idle), f"device {kind}, number int, first double, last double, n long, closed boolean", idle is not None)


class Ledger(StatefulProcessor):
    """Failures of an item after its last success."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", "ok long, seqs array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        ok, seqs = self.state.get() if self.state.exists() else (-1, [])
        seqs = set(seqs)
        for r in rows:
            if r["outcome"] == "success":
                ok = max(ok, r["seq"])
            elif r["outcome"] == "failure":
                seqs.add(r["seq"])
        left = sorted(s for s in seqs if s > ok)
        self.state.update((ok, left))
        yield Row(item=key[0], attempts=len(left), ok=ok)

    def close(self) -> None:
        pass


def failure_ledger(outcomes: DataFrame) -> DataFrame:
    """(item, attempts, ok) of items as outcomes (item, seq, outcome) come: failures since the last success, whose seq is ok (-1: none). Cancelled work isn't charged; the order in which outcomes arrive doesn't matter."""
    rows = outcomes.select("item", F.col("seq").cast("long").alias("seq"), "outcome")
    return stateful(rows, "item", Ledger(), f"item {dict(rows.dtypes)['item']}, attempts int, ok long")


class Lookups(StatefulProcessor):
    """A cell's lookup: waiting, to be tried again at a time, or answered."""

    def __init__(self, load: Callable[[], Callable[[float, float], str]], wait: float, longest: float, most: int):
        self.load, self.wait, self.longest, self.most = load, wait, longest, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.find = handle, self.load()
        self.state = handle.getValueState("lookup", "lat double, lon double, attempts int, due long, place string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(rows)
        for _ in rows:
            pass
        if not self.state.exists():
            yield from self.tried(key[0], first["lat"], first["lon"], 0, timerValues)
        else:
            lat, lon, _, due, place = self.state.get()
            if place is None and due < 0:  # given up before; a new photo of the cell takes it up again
                yield from self.tried(key[0], lat, lon, 0, timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        lat, lon, attempts, _, place = self.state.get()
        if place is None:
            yield from self.tried(key[0], lat, lon, attempts, timerValues)

    def tried(self, cell: str, lat: float, lon: float, attempts: int, timerValues: Any) -> Iterator[Row]:
        try:
            place = self.find(lat, lon) or ""
        except Exception as e:  # any error of the user's lookup puts the cell off
            attempts, due = attempts + 1, -1
            if attempts < self.most:
                due = timerValues.getCurrentProcessingTimeInMs() + int(1000 * min(self.wait * attempts, self.longest))
                self.handle.registerTimer(due)
            self.state.update((lat, lon, attempts, due, None))
            yield Row(cell=cell, place=None, attempts=attempts, error=f"{type(e).__name__}: {e}")
        else:
            self.state.update((lat, lon, attempts + 1, -1, place))
            yield Row(cell=cell, place=place, attempts=attempts + 1, error=None)

    def close(self) -> None:
        pass


def geocode_queue(cells: DataFrame, load: Callable[[], Callable[[float, float], str]], wait: float = 60, longest: float = 300, most: int = 5) -> DataFrame:
    """(cell, place, attempts, error): each cell (cell, lat, lon) is looked up once it is met, and answered once ('' without a place).

    A lookup that raises is tried again after `wait` seconds times its attempts (`longest`
    at most), `most` times; then it rests until another photo of the cell comes. `load`
    makes the lookup once a task.
    """
    rows = cells.where("cell is not null").select("cell", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return stateful(rows, "cell", Lookups(load, wait, longest, most), "cell string, place string, attempts int, error string", True)


class OnlineClusters(StatefulProcessor):
    """The clusters of an owner: centroid, number of photos and cover of each, and which photos it holds."""

    def __init__(self, least: float, larger: float):
        self.least, self.larger = least, larger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "cluster int", "centre array<double>, photos int, cover bigint, area double")
        self.held = handle.getMapState("held", "cluster int, photo bigint", "there boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = sorted((k[0], v) for k, v in self.clusters.iterator())
        state = Clusters(self.least, self.larger, [(np.array(v[0]), *v[1:]) for _, v in known], lambda c, p: self.held.containsKey((c, p)))
        touched = set()
        for r in sorted(rows, key=lambda r: r["id"]):
            c, new = state.add(np.asarray(r["v"], float), r["photo"], r["area"])
            touched.add(c)
            if new:
                self.held.updateValue((c, r["photo"]), (True,))
            _, photos, cover, _ = state.clusters[c]
            yield Row(owner=key[0], id=r["id"], cluster=c, photos=photos, cover=cover)
        for c in touched:
            centre, photos, cover, area = state.clusters[c]
            self.clusters.updateValue((c,), (centre.tolist(), photos, cover, area))

    def close(self) -> None:
        pass


def online_clusters(faces: DataFrame, least: float = 0.45, larger: float = 1.3) -> DataFrame:
    """I6 as a stream: (owner, id, cluster, photos, cover) of faces (owner, id, photo, v, area) as they come, in the order of ids within a batch; as operators.graph.online_clusters over all of them if ids rise from batch to batch."""
    rows = faces.select("owner", F.col("id").cast("long").alias("id"), F.col("photo").cast("long").alias("photo"), F.col("v").cast("array<double>").alias("v"), F.col("area").cast("double").alias("area"))
    return stateful(rows, "owner", OnlineClusters(least, larger), f"owner {dict(rows.dtypes)['owner']}, id long, cluster int, photos int, cover long")
