"""Stateful streams over several batches and restarts, against sequential forms."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.functions import udfs as U
from shoal.operators import graph as G
from shoal.operators import maintain as M
from shoal.sources import shared
from shoal.streaming import incremental as R
from shoal.streaming import stateful as W


def feed(spark, path, batches, schema, make):
    """Each batch as a file that a run of its own takes: a restart between all of them. The rows written, by batch."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        R.each_batch(make(spark.readStream.schema(schema).parquet(f"{path}/in")), R.appended(f"{path}/out"), f"{path}/at").awaitTermination()
        assert spark.read.parquet(f"{path}/out").select(F.max("batch")).first()[0] == k
    return spark.read.parquet(f"{path}/out")


def test_ledger(spark, tmp_path):
    random.seed(4)
    rows = [(random.randrange(9), seq, random.choice(["failure", "failure", "success", "cancelled"])) for seq in range(120)]
    late = rows[:40] + rows[60:80], rows[40:60], rows[80:]  # one batch comes late
    out = feed(spark, str(tmp_path), late, "item long, seq long, outcome string", W.failure_ledger)
    want = {}
    for item, _, outcome in rows:
        want[item] = 0 if outcome == "success" else want.get(item, 0) + (outcome == "failure")
    assert {r["item"]: r["attempts"] for r in R.latest(out, "item").collect()} == want
    batch = M.open_failures(spark.createDataFrame(rows, "item long, seq long, outcome string"))
    assert {r["item"]: r["attempts"] for r in batch.collect()} == {i: n for i, n in want.items() if n}


def debounce(batches, gap, late):
    """Upload by upload: an open batch takes what is near it, a closed one nothing more."""
    done, open_, high = [], [], float("-inf")
    for batch in batches:
        for t in sorted(batch):
            near = [b for b in open_ if b[0] - gap < t < b[1] + gap]
            open_ = [b for b in open_ if b not in near] + [[min([t, *(b[0] for b in near)]), max([t, *(b[1] for b in near)]), 1 + sum(b[2] for b in near)]]
        high = max([high, *batch])
        done += [b for b in open_ if b[1] + gap <= high - late]
        open_ = [b for b in open_ if b[1] + gap > high - late]
    return sorted(map(tuple, done)), sorted(map(tuple, open_))


def test_debounce(spark, tmp_path):
    random.seed(5)
    base = 1_700_000_000
    batches = [[base + k * 1500 + random.randrange(1500) for _ in range(25)] for k in range(3)]
    batches[1] += [base + 3, base + 20, base + 44, base + 3000]  # late, their batch may be closed
    batches[2] += [base + 1490, base + 3040, batches[0][0]]
    rows = [[(d, float(t)) for d in ("a", "b") for t in batch] for batch in batches]
    out = feed(spark, str(tmp_path), rows, "device string, at double", lambda df: W.debounced(df.withColumn("ts", F.timestamp_seconds("at")), "device", late=300))
    got = R.latest(out, "device", "number").where("n > 0").collect()
    done, still = debounce(batches, 45, 300)
    for d in ("a", "b"):
        mine = [r for r in got if r["device"] == d]
        assert sorted((r["first"], r["last"], r["n"]) for r in mine if r["closed"]) == done
        assert sorted((r["first"], r["last"], r["n"]) for r in mine if not r["closed"]) == still
        assert sum(r["n"] for r in mine) == sum(map(len, batches))


def written(spark, path):
    """What the batches that are written whole hold."""
    whole = [str(p.parent) for p in path.glob("out/batch=*/_SUCCESS")]
    return spark.read.option("basePath", f"{path}/out").parquet(*whole) if whole else None


def until(query, done, seconds=90):
    end = time.time() + seconds
    while not done() and time.time() < end:
        time.sleep(0.5)
    query.stop()
    query.awaitTermination()


def test_idle_devices_close(spark, tmp_path):
    spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 100.0)], "device string, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("device string, at double").parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_seconds("at"))
    query = W.debounced(stream, "device", idle=1.0).writeStream.outputMode("update").foreachBatch(R.appended(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second").start()
    read = lambda: [] if (out := written(spark, tmp_path)) is None else R.latest(out, "device", "number").collect()
    until(query, lambda: sum(r["closed"] for r in read()) == 2)
    assert sorted((r["first"], r["last"], r["n"], r["closed"]) for r in read()) == [(0.0, 10.0, 2, True), (100.0, 100.0, 1, True)]


def test_lookups_are_tried_again(spark, tmp_path):
    """Each cell is answered once; one that fails twice is tried a third time, one that always fails is left until a photo comes."""
    tries = str(tmp_path / "tries")

    def load():
        def find(lat, lon):
            with open(tries, "a") as f:
                f.write(f"{lat}\n")
            with open(tries) as f:
                n = f.read().split("\n").count(str(lat))
            if lat == 2.0 and n < 3 or lat == 3.0:
                raise OSError("throttled")
            return "" if lat == 4.0 else f"town {lat}"

        return find

    schema = "cell string, lat double, lon double"
    spark.createDataFrame([(f"c{k % 5}", float(k % 5), 0.0) for k in range(15)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    make = lambda: W.geocode_queue(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), load, wait=0.2, most=3)
    start = lambda: make().writeStream.outputMode("update").foreachBatch(R.appended(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="1 second").start()
    read = lambda: [] if (out := written(spark, tmp_path)) is None else out.collect()
    until(start(), lambda: sum(r["place"] is not None for r in read()) == 4 and sum(r["cell"] == "c3" for r in read()) == 3)
    said = read()
    assert sorted((r["cell"], r["place"], r["attempts"]) for r in said if r["place"] is not None) == [("c0", "town 0.0", 1), ("c1", "town 1.0", 1), ("c2", "town 2.0", 3), ("c4", "", 1)]
    assert sorted(r["attempts"] for r in said if r["cell"] == "c3") == [1, 2, 3] and all("throttled" in r["error"] for r in said if r["cell"] == "c3")
    spark.createDataFrame([("c3", 3.0, 0.0), ("c0", 0.0, 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    until(start(), lambda: sum(r["cell"] == "c3" for r in read()) > 3)  # after a restart
    assert sum(r["cell"] == "c3" for r in read()) > 3 and sum(r["cell"] == "c0" for r in read()) == 1


def faces(seed=6, n=90):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((6, 12))
    v = centre[rng.integers(0, 6, n)] + 0.6 * rng.standard_normal((n, 12))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(int(i % 2), i, int(i // 3), v[i].tolist(), float(rng.uniform(0.1, 1))) for i in range(n)]


def online(rows, least=0.45, larger=1.3):
    """Face by face, with a plain list of clusters an owner."""
    clusters, out = {}, []
    for owner, i, photo, v, area in sorted(rows, key=lambda r: r[1]):
        v, mine = np.array(v), clusters.setdefault(owner, [])
        best, top = None, least
        for k, c in enumerate(mine):
            if c["p"] @ v > top:
                best, top = k, c["p"] @ v
        if best is None:
            best = len(mine)
            mine.append({"p": v / np.linalg.norm(v), "photos": {photo}, "cover": photo, "area": area})
        else:
            c = mine[best]
            p = c["p"] * len(c["photos"]) + v
            c["p"] = p / (np.linalg.norm(p) + 1e-10)
            c["photos"].add(photo)
            if area > larger * c["area"]:
                c["cover"], c["area"] = photo, area
        out.append((owner, i, best, len(mine[best]["photos"]), mine[best]["cover"]))
    return out


FACE = "owner long, id long, photo long, v array<double>, area double"


def test_online_clusters(spark, tmp_path):
    rows = faces()
    want = sorted(online(rows))
    assert len({r[2] for r in want}) > 3 and any(r[3] > 3 for r in want)
    assert sorted(tuple(r) for r in G.online_clusters(spark.createDataFrame(rows, FACE)).collect()) == want
    out = feed(spark, str(tmp_path), (rows[:20], rows[20:61], rows[61:]), FACE, W.online_clusters)
    assert sorted(tuple(r) for r in out.drop("batch").collect()) == want


def test_reclustering_requests(spark, tmp_path):
    """Requests during a run cause one more run, whatever their number; a batch that runs again asks once; a restart serves what is left."""
    ran, inside, go_on = [], threading.Event(), threading.Event()

    def run(epoch):
        ran.append(epoch)
        inside.set()
        go_on.wait(30)

    again = R.Reclustering(spark, str(tmp_path / "runs"), run)
    again.request("first")
    worker = threading.Thread(target=again.settle)
    worker.start()
    inside.wait(30)
    for k in range(5):
        again.request(f"during-{k}")
        assert again.settle() == 0  # one runs already and will see it
    go_on.set()
    worker.join()
    assert ran == [1, 2] and not again.pending() and again.epoch() == 2
    batch = spark.range(30)
    again.after(25)(batch, 7)
    again.after(25)(batch, 7)
    again.after(25)(batch.limit(24), 8)
    assert ran == [1, 2, 3]
    again.request("left")
    other = R.Reclustering(spark, str(tmp_path / "runs"), run)
    assert other.settle() == 1 and ran == [1, 2, 3, 4] and shared.listed(spark, str(tmp_path / "none")) == []


def test_library_changes(spark, tmp_path):
    random.seed(7)
    snapshots = [sorted(random.sample(range(40), 25)) for _ in range(5)] + [[]]
    rows = [(k, i) for k, s in enumerate(snapshots) for i in s]
    do = R.library_changes(str(tmp_path / "feed"))
    for number, part in enumerate(([0], [1, 2], [3], [4])):
        batch = spark.createDataFrame([r for r in rows if r[0] in part], "snapshot long, id long")
        do(batch, number)
        do(batch, number)
    got = {tuple(r)[:3] for r in spark.read.parquet(str(tmp_path / "feed/changes")).select("snapshot", "id", "change").collect()}
    want, before = set(), set()
    for k, s in enumerate(snapshots[:5]):
        want |= {(k, i, "inserted") for i in set(s) - before} | {(k, i, "removed") for i in before - set(s)}
        before = set(s)
    assert got == want


def test_counts_are_refreshed(spark, tmp_path):
    axis = lambda k: [1.0 if i == k else 0.0 for i in range(4)]
    protos = spark.createDataFrame([(7, axis(0)), (8, axis(1))], "proto long, v array<double>")
    do = R.assign_and_append(protos, str(tmp_path / "p"), 0.5)
    for number, ids in enumerate(([0, 1, 2, 4], [5, 8, 9], [5, 8, 9])):
        do(spark.createDataFrame([(i, axis(i % 4)) for i in ids], "vec_id long, v array<double>"), min(number, 1))
    assert {tuple(r) for r in R.refreshed_counts(spark, str(tmp_path / "p")).collect()} == {(7, 3), (8, 3)}


def test_bad_items_are_found(spark):
    """An item that ends its process costs itself only; one that raises leaves its error."""

    def load():
        def f(x):
            import os

            if x in (13, 400):
                os._exit(3)
            if x == 20:
                raise ValueError("odd")
            return [x, 2 * x]

        return f

    got = {r["id"]: r for r in U.extract(spark.range(600).withColumn("x", F.col("id")), "id", "x", load).collect()}
    assert len(got) == 600
    assert {i for i, r in got.items() if r["error"]} == {13, 20, 400}
    assert got[13]["error"] == "the worker ended with code 3" and got[20]["error"] == "ValueError: odd"
    assert all(got[i]["v"] == [i, 2 * i] for i in got if i not in (13, 20, 400))


def test_encoder(spark):
    encode = U.encoder_udf(lambda: U.hashing_encoder(8), batch=3)
    texts = ["one two", "three", "", None, "one two", "two one"] * 3
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(encode("t")).collect()]
    plain = U.hashing_encoder(8)(texts)
    for v, w in zip(got, plain, strict=True):
        assert v == pytest.approx((w / (np.linalg.norm(w) + 1e-10)).tolist(), abs=1e-6)
    assert got[0] == got[4] == got[5] and got[2] == [0.0] * 8
