"""Graph operators: duplicate groups, density clustering, reclustering."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions.vectors import unit
from shoal.operators.hamming import hash_links
from shoal.operators.maintain import append_rows
from shoal.operators.online import Clusters
from shoal.operators.people import best_by
from shoal.operators.pivots import density_edges, finite, least_reached
from shoal.operators.simjoin import carry_names, nearest_prototype
from shoal.sources.shared import checkpointed

#: Words whose bits simhash_words counts at once, at most.
PART = 1 << 16
#: The lowest bit of each byte of a word.
ONES = np.uint64(0x0101010101010101)


def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (a, b) of a partition -> an edge from each node to the least one that it reaches there."""
    rows = least_reached(p for pdf in batches for p in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True))
    for start in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[start : start + 100_000], columns=["a", "b"])


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component = least node) of undirected edges (a, b).

    Partitions contract their own edges, then large and small stars alternate, a checkpoint
    a round, until each node that isn't a root has one edge, to a root.
    """
    now = checkpointed(edges.where("a <> b").select("a", "b").mapInPandas(contracted, "a long, b long"))
    for _ in range(rounds):
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("child")))
        if ends.groupBy("node").agg(F.sum("child").alias("roots"), F.min("child").alias("only_child")).where("roots > 1 or (roots = 1 and only_child = 0)").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where("a <> b").distinct().mapInPandas(contracted, "a long, b long"))
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def near_duplicate_groups(hashes: DataFrame, most: int, not_duplicate: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """(id, rep) for every row: groups within `most` bits, transitively; rep is the least id.

    Rows of not_duplicate (id) give no automatic edge; manual edges (a, b) come on top.
    """
    hashes = checkpointed(hashes)
    free = hashes if not_duplicate is None else hashes.join(not_duplicate, "id", "left_anti")
    edges = hash_links(free, most)
    if manual is not None:
        edges = edges.unionByName(manual.select("a", "b"))
    return hashes.select("id").join(components(edges).toDF("id", "rep"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def group_union(members: DataFrame) -> DataFrame:
    """(id, rep) of manual groups (gid, id): groups that share a row are one; rep is the least id."""
    least = members.groupBy("gid").agg(F.min("id").alias("b"))
    edges = members.join(least, "gid").select(F.col("id").alias("a"), "b")
    return members.select("id").distinct().join(components(edges).toDF("id", "rep"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))


def greedy_groups(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, rep): each row joins the group of its first earlier match; rows in id order.

    A row's parent is the least id among its earlier matches; following parents to their end
    equals taking the rows in turn.
    """
    parent = pairs.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("p")).groupBy("id").agg(F.min("p").alias("p"))
    now = checkpointed(ids.select("id").join(parent, "id", "left").select("id", F.coalesce("p", "id").alias("rep")))
    while True:
        up = now.toDF("rep", "next")
        step = checkpointed(now.join(up, "rep").select("id", "rep", "next"))
        if step.where("rep <> next").isEmpty():
            return now
        now = step.select("id", F.col("next").alias("rep"))


def dbscan(ids: DataFrame, pairs: DataFrame, min_samples: int = 3) -> DataFrame:
    """(id, label) from neighbour pairs (a, b): labels number the clusters by their first core row, noise is -1.

    A row with itself and its neighbours counting min_samples is core; cores that are
    neighbours are one cluster, and a border row goes to the earliest cluster beside it.
    """
    pairs = checkpointed(pairs.select("a", "b"))
    both = checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    core = checkpointed(both.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select(F.col("a").alias("id")))
    if min_samples <= 1:
        core = ids.select("id")
    inner = both.join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi")
    border = both.join(core.toDF("a"), "a", "left_anti").join(core.toDF("b"), "b", "left_semi")
    return labelled(ids, core, inner, border)


def dbscan_vectors(vectors: DataFrame, least: float = 0.6, min_samples: int = 3, strict: bool = False) -> DataFrame:
    """(id, label) of vectors (id, v), as dbscan() of the pairs with an inner product of at least (or above) `least`.

    Clusters form cell by cell around pivots and are tied together by the rows that lie
    near several cells; no pair is written. Null, empty, zero and other than finite
    vectors are noise.
    """
    core, edges, border = density_edges(vectors, least, min_samples, strict)
    return labelled(vectors, vectors.select("id") if min_samples <= 1 else core, edges, border)


def labelled(ids: DataFrame, core: DataFrame, edges: DataFrame, border: DataFrame) -> DataFrame:
    """(id, label): components of core rows (id,) over edges (a, b), numbered by their first row; other rows take the earliest cluster of their core partners (a, b)."""
    roots = checkpointed(core.join(components(edges).toDF("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    beside = border.join(roots.toDF("b", "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("root"))
    found = roots.unionByName(beside).join(numbered(roots.select("root").distinct(), "root", "label"), "root")
    return ids.select("id").join(found, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def numbered(rows: DataFrame, order: str, number: str) -> DataFrame:
    """Distinct values of a column with their numbers from 0, in order; ranges of it are counted apart."""
    none = rows.sparkSession.createDataFrame([], f"id long, {order} {dict(rows.dtypes)[order]}")
    return append_rows(none, rows.select(order), order).withColumnRenamed("id", number)


def prototypes(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, v, n): the normalised mean of each cluster's vectors, noise left out. Sums run per dimension, on the map side first."""
    parts = vectors.join(labels.where("label >= 0"), "id").select("label", F.posexplode("v").alias("d", "x"))
    means = parts.groupBy("label", "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy("label").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"])).alias("v"), F.max("n").alias("n"))


def total_udaf():
    """A grouped aggregate that adds vectors up."""

    @F.pandas_udf("array<double>")
    def total(v: pd.Series) -> list[float]:
        return np.sum(np.stack(v.to_numpy()), axis=0).tolist()

    return total


def centroids(vectors: DataFrame, by: str, v: str = "v", parts: int = 64) -> DataFrame:
    """K4: (by, m): the normalised mean of each group's vectors, by a user's aggregate.

    A group is summed in parts, so no task holds a whole one; the parts' sums are added.
    Null and empty vectors and those with other than finite numbers are left out, and of
    unlike lengths the commonest in a group counts (of equals the longer).
    """
    whole = vectors.where(finite(v)).withColumn("_width", F.size(v))
    sums = whole.groupBy(by, "_width", F.pmod(F.xxhash64(v), F.lit(parts)).alias("_part")).agg(total_udaf()(v).alias("s"))
    sums = sums.groupBy(by, "_width").agg(total_udaf()("s").alias("s"))
    common = whole.groupBy(by, "_width").agg(F.count("*").alias("_n")).groupBy(by).agg(F.max_by("_width", F.struct("_n", "_width")).alias("_width"))
    return sums.join(common, [by, "_width"], "left_semi").select(by, unit("s").alias("m"))


def merge_prototypes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(label, v, n) of pairs of clusters (label, v, n) merged by their counts and normalised."""
    met = one.toDF("label", "v1", "n1").join(two.toDF("label", "v2", "n2"), "label")
    mean = F.zip_with("v1", "v2", lambda x, y: (x * F.col("n1") + y * F.col("n2")) / (F.col("n1") + F.col("n2")))
    return met.select("label", unit(mean).alias("v"), (F.col("n1") + F.col("n2")).alias("n"))


def merge_members(members: DataFrame, into: DataFrame) -> DataFrame:
    """(label, photo_id): the photos of clusters, those of a merged one (label, target) with its target's, each once."""
    return members.join(into, "label", "left").select(F.coalesce("target", "label").alias("label"), "photo_id").distinct()


def recluster(faces: DataFrame, old: DataFrame, least: float = 0.6, min_samples: int = 3, assign: float = 0.42, carry: float = 0.42) -> tuple[DataFrame, DataFrame]:
    """I4: (people, face_person) of faces (id, v, area), neighbours from `least` on, and old prototypes (name, v).

    Clusters by density, their prototypes, every face (noise too) to its most similar
    prototype above `assign`, the largest face as cover, names of old prototypes carried
    over, and clusters without faces dropped and the rest numbered anew.
    """
    faces = checkpointed(faces.select("id", "v", "area"))
    protos = checkpointed(prototypes(faces.select("id", "v"), dbscan_vectors(faces.select("id", "v"), least, min_samples)).select(F.col("label").cast("long").alias("proto"), "v"))
    assigned = checkpointed(nearest_prototype(faces.select(F.col("id").alias("vec_id"), "v"), protos, assign, strict=True).where("proto >= 0").select(F.col("vec_id").alias("id"), "proto"))
    new = checkpointed(numbered(assigned.select("proto").distinct(), "proto", "person"))
    face_person = assigned.join(new, "proto").select("id", "person", "proto")
    cover = best_by(face_person.join(faces.select("id", "area"), "id"), ["person"], "id", [F.col("area"), -F.col("id")], "cover")
    named = carry_names(old, protos.join(new, "proto").select(F.col("person").cast("long").alias("cluster"), "v"), carry)
    sizes = face_person.groupBy("person").agg(F.count("*").alias("faces"))
    people = sizes.join(cover, "person").join(named.select(F.col("cluster").alias("person"), "name"), "person", "left")
    return people, face_person.select("id", "person")


def online_clusters(faces: DataFrame, least: float = 0.45, larger: float = 1.3) -> DataFrame:
    """(owner, id, cluster, photos, cover): faces (owner, id, photo, v, area) in id order join the most similar cluster above `least`, moving its centroid by the weight of its photos, or open one.

    photos and cover are the cluster's after the face; a face more than `larger` times the
    cover's area takes its place. The order matters within an owner, so an owner is one
    group; owners run in parallel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Clusters(least, larger), []
        for r in pdf.sort_values("id").itertuples(index=False):
            c, _ = state.add(np.asarray(r.v, float), r.photo, r.area)
            out.append((r.owner, r.id, c, state.clusters[c][1], state.clusters[c][2]))
        return pd.DataFrame(out, columns=["owner", "id", "cluster", "photos", "cover"])

    rows = faces.select("owner", F.col("id").cast("long").alias("id"), F.col("photo").cast("long").alias("photo"), "v", F.col("area").cast("double").alias("area"))
    return rows.groupBy("owner").applyInPandas(run, f"owner {dict(rows.dtypes)['owner']}, id long, cluster int, photos int, cover long")


def bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text as bytes) -> (id, n, b0 to b59): distinct words, and how many md5s of them have each bit; long texts in several rows."""
    md5 = hashlib.md5

    def counted(kind: pa.DataType, ids: list, words: list[bytes], ends: list[int]) -> pa.RecordBatch:
        n = np.diff([0, *ends])
        sums = np.zeros((60, len(ids)), np.int32)
        if words:
            values = np.frombuffer(b"".join([md5(w).digest() for w in words]), ">u8")[::2].astype("<u8") >> np.uint64(4)
            at = np.arange(len(words)) - np.repeat(np.array(ends) - n, n)
            runs = np.flatnonzero(at % 255 == 0)  # a byte counts as many
            lanes = np.stack([np.add.reduceat(values >> np.uint64(k) & ONES, runs).view(np.uint8).reshape(-1, 8) for k in range(8)], 2).reshape(-1, 64)
            sums = np.ascontiguousarray(np.add.reduceat(lanes[:, :60], np.flatnonzero(at[runs] == 0), axis=0, dtype=np.int32).T)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(n, pa.int64()), *map(pa.array, sums)], names=["id", "n", *[f"b{b}" for b in range(60)]])

    for batch in batches:
        kind, (ids, words, ends), blank = batch.schema.field(0).type, ([], [], []), []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            some = list(set((text.as_py() or b"").split()))  # at the six characters of the regular expression \s
            if not some:
                blank.append(i)
            for start in range(0, len(some), PART):
                if words and len(words) + len(some) - start > PART:
                    yield counted(kind, ids, words, ends)
                    ids, words, ends = [], [], []
                words += some[start : start + PART]
                ids.append(i)
                ends.append(len(words))
        for some in ((ids, words, ends), (blank, [], [0] * len(blank))):
            if some[0]:
                yield counted(kind, *some)


def simhash_words(docs: DataFrame) -> DataFrame:
    """(id, h): a 60-bit hash of a text's distinct words by the majority of each bit of the words' md5; 0 without words."""
    kind = dict(docs.dtypes)["id"]
    counts = docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(bit_counts, f"id {kind}, n long, " + ", ".join(f"b{b} int" for b in range(60)))
    h = F.lit(0).cast("long")
    for b in range(60):
        h = h + F.when(F.col(f"b{b}") * 2 > F.col("n"), F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return counts.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"b{b}").alias(f"b{b}") for b in range(60)]).select("id", h.alias("h"))
