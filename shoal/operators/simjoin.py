"""Similarity joins and ranked vector search.

Small sides (prototypes, prompts, query vectors) are counted and then broadcast as a
matrix against Arrow batches; two large sides meet block by block, so a task never
holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions.vectors import best_of, cosine, dot
from shoal.operators.pivots import dealt, finite, meets, near_pairs, partners, unpacked
from shoal.sources.shared import checkpointed

#: Numbers of a side that is broadcast at most (64 MB of doubles).
BROADCAST_NUMBERS = 8_000_000
BLOCK = 2048
#: Rows and prototypes that are multiplied at once.
STRIP, PROTOS = 512, 4096
#: Vectors that k-means cells are fitted on at most.
FIT = 65_536


def composite(terms: DataFrame, weights: Mapping[int, float]) -> list[float] | None:
    """H5: the normalised weighted sum of a few term vectors (term, v); None if no term is known."""
    rows = terms.where(F.col("term").isin(list(weights))).select("term", "v").collect()  # as many as the terms of one query
    total = [weights[r["term"]] * np.array(r["v"], float) for r in rows if r["v"]]
    if not total:
        return None
    q = np.sum(total, axis=0)
    return (q / (np.linalg.norm(q) + 1e-10)).tolist()


def matrices_of(small: DataFrame, key: str, v: str) -> dict[int, tuple[list, np.ndarray]] | None:
    """(keys, rows) of a small side's finite vectors in key order, by their length; None when it is too large to broadcast."""
    rows = small.where(finite(v))
    n, width = rows.agg(F.count("*"), F.max(F.size(v))).first()
    if n * max(1, width or 0) > BROADCAST_NUMBERS:
        return None
    held: dict[int, tuple[list, list]] = {}
    for r in rows.select(key, v).orderBy(key).collect():
        keys, vectors = held.setdefault(len(r[1]), ([], []))
        keys.append(r[0])
        vectors.append(r[1])
    return {w: (keys, np.array(vectors, np.float64)) for w, (keys, vectors) in held.items()}


def most_similar(x: np.ndarray, m: np.ndarray, last_wins: bool) -> tuple[np.ndarray, np.ndarray]:
    """(at, sim): the row of m with the largest inner product for each row of x, the first or last of equal ones; a strip at a time, so many prototypes cost no memory."""
    place, best = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for r in range(0, len(x), STRIP):
        for s in range(0, len(m), PROTOS):
            sims = x[r : r + STRIP] @ m[s : s + PROTOS].T
            at = sims.shape[1] - 1 - sims[:, ::-1].argmax(1) if last_wins else sims.argmax(1)
            sim = sims[np.arange(len(at)), at]
            held, where = best[r : r + STRIP], place[r : r + STRIP]
            better = (sim >= held) if last_wins else (sim > held)
            held[better], where[better] = sim[better], s + at[better]
    return place, best


def nearest_prototype(vectors: DataFrame, protos: DataFrame, least: float, strict: bool = False, last_wins: bool = False) -> DataFrame:
    """(vec_id, proto, sim): the most similar prototype (proto, v) of each vector, -1 below `least` and without any prototype.

    Ties go to the first prototype, or with last_wins to the last. Vectors and prototypes of
    unlike length don't match, nor do null and empty ones or those with other than finite
    numbers: such a vector gets -1 and no sim. Prototypes beyond the bound for sending them
    to all tasks meet the vectors in large blocks, which are written once; each pair of
    blocks yields a vector's best.
    """
    held = matrices_of(protos, "proto", "v")
    if held is None:
        best = best_of_blocks(vectors, protos.select(F.col("proto").alias("vec_id"), "v"), last_wins)
        best = best.groupBy(F.col("a").alias("vec_id")).agg(F.max_by(F.struct("b", "sim"), F.struct("sim", F.col("b") * (1 if last_wins else -1))).alias("x"))
        out = vectors.select("vec_id").join(best, "vec_id", "left").select("vec_id", F.col("x.b").alias("proto"), F.col("x.sim").alias("sim"))
    elif not held:
        out = vectors.select("vec_id", F.lit(None).cast("long").alias("proto"), F.lit(None).cast("double").alias("sim"))
    else:
        sent = vectors.sparkSession.sparkContext.broadcast(held)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                width = pdf["v"].map(lambda v: 0 if v is None else len(v)).to_numpy(int) if len(pdf) else np.zeros(0, int)
                for w in np.unique(width).tolist():
                    rows = pdf[width == w]
                    if w not in sent.value:
                        yield pd.DataFrame({"vec_id": rows["vec_id"], "proto": pd.array([None] * len(rows), "Int64"), "sim": None})
                        continue
                    keys, m = sent.value[w]
                    at, sim = most_similar(np.stack(rows["v"].to_numpy()), m, last_wins)
                    yield pd.DataFrame({"vec_id": rows["vec_id"], "proto": np.array(keys)[at], "sim": sim})

        # A vector with a number missing goes as none.
        out = vectors.select("vec_id", F.when(finite("v"), F.col("v")).alias("v")).mapInPandas(assign, "vec_id long, proto long, sim double")
    fits = F.col("sim") > least if strict else F.col("sim") >= least
    return out.withColumn("proto", F.when(fits, F.col("proto")).otherwise(F.lit(-1).cast("long")))


def blocks_of(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, width, ids, vectors) with a row a block and length of vectors; ids fall into blocks by their hash, blocks being as many as the count asks for."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "width": [pdf["width"].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "data": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()]})

    rows = vectors.where(finite("v")).select("vec_id", "v", F.size("v").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    return rows.groupBy("block", "width").applyInPandas(pack, "block int, width int, ids binary, data binary")


def met_blocks(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """(p, q, ids_a, data_a, ids_b, data_b): each block of one side with each of the other, or of one table (same) with itself and the later ones; vectors of one length meet."""
    n_left = max(1, -(-left.count() // BLOCK))
    n_right = n_left if same else max(1, -(-right.count() // BLOCK))
    blocks = checkpointed(blocks_of(left, n_left))
    one = blocks.toDF("p", "width", "ids_a", "data_a")
    two = (blocks if same else blocks_of(right, n_right)).select(F.col("block").alias("q"), "width", F.col("ids").alias("ids_b"), F.col("data").alias("data_b"))
    first = F.col("p") if same else F.lit(0)
    return one.withColumn("q", F.explode(F.sequence(first, F.lit(n_right - 1)))).join(two, ["q", "width"]).select("p", "q", "ids_a", "data_a", "ids_b", "data_b")


def best_of_blocks(vectors: DataFrame, protos: DataFrame, last_wins: bool) -> DataFrame:
    """(a, b, sim): the most similar row of each block of prototypes (vec_id, v) for each vector (vec_id, v) of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids_a, x, _, ids_b, y, _ in unpacked(batch):
                at, sim = most_similar(x, y, last_wins)
                yield pa.RecordBatch.from_arrays([pa.array(ids_a), pa.array(ids_b[at]), pa.array(sim)], names=["a", "b", "sim"])

    out = vectors.sparkSession.createDataFrame([], "a long, b long, sim double")
    vectors, protos = (checkpointed(df.where(finite("v")).select("vec_id", "v")) for df in (vectors, protos))
    guests, homes = ({r[0]: r[1] for r in df.groupBy(F.size("v")).agg(F.count("*")).collect()} for df in (vectors, protos))  # a row a length
    for width in sorted(homes.keys() & guests.keys()):
        of = lambda df, width=width: df.where(F.size("v") == width)
        out = out.unionByName(meets(dealt(of(protos), of(vectors), homes[width], guests[width]), float("inf"), guests_only=True).mapInArrow(run, out.schema))
    return out


def block_pairs(left: DataFrame, right: DataFrame, least: float, strict: bool = False, same: bool = True) -> DataFrame:
    """(a, b, sim) of pairs with an inner product of at least (or above) `least`; a < b within one table (same)."""

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ia, ib = np.frombuffer(r.ids_a, np.int64), np.frombuffer(r.ids_b, np.int64)
                x, y = np.frombuffer(r.data_a).reshape(len(ia), -1), np.frombuffer(r.data_b).reshape(len(ib), -1)
                for s in range(0, len(ia), 512):
                    sims = x[s : s + 512] @ y.T
                    i, j = np.nonzero(sims > least if strict else sims >= least)
                    a, b, sim = ia[s + i], ib[j], sims[i, j]
                    if same:
                        keep = (a < b) if r.p == r.q else (a != b)
                        a, b, sim = np.minimum(a, b)[keep], np.maximum(a, b)[keep], sim[keep]
                    yield pd.DataFrame({"a": a, "b": b, "sim": sim})

    return met_blocks(left, right, same).mapInPandas(meet, "a long, b long, sim double")


def duplicates(photos: DataFrame, above: float = 0.97) -> DataFrame:
    """(a, b, sim), a < b, of active photos (vec_id, v, is_video, is_deleted) of one media type more similar than `above`."""
    live = photos.where(~F.col("is_deleted"))
    images, videos = (live.where(F.col("is_video") == video) for video in (False, True))
    return near_pairs(images, above, strict=True).unionByName(near_pairs(videos, above, strict=True))


def carry_names(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """C11: (cluster, name, sim): for each new cluster (cluster, v) the name of the most similar old one (name, v) of at least `least`; ties to the smaller name."""
    from shoal.operators.maintain import append_rows

    none = old.sparkSession.createDataFrame([], "id long, name string, v array<double>")
    named = checkpointed(append_rows(none, old.select("name", "v"), "name"))
    at = nearest_prototype(new.select(F.col("cluster").alias("vec_id"), "v"), named.select(F.col("id").alias("proto"), "v"), least).where("proto >= 0")
    return at.join(named.select(F.col("id").alias("proto"), "name"), "proto").select(F.col("vec_id").alias("cluster"), "name", "sim")


def frame_pairs(videos: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, sim) for candidate pairs (a, b) of videos (video, frames, mean): the best pair of frames, or of the means if a side has none."""
    full = videos.withColumn("frames", F.filter("frames", lambda f: F.size(f) > 0))
    x, y = full.toDF("a", "frames_a", "mean_a"), full.toDF("b", "frames_b", "mean_b")
    both = pairs.join(x, "a").join(y, "b")
    best = F.array_max(F.transform("frames_a", lambda f: best_of(F.col("frames_b"), f)))
    return both.select("a", "b", F.when((F.size("frames_a") > 0) & (F.size("frames_b") > 0), best).otherwise(dot("mean_a", "mean_b")).alias("sim"))


def mutual_top_k(pairs: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """(a, b, sim), a < b, each among the other's k most similar; pairs holds both directions or a < b."""
    both = pairs.select("a", "b", "sim").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).distinct()
    top = both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("_r") <= k).drop("_r")
    out = top.join(top.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
    return out if least is None else out.where(F.col("sim") >= least)


def top_similar(vectors: DataFrame, source: int, k: int = 60, floor: float = 0.55) -> DataFrame:
    """the k vectors most similar to a source, itself left out."""
    found = vectors.where(F.col("vec_id") == source).select("v").first()
    q = F.array(*[F.lit(float(x)) for x in (found["v"] if found else [])])
    return vectors.where(F.col("vec_id") != source).select("vec_id", dot("v", q).alias("sim")).where(F.col("sim") >= floor).orderBy(F.desc("sim"), "vec_id").limit(k)


def cell_join(vectors: DataFrame, least: float, cells: int | None = None, probe: int = 32, seed: int = 5) -> DataFrame:
    """(a, b, sim), a < b, approximately: each vector meets those in its nearest `probe` k-means cells.

    Cells are 4 times the root of the count, between 64 and 8192 (but no more than
    vectors), fitted on FIT of them at most; all vectors are indexed and met, block by
    block. Recall against block_pairs is for the caller to measure.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = checkpointed(vectors.select("vec_id", "v"))
    n = vectors.count()
    cells = min(n, cells or int(np.clip(4 * np.sqrt(n), 64, 8192)))
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "a long, b long, sim double")
    some = checkpointed(vectors if n <= FIT else vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT).repartition(FIT // 2048))
    fit = KMeans(k=cells, seed=seed, maxIter=5, initMode="k-means||" if n <= FIT else "random").fit(some.select(array_to_vector("v").alias("features")))
    sent = vectors.sparkSession.sparkContext.broadcast(np.array([c for c in fit.clusterCenters()]))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        c, out = sent.value, []
        for s in range(0, len(v), STRIP):
            x = np.stack(v.iloc[s : s + STRIP].to_numpy())
            out += list(np.argsort((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)[:, :probe].astype(np.int32))
        return pd.Series(out)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ids_a, x, _, ids_b, y, _ in unpacked(batch):
                for s, sims, near in partners(False, x, y, least, False):
                    i, j = np.nonzero(near)
                    a, b, sim = ids_a[s + i], ids_b[j], sims[i, j]
                    keep = a != b
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[keep]), pa.array(np.maximum(a, b)[keep]), pa.array(sim[keep])], names=["a", "b", "sim"])

    at = checkpointed(vectors.select("vec_id", "v", nearest("v").alias("near")))
    homes = at.select(F.col("near")[0].alias("cell"), F.lit(0).alias("side"), F.lit(0.0).alias("at"), "vec_id", "v")
    guests = at.select(F.explode("near").alias("cell"), F.lit(1).alias("side"), F.lit(0.0).alias("at"), "vec_id", "v")
    return meets(homes.unionByName(guests), 1.0, guests_only=True).mapInArrow(compare, "a long, b long, sim double").dropDuplicates(["a", "b"])


def zero_shot(vectors: DataFrame, prompts: DataFrame) -> DataFrame:
    """(category, vec_id, score): categories (category, v, threshold; several prompts each) whose best prompt a vector reaches."""
    asked = checkpointed(prompts.select(F.monotonically_increasing_id().alias("vec_id"), "category", "v", "threshold"))
    reach = asked.groupBy("category").agg(F.max("threshold").alias("threshold"))
    lowest = reach.agg(F.min("threshold")).first()[0]
    hits = block_pairs(vectors, asked, 2.0 if lowest is None else lowest, same=False)
    best = hits.join(asked.select(F.col("vec_id").alias("b"), "category"), "b").groupBy("category", F.col("a").alias("vec_id")).agg(F.max("sim").alias("score"))
    return best.join(reach, "category").where("score >= threshold").select("category", "vec_id", "score")


def folder_members(vectors: DataFrame, saved: DataFrame) -> DataFrame:
    """(folder, vec_id) of saved searches (folder, q, anchor, floor): vectors at least `floor` like the query, the anchor left out."""
    lowest = saved.agg(F.min("floor")).first()[0]
    hits = block_pairs(vectors, saved.select(F.col("folder").alias("vec_id"), F.col("q").alias("v")), 2.0 if lowest is None else lowest, same=False)
    met = hits.join(saved.select(F.col("folder").alias("b"), "anchor", "floor"), "b").where((F.col("sim") >= F.col("floor")) & ~F.col("a").eqNullSafe(F.col("anchor")))
    return met.select(F.col("b").alias("folder"), F.col("a").alias("vec_id"))


def consistency(one: DataFrame, two: DataFrame) -> DataFrame:
    """(vec_id, status, sim) of two runs' vectors: same item in both, or missing from one."""
    x, y = one.select("vec_id", F.col("v").alias("x")), two.select("vec_id", F.col("v").alias("y"))
    status = F.when(F.col("x").isNull(), "missing in first").when(F.col("y").isNull(), "missing in second").otherwise("both")
    return x.join(y, "vec_id", "full_outer").select("vec_id", status.alias("status"), F.when(status == "both", cosine("x", "y")).alias("sim"))


def video_moments(videos: DataFrame, query: list[float], floor: float = 0.25, limit: int = 60) -> DataFrame:
    """(video, frame, score, t) of the best frame of each video (video, frames, duration, ts) at `floor` or more, by time, the first 60."""
    q = F.array(*[F.lit(float(x)) for x in query])
    frames = videos.select("video", "duration", "ts", F.size("frames").alias("n"), F.posexplode("frames").alias("frame", "v")).where(F.size("v") > 0)
    best = frames.withColumn("score", dot("v", q)).groupBy("video").agg(F.max_by(F.struct("frame", "score", "duration", "ts", "n"), F.struct("score", -F.col("frame"))).alias("x")).select("video", "x.*")
    t = F.col("duration") * (F.col("frame") + 0.5) / F.col("n")
    return best.where(F.col("score") >= floor).withColumn("t", t).orderBy(F.asc_nulls_first("ts"), "video").limit(limit)
