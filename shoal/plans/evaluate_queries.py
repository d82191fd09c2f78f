"""Queries of evaluation, boxes and pixels, user functions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import udfs as U
from shoal.functions import vectors as V
from shoal.operators import evaluate as E
from shoal.operators import graph as G
from shoal.operators import images as I
from shoal.operators import simjoin as J
from shoal.operators.pivots import near_pairs
from shoal.plans.registry import SQL, query
from shoal.plans.timeline_queries import TRACK, track
from shoal.plans.vector_queries import clustered_faces
from shoal.sources.bindings import Tables, bound
from shoal.sources.tables import scratch
from shoal.streaming import incremental as R
from shoal.streaming import stateful as W

#: Scored pairs: consecutive vectors up to ten apart, scores cut to four places.
PAIRS = bound("vectors") + ", pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 4) AS sim, a.label = b.label AS same, a.vec_id % 10 AS fold FROM vectors a JOIN vectors b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 10)"
GRID = [round(-0.2 + 0.02 * k, 2) for k in range(36)]
STEPS = "(SELECT unnest([" + ", ".join(map(str, GRID)) + "]) AS threshold)"


def pairs(t: Tables) -> DataFrame:
    near = t.vectors.select("vec_id", "v", "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 10)).alias("b"))
    other = t.vectors.select(F.col("vec_id").alias("b"), F.col("v").alias("w"), F.col("label").alias("other"))
    return near.join(other, "b").select(F.col("vec_id").alias("a"), "b", F.round(V.dot("v", "w"), 4).alias("sim"), (F.col("label") == F.col("other")).alias("same"), (F.col("vec_id") % 10).alias("fold"))


def r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query(PAIRS + " SELECT same, count(*) AS n, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, min(sim) AS low, max(sim) AS high FROM pairs GROUP BY same")
def d16_similarity_stats(t: Tables) -> DataFrame:
    return E.similarity_stats(pairs(t)).select("same", "n", r("mean"), r("std"), "low", "high")


@query(PAIRS + " SELECT same, CAST(least(19, greatest(0, trunc((sim - -0.2) / 0.05))) AS INT) AS bin, count(*) AS n FROM pairs GROUP BY 1, 2")
def d17_similarity_histogram(t: Tables) -> DataFrame:
    return E.histogram(pairs(t), hi=0.8)


SWEEP = PAIRS + f", s AS (SELECT threshold, count(*) FILTER (WHERE same AND sim >= threshold) AS tp, count(*) FILTER (WHERE NOT same AND sim >= threshold) AS fp, count(*) FILTER (WHERE same AND sim < threshold) AS fn FROM pairs, {STEPS} GROUP BY threshold), r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall FROM s)"


@query(SWEEP + " SELECT threshold, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r")
def d18_threshold_sweep(t: Tables) -> DataFrame:
    return E.sweep(pairs(t), GRID).select("threshold", "tp", "fp", "fn", r("precision"), r("recall"), r("f1"))


CURVE = PAIRS + ", c AS (SELECT sim, count(*) FILTER (WHERE same) AS p, count(*) FILTER (WHERE NOT same) AS n FROM pairs GROUP BY sim), k AS (SELECT *, sum(p) OVER (ORDER BY sim DESC) AS tp, sum(n) OVER (ORDER BY sim DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM c)"


@query(CURVE + " SELECT round(sum(tp / (tp + fp) * p / ps), 6) AS average_precision, round(max(2 * tp / (tp + fp + ps)), 6) AS best_f1, arg_max(sim, (2 * tp / (tp + fp + ps), sim)) AS threshold FROM k")
def d19_best_f1_and_average_precision(t: Tables) -> DataFrame:
    return E.average_precision(pairs(t)).select(r("average_precision"), r("best_f1"), "threshold")


@query(CURVE + " SELECT round(sum(n * (tp - p / 2)) / max(ps * ns), 6) AS auc FROM k")
def d20_roc_auc(t: Tables) -> DataFrame:
    return E.roc_auc(pairs(t)).select(r("auc"))


@query(PAIRS + ", n AS (SELECT sim, row_number() OVER (ORDER BY sim) - 1 AS i, count(*) OVER () AS n FROM pairs WHERE NOT same) SELECT fpr, sim AS threshold FROM n, (SELECT unnest([0.001, 0.01, 0.1, 1.0]) AS fpr) WHERE i = greatest(0, n - CAST(trunc(fpr * n) AS BIGINT) - 1)")
def d21_threshold_for_fpr(t: Tables) -> DataFrame:
    return E.threshold_for_fpr(pairs(t), [0.001, 0.01, 0.1, 1.0])


@query(PAIRS + f", c AS (SELECT fold, threshold, count(*) FILTER (WHERE (sim >= threshold) = same) AS ok, count(*) AS n FROM pairs, {STEPS} GROUP BY ALL), t AS (SELECT *, (sum(ok) OVER w - ok) / (sum(n) OVER w - n) AS train FROM c WINDOW w AS (PARTITION BY threshold)), u AS (SELECT fold, threshold, ok / n AS a FROM t QUALIFY row_number() OVER (PARTITION BY fold ORDER BY train DESC, threshold) = 1) SELECT fold, threshold, round(a, 6) AS accuracy, round(avg(a) OVER (), 6) AS mean, round(stddev_pop(a) OVER (), 6) AS std FROM u")
def d22_kfold_threshold_accuracy(t: Tables) -> DataFrame:
    return E.kfold_accuracy(pairs(t), GRID).select("fold", "threshold", r("accuracy"), r("mean"), r("std"))


#: Pair counts by grid point of rows g (point, truth, label).
GRID_SQL = " c AS (SELECT point, label, truth, count(*) AS n FROM g WHERE label >= 0 GROUP BY ALL), tp AS (SELECT point, sum(n * (n - 1) / 2) AS tp FROM c GROUP BY point), pr AS (SELECT point, sum(n * (n - 1) / 2) AS pr FROM (SELECT point, label, sum(n) AS n FROM c GROUP BY ALL) GROUP BY point), ac AS (SELECT point, sum(n * (n - 1) / 2) AS ac FROM (SELECT point, truth, count(*) AS n FROM g GROUP BY ALL) GROUP BY point), z AS (SELECT point, count(DISTINCT label) FILTER (WHERE label >= 0) AS clusters, count(*) FILTER (WHERE label < 0) / count(*) AS noise FROM g GROUP BY point)"


@query(bound("near").replace("WITH ", "WITH RECURSIVE ", 1) + """, pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS sim FROM blocks a JOIN blocks b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.55),
points AS (SELECT * FROM (VALUES ('0.2/2', 0.8, 2), ('0.2/3', 0.8, 3), ('0.4/2', 0.6, 2), ('0.4/3', 0.6, 3)) x(point, least, samples)), w AS (SELECT point, samples, a, b FROM pairs JOIN points ON sim >= least),
core AS (SELECT point, a AS id FROM w GROUP BY point, a, samples HAVING count(*) + 1 >= samples), links AS (SELECT w.point, w.a, w.b FROM w JOIN core c ON c.point = w.point AND c.id = w.a JOIN core d ON d.point = w.point AND d.id = w.b),
reach(point, id, other) AS (SELECT point, id, id FROM core UNION SELECT r.point, r.id, l.b FROM reach r JOIN links l ON l.point = r.point AND l.a = r.other), cores AS (SELECT point, id, min(other) AS root FROM reach GROUP BY point, id),
root AS (SELECT * FROM cores UNION ALL SELECT w.point, w.a, min(c.root) FROM w JOIN cores c ON c.point = w.point AND c.id = w.b WHERE NOT EXISTS (SELECT 1 FROM core k WHERE k.point = w.point AND k.id = w.a) GROUP BY w.point, w.a),
g AS (SELECT points.point, vec_id // 5 AS truth, coalesce(root, -1) AS label FROM points JOIN embeddings ON true LEFT JOIN root ON root.point = points.point AND root.id = vec_id),""" + GRID_SQL + " SELECT point, clusters, round(noise, 6) AS noise, round(tp / pr, 6) AS precision, round(tp / ac, 6) AS recall, round(2 * tp / (pr + ac), 6) AS f1 FROM z JOIN tp USING (point) JOIN pr USING (point) JOIN ac USING (point)")
def d23_clustering_grid_eval(t: Tables) -> DataFrame:
    near = G.checkpointed(near_pairs(t.blocks, 0.55))
    out = None
    for eps in (0.2, 0.4):
        for least in (2, 3):
            labels = G.dbscan(t.blocks.select(F.col("vec_id").alias("id")), near.where(F.col("sim") >= 1 - eps), least)
            rows = labels.join(t.blocks.select(F.col("vec_id").alias("id"), (F.col("vec_id") / 5).cast("long").alias("truth")), "id").select(F.lit(f"{eps}/{least}").alias("point"), "label", "truth")
            out = rows if out is None else out.unionByName(rows)
    return E.grid_eval(out).select("point", "clusters", r("noise"), r("precision"), r("recall"), r("f1"))


PROTO = bound("near") + ", p AS (SELECT vec_id // 5 AS proto, v AS pv FROM blocks WHERE vec_id % 5 = 0 AND vec_id % 2 = 0), s AS (SELECT vec_id, vec_id // 5 AS truth, arg_max(proto, (list_dot_product(v, pv), -proto)) AS proto, max(list_dot_product(v, pv)) AS sim FROM blocks, p GROUP BY vec_id), g AS (SELECT point, truth, CASE WHEN sim >= point THEN proto ELSE -1 END AS label FROM s, (SELECT unnest([0.3, 0.5, 0.7]) AS point)),"


@query(PROTO + GRID_SQL + " SELECT CAST(point AS VARCHAR) AS point, clusters, round(noise, 6) AS noise, round(tp / pr, 6) AS precision, round(tp / ac, 6) AS recall, round(2 * tp / (pr + ac), 6) AS f1 FROM z JOIN tp USING (point) JOIN pr USING (point) JOIN ac USING (point)")
def d24_prototype_grid_eval(t: Tables) -> DataFrame:
    protos = t.blocks.where("vec_id % 10 = 0").select((F.col("vec_id") / 5).cast("long").alias("proto"), "v")
    at = J.nearest_prototype(t.blocks, protos, -2.0)
    grid = at.select("vec_id", "proto", "sim", F.explode(F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7)])).alias("least"))
    rows = grid.select(F.col("least").cast("string").alias("point"), F.when(F.col("sim") >= F.col("least"), F.col("proto")).otherwise(-1).alias("label"), (F.col("vec_id") / 5).cast("long").alias("truth"))
    return E.grid_eval(rows).select("point", "clusters", r("noise"), r("precision"), r("recall"), r("f1"))


BOXES = "boxes AS (SELECT l_orderkey AS image, l_linenumber * 1000000 + l_partkey AS box_id, l_extendedprice / 105000 AS score, l_partkey % 300 / 1.0 AS x, l_suppkey * 3 % 200 / 1.0 AS y, 20 + l_quantity * 2 AS w, 30 + l_quantity AS h FROM lineitem)"


def boxes(t: Tables) -> DataFrame:
    return t.read("lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("box_id"), (F.col("l_extendedprice") / 105000).alias("score"),
                                     (F.col("l_partkey") % 300).cast("double").alias("x"), (F.col("l_suppkey") * 3 % 200).cast("double").alias("y"), (20 + F.col("l_quantity") * 2).alias("w"), (30 + F.col("l_quantity")).alias("h"))


@query(f"WITH {BOXES} SELECT image, box_id FROM boxes WHERE score >= 0.65 AND least(w, h) >= 50 AND abs(x - 150) <= 40")
def b11_face_quality_filter(t: Tables) -> DataFrame:
    rows = boxes(t).select("image", "box_id", F.col("score").alias("det_score"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), (F.col("x") - 150).alias("yaw"))
    return I.good_faces(rows, side=50).select("image", "box_id")


@query(f"WITH {BOXES}, q AS (SELECT image, box_id, x, y, w, h, greatest(w, h) * 0.25 AS p FROM boxes), s AS (SELECT *, greatest(w + 2 * p, 16.0) AS w2, greatest(h + 2 * p, 16.0) AS h2 FROM q), u AS (SELECT *, greatest(0.0, x + w / 2 - w2 / 2) AS x2, greatest(0.0, y + h / 2 - h2 / 2) AS y2 FROM s) SELECT image, box_id, round(x2, 6) AS x, round(y2, 6) AS y, round(least(400.0, x2 + w2) - x2, 6) AS w, round(least(300.0, y2 + h2) - y2, 6) AS h FROM u")
def h9_pad_and_clamp_box(t: Tables) -> DataFrame:
    b = I.padded_box(*[F.col(c) for c in "xywh"], F.lit(400.0), F.lit(300.0))
    return boxes(t).select("image", "box_id", b.alias("b")).select("image", "box_id", *[F.round(f"b.{c}", 6).alias(c) for c in "xywh"])


@query(f"WITH {BOXES}, o AS (SELECT a.image, a.box_id AS a, b.box_id AS b, greatest(0.0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.image = b.image AND a.box_id < b.box_id) SELECT image, a, b, round(i / (s - i + 1e-7), 6) AS iou FROM o")
def h10_iou(t: Tables) -> DataFrame:
    s = F.struct(*"xywh")
    x, y = boxes(t).select("image", F.col("box_id").alias("a"), s.alias("p")), boxes(t).select("image", F.col("box_id").alias("b"), s.alias("q"))
    return x.join(y, "image").where("a < b").select("image", "a", "b", F.round(I.iou(F.col("p"), F.col("q")), 6).alias("iou"))


#: Grey pictures: 8 by 8 values from each vector's components.
PIXELS = "px AS (SELECT vec_id AS image, k % 8 AS x, k // 8 AS y, CAST(trunc((list_extract(embedding, k + 1) + 1) * 100) AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(64)) AS k))"


def pixels(t: Tables) -> DataFrame:
    rows = t.read("embeddings").select("vec_id", F.posexplode("embedding").alias("k", "c"))
    return rows.select(F.col("vec_id").alias("image"), (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).alias("y"), ((F.col("c") + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("int").cast("double").alias("v"))


@query(f"WITH {PIXELS}, l AS (SELECT a.image, sum(b.v) - 4 * a.v AS l FROM px a JOIN px b ON a.image = b.image AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.x BETWEEN 1 AND 6 AND a.y BETWEEN 1 AND 6 GROUP BY a.image, a.x, a.y, a.v) SELECT image, round(greatest(0.0, avg(l * l) - avg(l) * avg(l)), 3) AS sharpness FROM l GROUP BY image")
def h8_laplacian_sharpness(t: Tables) -> DataFrame:
    return I.sharpness(pixels(t)).select("image", r("sharpness", 3))


@query("WITH p AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS p FROM embeddings) SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda k: CASE WHEN list_extract(p, k + k // 8 + 2) > list_extract(p, k + k // 8 + 1) THEN 1::BIGINT << (63 - k) ELSE 0 END)) AS BIGINT) AS low, list_extract(p, 2) > list_extract(p, 1) AS top FROM p")
def h7_difference_hash(t: Tables) -> DataFrame:
    p = t.read("embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 8)).alias("p")).select("vec_id", V.difference_hash("p").alias("h"))
    return p.select("vec_id", F.col("h").bitwiseAND(F.lit(2**63 - 1)).alias("low"), (F.col("h") < 0).alias("top"))


@query(f"""WITH RECURSIVE {BOXES}, f AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS k FROM boxes WHERE score >= 0.5),
t AS (SELECT image, CAST(1 AS BIGINT) AS k, [{{'id': box_id, 'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM f WHERE k = 1 UNION ALL
  SELECT f.image, f.k, CASE WHEN len(list_filter(kept, lambda c: greatest(0.0, least(c.x + c.w, f.x + f.w) - greatest(c.x, f.x)) * greatest(0.0, least(c.y + c.h, f.y + f.h) - greatest(c.y, f.y)) > 0.4 * (c.w * c.h + f.w * f.h
    - greatest(0.0, least(c.x + c.w, f.x + f.w) - greatest(c.x, f.x)) * greatest(0.0, least(c.y + c.h, f.y + f.h) - greatest(c.y, f.y)) + 1e-7))) > 0 THEN kept ELSE list_append(kept, {{'id': f.box_id, 'x': f.x, 'y': f.y, 'w': f.w, 'h': f.h}}) END
  FROM t JOIN f ON f.image = t.image AND f.k = t.k + 1)
SELECT image, unnest(list_transform(arg_max(kept, k), lambda c: c.id)) AS box_id FROM t GROUP BY image""")
def i15_non_max_suppression(t: Tables) -> DataFrame:
    return I.non_max_suppression(boxes(t))


@query("""WITH m AS (SELECT vec_id AS face, list_extract(embedding, 2 * k + 1) AS x, list_extract(embedding, 2 * k + 2) AS y, k AS u, (k * k) % 7 AS v FROM embeddings, (SELECT unnest(range(5)) AS k)), s AS (SELECT face, count(*) AS n, avg(CAST(x AS DOUBLE)) AS mx, avg(CAST(y AS DOUBLE)) AS my, avg(u) AS mu, avg(v) AS mv, sum(CAST(x AS DOUBLE) * x + CAST(y AS DOUBLE) * y) AS q, sum(CAST(x AS DOUBLE) * u + CAST(y AS DOUBLE) * v) AS p, sum(CAST(x AS DOUBLE) * v - CAST(y AS DOUBLE) * u) AS r FROM m GROUP BY face),
f AS (SELECT *, (p - n * (mx * mu + my * mv)) / (q - n * (mx * mx + my * my)) AS a, (r - n * (mx * mv - my * mu)) / (q - n * (mx * mx + my * my)) AS b FROM s)
SELECT face, round(a, 5) AS a, round(b, 5) AS b, round(mu - a * mx + b * my, 5) AS tx, round(mv - b * mx - a * my, 5) AS ty FROM f""")
def i16_similarity_transform_fit(t: Tables) -> DataFrame:
    rows = t.vectors.select(F.col("vec_id").alias("face"), "v", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    at = lambda d: F.element_at("v", 2 * F.col("k") + d)
    return I.similarity_transform(rows.select("face", at(1).alias("x"), at(2).alias("y"), F.col("k").alias("u"), (F.col("k") * F.col("k") % 7).alias("v"))).select("face", *[r(c, 5) for c in ("a", "b", "tx", "ty")])


@query()
def a1_scan_media(t: Tables) -> DataFrame:
    """The tables' own folder as the library: every Parquet file below it."""
    from shoal.sources.tables import scan_media

    return scan_media(t.spark, t.sf_dir, ("parquet",)).select(F.substring_index("path", "/", -1).alias("file"), "length")


@query("SELECT CAST(floor(k / 20) AS INT) AS fold, k % 2 = 0 AS same, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1, 2")
def a7_read_verification_pairs(t: Tables) -> DataFrame:
    from shoal.sources.tables import verification_pairs

    path = scratch(t.spark, "pairs")
    k = F.col("o_orderkey")
    line = F.when(k % 2 == 0, F.concat_ws("\t", F.concat(F.lit("n"), k.cast("string")), F.lit("1"), F.lit("2"))).otherwise(F.concat_ws("\t", F.concat(F.lit("n"), k.cast("string")), F.lit("1"), F.lit("m"), F.lit("3")))
    head = t.spark.createDataFrame([(-1, "10\t10")], "o_orderkey long, line string")
    t.read("orders").select("o_orderkey", line.alias("line")).unionByName(head).orderBy("o_orderkey").select("line").write.text(path)
    return verification_pairs(t.spark, path).groupBy("fold", "same").agg(F.count("*").alias("n"))


@query()
def k1_encoder_udf(t: Tables) -> DataFrame:
    encode = U.encoder_udf(U.hashing_encoder)
    return t.read("documents").select("doc_id", encode("text").alias("v")).select("doc_id", F.round(F.col("v")[0], 4).alias("first"), F.size("v").alias("width"))


def word_finder():
    return lambda text: [(len(w) / 10, i, 0, len(w), 1, [len(w), i]) for i, w in enumerate((text or "").split()) if len(w) > 12]


@query("WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), f AS (SELECT doc_id, unnest(list_filter(w, lambda x: length(x) > 12)) AS x FROM w) SELECT doc_id, count(*) AS found, max(length(x)) / 10 AS best FROM f GROUP BY doc_id")
def k2_detector_udtf(t: Tables) -> DataFrame:
    return U.detect(t.read("documents"), "doc_id", "text", word_finder).groupBy("doc_id").agg(F.count("*").alias("found"), F.max("score").alias("best"))


def first_number():
    return lambda text: [float(text.split("{\"k\": ")[1].split("}")[0]), 1.0 / (float(text.split("{\"k\": ")[1].split("}")[0]) % 5)]


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 = 0 AS failed, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS k FROM events")
def k3_partitioned_extract(t: Tables) -> DataFrame:
    got = U.extract(t.events, "event_id", "props", first_number)
    return got.select("event_id", F.col("error").isNotNull().alias("failed"), F.col("v")[0].alias("k"))


def uploads(t: Tables, table: str = "event[s]") -> DataFrame:
    """The events table as a stream of files."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{table}.parquet")


@query("""WITH e AS (SELECT event_type AS device, epoch_us(ts) / 1e6 AS x FROM events), f AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY device ORDER BY x) >= 45, true) AS opens FROM e),
s AS (SELECT device, x, sum(CAST(opens AS INT)) OVER (PARTITION BY device ORDER BY x ROWS UNBOUNDED PRECEDING) AS number FROM f) SELECT device, min(x) AS "first", max(x) AS "last", count(*) AS n FROM s GROUP BY device, number""")
def j1_debounced_batches(t: Tables) -> DataFrame:
    path = scratch(t.spark, "batches")
    R.each_batch(W.debounced(uploads(t), "event_type"), R.appended(path), f"{path}-at").awaitTermination()
    return R.latest(t.spark.read.parquet(path), "device", "number").where("n > 0").select("device", "first", "last", "n")


def vector_stream(t: Tables) -> DataFrame:
    schema = t.read("embeddings").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/embedding[s].parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


@query(bound("vectors") + ", protos AS (SELECT vec_id // 50 AS proto, v AS pv FROM vectors WHERE vec_id % 50 = 0), s AS (SELECT vec_id, arg_max(proto, (list_dot_product(v, pv), -proto)) AS proto, max(list_dot_product(v, pv)) AS sim FROM vectors, protos GROUP BY vec_id), a AS (SELECT vec_id, CASE WHEN sim >= 0.2 THEN proto ELSE -1 END AS proto FROM s) SELECT vec_id, proto, CASE WHEN proto >= 0 THEN count(*) OVER (PARTITION BY proto) END AS n FROM a")
def j2_incremental_assign_stream(t: Tables) -> DataFrame:
    path = scratch(t.spark, "assigned")
    protos = t.vectors.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("proto"), "v")
    R.each_batch(vector_stream(t), R.assign_and_append(protos, path, 0.2), f"{path}-at").awaitTermination()
    return t.spark.read.parquet(f"{path}/faces").join(R.refreshed_counts(t.spark, path), "proto", "left").select("vec_id", "proto", "n")


@query(SQL["i4_recluster_people"])
def j3_recluster_trigger(t: Tables) -> DataFrame:
    path = scratch(t.spark, "people")

    def again(epoch: int) -> None:
        faces, old = clustered_faces(t)
        people, _ = G.recluster(faces, old)
        people.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    runs = R.Reclustering(t.spark, f"{path}-runs", again)
    R.each_batch(vector_stream(t), runs.after(25), f"{path}-at").awaitTermination()
    return t.spark.read.parquet(f"{path}/epoch={runs.epoch()}")


@query()
def j4_stream_dedup(t: Tables) -> DataFrame:
    path = scratch(t.spark, "unique")
    schema = t.read("documents").schema
    docs = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/document[s].parquet").select(F.col("doc_id").alias("id"), "text")
    R.each_batch(docs, R.skip_duplicates(G.simhash_words, path), f"{path}-at").awaitTermination()
    return t.spark.read.parquet(path).select("id")


def town(lat: float, lon: float) -> str:
    """A stand-in lookup, alike all over a cell; it has no answer for some."""
    return f"town {int(lat * 100)}" if int(lon * 100) % 3 else ""


@query(f"WITH {TRACK} SELECT DISTINCT CAST(trunc(lat * 100) AS INT) || '_' || CAST(trunc(lon * 100) AS INT) AS cell, CASE WHEN CAST(trunc(lon * 100) AS INT) % 3 <> 0 THEN 'town ' || CAST(trunc(lat * 100) AS INT) ELSE '' END AS place FROM track WHERE lat IS NOT NULL")
def j8_geocode_queue(t: Tables) -> DataFrame:
    path = scratch(t.spark, "cells")
    live = Tables(t.spark, t.sf_dir)
    live.__dict__["events"] = uploads(t)
    R.each_batch(W.geocode_queue(R.located_cells(track(live)), lambda: town), R.appended(path), f"{path}-at").awaitTermination()
    return t.spark.read.parquet(path).select("cell", "place")
