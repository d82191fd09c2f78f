"""Queries of vectors, similarity joins and clusters. Thresholds fit the vectors at hand; the defaults are the operators' parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import vectors as V
from shoal.operators import graph as G
from shoal.operators import pivots
from shoal.operators import simjoin as J
from shoal.operators.hamming import hamming_join
from shoal.plans.registry import query
from shoal.sources.bindings import Tables, bound
from shoal.sources.shared import checkpointed

VE, BL = bound("vectors"), bound("near")
#: Neighbour pairs of the block vectors.
NEAR = BL + ", pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS sim FROM blocks a JOIN blocks b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.8)"
PROTOS = ", protos AS (SELECT vec_id // 50 AS proto, v AS pv FROM vectors WHERE vec_id % 50 = 0)"


def r6(c: str, name: str | None = None):
    return F.round(c, 6).alias(name or c)


def protos(t: Tables) -> DataFrame:
    return t.vectors.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("proto"), "v")


def near_pairs(t: Tables, least: float = 0.8) -> DataFrame:
    return pivots.near_pairs(t.blocks, least)


@query(VE + " SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot, 0.0 AS unequal FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def h1_dot(t: Tables) -> DataFrame:
    nxt = t.vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return t.vectors.join(nxt, "vec_id").select("vec_id", F.round(V.dot("v", "w"), 6).alias("dot"), V.dot("v", F.slice("w", 1, 3)).alias("unequal"))


@query(VE + " SELECT vec_id, round(v[1] * 3 / (sqrt(list_dot_product(v, v)) * 3 + 1e-10), 6) AS first FROM vectors")
def h2_l2_normalize(t: Tables) -> DataFrame:
    return t.vectors.select("vec_id", F.round(V.l2_normalize(V.scale("v", 3.0))[0], 6).alias("first"))


@query(VE + " SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS sim, list_cosine_similarity(a.v, b.v) >= 0.1 AS is_match FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def h3_cosine_similarity(t: Tables) -> DataFrame:
    nxt = t.vectors.select((F.col("vec_id") - 1).alias("vec_id"), V.scale("v", 2.5).alias("w"))
    sim = V.cosine("v", "w")
    return t.vectors.join(nxt, "vec_id").select("vec_id", F.round(sim, 6).alias("sim"), (sim >= 0.1).alias("is_match"))


def frames(t: Tables) -> DataFrame:
    """Videos: eight consecutive vectors each, with one empty slot in every third."""
    rows = t.vectors.groupBy((F.col("vec_id") / 8).cast("long").alias("video")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "v"))), lambda s: s["v"]).alias("frames"))
    hole = F.transform("frames", lambda f, i: F.when((F.col("video") % 3 == 0) & (i == 2), F.array().cast("array<double>")).otherwise(f))
    return rows.select("video", hole.alias("frames"))


FRAMES = VE + ", frames AS (SELECT vec_id // 8 AS video, vec_id % 8 AS pos, v FROM vectors WHERE NOT (vec_id // 8 % 3 = 0 AND vec_id % 8 = 2))"


@query(FRAMES + ", m AS (SELECT video, k, avg(list_extract(v, k)) AS x FROM frames, (SELECT unnest(range(1, 65)) AS k) GROUP BY video, k) SELECT video, round(max(x) FILTER (WHERE k = 1) / (sqrt(sum(x * x)) + 1e-10), 6) AS first, round(max(x) FILTER (WHERE k = 64) / (sqrt(sum(x * x)) + 1e-10), 6) AS last FROM m GROUP BY video")
def h4_vector_mean_renorm(t: Tables) -> DataFrame:
    m = frames(t).withColumn("m", V.mean_renormalised("frames"))
    return m.select("video", F.round(F.col("m")[0], 6).alias("first"), F.round(F.col("m")[63], 6).alias("last"))


@query(VE + ", q AS (SELECT list_transform(range(1, 65), lambda k: list_extract(a.v, k) + list_extract(b.v, k) - 0.8 * list_extract(c.v, k)) AS r FROM vectors a, vectors b, vectors c WHERE a.vec_id = 3 AND b.vec_id = 11 AND c.vec_id = 5) SELECT vec_id, round(list_dot_product(v, r) / (sqrt(list_dot_product(r, r)) + 1e-10), 6) AS score FROM vectors, q")
def h5_composite_query_vector(t: Tables) -> DataFrame:
    q = J.composite(t.vectors.toDF("term", "v", "label"), {3: 1.0, 11: 1.0, 5: -0.8})
    return t.vectors.select("vec_id", F.round(V.dot("v", F.array(*map(F.lit, q))), 6).alias("score"))


@query(VE + ", s AS (SELECT vec_id, CAST(array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS h FROM vectors) SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS INT) AS dist FROM s a JOIN s b ON b.vec_id = a.vec_id + 1")
def h6_hamming_distance(t: Tables) -> DataFrame:
    s = t.vectors.select("vec_id", V.sign_hash("v").alias("h"))
    return s.join(s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g")), "vec_id").select("vec_id", V.hamming("h", "g").alias("dist"))


@query(VE + PROTOS + ", s AS (SELECT vec_id, arg_max(proto, (list_dot_product(v, pv), -proto)) AS proto, max(list_dot_product(v, pv)) AS sim FROM vectors, protos GROUP BY vec_id) SELECT vec_id, CASE WHEN sim >= 0.2 THEN proto ELSE -1 END AS proto, round(sim, 6) AS sim FROM s")
def c6_nearest_prototype(t: Tables) -> DataFrame:
    return J.nearest_prototype(t.vectors, protos(t), 0.2).select("vec_id", "proto", r6("sim"))


@query(VE + PROTOS + ", s AS (SELECT vec_id, arg_max(proto, (list_dot_product(v, pv), -proto)) AS proto, max(list_dot_product(v, pv)) AS sim FROM vectors, protos GROUP BY vec_id) SELECT CASE WHEN sim >= 0.3 THEN proto ELSE -1 END AS person, vec_id AS photo FROM s")
def c7_photos_by_person_index(t: Tables) -> DataFrame:
    return J.nearest_prototype(t.vectors, protos(t), 0.3).select(F.col("proto").alias("person"), F.col("vec_id").alias("photo"))


@query(VE + ", s AS (SELECT vec_id, CAST(array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS h FROM vectors) SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS dist FROM s a JOIN s b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) <= 14")
def c8_hamming_join(t: Tables) -> DataFrame:
    return hamming_join(t.vectors.select(F.col("vec_id").alias("id"), V.sign_hash("v").alias("h")), 14)


def text_hashes(t: Tables) -> DataFrame:
    return G.simhash_words(t.read("documents").select(F.col("doc_id").alias("id"), "text"))


HASHED = """words AS (SELECT doc_id AS id, unnest(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS w FROM documents),
bits AS (SELECT id, b, sum(('0x' || md5(w)[1:15])::BIGINT >> b & 1) * 2 > count(*) AS up FROM words, (SELECT unnest(range(60)) AS b) GROUP BY id, b),
hashes AS (SELECT id, CAST(sum(CASE WHEN up THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS h FROM bits GROUP BY id)"""


@query("WITH RECURSIVE " + HASHED + """, e AS (SELECT a.id AS a, b.id AS b FROM hashes a JOIN hashes b ON a.id <> b.id WHERE bit_count(xor(a.h, b.h)) <= 7 AND a.id % 11 <> 0 AND b.id % 11 <> 0),
m AS (SELECT a, b FROM e UNION SELECT id, id + 10 FROM hashes WHERE id % 100 = 33 AND id + 10 IN (SELECT id FROM hashes) UNION SELECT id + 10, id FROM hashes WHERE id % 100 = 33 AND id + 10 IN (SELECT id FROM hashes)),
reach(id, other) AS (SELECT id, id FROM hashes UNION SELECT r.id, m.b FROM reach r JOIN m ON m.a = r.other)
SELECT id, min(other) AS rep FROM reach GROUP BY id""")
def i1_near_duplicate_groups(t: Tables) -> DataFrame:
    h = checkpointed(text_hashes(t))
    known = h.select((F.col("id") - 10).alias("id"))
    manual = h.where("id % 100 = 33").join(known, "id", "left_semi").select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"))
    return G.near_duplicate_groups(h, 7, h.where("id % 11 = 0").select("id"), manual)


@query("SELECT o_orderkey AS id, o_orderkey - o_orderkey % 12 + CASE WHEN o_orderkey % 12 >= 6 THEN 6 ELSE 0 END AS rep FROM orders WHERE o_orderkey % 12 IN (0, 1, 2, 3, 6, 7, 8)")
def g5_group_union(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    threes = t.read("orders").where((k / 3).cast("long") % 2 == 0).select((k / 3).cast("long").alias("gid"), k.alias("id"))
    twos = t.read("orders").where(k % 12 == 2).select((-k - 1).alias("gid"), F.explode(F.array(k, k + 1)).alias("id"))
    return G.group_union(threes.unionByName(twos))


@query(NEAR + " SELECT a, b, round(sim, 6) AS sim FROM pairs WHERE sim > 0.9 AND (a % 2 = 0) = (b % 2 = 0) AND a % 17 <> 0 AND b % 17 <> 0")
def c9_cosine_join(t: Tables) -> DataFrame:
    photos = t.blocks.withColumn("is_video", F.col("vec_id") % 2 == 0).withColumn("is_deleted", F.col("vec_id") % 17 == 0)
    return J.duplicates(photos, 0.9).select("a", "b", r6("sim"))


@query(FRAMES + ", p AS (SELECT DISTINCT video AS a, video + 1 AS b FROM frames WHERE video + 1 IN (SELECT video FROM frames)) SELECT p.a, p.b, round(max(list_dot_product(x.v, y.v)), 6) AS sim FROM p JOIN frames x ON x.video = p.a JOIN frames y ON y.video = p.b GROUP BY p.a, p.b")
def c10_frame_pair_similarity(t: Tables) -> DataFrame:
    videos = frames(t).withColumn("mean", V.mean_renormalised("frames"))
    pairs = videos.select(F.col("video").alias("a"), (F.col("video") + 1).alias("b")).join(videos.select(F.col("video").alias("b")), "b", "left_semi")
    return J.frame_pairs(videos, pairs).select("a", "b", r6("sim"))


@query(VE + ", old AS (SELECT 'name ' || (vec_id // 50 % 4) AS name, v FROM vectors WHERE vec_id % 2 = 1), fresh AS (SELECT vec_id AS cluster, v AS w FROM vectors WHERE vec_id % 2 = 0), s AS (SELECT cluster, name, list_dot_product(v, w) AS sim FROM old, fresh) SELECT cluster, name, round(sim, 6) AS sim FROM s WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY sim DESC, name) = 1")
def c11_carry_names(t: Tables) -> DataFrame:
    old = t.vectors.where("vec_id % 2 = 1").select(F.concat(F.lit("name "), ((F.col("vec_id") / 50).cast("long") % 4).cast("string")).alias("name"), "v")
    new = t.vectors.where("vec_id % 2 = 0").select(F.col("vec_id").alias("cluster"), "v")
    return J.carry_names(old, new, 0.1).select("cluster", "name", r6("sim"))


@query(NEAR + " SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS sim, a.label = b.label AS same FROM blocks a JOIN blocks b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.3")
def c18_ground_truth_pairs(t: Tables) -> DataFrame:
    pairs = pivots.near_pairs(t.blocks, 0.3, mark="label")
    return pairs.select("a", "b", r6("sim"), (F.col("mark_a") == F.col("mark_b")).alias("same"))


@query(VE + PROTOS + ", s AS (SELECT vec_id, arg_max(proto, (list_dot_product(v, pv), proto)) AS proto, max(list_dot_product(v, pv)) AS sim FROM vectors, protos WHERE proto % 3 <> 0 GROUP BY vec_id) SELECT vec_id, CASE WHEN sim >= 0.25 THEN proto END AS proto FROM s")
def c20_backfill_face_match(t: Tables) -> DataFrame:
    at = J.nearest_prototype(t.vectors, protos(t).where("proto % 3 <> 0"), 0.25, last_wins=True)
    return at.select("vec_id", F.when(F.col("proto") >= 0, F.col("proto")).alias("proto"))


@query(NEAR + ", w AS (SELECT a, b, sim FROM pairs UNION SELECT b, a, sim FROM pairs), t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS r FROM w) SELECT x.a, x.b, round(x.sim, 6) AS sim FROM t x JOIN t y ON x.a = y.b AND x.b = y.a WHERE x.r <= 2 AND y.r <= 2 AND x.a < x.b")
def e7_mutual_top_k(t: Tables) -> DataFrame:
    return J.mutual_top_k(near_pairs(t).withColumn("sim", F.round("sim", 9)), 2).select("a", "b", r6("sim"))


@query(VE + ", q AS (SELECT v AS qv FROM vectors WHERE vec_id = 7) SELECT vec_id AS photo_id, round(list_dot_product(v, qv), 6) AS score FROM vectors, q WHERE list_dot_product(v, qv) >= 0.25")
def f1_rank_by_score(t: Tables) -> DataFrame:
    from shoal.operators.search import by_score, scored

    q = t.vectors.where("vec_id = 7").first()["v"]
    rows = t.vectors.select(F.col("vec_id").alias("photo_id"), "v")
    return by_score(scored(rows.select("photo_id"), rows, q), 0.25).select("photo_id", r6("score"))


@query(VE + ", q AS (SELECT v AS qv FROM vectors WHERE vec_id = 7) SELECT vec_id, round(list_dot_product(v, qv), 6) AS sim FROM vectors, q WHERE vec_id <> 7 AND list_dot_product(v, qv) >= 0.1 ORDER BY list_dot_product(v, qv) DESC, vec_id LIMIT 60")
def f4_top_k_similar(t: Tables) -> DataFrame:
    return J.top_similar(t.vectors, 7, 60, 0.1).select("vec_id", r6("sim"))


DENSE = NEAR.replace("WITH ", "WITH RECURSIVE ", 1).replace(">= 0.8", ">= 0.6") + """, w AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), core AS (SELECT a AS id FROM w GROUP BY a HAVING count(*) + 1 >= 3),
links AS (SELECT w.a, w.b FROM w JOIN core x ON x.id = w.a JOIN core y ON y.id = w.b), reach(id, other) AS (SELECT id, id FROM core UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
cores AS (SELECT id, min(other) AS root FROM reach GROUP BY id), root AS (SELECT id, root FROM cores UNION ALL SELECT w.a, min(c.root) FROM w JOIN cores c ON c.id = w.b WHERE w.a NOT IN (SELECT id FROM core) GROUP BY w.a)"""


@query(DENSE + ", n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM root)) SELECT vec_id AS id, coalesce(n.label, -1) AS label FROM embeddings LEFT JOIN root ON id = vec_id LEFT JOIN n USING (root)")
def i3_dbscan(t: Tables) -> DataFrame:
    return G.dbscan_vectors(t.blocks.select(F.col("vec_id").alias("id"), "v"), 0.6)


@query(NEAR + ", p AS (SELECT greatest(a, b) AS id, min(least(a, b)) AS p FROM pairs WHERE sim > 0.9 GROUP BY 1) SELECT vec_id AS id, coalesce((SELECT coalesce((SELECT r.p FROM p r WHERE r.id = q.p), q.p) FROM p q WHERE q.id = vec_id), vec_id) AS rep FROM embeddings")
def i2_greedy_duplicate_groups(t: Tables) -> DataFrame:
    return G.greedy_groups(t.blocks.select(F.col("vec_id").alias("id")), pivots.near_pairs(t.blocks, 0.9, strict=True))


@query(VE + ", m AS (SELECT label, k, avg(list_extract(v, k)) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS k) GROUP BY label, k) SELECT label, round(max(x) FILTER (WHERE k = 1) / sqrt(sum(x * x)), 6) AS first, round(max(x) FILTER (WHERE k = 64) / sqrt(sum(x * x)), 6) AS last FROM m GROUP BY label")
def d7_cluster_prototypes(t: Tables) -> DataFrame:
    p = G.prototypes(t.vectors.select(F.col("vec_id").alias("id"), "v"), t.vectors.select(F.col("vec_id").alias("id"), "label"))
    return p.select("label", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query(VE + ", m AS (SELECT label, k, avg(list_extract(v, k)) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS k) GROUP BY label, k) SELECT label, round(max(x) FILTER (WHERE k = 1) / sqrt(sum(x * x)), 6) AS first FROM m GROUP BY label")
def k4_centroid_udaf(t: Tables) -> DataFrame:
    p = G.centroids(t.vectors, "label")
    return p.select("label", F.round(F.col("m")[0], 6).alias("first"))


@query(VE + ", g AS (SELECT label, vec_id % 2 AS half, k, avg(list_extract(v, k)) AS x, count(*) AS n FROM vectors, (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL), u AS (SELECT label, half, k, n, x / sqrt(sum(x * x) OVER (PARTITION BY label, half)) AS x FROM g), m AS (SELECT label, k, sum(x * n) / sum(n) AS x, sum(n) AS n FROM u GROUP BY label, k) SELECT label, CAST(max(n) AS BIGINT) AS n, round(max(x) FILTER (WHERE k = 1) / sqrt(sum(x * x)), 6) AS first, (SELECT count(DISTINCT vec_id // 3) FROM vectors v WHERE v.label = m.label) AS photos FROM m GROUP BY label HAVING (SELECT count(DISTINCT half) FROM u WHERE u.label = m.label) = 2")
def d8_weighted_prototype_merge(t: Tables) -> DataFrame:
    half = [G.prototypes(t.vectors.where(f"vec_id % 2 = {k}").select(F.col("vec_id").alias("id"), "v"), t.vectors.select(F.col("vec_id").alias("id"), "label")).select("label", "v", "n") for k in (0, 1)]
    cluster = F.col("label") * 2 + F.col("vec_id") % 2  # halves of a label, the odd one merged into the even one
    held = t.vectors.select(cluster.alias("label"), (F.col("vec_id") / 3).cast("long").alias("photo_id"))
    into = held.where("label % 2 = 1").select("label", (F.col("label") - 1).alias("target")).distinct()
    photos = G.merge_members(held, into).groupBy((F.col("label") / 2).cast("int").alias("label")).agg(F.count("*").alias("photos"))
    return G.merge_prototypes(*half).join(photos, "label").select("label", "n", F.round(F.col("v")[0], 6).alias("first"), "photos")


@query(DENSE + """, m AS (SELECT root, k, avg(list_extract(v, k)) AS x FROM blocks JOIN root ON id = vec_id, (SELECT unnest(range(1, 65)) AS k) GROUP BY root, k), raw AS (SELECT root, list(x ORDER BY k) AS raw FROM m GROUP BY root),
pr AS (SELECT root, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS pv FROM raw), s AS (SELECT vec_id, arg_max(root, (list_dot_product(v, pv), -root)) AS proto, max(list_dot_product(v, pv)) AS sim FROM blocks, pr GROUP BY vec_id),
a AS (SELECT vec_id AS id, proto FROM s WHERE sim > 0.42), person AS (SELECT proto, row_number() OVER (ORDER BY proto) - 1 AS person FROM (SELECT DISTINCT proto FROM a)),
cover AS (SELECT person, count(*) AS faces, arg_max(id, ((id * 7 % 31) / 31.0, -id)) AS cover FROM a JOIN person USING (proto) GROUP BY person),
named AS (SELECT person, 'name ' || vec_id AS name FROM person JOIN pr ON root = proto, blocks WHERE vec_id % 50 = 0 AND list_dot_product(v, pv) >= 0.42 QUALIFY row_number() OVER (PARTITION BY person ORDER BY list_dot_product(v, pv) DESC, 'name ' || vec_id) = 1)
SELECT person, faces, cover, name FROM cover LEFT JOIN named USING (person)""")
def i4_recluster_people(t: Tables) -> DataFrame:
    people, _ = G.recluster(*clustered_faces(t))
    return people


def clustered_faces(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Faces (id, v, area) and old prototypes (name, v)."""
    faces = t.blocks.select(F.col("vec_id").alias("id"), "v", ((F.col("vec_id") * 7 % 31) / 31.0).alias("area"))
    return faces, t.blocks.where("vec_id % 50 = 0").select(F.concat(F.lit("name "), F.col("vec_id").cast("string")).alias("name"), "v")


@query()
def i5_cell_range_join(t: Tables) -> DataFrame:
    return J.cell_join(t.blocks, 0.6)


@query("WITH RECURSIVE " + BL.removeprefix("WITH ") + """, f AS (SELECT vec_id % 10 AS owner, vec_id AS id, vec_id // 20 AS photo, v, vec_id * 7 % 31 / 31 AS area, row_number() OVER (PARTITION BY vec_id % 10 ORDER BY vec_id) AS k FROM blocks),
t AS (SELECT owner, k, id, CAST(1 AS BIGINT) AS hit, [{'c': list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10)), 'photos': [photo], 'cover': photo, 'held': area}] AS st FROM f WHERE k = 1 UNION ALL
  SELECT owner, k, id, hit, CASE WHEN hit > len(st) THEN list_append(st, {'c': list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) + 1e-10)), 'photos': [photo], 'cover': photo, 'held': area})
    ELSE list_transform(st, lambda c, i: CASE WHEN i = hit THEN {'c': list_transform(m, lambda x: x / (sqrt(list_sum(list_transform(m, lambda y: y * y))) + 1e-10)), 'photos': list_distinct(list_append(c.photos, photo)),
      'cover': CASE WHEN area > 1.3 * c.held THEN photo ELSE c.cover END, 'held': CASE WHEN area > 1.3 * c.held THEN area ELSE c.held END} ELSE c END) END AS st
  FROM (SELECT *, CASE WHEN hit <= len(st) THEN list_transform(v, lambda x, j: coalesce(st[hit].c[j] * len(st[hit].photos), 0) + x) END AS m
    FROM (SELECT *, CASE WHEN list_max(sims) > 0.45 THEN list_position(sims, list_max(sims)) ELSE len(st) + 1 END AS hit
      FROM (SELECT f.owner, f.k, f.id, f.photo, f.v, f.area, t.st, list_transform(t.st, lambda c: list_sum(list_transform(c.c, lambda x, j: x * f.v[j]))) AS sims FROM t JOIN f ON f.owner = t.owner AND f.k = t.k + 1))))
SELECT owner, id, CAST(hit - 1 AS INT) AS cluster, len(st[hit].photos) AS photos, st[hit].cover AS cover FROM t""")
def i6_online_face_clusters(t: Tables) -> DataFrame:
    k = F.col("vec_id")
    return G.online_clusters(t.blocks.select((k % 10).alias("owner"), k.alias("id"), (k / 20).cast("long").alias("photo"), "v", (k * 7 % 31 / 31).alias("area")))


@query(VE + ", p AS (SELECT 'category ' || (vec_id // 100) AS category, v AS pv, 0.2 + 0.01 * (vec_id // 100 % 3) AS threshold FROM vectors WHERE vec_id % 100 IN (3, 4)) SELECT category, vec_id, round(max(list_dot_product(v, pv)), 6) AS score FROM vectors, p GROUP BY category, vec_id HAVING max(list_dot_product(v, pv)) >= max(threshold)")
def i7_zero_shot_categories(t: Tables) -> DataFrame:
    k = (F.col("vec_id") / 100).cast("long")
    prompts = t.vectors.where("vec_id % 100 in (3, 4)").select(F.concat(F.lit("category "), k.cast("string")).alias("category"), "v", (0.2 + 0.01 * (k % 3)).alias("threshold"))
    return J.zero_shot(t.vectors, prompts).select("category", "vec_id", r6("score"))


@query(FRAMES + ", q AS (SELECT v AS qv FROM vectors WHERE vec_id = 9) SELECT video, round(max(list_dot_product(v, qv)), 6) AS score FROM frames, q GROUP BY video")
def i8_best_representation_score(t: Tables) -> DataFrame:
    q = F.array(*map(F.lit, t.vectors.where("vec_id = 9").first()["v"]))
    return frames(t).select("video", F.round(V.best_of(F.col("frames"), q), 6).alias("score"))


@query(FRAMES + ", q AS (SELECT v AS qv FROM vectors WHERE vec_id = 9) SELECT video, round(max(list_dot_product(v, qv)), 6) AS score FROM frames, q WHERE video % 7 <> 0 GROUP BY video HAVING max(list_dot_product(v, qv)) >= 0.2 ORDER BY max(list_dot_product(v, qv)) DESC, video LIMIT 40")
def i9_embedding_search(t: Tables) -> DataFrame:
    q = F.array(*map(F.lit, t.vectors.where("vec_id = 9").first()["v"]))
    rows = frames(t).where("video % 7 <> 0").select("video", V.best_of(F.col("frames"), q).alias("score"))
    return rows.where("score >= 0.2").orderBy(F.desc("score"), "video").limit(40).select("video", r6("score"))


@query(VE + ", f AS (SELECT vec_id % 20 AS folder, v AS qv, vec_id AS anchor, 0.1 + (vec_id % 2) * 0.05 AS floor FROM vectors WHERE vec_id < 20) SELECT folder, vec_id FROM vectors, f WHERE vec_id <> anchor AND list_dot_product(v, qv) >= floor")
def i13_smart_folder_members(t: Tables) -> DataFrame:
    saved = t.vectors.where("vec_id < 20").select((F.col("vec_id") % 20).alias("folder"), F.col("v").alias("q"), F.col("vec_id").alias("anchor"), (0.1 + F.col("vec_id") % 2 * 0.05).alias("floor"))
    return J.folder_members(t.vectors, saved)


@query(FRAMES + ", q AS (SELECT v AS qv FROM vectors WHERE vec_id = 9), s AS (SELECT video, pos, list_dot_product(v, qv) AS score FROM frames, q), b AS (SELECT video, arg_max(pos, (score, -pos)) AS frame, max(score) AS score FROM s GROUP BY video) SELECT b.video, CAST(frame AS INT) AS frame, round(score, 6) AS score, round(duration * (frame + 0.5) / n, 6) AS t FROM b JOIN (SELECT vec_id // 8 AS video, count(*) AS n FROM vectors GROUP BY 1) k ON k.video = b.video JOIN (SELECT o_orderkey AS video, o_orderdate AS ts, CAST(o_orderkey * 7 % 900 AS DOUBLE) / 10 AS duration FROM orders) p ON p.video = b.video WHERE score >= 0.15 ORDER BY ts NULLS FIRST, b.video LIMIT 60")
def i14_video_moments(t: Tables) -> DataFrame:
    q = t.vectors.where("vec_id = 9").first()["v"]
    videos = frames(t).join(t.photos.select(F.col("photo_id").alias("video"), "ts", "duration"), "video")
    return J.video_moments(videos, q, 0.15).select("video", "frame", r6("score"), r6("t"))


@query(VE + " SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 0 THEN 'missing in second' WHEN a.vec_id % 11 = 0 THEN 'missing in first' ELSE 'both' END AS status, CASE WHEN a.vec_id % 7 <> 0 AND a.vec_id % 11 <> 0 THEN round(list_cosine_similarity(a.v, list_transform(range(1, 65), lambda k: list_extract(a.v, k) + 0.1 * (k % 3))), 6) END AS sim FROM vectors a WHERE NOT (a.vec_id % 77 = 0)")
def i19_embedding_consistency(t: Tables) -> DataFrame:
    one = t.vectors.where("vec_id % 11 <> 0")
    two = t.vectors.where("vec_id % 7 <> 0").select("vec_id", F.transform("v", lambda x, i: x + 0.1 * ((i + 1) % 3)).alias("v"))
    return J.consistency(one, two).select("vec_id", "status", r6("sim"))


@query(VE + " SELECT vec_id, round(v[1], 6) AS first, len(v) AS width FROM vectors")
def a4_read_vectors(t: Tables) -> DataFrame:
    from shoal.sources.tables import round_trip

    back = round_trip(t.vectors.select("vec_id", "v"), "vectors")
    return back.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.size("v").cast("long").alias("width"))


