"""Queries of maintenance: sources and indexes, duplicates, folders, edits, places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.operators import maintain as M
from shoal.plans.registry import query
from shoal.plans.timeline_queries import TRACK, track
from shoal.sources import tables as A
from shoal.sources.bindings import Tables, bound

PH = bound("photos")



@query("SELECT CAST(o_orderkey AS VARCHAR) || '.jpg' AS stem, coalesce(CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN 'side ' || o_orderkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'exif ' || o_orderkey END, 'file ' || o_orderkey) AS taken, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey / 10.0 WHEN o_orderkey % 2 = 0 THEN o_custkey / 20.0 END AS lat, CASE WHEN o_orderkey % 3 = 0 THEN 1.5 WHEN o_orderkey % 2 = 0 THEN 2.5 END AS lon FROM orders")
def a2_read_capture_meta(t: Tables) -> DataFrame:
    o = t.read("orders").withColumn("stem", F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")))
    k, said = F.col("o_orderkey"), lambda w: F.concat(F.lit(f"{w} "), F.col("o_orderkey").cast("string"))
    side = o.where(k % 3 == 0).select("stem", F.when(k % 6 != 0, said("side")).alias("created"), (F.col("o_custkey") / 10).alias("lat"), F.lit(1.5).alias("lon"))
    exif = o.where(k % 2 == 0).select("stem", said("exif").alias("exif_ts"), (F.col("o_custkey") / 20).alias("lat"), F.lit(2.5).alias("lon"))
    return A.capture_meta(o.select("stem", said("file").alias("modified")), side, exif)


@query("SELECT s_suppkey AS asset, l_orderkey AS seq, l_linenumber * 1000000 + l_partkey AS face_idx FROM lineitem JOIN supplier ON s_suppkey = l_suppkey QUALIFY l_orderkey = max(l_orderkey) OVER (PARTITION BY s_suppkey)")
def a5_append_face_log(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_suppkey").alias("asset"), F.col("l_orderkey").alias("seq"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("face_idx"))
    path = A.scratch(t.spark, "faces")
    for part in (0, 1):
        A.append_face_log(rows.where(F.col("seq") % 2 == part), path)
    return A.last_of_log(t.spark.read.schema(rows.schema).parquet(path))


@query("SELECT o_orderkey AS photo_id, 'p/' || o_orderkey || '.jpg' AS path, CAST(NULL AS DOUBLE) AS lat FROM orders")
def a3_read_write_index(t: Tables) -> DataFrame:
    path = A.scratch(t.spark, "index")
    A.write_index(t.read("orders").select(F.col("o_orderkey").alias("photo_id"), F.concat(F.lit("p/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path")), path)
    return t.spark.read.schema(A.PHOTO).json(path).select("photo_id", "path", "lat")


@query("SELECT CASE WHEN event_id % 13 = 0 THEN 'quarantine' ELSE 'good' END AS kind, count(*) AS n, coalesce(CAST(sum(CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT), 0) AS total FROM events GROUP BY 1")
def a6_quarantine_bad_records(t: Tables) -> DataFrame:
    lines = t.events.select(F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit("{oops"))).otherwise(F.col("props")).alias("value"))
    lines = lines.select(F.when(F.col("value").endswith("{oops"), F.substring("value", 2, 100)).otherwise(F.col("value")).alias("value"))
    good, bad = A.split_bad_records(lines, "k long")
    return good.agg(F.lit("good").alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")).unionByName(
        bad.agg(F.lit("quarantine").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("total")))


FEED = "before AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A'), after AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    of = lambda flag: t.read("lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("id")).distinct()
    return of("A"), of("R")


@query(f"WITH {FEED} SELECT id, 'inserted' AS change FROM after WHERE id NOT IN (SELECT id FROM before) UNION ALL SELECT id, 'removed' FROM before WHERE id NOT IN (SELECT id FROM after)")
def a8_read_change_feed(t: Tables) -> DataFrame:
    return M.change_feed(*snapshots(t))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) AND o_orderkey % 7 <> 3")
def b14_needs_index_filter(t: Tables) -> DataFrame:
    source = t.read("orders").select(F.col("o_orderkey").alias("id"))
    index = t.read("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"))
    return M.needs_index(source, index, source.where("id % 7 in (2, 3)").select("id", (F.col("id") % 7).cast("int").alias("attempts")))


@query(PH + " SELECT photo_id FROM photos WHERE NOT is_deleted AND ((photo_id % 4 = 0 AND photo_id % 3 > 0) OR photo_id % 6 = 1)")
def b15_needs_backfill_filter(t: Tables) -> DataFrame:
    k = F.col("photo_id")
    faces = F.when(k % 4 == 1, F.array().cast("array<int>")).when(k % 4 != 0, F.array(F.lit(1)))
    rows = t.photos.withColumn("faces", faces).withColumn("people", F.slice(F.array(F.lit(1), F.lit(2)), 1, (k % 3).cast("int"))).withColumn("sharpness", F.when(k % 6 != 1, F.lit(1.0)))
    return M.needs_backfill(rows).select("photo_id")


PLAN = "known AS (SELECT o_orderkey AS id, o_orderkey % 17 = 0 AS is_deleted FROM orders WHERE o_orderkey % 3 <> 0), source AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0)"


def known_source(t: Tables) -> tuple[DataFrame, DataFrame]:
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 17 == 0).alias("is_deleted"))
    return o.where("id % 3 <> 0"), o.where("id % 5 <> 0").select("id")


@query(f"WITH {PLAN} SELECT CASE WHEN k.id IS NULL THEN 'new' WHEN s.id IS NOT NULL AND is_deleted THEN 'excluded' WHEN s.id IS NULL AND NOT is_deleted THEN 'gone' ELSE 'kept' END AS status, count(*) AS n FROM source s FULL JOIN known k ON k.id = s.id GROUP BY 1")
def c12_sync_plan(t: Tables) -> DataFrame:
    known, source = known_source(t)
    return M.sync_plan(source, known).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {PLAN} SELECT count(*) FILTER (WHERE is_deleted) AS restore, count(*) FILTER (WHERE is_deleted IS NULL) AS \"new\", count(*) FILTER (WHERE NOT is_deleted) AS present FROM (SELECT id FROM source WHERE id % 2 = 0) LEFT JOIN known USING (id)")
def c13_picked_classification(t: Tables) -> DataFrame:
    known, source = known_source(t)
    return M.picked(source.where("id % 2 = 0"), known)


@query(f"WITH {PLAN} SELECT id FROM source WHERE id NOT IN (SELECT id FROM known)")
def c14_new_files_anti_join(t: Tables) -> DataFrame:
    known, source = known_source(t)
    return M.difference(source, known)


@query("""WITH RECURSIVE s AS (SELECT vec_id AS id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS h FROM embeddings),
up AS (SELECT id, h, row_number() OVER (ORDER BY id) AS k FROM s WHERE id % 3 = 0), ix AS (SELECT id, h, id % 4 = 1 AS is_deleted FROM s WHERE id % 3 <> 0),
hit AS (SELECT up.id AS upload, ix.id, bit_count(xor(up.h, ix.h)) AS dist, NOT is_deleted AS active FROM up JOIN ix ON bit_count(xor(up.h, ix.h)) <= 18),
turn AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(id BIGINT, h BIT)[]) AS added UNION ALL
  SELECT up.k, CASE WHEN up.id IN (SELECT upload FROM hit) OR len(list_filter(added, lambda a: bit_count(xor(a.h, up.h)) <= 18)) > 0 THEN added ELSE list_append(added, {'id': up.id, 'h': up.h}) END FROM turn JOIN up ON up.k = turn.k + 1),
fresh AS (SELECT a.id, a.h FROM (SELECT unnest(added) AS a FROM turn ORDER BY k DESC LIMIT (SELECT len(added) FROM turn ORDER BY k DESC LIMIT 1))),
met AS (SELECT * FROM hit UNION ALL SELECT up.id, f.id, bit_count(xor(up.h, f.h)), true FROM up JOIN fresh f ON f.id < up.id AND bit_count(xor(up.h, f.h)) <= 18),
best AS (SELECT upload, arg_min(id, (dist, active, id)) AS m, arg_min(active, (dist, active, id)) AS active FROM met WHERE upload NOT IN (SELECT id FROM fresh) GROUP BY upload)
SELECT up.id AS upload, m AS "match", CASE WHEN m IS NULL THEN 'add' WHEN NOT active AND up.id = min(up.id) OVER (PARTITION BY m) THEN 'restore' ELSE 'skip' END AS action FROM up LEFT JOIN best ON upload = up.id""")
def c15_upload_dedup_nearest(t: Tables) -> DataFrame:
    from shoal.functions.vectors import sign_hash

    h = t.vectors.select(F.col("vec_id").alias("id"), sign_hash("v").alias("h"))
    return M.upload_dedup(h.where("id % 3 = 0"), h.where("id % 3 <> 0").withColumn("is_deleted", F.col("id") % 4 == 1), 18)


@query(f"WITH {TRACK}, c AS (SELECT event_id, CASE WHEN lat IS NOT NULL THEN CAST(trunc(lat * 100) AS INT) || '_' || CAST(trunc(lon * 100) AS INT) END AS cell FROM track) SELECT event_id, cell, CASE WHEN length(cell) % 2 = 0 THEN 'town ' || cell END AS place FROM c WHERE cell IS NOT NULL")
def c16_geocode_by_cell(t: Tables) -> DataFrame:
    rows = track(t).where("lat is not null").drop("place")
    cells = M.pending_cells(rows, t.spark.createDataFrame([], "cell string, place string"))
    resolved = cells.select("cell", F.when(F.length("cell") % 2 == 0, F.concat(F.lit("town "), F.col("cell"))).alias("place"))
    return M.geocode_cells(rows, resolved).select("event_id", "cell", "place")


GAZETTEER = "gaz AS (SELECT s_suppkey AS gid, s_name AS city, CASE WHEN s_suppkey % 2 = 0 THEN 'S' || s_nationkey ELSE '' END AS state, 'C' || s_nationkey AS cc, ((s_suppkey * 71) % 1700) / 10.0 - 85 AS glat, ((s_suppkey * 113) % 3590) / 10.0 - 179.5 AS glon FROM supplier)"


@query("WITH " + GAZETTEER + """, p AS (SELECT c_custkey AS id, ((c_custkey * 37) % 1700) / 10.0 - 84.97 AS lat, ((c_custkey * 53) % 3590) / 10.0 - 179.53 AS lon FROM customer),
d AS (SELECT id, gid, city, state, cc, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(glat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(glat)) * pow(sin(radians(glon - lon) / 2), 2)))) AS km FROM p, gaz)
SELECT id, arg_min(concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(cc, '')), (km, gid)) AS place, round(min(km), 4) AS km FROM d GROUP BY id""")
def c17_reverse_geocode_nearest(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    gaz = t.read("supplier").select(k.alias("gid"), F.col("s_name").alias("city"), F.when(k % 2 == 0, F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).otherwise("").alias("state"), F.concat(F.lit("C"), F.col("s_nationkey").cast("string")).alias("cc"),
                                    (k * 71 % 1700 / 10 - 85).alias("glat"), (k * 113 % 3590 / 10 - 179.5).alias("glon"))
    c = F.col("c_custkey")
    points = t.read("customer").select(c.alias("id"), (c * 37 % 1700 / 10 - 84.97).alias("lat"), (c * 53 % 3590 / 10 - 179.53).alias("lon"))
    return M.nearest_place(points, gaz).select("id", "place", F.round("km", 4).alias("km"))


GROUPED = PH + ", g AS (SELECT owner AS gid, photo_id, ts, is_deleted FROM photos)"


def grouped(t: Tables) -> DataFrame:
    return t.photos.select(F.col("owner").alias("gid"), "photo_id", "ts", "is_deleted")


@query(GROUPED + " SELECT photo_id, greatest(1, count(*) FILTER (WHERE NOT is_deleted) OVER (PARTITION BY gid)) AS dup_count FROM g")
def d6_dup_group_size(t: Tables) -> DataFrame:
    return M.group_sizes(grouped(t))


@query(GROUPED + " SELECT CAST(sum(n - 1) AS BIGINT) AS removable FROM (SELECT count(*) AS n FROM g GROUP BY gid)")
def d27_removable_duplicates(t: Tables) -> DataFrame:
    return M.removable(grouped(t))


MEMBERS = "members AS (SELECT l_suppkey AS folder, l_orderkey AS photo_id, max(l_linenumber * 1000000 + l_orderkey) AS pos FROM lineitem GROUP BY ALL)"


def members(t: Tables) -> DataFrame:
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("folder"), F.col("l_orderkey").alias("photo_id")).agg(F.max(F.col("l_linenumber") * 1_000_000 + F.col("l_orderkey")).alias("pos"))


@query(PH + f", {MEMBERS} SELECT m.folder, count(p.photo_id) AS \"count\", arg_max(p.photo_id, pos) FILTER (WHERE p.photo_id IS NOT NULL) AS cover FROM members m LEFT JOIN photos p ON p.photo_id = m.photo_id AND NOT is_deleted GROUP BY m.folder")
def d28_folder_counts_and_cover(t: Tables) -> DataFrame:
    return M.folder_summary(members(t), t.photos)


@query(GROUPED + " SELECT photo_id, row_number() OVER (PARTITION BY gid ORDER BY ts DESC NULLS LAST, photo_id) > 1 AS is_deleted FROM g")
def e5_keep_newest(t: Tables) -> DataFrame:
    return M.keep_newest(grouped(t))


@query(GROUPED + " SELECT gid, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, string_agg(CAST(photo_id AS VARCHAR), ',' ORDER BY ts, photo_id) AS members FROM g WHERE NOT is_deleted GROUP BY gid HAVING count(*) > 1")
def e6_duplicate_groups(t: Tables) -> DataFrame:
    return M.duplicate_groups(grouped(t)).select("gid", "n", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "members")


@query("SELECT o_orderkey AS id, 'old' AS path FROM orders UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_name), c_name FROM customer")
def g1_append_rows(t: Tables) -> DataFrame:
    base = t.read("orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("path"))
    return M.append_rows(base, t.read("customer").select(F.col("c_name").alias("path")), "path")


@query(f"WITH {FEED} SELECT id FROM after EXCEPT SELECT id FROM before")
def g2_set_difference(t: Tables) -> DataFrame:
    before, after = snapshots(t)
    return M.difference(after, before)


@query("WITH p AS (SELECT l_orderkey AS photo_id, list_distinct(list(l_suppkey)) AS have FROM lineitem GROUP BY 1) SELECT photo_id, list_has_any(have, [3, 5, 7]) AS overlap, list_has_all(have, [3, 5]) AS subset FROM p")
def g3_set_intersection_test(t: Tables) -> DataFrame:
    have = t.photo_people.groupBy("photo_id").agg(F.collect_set("person_id").alias("have"))
    rows = have.withColumn("any", F.array(*[F.lit(x).cast("long") for x in (3, 5, 7)])).withColumn("all", F.array(*[F.lit(x).cast("long") for x in (3, 5)]))
    return rows.select("photo_id", M.set_tests("any", "have")[0].alias("overlap"), M.set_tests("all", "have")[1].alias("subset"))


@query(f"WITH {MEMBERS}, u AS (SELECT folder, photo_id FROM members UNION SELECT folder, photo_id + 1 FROM members WHERE photo_id % 50 = 0) SELECT folder, photo_id FROM u WHERE (folder, photo_id) NOT IN (SELECT folder, photo_id FROM members WHERE photo_id % 9 = 4)")
def g4_membership_union_minus(t: Tables) -> DataFrame:
    m = members(t)
    more = M.add_members(m, m.where("photo_id % 50 = 0").select("folder", (F.col("photo_id") + 1).alias("photo_id")))
    return M.remove_members(more, m.where("photo_id % 9 = 4").select("folder", "photo_id"))


#: Edits of all kinds, made of the events.
EDITS = """said AS (SELECT event_id AS seq, event_id % 29 AS k, user_id AS u, event_id * 7 % 211 AS photo FROM events), every AS (SELECT seq,
  CASE WHEN k < 6 THEN 'rename' WHEN k = 6 THEN 'hide' WHEN k < 9 THEN 'merge' WHEN k = 9 THEN 'unmerge' WHEN k < 12 THEN 'alias' WHEN k < 14 THEN 'create_folder' WHEN k = 14 THEN 'smart_folder' WHEN k = 15 THEN 'rename_folder'
    WHEN k = 16 THEN CASE WHEN u % 31 > 24 THEN 'delete_folder' ELSE 'other' END WHEN k < 21 THEN 'add_to_folder' WHEN k = 21 THEN 'remove_from_folder' WHEN k < 24 THEN 'delete' WHEN k = 24 THEN 'restore' WHEN k = 25 THEN 'prune' WHEN k < 28 THEN 'keep' ELSE 'not_duplicate' END AS op,
  CASE WHEN k < 10 THEN u WHEN k < 12 THEN NULL WHEN k < 22 THEN u % 31 WHEN k < 26 THEN photo ELSE photo - photo % 4 END AS id,
  CASE WHEN k < 10 THEN u * 7 % 150 WHEN k BETWEEN 17 AND 21 THEN photo WHEN k = 26 THEN photo END AS member, CASE WHEN k BETWEEN 10 AND 11 THEN 'place ' || (u % 20) END AS name,
  CASE WHEN k = 16 THEN CASE WHEN seq % 2 = 0 THEN 'photos' END WHEN seq % 5 = 0 THEN ' ' ELSE 'v' || seq END AS text FROM said), edits AS (SELECT * FROM every WHERE NOT (op = 'merge' AND id = member))"""


@query(f"""WITH RECURSIVE {EDITS},
named AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM edits WHERE op IN ('rename', 'hide', 'merge')),
turn AS (SELECT CAST(0 AS BIGINT) AS k, MAP([CAST(-1 AS BIGINT)], ['']) AS held UNION ALL
  SELECT n.k, map_concat(held, CASE n.op WHEN 'rename' THEN MAP([n.id], [trim(n.text)]) WHEN 'hide' THEN MAP([n.id], [''])
    ELSE CASE WHEN n.id <> n.member AND coalesce(held[n.id], '') <> '' AND coalesce(held[n.member], '') = '' THEN MAP([n.member, n.id], [held[n.id], '']) ELSE MAP([n.id], ['']) END END) FROM turn JOIN named n ON n.k = turn.k + 1),
names AS (SELECT unnest(map_keys(held)) AS id, unnest(map_values(held)) AS v FROM turn WHERE k = (SELECT max(k) FROM turn)),
lives AS (SELECT c.id AS folder, c.made, d.ended, d.photos FROM (SELECT id, min(seq) AS made FROM edits WHERE op = 'create_folder' GROUP BY id) c
  LEFT JOIN (SELECT x.id, min(x.seq) AS ended, arg_min(text IS NOT NULL, x.seq) AS photos FROM edits x WHERE op = 'delete_folder' AND x.seq > (SELECT min(seq) FROM edits m WHERE m.op = 'create_folder' AND m.id = x.id) GROUP BY x.id) d ON d.id = c.id),
live AS (SELECT e.*, l.* FROM edits e JOIN lives l ON l.folder = e.id WHERE op IN ('create_folder', 'rename_folder', 'smart_folder', 'add_to_folder', 'remove_from_folder') AND seq >= made AND (ended IS NULL OR seq < ended)),
pairs AS (SELECT folder, member AS photo, arg_max(op, seq) AS op, max(seq) AS added, any_value(ended) AS ended, any_value(photos) AS photos FROM live WHERE op IN ('add_to_folder', 'remove_from_folder') GROUP BY folder, member),
held AS (SELECT * FROM pairs p WHERE op = 'add_to_folder' AND NOT EXISTS (SELECT 1 FROM edits e WHERE e.op = 'prune' AND e.id = p.photo AND e.seq > p.added AND (p.ended IS NULL OR e.seq < p.ended))),
groups AS (SELECT photo - photo % 4 AS rep, photo FROM (SELECT unnest(range(211)) AS photo)),
writes AS (SELECT seq, id AS photo, op <> 'restore' AS gone FROM edits WHERE op IN ('delete', 'restore', 'prune') UNION ALL SELECT ended, photo, true FROM held WHERE photos
  UNION ALL SELECT e.seq, g.photo, true FROM edits e JOIN groups g ON g.rep = e.id WHERE e.op = 'keep' AND e.member IS DISTINCT FROM g.photo)
SELECT 'person name' AS entity, CAST(id AS VARCHAR) AS key, v AS value FROM names WHERE v <> ''
UNION ALL SELECT 'person hidden', CAST(id AS VARCHAR), NULL FROM (SELECT id, arg_max(op, seq) AS op FROM edits WHERE op IN ('hide', 'merge') GROUP BY id) WHERE op = 'hide'
UNION ALL SELECT 'person merged', CAST(id AS VARCHAR), CAST(member AS VARCHAR) FROM (SELECT id, arg_max(op, seq) AS op, arg_max(member, seq) AS member FROM edits WHERE op IN ('merge', 'unmerge') GROUP BY id) WHERE op = 'merge'
UNION ALL SELECT 'alias', name, v FROM (SELECT name, arg_max(trim(text), seq) AS v FROM edits WHERE op = 'alias' GROUP BY name) WHERE v <> ''
UNION ALL SELECT 'folder name', CAST(folder AS VARCHAR), (SELECT arg_max(trim(text), seq) FROM live v WHERE v.folder = l.folder AND op IN ('create_folder', 'rename_folder') AND trim(text) <> '') FROM lives l WHERE ended IS NULL
UNION ALL SELECT 'folder query', CAST(folder AS VARCHAR), q FROM (SELECT folder, arg_max(trim(text), seq) AS q FROM live WHERE op = 'smart_folder' AND ended IS NULL GROUP BY folder) WHERE q <> ''
UNION ALL SELECT 'member', CAST(folder AS VARCHAR), CAST(photo AS VARCHAR) FROM held WHERE ended IS NULL
UNION ALL SELECT 'photo deleted', CAST(photo AS VARCHAR), NULL FROM (SELECT photo, arg_max(gone, seq) AS gone FROM writes GROUP BY photo) WHERE gone
UNION ALL SELECT 'not duplicate', CAST(g.photo AS VARCHAR), NULL FROM groups g WHERE g.rep IN (SELECT id FROM edits WHERE op = 'not_duplicate')""")
def i17_edit_log_fold(t: Tables) -> DataFrame:
    from shoal.operators.edits import fold

    t.events.createOrReplaceTempView("shoal_events")
    edits = t.spark.sql(f"WITH {EDITS} SELECT * FROM edits".replace("FROM events", "FROM shoal_events"))
    photos = t.events.select((F.col("event_id") * 7 % 211).alias("photo_id")).distinct()
    out = fold(edits, photos.select((F.col("photo_id") - F.col("photo_id") % 4).alias("rep"), "photo_id"))
    said = lambda df, entity, key, value=None: df.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), (F.col(value).cast("string") if value else F.lit(None).cast("string")).alias("value"))
    parts = [said(out.persons.where("name is not null"), "person name", "person_id", "name"), said(out.persons.where("hidden"), "person hidden", "person_id"), said(out.persons.where("merged_into is not null"), "person merged", "person_id", "merged_into"),
             said(out.aliases, "alias", "place", "alias"), said(out.folders, "folder name", "folder", "name"), said(out.folders.where("query is not null"), "folder query", "folder", "query"), said(out.members, "member", "folder", "photo_id"),
             said(out.photos.where("is_deleted"), "photo deleted", "photo_id"), said(out.not_duplicate, "not duplicate", "photo_id")]
    return reduce(DataFrame.unionByName, parts)


@query(PH + " SELECT photo_id, CASE WHEN photo_id % 4 = 0 AND photo_id % 8 <> 0 THEN 'moved' ELSE place END AS place, CASE WHEN photo_id % 4 = 0 AND photo_id % 3 <> 0 THEN 9.5 ELSE duration END AS duration, (photo_id % 4 = 0 AND photo_id % 8 <> 0) OR (photo_id % 4 = 0 AND photo_id % 3 <> 0 AND duration <> 9.5) AS changed FROM photos")
def i18_backfill_patch(t: Tables) -> DataFrame:
    k = F.col("photo_id")
    changes = t.photos.where(k % 4 == 0).select("photo_id", F.when(k % 8 != 0, "moved").alias("place"), F.when(k % 3 != 0, F.lit(9.5)).alias("duration"))
    return M.patch(t.photos.select("photo_id", "place", "duration"), changes, "photo_id")


@query("SELECT event_id, round((user_id % 90 + (event_id % 60) / 60.0 + value / 3600) * CASE WHEN event_type IN ('click', 'view') THEN -1 ELSE 1 END, 6) AS degrees FROM events")
def h13_gps_to_decimal(t: Tables) -> DataFrame:
    ref = F.when(F.col("event_type") == "click", "s").when(F.col("event_type") == "view", "W").otherwise("N")
    return t.events.select("event_id", F.round(M.gps_decimal(F.col("user_id") % 90, F.col("event_id") % 60, F.col("value"), ref), 6).alias("degrees"))


@query("SELECT page_id, regexp_replace(url, '^https?://', '') AS relative, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.*?)([.][^./]*)?$', 1) AS stem, trim(regexp_replace(url, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS title FROM pages")
def h24_path_and_name_cleanup(t: Tables) -> DataFrame:
    rows = t.read("pages").withColumn("path", F.regexp_replace("url", "^https?://", "/root/"))
    return rows.select("page_id", M.relative_path("path", "/root").alias("relative"), M.stem("url").alias("stem"), M.title("url").alias("title"))


@query("SELECT event_id, json_extract_string(body, '$.created') AS created, CASE WHEN event_id % 3 <> 1 AND event_id % 5 <> 0 THEN value END AS lat, CASE WHEN event_id % 3 <> 1 AND event_id % 5 <> 0 THEN 7.25 END AS lon FROM (SELECT event_id, value, '{\"created\": \"day ' || user_id || '\"}' AS body FROM events)")
def h25_json_field_get(t: Tables) -> DataFrame:
    lat = F.when(F.col("event_id") % 5 == 0, F.lit('"bad"')).otherwise(F.col("value").cast("string"))
    lon = F.when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.lit(', "lon": 7.25'))
    body = F.concat(F.lit('{"created": "day '), F.col("user_id").cast("string"), F.lit('", "lat": '), lat, lon, F.lit("}"))
    return t.events.select("event_id", body.alias("body")).select("event_id", M.json_fields("body").alias("f")).select("event_id", "f.created", "f.lat", "f.lon")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 3")
def h11_parse_iso(t: Tables) -> DataFrame:
    from shoal.functions.text import naive_iso

    k, base = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, base).when(k == 1, F.concat(base, F.lit("Z"))).when(k == 2, F.concat(base, F.lit("+05:30"))).otherwise(F.concat(F.lit("on "), base))
    return t.events.select("event_id", F.date_format(naive_iso(said), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("WITH ok AS (SELECT user_id, max(event_id) AS ok FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id AS item, count(*) AS attempts FROM events e LEFT JOIN ok USING (user_id) WHERE event_type = 'error' AND event_id > coalesce(ok, -1) GROUP BY 1")
def j5_failure_ledger(t: Tables) -> DataFrame:
    """The ledger as a stream, item by item; maintain.open_failures is its batch form."""
    from shoal.sources.tables import scratch
    from shoal.streaming import incremental as R
    from shoal.streaming import stateful as W

    path = scratch(t.spark, "failures")
    kind: Column = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").otherwise("cancelled")
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/event[s].parquet")
    outcomes = events.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), kind.alias("outcome"))
    R.each_batch(W.failure_ledger(outcomes), R.appended(path), f"{path}-at").awaitTermination()
    return R.latest(t.spark.read.parquet(path), "item").where("attempts > 0").select("item", "attempts")


@query("SELECT event_id FROM events WHERE event_id % 3 = user_id % 3")
def j7_epoch_guard(t: Tables) -> DataFrame:
    matches = t.events.select("event_id", F.col("user_id").alias("proto"), (F.col("event_id") % 3).alias("epoch"))
    current = t.events.select(F.col("user_id").alias("proto"), (F.col("user_id") % 3).alias("epoch")).distinct()
    return M.matched_epoch(matches, current).select("event_id")
