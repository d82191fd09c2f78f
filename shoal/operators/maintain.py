"""Keeping an index in step with its source: plans, patches, folders, edits, geocoding."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.operators.hamming import first_come, near_hashes
from shoal.operators.timeline import cell
from shoal.sources.shared import checkpointed

#: Of nearest_place: places a task puts into cubes, points a task looks up, and places of a cube's list on average, at most.
SPREAD, POINTS, PLACES = 16_384, 65_536, 1024


def needs_index(source: DataFrame, index: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """Source rows not in the index that have failed fewer than `most` times."""
    return source.join(index.select("id"), "id", "left_anti").join(failures.select("id", "attempts"), "id", "left").where(F.coalesce("attempts", F.lit(0)) < most).select(*source.columns)


def needs_backfill(photos: DataFrame) -> DataFrame:
    """Active rows without sharpness, or with people but faces never looked at (null; an empty list means done)."""
    return photos.where(~F.col("is_deleted") & ((F.col("faces").isNull() & (F.size("people") > 0)) | F.col("sharpness").isNull()))


def sync_plan(source: DataFrame, known: DataFrame, full_access: bool = True) -> DataFrame:
    """(id, status): new, gone (only with full access), excluded (deleted here, still in the source) or kept."""
    both = source.select("id", F.lit(True).alias("s")).join(known.select("id", "is_deleted", F.lit(True).alias("k")), "id", "full_outer")
    status = (F.when(F.col("k").isNull(), "new").when(F.col("s").isNotNull() & F.col("is_deleted"), "excluded")
              .when(F.col("s").isNull() & ~F.col("is_deleted") & F.lit(full_access), "gone").otherwise("kept"))
    return both.select("id", status.alias("status"))


def picked(items: DataFrame, known: DataFrame) -> DataFrame:
    """(restore, new, present): counts of picked ids by what the index holds."""
    met = items.select("id").distinct().join(known.select("id", "is_deleted"), "id", "left")
    return met.agg(F.count_if("is_deleted").alias("restore"), F.count_if(F.col("is_deleted").isNull()).alias("new"), F.count_if(~F.col("is_deleted")).alias("present"))


def upload_dedup(uploads: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """(upload, match, action) for each of the uploads (id, h), which come in the order of their ids, against the index (id, h, is_deleted).

    An upload is added if nothing within `most` bits is in the index or was added before it
    in the batch. Others are skipped for the nearest match: at equal distance a deleted row
    comes first (by the state before the batch), then the least id. A deleted match is
    restored by its first upload. Uploads without a hash are added.
    """
    hashed = uploads.where("h is not null").select(F.col("id").alias("upload"), "h")
    # One row of each hash stands for the index: a deleted one if there is one, of the least id.
    held = index.where("h is not null").groupBy(F.col("h").alias("g")).agg(F.min(F.struct((~F.col("is_deleted")).alias("active"), "id")).alias("of"))
    near = near_hashes(hashed, most, held).join(held, "g")
    best = checkpointed(near.groupBy("h").agg(F.min(F.struct("dist", "of.active", "of.id")).alias("best")))
    fresh = hashed.join(best, "h", "left_anti").select(F.col("upload").alias("id"), "h")
    added = checkpointed(first_come(fresh, most).join(fresh, "id"))
    mine = near_hashes(hashed, most, added.select(F.col("h").alias("g"))).join(added.select(F.col("id"), F.col("h").alias("g")), "g")
    inside = hashed.join(mine, "h").where("id < upload").select("upload", F.struct("dist", F.lit(True).alias("active"), "id").alias("best"))
    found = hashed.join(best, "h").select("upload", "best").unionByName(inside).join(added.select(F.col("id").alias("upload")), "upload", "left_anti")
    found = found.groupBy("upload").agg(F.min("best").alias("best")).select("upload", F.col("best.id").alias("match"), F.col("best.active").alias("active"))
    first = found.where("not active").groupBy("match").agg(F.min("upload").alias("first"))
    acted = found.join(first, "match", "left").select("upload", "match", F.when(~F.col("active") & (F.col("upload") == F.col("first")), "restore").otherwise("skip").alias("action"))
    return uploads.select(F.col("id").alias("upload")).join(acted, "upload", "left").select("upload", "match", F.coalesce("action", F.lit("add")).alias("action"))


def geocode_cells(photos: DataFrame, resolved: DataFrame, by: int = 100) -> DataFrame:
    """Photos with the place of their cell, from one lookup (cell, place; place may be null) a cell."""
    return photos.withColumn("cell", cell("lat", "lon", by)).join(resolved, "cell", "left")


def pending_cells(photos: DataFrame, resolved: DataFrame, by: int = 100) -> DataFrame:
    """(cell, waiting): cells of located photos that no lookup has answered, and how many photos wait."""
    rows = photos.where("lat is not null and lon is not null").withColumn("cell", cell("lat", "lon", by))
    return rows.join(resolved.select("cell"), "cell", "left_anti").groupBy("cell").agg(F.count("*").alias("waiting"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def nearest_place(points: DataFrame, gazetteer: DataFrame, chord: float | None = None) -> DataFrame:
    """C17: (id, place, km): the nearest gazetteer row (gid, city, state, cc, glat, glon) of each located point (id, lat, lon).

    The sphere lies in a grid of cubes, so poles and the date line are like any other place.
    A point meets the places of its own and the cubes around; one whose nearest lies further
    off than a cube is wide takes another round with cubes twice as wide. The first are as
    wide as the room that the gazetteer has for a place (of radius 1). Places, not points,
    go to the cubes around and wait there in bounded lists, so no row is made for a pair,
    and tasks that make rows get bounded shares.
    """
    name = F.concat_ws(", ", *[F.nullif(F.trim(c), F.lit("")) for c in ("city", "state", "cc")])
    places = gazetteer.where("glat is not null and glon is not null").select("gid", name.alias("place"), "glat", "glon")
    rest = points.where("lat is not null and lon is not null").select("id", "lat", "lon")
    n = places.count()
    chord = chord or min(2.0, (4 * math.pi / max(1, n)) ** 0.5)
    places, rest = places.repartition(max(1, -(-n // SPREAD))), rest.repartition(max(1, -(-rest.count() // POINTS)))
    found = None
    while True:
        best = nearest_in_cubes(rest, places, chord, found is not None)
        if chord < 2:  # a place beyond the cubes around is a cube's width away at least
            best = checkpointed(best.where(F.col("km") <= 2 * 6371.0 * math.asin(chord / 2) * (1 - 1e-9)))
        found = best if found is None else found.unionByName(best)
        if chord >= 2:
            return found
        rest = checkpointed(rest.join(best.select("id"), "id", "left_anti"))
        if rest.isEmpty():
            return found
        chord = min(2.0, 2 * chord)


def nearest_in_cubes(points: DataFrame, places: DataFrame, chord: float, few: bool) -> DataFrame:
    """(id, place, km): the nearest place (gid, place, glat, glon) to a point (id, lat, lon) of those in its cube and the cubes around. Only cubes of points get lists where points are few."""
    cube = lambda lat, lon: [F.floor(c / chord) for c in (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))]
    around = F.array(*[F.array(*map(F.lit, step)) for step in itertools.product((-1, 0, 1), repeat=3)])
    own = places.withColumn("_own", F.array(*cube("glat", "glon")))
    fullest = own.groupBy("_own").count().agg(F.max("count")).first()[0] or 0
    # Cubes with one hash share their lists, which are places somewhat further off.
    there = own.withColumn("_step", F.explode(around)).select("gid", "place", "glat", "glon", F.xxhash64(*[F.col("_own")[k] + F.col("_step")[k] for k in range(3)]).alias("cell"))
    asked = points.withColumn("cell", F.xxhash64(*cube("lat", "lon")))
    if few:
        there = there.join(asked.select("cell").distinct(), "cell", "left_semi")
    parts = max(1, -(-27 * fullest // PLACES))
    lists = there.groupBy("cell", *([F.pmod(F.xxhash64("gid"), F.lit(parts)).alias("part")] if parts > 1 else [])).agg(F.collect_list(F.struct("gid", "place", "glat", "glon")).alias("places"))
    km = lambda p: haversine(F.col("lat"), F.col("lon"), p["glat"], p["glon"])
    least = F.array_min(F.transform("places", lambda p: F.struct(km(p).alias("km"), p["gid"].alias("gid"), p["place"].alias("place"))))
    # A merge join: the plan knows nothing of the 27 cubes and would broadcast the lists.
    return asked.join(lists.hint("merge"), "cell").select("id", least.alias("b")).groupBy("id").agg(F.min("b").alias("b")).select("id", "b.place", "b.km")


def folder_summary(members: DataFrame, photos: DataFrame) -> DataFrame:
    """(folder, count, cover) of members (folder, photo_id, pos): active ones, the last as cover; 0 and null without any."""
    live = members.join(photos.where(~F.col("is_deleted")).select("photo_id"), "photo_id")
    found = live.groupBy("folder").agg(F.count("*").alias("n"), F.max_by("photo_id", "pos").alias("cover"))
    return members.select("folder").distinct().join(found, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("count"), "cover")


def keep_newest(groups: DataFrame) -> DataFrame:
    """E5: (photo_id, is_deleted) of grouped photos (gid, photo_id, ts): all but the newest of a group (ties to the least id) go. The newest are found task by task and joined, so large groups stay split; rows without a group are one group."""
    w = Window.partitionBy("gid").orderBy(F.desc_nulls_last("ts"), "photo_id")
    newest = groups.select("gid", F.col("photo_id").alias("newest"), F.row_number().over(w).alias("_r")).where("_r = 1")  # each task sends one row a group
    both = groups.alias("g").join(newest.alias("n"), F.col("g.gid").eqNullSafe(F.col("n.gid")))
    return both.select("g.photo_id", (F.col("g.photo_id") != F.col("newest")).alias("is_deleted"))


def duplicate_groups(groups: DataFrame) -> DataFrame:
    """(gid, n, first, members) of groups of at least two active photos, members oldest first, joined by commas."""
    listed = F.array_sort(F.collect_list(F.struct("ts", "photo_id")))
    found = groups.where(~F.col("is_deleted")).groupBy("gid").agg(listed.alias("m")).where(F.size("m") > 1)
    return found.select("gid", F.size("m").alias("n"), F.col("m")[0]["ts"].alias("first"), F.array_join(F.transform("m", lambda s: s["photo_id"].cast("string")), ",").alias("members")).orderBy(F.desc("first"), "gid")


def group_sizes(groups: DataFrame) -> DataFrame:
    """(photo_id, dup_count): active members of the photo's group, 1 at least. Counted by group and joined, so large groups stay split."""
    n = groups.groupBy("gid").agg(F.count_if(~F.col("is_deleted")).alias("n"))
    return groups.join(n, "gid").select("photo_id", F.greatest(F.lit(1).cast("long"), "n").alias("dup_count"))


def removable(groups: DataFrame) -> DataFrame:
    """(removable,): rows that could go if each group kept one."""
    return groups.groupBy("gid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removable"))


def append_rows(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """G1: base and new rows, new ids going on from the largest in the order of a column.

    New rows are range-partitioned; an id is the rows in the partitions before and the place within.
    """
    largest = base.agg(F.max("id")).first()[0]
    start = 0 if largest is None else largest + 1
    # Written once: a plan that is run anew with fewer columns may be cut into other partitions, and its counts then fit no row.
    part = checkpointed(new.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()))
    counts = part.groupBy(F.shiftright("_m", 33).alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    placed = part.join(F.broadcast(before), F.shiftright("_m", 33) == F.col("_p"))  # a row a partition
    return base.unionByName(placed.withColumn("id", F.lit(start) + F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).select(*base.columns))


def difference(source: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct source ids that aren't known."""
    return source.select("id").distinct().join(known.select("id"), "id", "left_anti")


def set_tests(want: str, have: str) -> tuple[Column, Column]:
    """(any overlap, all wanted are there) of two array columns."""
    return F.arrays_overlap(want, have), F.size(F.array_except(want, have)) == 0


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members (folder, photo_id) with more of them, as a set."""
    return members.select("folder", "photo_id").union(new.select("folder", "photo_id")).distinct()


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without some."""
    return members.select("folder", "photo_id").join(gone, ["folder", "photo_id"], "left_anti").distinct()


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two snapshots: inserted or removed."""
    ins = after.select("id").join(before.select("id"), "id", "left_anti").select("id", F.lit("inserted").alias("change"))
    return ins.unionByName(before.select("id").join(after.select("id"), "id", "left_anti").select("id", F.lit("removed").alias("change")))


def patch(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base with the non-null columns of a patch over its own, and changed, whether a row differs now."""
    columns = [c for c in changes.columns if c != key]
    met = base.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns]), key, "left")
    same = F.lit(True)
    for c in columns:
        same = same & F.coalesce(f"_{c}", c).eqNullSafe(F.col(c))
    return met.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns if c != key], (~same).alias("changed"))


def matched_epoch(matches: DataFrame, current: DataFrame) -> DataFrame:
    """Matches (proto, epoch, ..) made on the numbering that holds now."""
    return matches.join(current.select("proto", "epoch"), ["proto", "epoch"], "left_semi")


def open_failures(outcomes: DataFrame) -> DataFrame:
    """(item, attempts): failures since the last success of an item, from (item, seq, outcome); cancelled ones don't count."""
    last = outcomes.where("outcome = 'success'").groupBy("item").agg(F.max("seq").alias("ok"))
    return outcomes.join(last, "item", "left").where((F.col("outcome") == "failure") & (F.col("seq") > F.coalesce("ok", F.lit(-1)))).groupBy("item").agg(F.count("*").alias("attempts"))


def gps_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Signed degrees; south and west are negative."""
    return (d + m / 60 + s / 3600) * F.when(F.upper(ref).isin("S", "W"), -1).otherwise(1)


def relative_path(path: str, root: str) -> Column:
    """A path below a root."""
    return F.regexp_replace(F.col(path), "^" + "".join("\\" + c if c in ".*+?()[]{}|^$\\" else c for c in root.rstrip("/")) + "/", "")


def stem(path: str) -> Column:
    return F.regexp_extract(F.col(path), "([^/]*?)(\\.[^./]*)?$", 1)


def title(name: str) -> Column:
    """Letters and digits of a name, what lies between them as one blank."""
    return F.trim(F.regexp_replace(F.col(name), "[^\\p{L}\\p{N}]+", " "))


def json_fields(body: str) -> Column:
    """Struct (created, lat, lon) of a JSON body; bad numbers are null, and a point needs both."""
    got = F.from_json(F.col(body), "created string, lat string, lon string")
    lat, lon = got["lat"].try_cast("double"), got["lon"].try_cast("double")
    both = lat.isNotNull() & lon.isNotNull()
    return F.struct(got["created"].alias("created"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"))
