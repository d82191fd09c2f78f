"""Timelines: buckets, covers, gap sessions, trips, on this day, best face a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cell(lat: str, lon: str, by: int) -> F.Column:
    """Grid cell of a point, truncated toward zero."""
    return F.concat_ws("_", (F.col(lat) * by).cast("int").cast("string"), (F.col(lon) * by).cast("int").cast("string"))


def location_counts(photos: DataFrame, least: int = 1) -> DataFrame:
    """D3: (place, count, cover): photos a place, the first photo as cover."""
    return photos.where(F.col("place").isNotNull()).groupBy("place").agg(F.count("*").alias("count"), F.min("photo_id").alias("cover")).where(F.col("count") >= least)


def year_month(photos: DataFrame) -> DataFrame:
    """(year, month, count, cover): years (month null) and months in one pass; the cover is the newest photo, ties to the smallest id."""
    rows = photos.where(F.col("ts").isNotNull()).select(F.year("ts").alias("year"), F.month("ts").alias("month"), "ts", "photo_id")
    return rows.groupingSets([["year"], ["year", "month"]], "year", "month").agg(F.count("*").alias("count"), F.max_by("photo_id", F.struct("ts", -F.col("photo_id"))).alias("cover"))


def day_covers(photos: DataFrame, year: int, month: int) -> DataFrame:
    """(day, cover) of a month."""
    start = F.make_timestamp(F.lit(year), F.lit(month), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz")
    rows = photos.where((F.col("ts") >= start) & (F.col("ts") < F.add_months(start, 1).cast("timestamp_ntz")))
    return rows.groupBy(F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("count"), F.max_by("photo_id", F.struct("ts", -F.col("photo_id"))).alias("cover"))


def place_centroids(photos: DataFrame) -> DataFrame:
    """(place, lat, lon): means over located photos."""
    return photos.where("lat is not null and lon is not null").groupBy("place").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def home_cells(photos: DataFrame, owner: str, by: int = 10) -> DataFrame:
    """(owner, home): the commonest cell of dated, located photos, ties to the smallest name."""
    rows = photos.where("ts is not null and lat is not null and lon is not null").groupBy(owner, cell("lat", "lon", by).alias("cell")).agg(F.count("*").alias("n"))
    most = rows.groupBy(owner).agg(F.max("n").alias("n"))
    return rows.join(most, [owner, "n"]).groupBy(owner).agg(F.min("cell").alias("home"))


def years_between(photos: DataFrame) -> DataFrame:
    """(year, count) for every year from the first to the last, zeros included."""
    counts = photos.where("ts is not null").groupBy(F.year("ts").alias("year")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("count"))


def top_places(photos: DataFrame, limit: int = 8) -> DataFrame:
    """The places of most photos."""
    return photos.where("place is not null").groupBy("place").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "place").limit(limit)


def gap_sessions(rows: DataFrame, owner: str, ts: str, tie: str, hours: float = 36) -> DataFrame:
    """Rows with their session, a number within the owner: a new one starts when the gap is more than `hours`."""
    w = Window.partitionBy(owner).orderBy(ts, tie)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) > int(hours * 3_600_000_000)
    return rows.withColumn("_new", F.when(F.coalesce(gap, F.lit(False)), 1).otherwise(0)).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def trips(rows: DataFrame, owner: str, ts: str, tie: str, place: str, least: int = 8, hours: float = 36) -> DataFrame:
    """(owner, session, first, last, n, name): sessions of at least `least` rows and a whole day, most located rows of which lie away from home.

    The name is the commonest place (ties to the smaller), or Trip without one. Owners with
    fewer than `least` dated rows have none.
    """
    dated = rows.where(F.col(ts).isNotNull())
    dated = dated.join(dated.groupBy(owner).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(owner), owner, "left_semi")
    home = home_cells(dated.withColumn("ts", F.col(ts)), owner)
    at = gap_sessions(dated, owner, ts, tie, hours).join(home, owner, "left").withColumn("_cell", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), cell("lat", "lon", 10)))
    found = at.groupBy(owner, "session").agg(
        F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"), F.count("_cell").alias("located"), F.count_if(F.col("_cell") != F.col("home")).alias("away"))
    found = found.where((F.col("n") >= least) & (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp")) >= 86_400_000_000) & (F.col("away") * 2 > F.col("located")))
    named = at.where(F.col(place).isNotNull()).groupBy(owner, "session", place).agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy(owner, "session").orderBy(F.desc("c"), place))
    named = named.withColumn("_r", rank).where("_r = 1").select(owner, "session", F.col(place).alias("name"))
    return found.join(named, [owner, "session"], "left").select(owner, "session", "first", "last", "n", F.coalesce("name", F.lit("Trip")).alias("name"))


def growth_timeline(photos: DataFrame, faces: DataFrame) -> DataFrame:
    """(year, photo_id, face_idx, score): of one person's faces the best a year by sharpness (1 if unknown) times the root of the area.

    Ties keep the newest photo, then the lowest face. A year whose photos have no face
    data gives its latest photo with score 0 and no face.
    """
    rows = photos.join(faces, "photo_id", "left").withColumn("year", F.year("ts"))
    score = F.coalesce("sharpness", F.lit(1.0)) * F.sqrt("area")
    first = F.struct("score", "ts", -F.col("face_idx"), -F.col("photo_id"))  # a null score comes last
    best = rows.withColumn("score", score).groupBy("year").agg(F.max_by(F.struct("photo_id", "face_idx", "score"), first).alias("x")).select("year", "x.*")
    return best.select("year", "photo_id", F.when(F.col("score").isNotNull(), F.col("face_idx")).alias("face_idx"), F.coalesce("score", F.lit(0.0)).alias("score"))


def on_this_day(photos: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """Photos of the same month and day in other years, with years ago."""
    ts = F.col("ts")
    return photos.where((F.month(ts) == month) & (F.dayofmonth(ts) == day) & (F.year(ts) != year)).withColumn("years_ago", F.lit(year) - F.year(ts))


def reel(hits: DataFrame, clip: float = 5.0) -> DataFrame:
    """(reel, pos, start, length, offset): clips around times t in videos of a duration, in hit order; those of 0.1 s or less go."""
    start = F.greatest(F.lit(0.0), F.least(F.col("t") - clip / 2, F.col("duration") - 0.5))
    rows = hits.withColumn("start", start).withColumn("length", F.least(F.lit(clip), F.col("duration") - F.col("start"))).where("length > 0.1")
    before = F.sum("length").over(Window.partitionBy("reel").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("reel", "pos", "start", "length", F.coalesce(before, F.lit(0.0)).alias("offset"))


def sample_times(videos: DataFrame) -> DataFrame:
    """(photo_id, i, t): the times of 1 to 8 frames, one for ten seconds, in the middle of even parts."""
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.col("duration") / 10))).cast("int")
    return videos.withColumn("_n", n).select("photo_id", "duration", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i")).select("photo_id", "i", (F.col("duration") * (F.col("i") + 0.5) / F.col("_n")).alias("t"))
