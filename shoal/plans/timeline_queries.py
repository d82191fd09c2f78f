"""Queries of timelines and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.operators import timeline as L
from shoal.operators.search import active, newest_first
from shoal.plans.registry import query
from shoal.plans.search_queries import stamp
from shoal.sources.bindings import Tables, bound

PH = bound("photos")
#: Places of events: by user and a six-day step, the same arithmetic in both engines.
TRACK = """track AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN ((user_id * 37 + (day(ts) // 6) * 11) % 1700) / 10.0 - 85 END AS lat,
  CASE WHEN event_id % 7 <> 0 THEN ((user_id * 53 + (day(ts) // 6) * 7) % 3500) / 10.0 - 175 END AS lon, CASE WHEN event_id % 7 <> 0 THEN 'place ' || ((user_id + day(ts) // 6) % 5) END AS place FROM events)"""


def track(t: Tables) -> DataFrame:
    step, located = F.floor(F.dayofmonth("ts") / 6), F.col("event_id") % 7 != 0
    return t.events.select("event_id", "user_id", "ts", F.when(located, (F.col("user_id") * 37 + step * 11) % 1700 / 10 - 85).alias("lat"), F.when(located, (F.col("user_id") * 53 + step * 7) % 3500 / 10 - 175).alias("lon"),
                           F.when(located, F.concat(F.lit("place "), ((F.col("user_id") + step) % 5).cast("string"))).alias("place"))


@query(PH + ' SELECT place, count(*) AS "count", min(photo_id) AS cover FROM photos GROUP BY place HAVING count(*) >= 3')
def d3_location_counts(t: Tables) -> DataFrame:
    return L.location_counts(t.photos, 3)


@query(PH + ' SELECT year(ts) AS year, CASE WHEN grouping(month(ts)) = 0 THEN month(ts) END AS month, count(*) AS "count", arg_max(photo_id, (ts, -photo_id)) AS cover FROM photos GROUP BY GROUPING SETS ((year(ts)), (year(ts), month(ts)))')
def d4_year_month_summary(t: Tables) -> DataFrame:
    return L.year_month(t.photos)


@query(PH + ' SELECT day(ts) AS day, count(*) AS "count", arg_max(photo_id, (ts, -photo_id)) AS cover FROM photos WHERE year(ts) = 1997 AND month(ts) = 5 GROUP BY 1')
def d5_day_covers(t: Tables) -> DataFrame:
    return L.day_covers(t.photos, 1997, 5)


@query(PH + " SELECT place, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM photos WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY place")
def d12_place_centroid(t: Tables) -> DataFrame:
    return L.place_centroids(t.photos).select("place", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


HOME = "cells AS (SELECT user_id, CAST(trunc(lat * 10) AS INT) || '_' || CAST(trunc(lon * 10) AS INT) AS cell, count(*) AS n FROM track WHERE lat IS NOT NULL GROUP BY ALL), homes AS (SELECT user_id, min(cell) AS home FROM cells c WHERE n = (SELECT max(n) FROM cells d WHERE d.user_id = c.user_id) GROUP BY user_id)"


@query(f"WITH {TRACK}, {HOME} SELECT user_id, home FROM homes")
def d13_home_cell(t: Tables) -> DataFrame:
    return L.home_cells(track(t), "user_id")


@query(PH + ' , y AS (SELECT year(ts) AS year, count(*) AS n FROM photos WHERE is_video AND year(ts) % 2 = 1 GROUP BY 1) SELECT CAST(s.year AS INT) AS year, coalesce(n, 0) AS "count" FROM (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) FROM y) + 1)) AS year) s LEFT JOIN y ON y.year = s.year')
def d14_together_years(t: Tables) -> DataFrame:
    return L.years_between(t.photos.where("is_video and year(ts) % 2 = 1"))


@query(PH + ' SELECT place, count(*) AS "count" FROM photos GROUP BY place ORDER BY count(*) DESC, place LIMIT 8')
def d15_together_places(t: Tables) -> DataFrame:
    return L.top_places(t.photos)


@query("""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 129600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def e1_gap_sessions(t: Tables) -> DataFrame:
    return L.gap_sessions(t.events, "user_id", "ts", "event_id").select("event_id", "user_id", "session")


@query(f"""WITH {TRACK}, {HOME}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 129600000000 THEN 1 ELSE 0 END AS fresh FROM track WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session, CASE WHEN lat IS NOT NULL THEN CAST(trunc(lat * 10) AS INT) || '_' || CAST(trunc(lon * 10) AS INT) END AS cell FROM g),
f AS (SELECT user_id, session, min(ts) AS first, max(ts) AS last, count(*) AS n, count(cell) AS located, count(*) FILTER (WHERE cell <> home) AS away FROM s LEFT JOIN homes USING (user_id) GROUP BY user_id, session),
p AS (SELECT user_id, session, place, row_number() OVER (PARTITION BY user_id, session ORDER BY count(*) DESC, place) AS r FROM s WHERE place IS NOT NULL GROUP BY user_id, session, place)
SELECT f.user_id, f.session, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, n, coalesce(place, 'Trip') AS name FROM f LEFT JOIN p ON p.user_id = f.user_id AND p.session = f.session AND r = 1
WHERE n >= 8 AND epoch_us(last) - epoch_us(first) >= 86400000000 AND away * 2 > located""")
def e2_trips(t: Tables) -> DataFrame:
    return L.trips(track(t), "user_id", "ts", "event_id", "place").select("user_id", "session", stamp("first"), stamp("last"), "n", "name")


@query(bound("photos", "faces") + """, r AS (SELECT year(ts) AS year, photo_id, face_idx, coalesce(sharpness, 1) * sqrt(area) AS score, ts FROM photos LEFT JOIN (SELECT * FROM faces WHERE person_id = 3) f USING (photo_id) WHERE folder = 'F' AND device_id = '2-HIGH')
SELECT year, photo_id, CASE WHEN score IS NOT NULL THEN face_idx END AS face_idx, round(coalesce(score, 0), 4) AS score FROM r QUALIFY row_number() OVER (PARTITION BY year ORDER BY score DESC NULLS LAST, ts DESC, face_idx, photo_id) = 1""")
def e3_growth_timeline(t: Tables) -> DataFrame:
    return L.growth_timeline(t.photos.where("folder = 'F' and device_id = '2-HIGH'"), t.faces.where("person_id = 3")).withColumn("score", F.round("score", 4))


@query(PH + " SELECT photo_id, 2000 - year(ts) AS years_ago FROM photos WHERE NOT is_deleted AND month(ts) = 5 AND day(ts) = 28 AND year(ts) <> 2000")
def e8_on_this_day(t: Tables) -> DataFrame:
    return newest_first(L.on_this_day(active(t.photos), 2000, 5, 28)).select("photo_id", "years_ago")


@query(PH + """, h AS (SELECT folder AS reel, photo_id AS pos, duration, duration * (photo_id % 10) / 10 AS t FROM photos WHERE is_video), c AS (SELECT *, greatest(0.0, least(t - 2.5, duration - 0.5)) AS start FROM h), d AS (SELECT *, least(5.0, duration - start) AS length FROM c)
SELECT reel, pos, round(start, 6) AS start, round(length, 6) AS length, round(coalesce(sum(length) OVER (PARTITION BY reel ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS "offset" FROM d WHERE length > 0.1""")
def e9_reel_timeline(t: Tables) -> DataFrame:
    hits = t.photos.where("is_video").select(F.col("folder").alias("reel"), F.col("photo_id").alias("pos"), "duration", (F.col("duration") * (F.col("photo_id") % 10) / 10).alias("t"))
    return L.reel(hits).select("reel", "pos", F.round("start", 6).alias("start"), F.round("length", 6).alias("length"), F.round("offset", 3).alias("offset"))


@query(PH + " SELECT photo_id, CAST(lat IS NOT NULL AS INT) AS located, CASE WHEN lat IS NOT NULL THEN CAST(trunc(lat * 10) AS INT) || '_' || CAST(trunc(lon * 10) AS INT) END AS cell FROM photos")
def h14_grid_cell(t: Tables) -> DataFrame:
    located = F.col("lat").isNotNull()
    return t.photos.select("photo_id", located.cast("int").alias("located"), F.when(located, L.cell("lat", "lon", 10)).alias("cell"))


@query(PH + ", n AS (SELECT photo_id, duration, CAST(greatest(1, least(8, ceil(duration / 10))) AS INT) AS n FROM photos WHERE is_video) SELECT photo_id, i, round(duration * (i + 0.5) / n, 6) AS t FROM (SELECT *, CAST(unnest(range(n)) AS INT) AS i FROM n)")
def h22_frame_sample_times(t: Tables) -> DataFrame:
    return L.sample_times(t.photos.where("is_video")).select("photo_id", "i", F.round("t", 6).alias("t"))


@query(PH + " SELECT photo_id, CAST(floor(duration) AS INT) // 60 || ':' || printf('%02d', CAST(floor(duration) AS INT) % 60) AS length, strftime(ts, '%Y-%m') AS period FROM photos")
def h23_duration_and_period_text(t: Tables) -> DataFrame:
    s = F.floor("duration").cast("int")
    return t.photos.select("photo_id", F.format_string("%d:%02d", F.floor(s / 60).cast("int"), s % 60).alias("length"), F.date_format("ts", "yyyy-MM").alias("period"))


@query(PH + " SELECT photo_id, year(ts) AS year, month(ts) AS month, day(ts) AS day FROM photos")
def h12_date_parts(t: Tables) -> DataFrame:
    return t.photos.select("photo_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"))


@query(bound("photos", "aliases") + ' SELECT p.place, coalesce(nullif(alias, \'\'), p.place) AS display, count(*) AS "count" FROM photos p LEFT JOIN aliases a ON a.place = p.place GROUP BY ALL')
def c19_place_alias_join(t: Tables) -> DataFrame:
    listed = t.photos.groupBy("place").agg(F.count("*").alias("count"))
    return listed.join(t.aliases, "place", "left").select("place", F.coalesce(F.nullif("alias", F.lit("")), "place").alias("display"), "count")
