"""Whole searches: a request of text and explicit filters on a library (I11), and a query taken apart into filters and a caption."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions import text as T
from shoal.functions.vectors import best_of
from shoal.operators import people as P
from shoal.operators import search as S
from shoal.operators.simjoin import composite
from shoal.sources.shared import checkpointed

Encode = Callable[[str], Sequence[float]]

#: Least similarity of a caption or a text, and of a photo that a folder is anchored on.
CAPTION_FLOOR, ANCHOR_FLOOR = 0.25, 0.55


class Library(NamedTuple):
    photos: DataFrame
    """(photo_id, ts, place, device_id, is_deleted)."""
    photo_people: DataFrame
    """(photo_id, person_id)."""
    persons: DataFrame
    """(person_id, name, merged_into)."""
    aliases: DataFrame
    """(place, alias)."""
    members: DataFrame
    """(folder, photo_id)."""
    groups: DataFrame
    """(photo_id, rep) of photos with duplicates."""
    vectors: DataFrame
    """(photo_id, v), and frames, a list of vectors, for videos."""


class Request(NamedTuple):
    q: str = ""
    names: Sequence[str] = ()
    caption: str = ""
    timestamp: str = ""
    location: str = ""
    device: str = ""
    folder: object = None
    limit: int = 200
    offset: int = 0


def interpreted(library: Library, request: Request) -> Request:
    """The request with what its text says, where no explicit value is given."""
    if not request.q.strip():
        return request
    spark = library.photos.sparkSession
    places = S.place_vocabulary(library.photos.where("place is not null").select("place").distinct(), library.aliases.where("alias is not null"))
    names = library.persons.where("trim(name) <> ''").select("name").distinct()
    said = S.parse_queries(spark.createDataFrame([(request.q,)], "q string"), names, places).first()
    return request._replace(names=request.names or (said["names"].split("|") if said["names"] else ()), caption=request.caption or said["caption"], timestamp=request.timestamp or said["timestamp"] or "",
                            location=request.location or said["location"] or "")


def representations(library: Library) -> Column:
    """All vectors of a photo: its own and its frames'."""
    own = F.array("v")
    return F.concat(own, F.coalesce("frames", F.array().cast("array<array<double>>"))) if "frames" in library.vectors.columns else own


def ranked_by(rows: DataFrame, library: Library, query: Sequence[float], floor: float) -> DataFrame:
    """Rows whose best representation is at least `floor` like a query vector, with that as score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.join(library.vectors, "photo_id").withColumn("score", best_of(representations(library), q)).where(F.col("score") >= floor).select(*rows.columns, "score")


def api_search(library: Library, request: Request, encode: Encode | None = None, floor: float = CAPTION_FLOOR) -> DataFrame:
    """A page of results (photo_id, urls, timestamp, place, score, people, dup_count, rank, total, pages) of a request.

    Free text gives names, place, time and caption where the request has none. Photos that
    aren't deleted are narrowed by device, folder, all names (an unknown one leaves none),
    time (an error if it isn't one) and place; a caption ranks by similarity and drops what
    is below the floor, else the newest come first. Each duplicate group shows its best
    photo, with the number of photos it stands for; the total counts what is left. What is
    found is written once, so that total and page don't run the search twice.
    """
    request = interpreted(library, request)
    canonical = P.resolve_aliases(library.persons)
    rows = S.active(library.photos)
    if request.device.strip():
        rows = S.of_device(rows, request.device)
    if request.folder is not None and str(request.folder).strip():
        rows = S.in_folder(rows, library.members.where(F.col("folder") == request.folder))
    names = [n for n in request.names if n.strip()]
    if names:
        asked = library.photos.sparkSession.createDataFrame([(n,) for n in set(names)], "name string")
        rows = S.in_folder(rows, P.photos_with_all_names(library.photo_people, canonical, P.resolve_names(library.persons, asked), len(set(names))))
    if request.timestamp.strip():
        rows = S.at_time(rows, request.timestamp)
    if request.location.strip():
        rows = S.place_contains(rows, library.aliases, request.location)
    rows = rows.select("photo_id", "ts", "place")
    if request.caption.strip() and encode is not None:
        rows, order = ranked_by(rows, library, encode(request.caption.strip()), floor), [F.desc("score"), F.col("photo_id")]
    else:
        rows, order = rows.withColumn("score", F.lit(0.0)), [F.desc_nulls_last("ts"), F.col("photo_id")]
    found = checkpointed(S.collapse(rows.join(library.groups, "photo_id", "left"), "rep", order))
    shown = S.page(found, order, request.offset, request.limit)
    counts = dup_counts(library.photos, library.groups, shown.select("photo_id"))
    named = canonical_names(library, canonical, shown.select("photo_id"))
    return S.payload(shown, named, counts, ["rank", "total", "pages"]).orderBy("rank")


def dup_counts(photos: DataFrame, groups: DataFrame, of: DataFrame) -> DataFrame:
    """(photo_id, dup_count): photos of the group that aren't deleted, whatever else is filtered; 1 without a group."""
    mine = groups.join(of, "photo_id", "left_semi").select("photo_id", "rep")
    live = groups.join(mine.select("rep").distinct(), "rep", "left_semi").join(S.active(photos).select("photo_id"), "photo_id", "left_semi")
    sizes = live.groupBy("rep").agg(F.count("*").alias("dup_count"))
    return mine.join(sizes, "rep", "left").select("photo_id", F.greatest(F.coalesce("dup_count", F.lit(1)), F.lit(1)).alias("dup_count"))


def canonical_names(library: Library, canonical: DataFrame, of: DataFrame) -> DataFrame:
    """(photo_id, name) of the people of some photos, by the names of those they are merged into."""
    held = P.canonical_photos(library.photo_people.join(of, "photo_id", "left_semi"), canonical)
    return held.join(library.persons.where("trim(name) <> ''").select("person_id", "name"), "person_id").select("photo_id", "name")


def structured(library: Library, query: str, folder: object = None) -> tuple[DataFrame, str]:
    """I10's first stage: (photos that a query's hard filters leave, the caption that is left of the query).

    Year, month with a year, places (any whose city or alias is a word of the query) and
    people (any whose name is) filter where they are found; what they and stop words don't
    use is the caption. A blank query leaves nothing.
    """
    q = query.strip().lower()
    spark = library.photos.sparkSession
    rows = S.active(library.photos)
    if not q:
        return rows.where("1 = 0"), ""
    if folder is not None:
        rows = S.in_folder(rows, library.members.where(F.col("folder") == folder))
    said = spark.range(1).select(T.year_of(F.lit(q)).alias("year"), T.month_year(F.lit(q)).alias("month")).first()
    if said["month"]:
        rows = S.at_time(rows, f"{said['month']['year']}-{said['month']['month']:02d}")
    elif said["year"]:
        rows = S.at_time(rows, str(said["year"]))
    words = F.array(*[F.lit(w) for w in q.split()])
    used = lambda *texts: F.array_distinct(F.flatten(F.collect_set(F.array_intersect(F.split(F.concat_ws(" ", *texts), " "), words))))  # noqa: E731  as many as the query has
    known = library.photos.where("place is not null").select("place").distinct().join(library.aliases, "place", "left").select("place", F.lower("alias").alias("alias"), T.city_part("place").alias("city"))
    places = checkpointed(known.where(T.has_word(F.lit(q), F.col("city")) | T.has_word(F.lit(q), F.col("alias"))))
    by_name = checkpointed(library.persons.where("trim(name) <> ''").where(T.has_word(F.lit(q), F.lower("name"))).select("person_id", F.lower("name").alias("name")))
    at, who = places.agg(F.count("*").alias("n"), used("city", "alias").alias("words")).first(), by_name.agg(F.count("*").alias("n"), used("name").alias("words")).first()
    if at["n"]:
        rows = rows.join(places.select("place"), "place", "left_semi")
    if who["n"]:
        rows = S.in_folder(rows, P.photos_of_any(library.photo_people, P.resolve_aliases(library.persons), by_name.select("person_id")))
    matched = F.array(*[F.lit(w) for w in [*at["words"], *who["words"], ""]])
    caption = spark.range(1).select(S.residual_caption(F.lit(q), matched, F.lit(said["month"] is not None))).first()[0]
    return rows, caption


def structured_search(library: Library, query: str, folder: object = None, encode: Encode | None = None, floor: float = CAPTION_FLOOR) -> DataFrame:
    """(photo_id, ts, place, score) of a query: its hard filters, then ranked by the rest of it as a caption, or the newest first without one (score 0)."""
    rows, caption = structured(library, query, folder)
    rows = rows.select("photo_id", "ts", "place")
    if caption and encode is not None:
        return S.by_score(ranked_by(rows, library, encode(caption), floor), floor)
    return S.newest_first(rows.withColumn("score", F.lit(0.0)))


class Folder(NamedTuple):
    folder: object
    query: str | None = None
    anchor: int | None = None
    minus: str | None = None
    least: float | None = None


def smart_folder(library: Library, saved: Folder, encode: Encode | None = None) -> DataFrame:
    """(photo_id, score) of a saved folder.

    With an anchor photo or a pinned floor: what is like the anchor and the query, less the
    minus terms (separated by commas), the anchor left out; by text: its search; else the
    photos it holds.
    """
    if saved.anchor is not None or saved.least is not None:
        texts = [t for t in [saved.query, *(saved.minus or "").split(",")] if t and t.strip()]
        spark = library.photos.sparkSession
        terms = library.vectors.where(F.col("photo_id") == saved.anchor).select(F.lit(0).cast("long").alias("term"), F.col("v").cast("array<double>").alias("v"))
        said = [(k + 1, [float(x) for x in encode(t.strip())]) for k, t in enumerate(texts)] if encode is not None else []
        weights = {0: 1.0} | {k + 1: 1.0 if t == saved.query else -0.8 for k, t in enumerate(texts)}
        q = composite(terms.unionByName(spark.createDataFrame(said, "term long, v array<double>")), weights)
        rows = S.active(library.photos).where(~F.col("photo_id").eqNullSafe(F.lit(saved.anchor).cast("long"))).select("photo_id")
        if q is None:
            return rows.where("1 = 0").withColumn("score", F.lit(0.0))
        floor = saved.least if saved.least is not None else ANCHOR_FLOOR if saved.anchor is not None else CAPTION_FLOOR
        return S.by_score(ranked_by(rows, library, q, floor), floor)
    if saved.query and saved.query.strip():
        return structured_search(library, saved.query, None, encode).select("photo_id", "score")
    return S.in_folder(S.active(library.photos), library.members.where(F.col("folder") == saved.folder)).select("photo_id", F.lit(0.0).alias("score"))


def similar_photos(library: Library, source: int, k: int = 60, floor: float = ANCHOR_FLOOR) -> DataFrame:
    """(photo_id, score) of the k photos most like a source, by the best pair of their representations, itself left out."""
    found = library.vectors.where(F.col("photo_id") == source).select(F.filter(representations(library), lambda v: F.size(v) > 0).alias("all")).first()
    queries = [list(v) for v in (found["all"] if found else [])]  # a vector and its frames
    rows = S.active(library.photos).where(F.col("photo_id") != source).select("photo_id").join(library.vectors, "photo_id")
    if not queries:
        return rows.where("1 = 0").select("photo_id", F.lit(0.0).alias("score"))
    each = [best_of(representations(library), F.array(*[F.lit(float(x)) for x in q])) for q in queries]
    best = F.greatest(*each) if len(each) > 1 else each[0]
    return rows.select("photo_id", best.alias("score")).where(F.col("score") >= floor).orderBy(F.desc("score"), "photo_id").limit(k)
