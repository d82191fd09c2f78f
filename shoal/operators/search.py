"""Structured search: filters, free text to filters, ranking, collapse and pages."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import text as T
from shoal.functions.groups import in_turn
from shoal.functions.vectors import dot


def active(photos: DataFrame) -> DataFrame:
    """B1: rows that aren't soft-deleted."""
    return photos.where(~F.col("is_deleted"))


def of_device(photos: DataFrame, device: str) -> DataFrame:
    """B2: rows of a device; a missing id is the empty one."""
    return photos.where(F.coalesce("device_id", F.lit("")) == device)


def in_folder(photos: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of a folder, by its members (photo_id)."""
    return photos.join(members.select("photo_id"), "photo_id", "left_semi")


def media(photos: DataFrame, video: bool) -> DataFrame:
    """Images or videos."""
    return photos.where(F.col("is_video") == video)


def at_time(photos: DataFrame, when: str) -> DataFrame:
    """Rows of a year, month, day, or within six hours of a time. The bounds become literals, so the scan gets them."""
    r = photos.sparkSession.range(1).select(T.time_range(F.lit(when)).alias("r")).first()["r"]
    ts = F.col("ts").cast("timestamp_ntz")
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (r["lo"], r["hi"]))
    return photos.where((ts >= lo) & ((ts <= hi) if r["granularity"] == "datetime" else (ts < hi)))


def place_contains(photos: DataFrame, aliases: DataFrame, q: str) -> DataFrame:
    """Rows whose place, or its alias, contains a phrase, case ignored. No place, no match."""
    q = q.strip().lower()
    named = photos.join(aliases, "place", "left")
    return named.where(F.contains(F.lower("place"), F.lit(q)) | F.coalesce(F.contains(F.lower("alias"), F.lit(q)), F.lit(False))).drop("alias")


def newest_first(df: DataFrame) -> DataFrame:
    """by time downwards, rows without one last, ties by id."""
    return df.orderBy(F.desc_nulls_last("ts"), "photo_id")


def by_score(df: DataFrame, floor: float) -> DataFrame:
    """rows of at least `floor`, best first, ties by id."""
    return df.where(F.col("score") >= floor).orderBy(F.desc("score"), "photo_id")


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 200) -> DataFrame:
    """a page in an order, each row with its rank (from 1), the total and the number of pages.

    The total is an aggregate of its own, so the page stays a bounded top-k.
    """
    total = df.count()
    pages = -(-total // limit)
    shown = df.orderBy(*order).offset(offset).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)) + offset  # a page of rows
    return shown.withColumn("rank", rank.cast("long")).withColumn("total", F.lit(total).cast("long")).withColumn("pages", F.lit(pages).cast("long"))


def collapse(df: DataFrame, group: str, order: Sequence[Column | str]) -> DataFrame:
    """Of each duplicate group the row that ranks first; rows without a group stay."""
    w = Window.partitionBy(F.coalesce(F.col(group).cast("string"), F.concat(F.lit("own "), F.col("photo_id").cast("string")))).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def payload(df: DataFrame, people: DataFrame, dup_counts: DataFrame | None = None, more: Sequence[str] = (), base_url: str = "/api/photo/") -> DataFrame:
    """Id, urls, time, place, score to three places, the sorted distinct names of a photo's people, joined by `, `, and dup_count, how many photos it stands for (photo_id, dup_count; 1 where there is none)."""
    names = people.groupBy("photo_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("people"))
    url = F.concat(F.lit(base_url), F.col("photo_id").cast("string"))
    counted = df.withColumn("dup_count", F.lit(1).cast("long")) if dup_counts is None else df.join(dup_counts, "photo_id", "left")
    return counted.join(names, "photo_id", "left").select(
        "photo_id", url.alias("url"), F.concat(url, F.lit("/thumb")).alias("thumb_url"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "place",
        F.round("score", 3).alias("score"), F.coalesce("people", F.lit("")).alias("people"), F.coalesce("dup_count", F.lit(1)).cast("long").alias("dup_count"), *more)


def place_vocabulary(places: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct lower-case parts of places of more than two letters, and aliases."""
    parts = places.select(F.explode(F.split(F.lower("place"), ",")).alias("phrase")).select(F.trim("phrase").alias("phrase"))
    other = aliases.select(F.trim(F.lower("alias")).alias("phrase"))
    return parts.unionByName(other).where(F.length("phrase") > 2).distinct()


def match_phrases(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(q, phrase, start, words, rank): known phrases in each query's tokens, most words first, over free positions only.

    Phrases may have a rank: all of a smaller one come before those of a larger one.
    Windows of tokens, as long as some phrase is, meet the phrases by an equi-join; only
    the few hits of one query are taken in turn.
    """
    rank = F.col("rank").cast("int") if "rank" in phrases.columns else F.lit(0)
    known = phrases.select("phrase", rank.alias("rank"), F.array_join(T.tokens("phrase"), " ").alias("key"), F.size(T.tokens("phrase")).alias("words")).where("words > 0").distinct()
    lengths = [r["words"] for r in known.select("words").distinct().collect()]  # a row a length
    words = queries.select("q", F.posexplode(T.tokens("q")).alias("start", "_t"), T.tokens("q").alias("t"))
    sizes = words.select("q", "start", "t", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("words")).where(F.col("start") + F.col("words") <= F.size("t"))
    spans = sizes.select("q", "start", F.array_join(F.slice("t", F.col("start") + 1, F.col("words")), " ").alias("key"))
    hits = spans.join(known, "key").select("q", "phrase", "start", "words", "rank")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[int] = set()
        keep = []
        for row in pdf.sort_values(["rank", "words", "phrase", "start"], ascending=[True, False, True, True]).itertuples(index=False):
            span = range(row.start, row.start + row.words)
            if not used.intersection(span):
                used.update(span)
                keep.append(row)
        return pd.DataFrame(keep, columns=pdf.columns)

    return in_turn(hits, "q", take, "q string, phrase string, start int, words int, rank int")


def parse_queries(queries: DataFrame, names: DataFrame, places: DataFrame) -> DataFrame:
    """(q, names, location, timestamp, caption) of free-text queries.

    Names come first, then places, of which the longest is the location. What neither uses
    is free: its first year is the time, with its first month if there is one (a month
    without a year stays in the caption). The caption is the free tokens left but stop words.
    """
    kinds = names.select(F.col("name").alias("phrase"), F.lit(0).alias("rank")).unionByName(places.select("phrase", F.lit(1).alias("rank")))
    hits = match_phrases(queries, kinds)
    used = hits.select("q", F.explode(F.sequence("start", F.col("start") + F.col("words") - 1)).alias("pos")).groupBy("q").agg(F.collect_set("pos").alias("used"))
    place = F.col("rank") == 1
    found = hits.groupBy("q").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~place, F.col("phrase")))), "|").alias("names"),
        F.min_by(F.when(place, F.col("phrase")), F.when(place, F.struct(-F.col("words"), F.col("phrase"), F.col("start")))).alias("location"))
    out = queries.select("q").distinct().join(found, "q", "left").join(used, "q", "left")
    used_at = F.coalesce("used", F.array().cast("array<int>"))
    placed = F.transform(T.tokens("q"), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    out = out.withColumn("free", F.filter(placed, lambda s: ~F.array_contains(used_at, s["i"])))
    first = lambda fits: F.try_element_at(F.filter("free", lambda s: fits(s["t"])), F.lit(1))
    out = out.withColumn("year", first(lambda t: t.rlike("^(19|20)\\d\\d$"))).withColumn("month", first(lambda t: T.month_number(t).isNotNull()))
    dated = F.col("year").isNotNull()
    stamp = F.when(dated & F.col("month").isNotNull(), F.concat("year.t", F.lit("-"), F.lpad(T.month_number(F.col("month.t")).cast("string"), 2, "0"))).when(dated, F.col("year.t"))
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    spent = lambda s: dated & (s["i"].eqNullSafe(F.col("year.i")) | s["i"].eqNullSafe(F.col("month.i")))
    caption = F.transform(F.filter("free", lambda s: ~F.array_contains(stop, s["t"]) & ~spent(s)), lambda s: s["t"])
    return out.select("q", F.coalesce("names", F.lit("")).alias("names"), "location", stamp.alias("timestamp"), F.array_join(caption, " ").alias("caption"))


def residual_caption(q: str | Column, matched: Column, dated: Column) -> Column:
    """Words of a query that are neither matched words nor years nor stop words, nor months when a month and year matched."""
    words = F.split(F.lower(F.trim(F.col(q) if isinstance(q, str) else q)), "\\s+")
    stop = F.array(*map(F.lit, T.STOP_WORDS))
    return F.array_join(F.filter(words, lambda w: (w != "") & ~F.array_contains(stop, w) & ~F.array_contains(matched, w) & ~w.rlike("^(19|20)\\d\\d$") & ~(dated & T.month_number(w).isNotNull())), " ")


def scored(photos: DataFrame, vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Rows with the inner product of their vector and a query vector as score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return photos.join(vectors, "photo_id").withColumn("score", dot("v", q)).drop("v")


def pretokenize(text: str | Column, length: int = 77) -> Column:
    """Lower-case words, digits and symbol runs between start and end marks, cut and padded to a length."""
    bare = F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), "\\s+", " "))
    words = F.regexp_extract_all(bare, F.lit("'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+"), F.lit(0))
    marked = F.concat(F.array(F.lit("<start>")), F.slice(words, 1, length - 2), F.array(F.lit("<end>")))
    return F.concat(marked, F.array_repeat(F.lit(""), F.lit(length) - F.size(marked)))


def ids_by_vocabulary(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ids of pre-tokens by a user's vocabulary (word, id); unknown ones are 0."""
    return words.join(vocabulary, "word", "left").withColumn("id", F.coalesce("id", F.lit(0)))
