"""People: canonical ids, names, photos by person, counts and representatives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.sources.shared import checkpointed


#: Letters of an asked name on which names are joined.
GRAM = 8


#: Merges that the driver follows at most.
MERGES = 100_000


def followed(persons: DataFrame, into: dict[int, int]) -> DataFrame:
    """Canonical ids by merges that fit into a small table."""
    ends = []
    for start in into:
        at, passed = start, {start}
        while at in into and into[at] not in passed:
            at = into[at]
            passed.add(at)
        ends.append((start, min(passed) if at in into else at))
    small = persons.sparkSession.createDataFrame(ends, "person_id long, end long")
    return persons.select("person_id").join(F.broadcast(small), "person_id", "left").select("person_id", F.coalesce("end", "person_id").alias("canonical_id"))


def resolve_aliases(persons: DataFrame, rounds: int = 32) -> DataFrame:
    """(person_id, canonical_id) by following merged_into to its end, by pointer jumping.

    A cycle resolves to its smallest id: ids on it keep the least they have passed. Merges
    are counted first: up to MERGES of them are followed by the driver.
    """
    merges = persons.where("merged_into <> person_id").select("person_id", "merged_into").limit(MERGES + 1).collect()
    if len(merges) <= MERGES:
        return followed(persons, {r[0]: r[1] for r in merges})
    now = persons.select("person_id", F.coalesce("merged_into", "person_id").alias("at"), F.least("person_id", F.coalesce("merged_into", "person_id")).alias("least"))
    for _ in range(min(rounds, persons.count().bit_length() + 1)):  # a chain is passed in doublings
        hop = now.select(F.col("person_id").alias("k"), F.col("at").alias("next"), F.col("least").alias("least_there"))
        step = now.join(hop, F.col("at") == F.col("k"), "left").select(
            "person_id", "at", F.coalesce("next", "at").alias("next"), F.least("least", F.coalesce("least_there", "least")).alias("least"))
        step = checkpointed(step)
        moved = step.where("at <> next").limit(1).count()
        now = step.select("person_id", F.col("next").alias("at"), "least")
        if not moved:
            break
    # Ends point at themselves; what still moves after that many doublings is on or before a cycle.
    ends = now.alias("n").join(now.select(F.col("person_id").alias("k"), F.col("at").alias("end")).alias("e"), F.col("n.at") == F.col("k"), "left")
    return ends.select("person_id", F.when(F.coalesce("end", "at") == F.col("at"), F.col("at")).otherwise(F.col("least")).alias("canonical_id"))


def resolve_names(persons: DataFrame, names: DataFrame) -> DataFrame:
    """(name, person_id) for each asked name: those equal to it, case ignored; only without any, those that contain it.

    Names meet on the last letters of what is asked, an equi-join of any size.
    """
    asked, has = F.lower("name"), F.lower("person_name")
    ends = names.select("name").distinct().withColumn("gram", F.right(asked, F.lit(GRAM)))
    sizes = [r["n"] for r in ends.select(F.length("gram").alias("n")).distinct().collect()]  # GRAM + 1 at most
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(has) - n + 1)), lambda i: F.substring(has, i, F.lit(n)))
    named = persons.select("person_id", F.col("name").alias("person_name")).where("person_name is not null")
    hits = named.withColumn("gram", F.explode(F.array_distinct(F.flatten(F.array(*map(pieces, sizes or [0])))))).join(ends, "gram").where(F.contains(has, asked))
    kind = F.when(asked == has, 0).otherwise(1)
    return hits.withColumn("kind", kind).withColumn("best", F.min("kind").over(Window.partitionBy("name"))).where("kind = best").select("name", "person_id")


def canonical_photos(photo_people: DataFrame, canonical: DataFrame) -> DataFrame:
    """Distinct (photo_id, person_id) with canonical ids."""
    return photo_people.join(canonical, "person_id").select("photo_id", F.col("canonical_id").alias("person_id")).distinct()


def photos_with_all_names(photo_people: DataFrame, canonical: DataFrame, resolved: DataFrame, asked: int) -> DataFrame:
    """Photos that hold, for each of `asked` names, a person it resolves to. A name of no one gives no photos."""
    ids = resolved.join(canonical, "person_id").select("name", "canonical_id").distinct()
    # All original ids of who is asked for: a written table, whose size lets Spark filter the photos as they are read.
    wanted = checkpointed(canonical.join(ids, "canonical_id").select("person_id", "name").distinct())
    hits = photo_people.join(wanted.select("person_id"), "person_id", "left_semi").join(wanted, "person_id")
    return hits.groupBy("photo_id").agg(F.countDistinct("name").alias("n")).where(F.col("n") == asked).select("photo_id")


def photos_of_all(photos: DataFrame, photo_people: DataFrame, canonical: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Photos that aren't deleted and hold all the given people, merged ids resolved on both sides, oldest first.

    None for an empty request, nor if an id is no one's.
    """
    asked = photo_people.sparkSession.createDataFrame([(int(i),) for i in set(ids)], "person_id long")
    wanted = asked.join(canonical, "person_id", "left").select(F.coalesce("canonical_id", "person_id").alias("person_id")).distinct()
    n = wanted.count()
    hits = canonical_photos(photo_people, canonical).join(F.broadcast(wanted), "person_id", "left_semi")  # as many as were asked for
    held = hits.groupBy("photo_id").agg(F.count("*").alias("n")).where((F.col("n") == n) & F.lit(n > 0))
    return photos.where(~F.col("is_deleted")).join(held, "photo_id", "left_semi").orderBy(F.asc_nulls_first("ts"), "photo_id")


def photos_of_any(photo_people: DataFrame, canonical: DataFrame, ids: DataFrame) -> DataFrame:
    """Photos that hold any of the given people (person_id)."""
    asked = ids.join(canonical, "person_id").select("canonical_id").distinct()
    wanted = checkpointed(canonical.join(asked, "canonical_id", "left_semi").select("person_id"))
    return photo_people.join(wanted, "person_id", "left_semi").select("photo_id").distinct()


def people_counts(photo_people: DataFrame, canonical: DataFrame, deleted: DataFrame, parts: int | None = None) -> DataFrame:
    """(person_id, count) of photos that aren't deleted, by canonical person. Rows may repeat; with `parts` they are dealt by photo into so many, so a task's share is the caller's choice."""
    rows = photo_people.join(canonical, "person_id").select("photo_id", F.col("canonical_id").alias("person_id"))
    gone = deleted.select("photo_id")
    if parts:
        rows, gone = rows.repartition(parts, "photo_id"), gone.repartition(parts, "photo_id")
    live = rows.join(gone, "photo_id", "left_anti").distinct()
    return live.groupBy("person_id").agg(F.count("*").alias("count"))


def raw_counts(photo_people: DataFrame, canonical: DataFrame) -> DataFrame:
    """(person_id, canonical_id, count, is_primary) before merging, deleted photos included."""
    n = photo_people.groupBy("person_id").agg(F.countDistinct("photo_id").alias("count"))
    return canonical.join(n, "person_id", "left").select("person_id", "canonical_id", F.coalesce("count", F.lit(0)).alias("count"), (F.col("person_id") == F.col("canonical_id")).alias("is_primary"))


def at_least(counts: DataFrame, least: int, hidden: DataFrame | None = None) -> DataFrame:
    """People of at least so many photos who aren't hidden."""
    out = counts.where(F.col("count") >= least)
    return out if hidden is None else out.join(hidden.select("person_id"), "person_id", "left_anti")


def people_in(counts: DataFrame, photo_people: DataFrame, canonical: DataFrame, photos: DataFrame) -> DataFrame:
    """Rows of counts for people who appear in some photos; deleted ones count as presence."""
    there = canonical_photos(photo_people.join(photos.select("photo_id"), "photo_id", "left_semi"), canonical)
    return counts.join(there.select("person_id"), "person_id", "left_semi")


def best_by(rows: DataFrame, group: Sequence[str], value: str, order: Sequence[Column], name: str) -> DataFrame:
    """Per group the `value` of the row that is greatest by `order` (give it a last, unique term)."""
    return rows.groupBy(*group).agg(F.max_by(value, F.struct(*order)).alias(name))


def size_distribution(members: DataFrame, group: str) -> DataFrame:
    """(size, clusters): how many clusters have each size."""
    return members.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))
