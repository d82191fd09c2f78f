"""A log of user edits folded into the tables that it makes.

Edits are rows (seq long, op string, id long, member long, name string, text string) of
an append-only log. Single values are registers, of which the last write by seq holds;
folders hold sets, in which each (folder, photo) pair is a register of its own, so that
two additions of one photo to two folders, or of two photos to one, both last. Some edits
write several registers at their seq, and are spread first:

| op | id, member, name, text | writes |
|-|-|-|
| rename | person, text | name (blank: none) |
| hide | person | hidden, no name |
| merge | person, member: into | merged_into, no longer hidden; its name goes to a nameless target |
| unmerge | person | merged_into: none |
| alias | name: place, text | alias (blank: none) |
| create_folder, smart_folder | folder, text | name; query (blank: none) |
| rename_folder | folder, text | name, unless blank |
| delete_folder | folder, text: 'photos' if these go too | no folder, no members; photos deleted |
| add_to_folder, remove_from_folder | folder, member: photo | membership |
| delete, restore | photo | is_deleted |
| prune | photo | is_deleted, no membership of what was added before |
| keep | group, member: photo kept (null: none), a row each | others of the group deleted |
| not_duplicate | group | its photos, for good |

Edits of a folder count from its creation to its deletion, whose ids aren't used again.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.functions.groups import in_turn
from shoal.sources.shared import checkpointed


class Folded(NamedTuple):
    persons: DataFrame
    """(person_id, name, hidden, merged_into) of persons that an edit names."""
    aliases: DataFrame
    """(place, alias) of places with one."""
    folders: DataFrame
    """(folder, name, query) of folders that exist."""
    members: DataFrame
    """(folder, photo_id)."""
    photos: DataFrame
    """(photo_id, is_deleted) of photos that an edit names."""
    not_duplicate: DataFrame
    """(photo_id,)."""


def last(rows: DataFrame, key: str | list[str], **values: Column) -> DataFrame:
    """The values of the last row of each key, by seq."""
    keys = [key] if isinstance(key, str) else key
    held = F.max_by(F.struct(*[v.alias(k) for k, v in values.items()]), "seq").alias("x")
    return rows.groupBy(*keys).agg(held).select(*keys, *[F.col(f"x.{k}").alias(k) for k in values])


def filled(text: str) -> Column:
    """A text without blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def names_in_turn(rows: DataFrame) -> DataFrame:
    """(id, name) of name edits (cluster, seq, op, id, member, text) of persons tied by merges: a target's name depends on the sources' at that time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[int, str | None] = {}
        for r in pdf.sort_values("seq").itertuples(index=False):
            if r.op == "merge":
                if names.get(r.id) and not names.get(r.member):
                    names[r.member] = names[r.id]
                names[r.id] = None
            else:
                names[r.id] = r.text if r.op == "rename" else None
        return pd.DataFrame({"id": list(names), "name": pd.Series(list(names.values()), dtype=object)})

    return in_turn(rows, "cluster", run, "id long, name string")


def persons(edits: DataFrame) -> DataFrame:
    """(person_id, name, hidden, merged_into)."""
    from shoal.operators.graph import components

    own = edits.where(F.col("op").isin("rename", "hide", "merge", "unmerge")).withColumn("text", filled("text"))
    merges = own.where("op = 'merge'").select(F.col("id").alias("a"), F.col("member").alias("b"))
    tied = checkpointed(components(merges).select(F.col("node").alias("id"), F.col("component").alias("cluster")))
    named = own.where("op <> 'unmerge'")
    # Only persons that merges tie together are folded in turn; all others are registers.
    alone = last(named.join(tied, "id", "left_anti"), "id", name=F.when(F.col("op") == "rename", F.col("text")))
    names = alone.unionByName(names_in_turn(named.join(tied, "id").select("cluster", "seq", "op", "id", "member", "text")))
    hidden = last(own.where("op in ('hide', 'merge')"), "id", hidden=F.col("op") == "hide")
    into = last(own.where("op in ('merge', 'unmerge')"), "id", merged_into=F.when(F.col("op") == "merge", F.col("member")))
    ids = own.select("id").union(merges.select("b")).distinct()
    out = ids.join(names, "id", "left").join(hidden, "id", "left").join(into, "id", "left")
    return out.select(F.col("id").alias("person_id"), "name", F.coalesce("hidden", F.lit(False)).alias("hidden"), "merged_into")


def fold(edits: DataFrame, groups: DataFrame | None = None) -> Folded:
    """The tables that a log of edits makes; groups (rep, photo_id) says which photos keep and not_duplicate mean, at the time of folding.

    Null ids, unknown ops and merges into oneself write nothing. An empty log makes empty tables.
    """
    edits = checkpointed(edits.select("seq", "op", "id", "member", "name", "text").where("(id is not null or op = 'alias') and not (op = 'merge' and (member is null or id = member))"))
    groups = edits.sparkSession.createDataFrame([], "rep long, photo_id long") if groups is None else groups
    of = lambda *ops: edits.where(F.col("op").isin(*ops))

    aliases = last(of("alias").where("name is not null").withColumn("place", F.col("name")), "place", alias=filled("text")).where("alias is not null")

    made = of("create_folder").groupBy(F.col("id").alias("folder")).agg(F.min("seq").alias("made"))
    ended = of("delete_folder").withColumn("folder", F.col("id")).join(made, "folder").where("seq > made")
    ended = ended.groupBy("folder").agg(F.min(F.struct("seq", (F.coalesce("text", F.lit("")) == "photos").alias("photos"))).alias("end"))
    lives = checkpointed(made.join(ended, "folder", "left").select("folder", "made", F.col("end.seq").alias("ended"), F.col("end.photos").alias("photos")))
    within = lambda rows: rows.withColumn("folder", F.col("id")).join(lives, "folder").where("seq >= made and (ended is null or seq < ended)")
    titles = last(within(of("create_folder", "rename_folder").where(filled("text").isNotNull())), "folder", name=filled("text"))
    queries = last(within(of("smart_folder")), "folder", query=filled("text"))
    folders = lives.where("ended is null").select("folder").join(titles, "folder", "left").join(queries, "folder", "left")

    pairs = within(of("add_to_folder", "remove_from_folder")).where("member is not null").groupBy("folder", F.col("member").alias("photo_id")).agg(
        F.max_by(F.struct("op", "seq"), "seq").alias("x"), F.first("ended").alias("ended"), F.first("photos").alias("photos"))
    added = pairs.where("x.op = 'add_to_folder'").select("folder", "photo_id", F.col("x.seq").alias("added"), "ended", "photos")
    prunes = of("prune").select(F.col("id").alias("photo_id"), F.col("seq").alias("pruned"))
    # Memberships that no prune undid before the folder's end.
    undone = added.join(prunes, "photo_id").where("pruned > added and (ended is null or pruned < ended)").select("folder", "photo_id").distinct()
    held = checkpointed(added.join(undone, ["folder", "photo_id"], "left_anti"))

    keeps = of("keep").select("seq", F.col("id").alias("rep"), "member")
    spared = keeps.where("member is not null").select("seq", "rep", F.col("member").alias("photo_id"))
    dropped = keeps.select("seq", "rep").distinct().join(groups, "rep").join(spared, ["seq", "rep", "photo_id"], "left_anti")
    writes = (of("delete", "prune", "restore").select("seq", F.col("id").alias("photo_id"), (F.col("op") != "restore").alias("gone"))
              .unionByName(held.where("photos").select(F.col("ended").alias("seq"), "photo_id", F.lit(True).alias("gone")))
              .unionByName(dropped.select("seq", "photo_id", F.lit(True).alias("gone"))))
    photos = last(writes, "photo_id", is_deleted=F.col("gone"))

    loose = of("not_duplicate").select(F.col("id").alias("rep")).distinct().join(groups, "rep").select("photo_id").distinct()
    return Folded(persons(edits), aliases, folders, held.where("ended is null").select("folder", "photo_id"), photos, loose)
