"""A Merkle tree over the rows of a dataset: leaf digests, a tree a group, one over the groups, and a proof a row.

A window over the rows of a block (a whole subtree, of at most BLOCK leaves) takes a
level a step: a node lives at the row of its first leaf, lag and lead columns at the
fixed offsets of the level, masked by the node's slot and the length of its run, are
its siblings, and first children hash their parents. Nothing moves between the levels
of a block. The blocks' nodes are the leaves of the next round, so the rows shrink by
BLOCK each time, and paths come back by a join on the block. No task holds more than
a block, however large a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, global_rank, table

#: Leaves of a block at most. Spark keeps so many rows of a window in memory.
BLOCK = 1024


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """The digest of values as text: '-' for null, else the UTF-8 byte count, ':' and the value."""
    said = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path make."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def proof_digest(path: Column) -> Column:
    """The digest of a path's siblings, level by level, left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def climb(nodes: DataFrame, most: int, fanout: int = 2, carry: Sequence[str] = (), top: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(tree, pos, carried columns, path array<struct<before, after>>, subroot, root) for nodes (tree, pos long, n long, h string).

    n is the number of nodes of a tree (`most` at most), pos a node's place among them from
    0. While several remain, each `fanout` consecutive ones (the last run may be shorter,
    even one) become their digest; what remains is the subroot, of a lone node itself, with
    an empty path. `top` makes (tree, above, root) of all subroots (tree, h): the way on.
    """
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    block = fanout**depth
    w = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = nodes.select("tree", "pos", "n", "h", *carry, F.expr(f"pos div {block}").alias("block"))
    steps = []
    for k in range(depth):
        span = fanout**k
        if span >= most:
            break
        slot = F.expr(f"pos div {span} % {fanout}")
        first = F.col("pos") % span == 0  # the row of a node's first leaf
        grows = F.col("n") > span
        run = F.least(F.lit(fanout), F.expr(f"(n + {span - 1}) div {span} - pos div {span}") + slot)  # nodes of this one's run
        near = {f"lag{j}": F.lag("h", j * span).over(w) for j in range(1, fanout)} | {f"lead{j}": F.lead("h", j * span).over(w) for j in range(1, fanout)}
        before = F.concat(*[F.when(slot >= j, F.col(f"lag{j}")).otherwise("") for j in range(fanout - 1, 0, -1)])
        after = F.concat(*[F.when(slot + j < run, F.col(f"lead{j}")).otherwise("") for j in range(1, fanout)])
        level = level.withColumns(near).withColumn(f"step{k}", F.when(first & grows, F.struct(before.alias("before"), after.alias("after")))).drop(*near)
        parent = digest(F.concat("h", F.col(f"step{k}.after")))
        level = level.withColumn("h", F.when(first & grows & (slot == 0), parent).otherwise(F.col("h")))
        steps.append(f"step{k}")
    # A row's steps are those of the nodes it lies in: of the last first leaf at or before it.
    found = [F.last(s, ignorenulls=True).over(so_far).alias(s) for s in steps]
    within = level.select("tree", "pos", "block", *carry, *found, F.first("h").over(so_far).alias("subroot"))
    path = F.filter(F.array(*steps), lambda s: s.isNotNull()) if steps else F.expr(NO_STEPS)
    within = within.select("tree", "pos", "block", *carry, path.alias("path"), "subroot")
    tops = level.where(F.col("pos") % block == 0).select("tree", F.col("block").alias("pos"), F.expr(f"(n + {block - 1}) div {block}").alias("n"), "h")
    if most > block:
        above = climb(table(tops, "nodes"), -(-most // block), fanout, (), top)
        above = above.select("tree", F.col("pos").alias("block"), F.col("path").alias("above"), "subroot", "root")
        out = within.drop("subroot").join(above, ["tree", "block"])
    elif top:
        out = within.join(top(table(tops.select("tree", "h"), "subroots")), "tree")
    else:
        out = within.select("*", F.expr(NO_STEPS).alias("above"), F.col("subroot").alias("root"))
    return out.select("tree", "pos", *carry, F.concat("path", "above").alias("path"), "subroot", "root")


#: A path without steps.
NO_STEPS = "cast(array() as array<struct<before: string, after: string>>)"


def forest_top(fanout: int) -> Callable[[DataFrame], DataFrame]:
    """(tree, above, root) of subroots (tree, h): the tree over the trees, in bytewise order of their names."""

    def top(subroots: DataFrame) -> DataFrame:
        n = subroots.count()
        nodes = global_rank(subroots, ["tree"], "pos", "subroots").select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("n"), "h", F.col("tree").alias("name"))
        return climb(nodes, n, fanout, ["name"]).select(F.col("name").alias("tree"), F.col("path").alias("above"), "root")

    return top


def manifest(df: DataFrame, leaf: Column, group: str, order: str, keep: Sequence[Column] = (), fanout: int = 2) -> DataFrame:
    """(kept columns, leaf, subroot, root, path) for each row of df.

    The rows of a group (null is a group of its own, the first) ascend by `order`, nulls
    first; equal ones by their leaves, so that repeated rows have places of their own, and
    rows alike in all that is hashed have equal ones in turn. Groups ascend bytewise. The
    path holds the siblings from the leaf to the group's subroot and on to the root. `leaf`
    and `keep` are columns of df; whatever else it holds is left out, so no name can clash.
    An empty table gives an empty result.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # '-' sorts before '='
    leaves = table(df.select(tree.alias("tree"), F.col(order).alias("at"), leaf.alias("h"), F.struct(*keep).alias("kept") if keep else F.struct().alias("kept")), "leaves")  # rows are read and hashed once
    ranked = global_rank(leaves, ["tree", F.asc_nulls_first("at"), "h", F.xxhash64("kept")], "rank", "leaves")
    drop(leaves)
    trees = table(ranked.groupBy("tree").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "trees")
    most = trees.agg(F.max("n")).first()[0] or 1
    placed = ranked.join(trees, "tree").select("tree", (F.col("rank") - F.col("start")).alias("pos"), "n", "h", F.col("h").alias("leaf"), "kept")
    out = climb(placed, most, fanout, ["leaf", "kept"], forest_top(fanout))
    return out.select("kept.*", "leaf", "subroot", "root", "path")
