"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget runs down the tree by the
weights of each node's children; a child takes no more than it can give (its tokens
times `max_epochs`). What it can't take goes to its siblings first and reaches the
parent's siblings only when the whole subtree is exhausted, because a node's own
capacity is the sum of its children's. Each leaf then fills its budget with seeded
epochs: whole passes over its documents and, last, a prefix of one more pass in an
order drawn from (seed, epoch, document).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

LEVELS = ("domain", "lang", "source")
#: Leaves whose plan is broadcast at most; beyond, the plan is joined by shuffle.
BROADCAST_LEAVES = 100_000


def words(text: Column) -> Column:
    """Number of runs of other than white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def spread(nodes: DataFrame, parents: DataFrame | int, keys: Sequence[str], weight: Column) -> DataFrame:
    """Share each parent's `budget` among its children: (keys.., cap, budget) by weights under caps.

    In the order of cap / weight a child is full as long as its cap is below its share
    of what is left; the rest share what remains by weight. One window a parent over
    rows of the tree (never of documents).
    """
    up = list(keys[:-1])
    rows = nodes.withColumn("w", weight.cast("double"))
    rows = rows.join(parents.select(*up, F.col("budget").alias("given")), up) if up else rows.withColumn("given", F.lit(parents))
    asc = Window.partitionBy(*[F.col(c) for c in up] or [F.lit(0)]).orderBy(F.col("cap") / F.col("w"), F.col(keys[-1]))
    before = asc.rowsBetween(Window.unboundedPreceding, -1)
    onward = asc.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.greatest(F.lit(0), F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0)))).withColumn("w_left", F.sum("w").over(onward))
    rows = rows.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    # From the first child that isn't full on, all share by weight what that child found left.
    first = F.first(F.when(~F.col("full"), F.struct("left", "w_left")), ignorenulls=True).over(asc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("at", first).withColumn("at", F.when(~F.col("full"), F.col("at")))
    share = F.floor(F.col("at.left") * F.col("w") / F.col("at.w_left")).cast("long")
    return rows.select(*keys, "cap", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(share, F.col("cap"))).alias("budget"))


def budgets(leaves: DataFrame, budget: int, weights: Sequence[Column]) -> DataFrame:
    """Run `budget` down a table of leaves (domain, lang, source, cap): adds each leaf's budget."""
    levels = [leaves.groupBy(*LEVELS[: k + 1]).agg(F.sum("cap").alias("cap")) for k in range(len(LEVELS))]
    given: DataFrame | int = min(int(budget), leaves.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0])
    for k, nodes in enumerate(levels):
        given = spread(nodes, given, LEVELS[: k + 1], weights[k])
    return given.select(*LEVELS, "budget")


def weight_of(column: str, weights: Mapping[str, int] | None) -> Column:
    """The whole-number weight of a node by its name; 1 where none is given."""
    out = F.lit(1)
    for name, w in (weights or {}).items():
        if not isinstance(w, int) or w < 1:
            raise ValueError("weights are whole numbers of 1 or more")
        out = F.when(F.col(column) == name, F.lit(w)).otherwise(out)
    return out


def mix(df: DataFrame, domain: Column, budget: float, weights: Sequence[Mapping[str, int] | None] = (None, None, None), max_epochs: int = 4, seed: str = "0",
        id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The mixture: (id_col, domain, lang, source, n_tokens, leaf_tokens, leaf_budget, epoch) with a row for each copy taken.

    budget: tokens as a share of all tokens of df (1.0: as many as there are). Null
    names of domain, language and source count as ''. A document's tokens are its words;
    documents without words weigh nothing and go with every epoch their leaf begins.
    Repeated rows of one id are mixed as rows of their own, ties in the seeded order
    falling to the id; a leaf's last epoch ends before the document that would pass its
    budget. Other columns are ignored. An empty table gives an empty mixture.
    """
    spark = df.sparkSession
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    docs = table(df.select(F.col(id_col), name(domain).alias("domain"), name(F.col(lang)).alias("lang"), name(F.col(source)).alias("source"), words(F.col(text).cast("string")).alias("n_tokens")), "mix-docs")
    stats = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    leaves = table(stats.withColumn("cap", F.col("tokens") * max_epochs), "mix-leaves")
    n_leaves, total = leaves.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    plan = table(leaves.join(budgets(leaves, int(budget * total), [weight_of(c, w) for c, w in zip(LEVELS, weights, strict=True)]), list(LEVELS))
                 .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))
                 .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
                 .withColumn("buckets", F.ceil(F.sqrt("n_docs"))), "mix-plan")
    near = F.broadcast if n_leaves <= BROADCAST_LEAVES else (lambda x: x)
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("whole").cast("string"), F.col(id_col).cast("string")))
    rows = docs.join(near(plan.select(*LEVELS, "tokens", "budget", "whole", "rest", "buckets")), list(LEVELS)).withColumn("order", order)
    # The seeded order is cut by its first 32 bits into as many buckets as each has documents, about:
    # whole buckets are added up first, and only one bucket a leaf is sorted.
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * F.col("buckets")).cast("long"))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    run = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    edge = (sums.withColumn("before", F.coalesce(run, F.lit(0))).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
            .groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("cut")))
    edge = table(edge, "mix-edge")
    rows = rows.join(near(edge), list(LEVELS), "left")
    keep = [id_col, *LEVELS, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget")]
    below = rows.where((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut.bucket")))).select(*keep, F.col("whole").alias("epoch"))
    within = rows.where((F.col("rest") > 0) & (F.col("bucket") == F.col("cut.bucket")))
    upto = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("order", id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    within = within.withColumn("upto", F.col("cut.before") + upto).where(F.col("upto") <= F.col("rest")).select(*keep, F.col("whole").alias("epoch"))
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0, whole - 1)"))).select(*keep, "epoch")
    return full.unionByName(below).unionByName(within)
