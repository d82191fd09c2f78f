"""Evaluation of pair classifiers and clusterings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.sources.shared import checkpointed


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def similarity_stats(pairs: DataFrame) -> DataFrame:
    """(same, n, mean, std, low, high) of scores by label."""
    return pairs.groupBy("same").agg(F.count("*").alias("n"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("std"), F.min("sim").alias("low"), F.max("sim").alias("high"))


def histogram(pairs: DataFrame, lo: float = -0.2, hi: float = 0.8, bins: int = 20) -> DataFrame:
    """(same, bin, n): equal bins, cut toward zero and then clamped to the end bins."""
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((F.col("sim") - lo) / ((hi - lo) / bins)).cast("int")))
    return pairs.groupBy("same", at.alias("bin")).agg(F.count("*").alias("n"))


def at_thresholds(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(k, same, n): how many pairs score at least the k-th threshold. Each pair falls into one step; steps are summed from the top."""
    grid = F.array(*[F.lit(float(x)) for x in sorted(thresholds)])
    step = F.size(F.filter(grid, lambda x: F.col("sim") >= x))
    counts = pairs.groupBy(step.alias("step"), "same").agg(F.count("*").alias("n"))
    return counts.withColumn("k", F.explode(F.when(F.col("step") > 0, F.sequence(F.lit(0), F.col("step") - 1)))).groupBy("k", "same").agg(F.sum("n").alias("n"))


def sweep(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) for each threshold."""
    grid = sorted(thresholds)
    spark = pairs.sparkSession
    ks = spark.createDataFrame([(k, float(x)) for k, x in enumerate(grid)], "k int, threshold double")
    above = at_thresholds(pairs, grid).groupBy("k").agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0)).alias("fp"))
    positives = pairs.agg(F.count_if("same")).first()[0]
    return with_rates(ks.join(above, "k", "left").select("threshold", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp")).withColumn("fn", F.lit(positives) - F.col("tp")))


def with_rates(df: DataFrame) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumn("precision", p).withColumn("recall", r)
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def running(df: DataFrame, order: str, descending: bool, sums: dict[str, str]) -> DataFrame:
    """df with the running sums of some columns (name -> column) in the order of a unique one.

    Rows are dealt by ranges of the order; a sum is that of the ranges before, a row a
    partition, and that within the range.
    """
    by = F.desc(order) if descending else F.asc(order)
    part = checkpointed(df.repartitionByRange(by).withColumn("_p", F.spark_partition_id()))
    totals = part.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in enumerate(sums.values())])
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_p", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in range(len(sums))])
    within = Window.partitionBy("_p").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = part.join(F.broadcast(before), "_p").select(*df.columns, *[(F.col(f"_{k}") + F.sum(c).over(within)).alias(name) for k, (name, c) in enumerate(sums.items())])
    return out


def curve(pairs: DataFrame) -> DataFrame:
    """(sim, p, n, tp, fp) after each distinct score, from the highest down."""
    ties = pairs.groupBy("sim").agg(F.count_if("same").alias("p"), F.count_if(~F.col("same")).alias("n"))
    return running(ties, "sim", True, {"tp": "p", "fp": "n"})


def average_precision(pairs: DataFrame) -> DataFrame:
    """(average_precision, best_f1, threshold): precision summed over steps of recall, and the best F1 (ties to the higher threshold)."""
    c = curve(pairs)
    positives = pairs.agg(F.count_if("same")).first()[0]
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    f1 = ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.lit(positives))
    return c.agg((F.sum(precision * F.col("p")) / F.lit(positives or None)).alias("average_precision"), F.max(f1).alias("best_f1"), F.max_by("sim", F.struct(f1, F.col("sim"))).alias("threshold"))


def roc_auc(pairs: DataFrame) -> DataFrame:
    """(auc,): the area under the curve, tied scores as one step of half their width."""
    c = curve(pairs)
    p, n = pairs.agg(F.count_if("same"), F.count_if(~F.col("same"))).first()
    return c.agg((F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / F.lit(p * n or None)).alias("auc"))


def threshold_for_fpr(pairs: DataFrame, fprs: Sequence[float]) -> DataFrame:
    """(fpr, threshold): the score of the negative at index n - int(fpr n) - 1 in ascending order, 0 at least.

    Equal scores are counted together.
    """
    ties = pairs.where(~F.col("same")).groupBy("sim").agg(F.count("*").alias("c"))
    n = pairs.agg(F.count_if(~F.col("same"))).first()[0]
    wanted = pairs.sparkSession.createDataFrame([(float(f), max(0, n - int(f * n) - 1)) for f in fprs], "fpr double, at long")
    ranked = running(ties, "sim", False, {"upto": "c"}).select("sim", (F.col("upto") - F.col("c")).alias("from"), "upto")
    return F.broadcast(wanted).join(ranked, (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto"))).select("fpr", F.col("sim").alias("threshold"))


def kfold_accuracy(pairs: DataFrame, thresholds: Sequence[float], strict: bool = False) -> DataFrame:
    """(fold, threshold, accuracy, mean, std) of pairs (fold, sim, same): the first best threshold on the other folds, scored on its own; mean and population deviation are those of the folds' accuracies.

    Right answers are counted once by fold and threshold; a training count is the total less the fold.
    """
    grid = sorted(thresholds)
    passes = (lambda x: F.col("sim") > x) if strict else (lambda x: F.col("sim") >= x)
    right = [F.count_if(passes(F.lit(x)) == F.col("same")).alias(f"c{k}") for k, x in enumerate(grid)]
    by_fold = pairs.groupBy("fold").agg(F.count("*").alias("n"), *right)
    long = by_fold.select("fold", "n", F.posexplode(F.array(*[f"c{k}" for k in range(len(grid))])).alias("k", "right"))
    total = F.sum("right").over(Window.partitionBy("k")), F.sum("n").over(Window.partitionBy("k"))
    train = long.withColumn("train", (total[0] - F.col("right")) / F.nullif(total[1] - F.col("n"), F.lit(0)))
    best = train.groupBy("fold").agg(F.max_by(F.struct("k", "right", "n"), F.struct("train", -F.col("k"))).alias("x"))
    threshold = F.element_at(F.array(*[F.lit(float(x)) for x in grid]), F.col("x.k") + 1)
    folds = best.select("fold", threshold.alias("threshold"), (F.col("x.right") / F.col("x.n")).alias("accuracy"))
    return folds.crossJoin(F.broadcast(folds.agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))))  # one row


def pair_counts(labels: DataFrame) -> DataFrame:
    """(grid columns.., tp, fp, fn) of same-cluster pairs by contingency counts, from rows (point, label, truth); label -1 is noise and pairs with nothing."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = labels.where("label >= 0").groupBy("point", "label", "truth").agg(F.count("*").alias("n"))
    tp = cells.groupBy("point").agg(two("n").alias("tp"))
    predicted = cells.groupBy("point", "label").agg(F.sum("n").alias("n")).groupBy("point").agg(two("n").alias("predicted"))
    actual = labels.groupBy("point", "truth").agg(F.count("*").alias("n")).groupBy("point").agg(two("n").alias("actual"))
    out = actual.join(tp, "point", "left").join(predicted, "point", "left").na.fill(0, ["tp", "predicted"])
    return out.select("point", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("actual") - F.col("tp")).alias("fn"))


def grid_eval(labels: DataFrame) -> DataFrame:
    """(point, clusters, noise, precision, recall, f1) of labelled rows (point, label, truth) of each grid point."""
    shape = labels.groupBy("point").agg(F.countDistinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), (F.count_if(F.col("label") < 0) / F.count("*")).alias("noise"))
    return shape.join(with_rates(pair_counts(labels)), "point").select("point", "clusters", "noise", "precision", "recall", "f1")
