"""Quality classifier as a sparse rule ensemble.

Trees grown on statistics of labelled texts give their paths as conjunctive rules; a
logistic regression with an L1 penalty weighs the rules, most of which get none; the
rest are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, table

#: Labelled rows the model is fitted on at most (those with the least hash of their id).
MAX_LABELLED = 16_000
STATS = ("n_bytes", "n_words", "n_lines", "upper", "letters", "digits", "blanks", "marks", "symbols", "bangs", "bars", "word_len", "distinct", "repeats", "caps_words", "top_line")

_CLASS = np.zeros((8, 256))
_CLASS[0, 65:91] = 1  # upper case
_CLASS[1, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters; any byte of a longer character counts as one
_CLASS[2, 48:58] = 1
_CLASS[3, [9, 10, 11, 12, 13, 32]] = 1
_CLASS[4, [33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 1  # marks of prose
_CLASS[5] = (np.arange(256) > 32) & (_CLASS[:5].sum(0) == 0)  # other symbols
_CLASS[6, 33] = 1
_CLASS[7, 124] = 1


def describe(text: str | None) -> tuple[float, ...]:
    """STATS of a text; shares are of its bytes or words, and those of an empty text are 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(data))
    shares = _CLASS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    words = (text or "").split()
    w = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words, words[1:])) / w
    caps = sum(map(str.isupper, words)) / w
    top = 1 - len(set(lines)) / max(1, len(lines))
    return (float(len(data)), float(len(words)), float(len(lines)), *map(float, shares), len(data) / w, len(set(words)) / w**0.9, repeats, caps, top)


def stats_udf():
    """A column function from texts to their STATS. Only texts go to Python and only statistics come back; rows wait in the JVM."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def stats(texts: pa.Array) -> pa.Array:
        return pa.array([describe(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return stats.asNondeterministic()  # so that the optimiser doesn't repeat it where it is used


def with_stats(df: DataFrame, text: str) -> DataFrame:
    """(row struct of df's columns, stats array<double>) of each row, from its whole text."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), stats_udf()(F.col(text).cast("string")).alias("stats"))


class Rule(NamedTuple):
    """Conditions (statistic, above?, cut) that must all hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for i, above, cut in self.conditions:
            out = out & ((stats[i] > cut) if above else (stats[i] <= cut))
        return out


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-\d.eE+]+)\)")


def rules_of(described: str) -> list[Rule]:
    """The conjunctions along every path of the trees in a forest's printed form, each once."""
    path: list[tuple[int, tuple[int, bool, float]]] = []
    out: dict[Rule, None] = {}
    for line in described.splitlines():
        if line.strip().startswith("Tree "):
            path = []
        if m := _SPLIT.match(line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[3]), m[4] == ">", float(m[5])))]
            out[Rule(tuple(sorted({c for _, c in path})))] = None
    return list(out)


class Model(NamedTuple):
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: Column) -> Column:
        """The compiled ensemble: a column between 0 and 1."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def constant(share: float) -> Model:
    share = min(max(share, 0.01), 0.99)
    return Model(math.log(share / (1 - share)), [])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED,
        trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 17) -> Model:
    """Fit on at most `max_labelled` labelled rows that have a document.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice counts by
    its smaller label, one with several document rows by all of them. Without labelled
    documents, or with labels of one kind, the model is a constant.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).cast("double").alias("label"))
              .orderBy(F.xxhash64(id_col), id_col).limit(max_labelled))
    chosen = table(chosen, "labelled")  # max_labelled rows of two numbers at most
    known = with_stats(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen.toDF("id", "label")), "id"), "text")
    train = known.select("row.id", "row.label", array_to_vector("stats").alias("features"), "stats")
    train = table(train.repartition(1).sortWithinPartitions("id", "stats"), "train")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if n == 0 or ones in (0, n):
        drop(chosen), drop(train)
        return constant(ones / n if n else 0.5)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=128, minInstancesPerNode=max(2, n // 2000), featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=seed).fit(train)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return constant(ones / n)
    holds = F.array(*[r.column(F.col("stats")).cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(train.select("label", array_to_vector(holds).alias("features")))
    weights = [float(w) for w in lasso.coefficients.toArray()]
    drop(chosen), drop(train)
    return Model(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights, strict=True) if w])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score double) of each row of df. A null or empty text has a score too, that of all-zero statistics."""
    slim = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return with_stats(slim, "text").select(F.col("row.id").alias(id_col), model.score(F.col("stats")).alias("score"))


def keep(df: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of df, with all their columns, that score `least` or more."""
    return with_stats(df, text).where(model.score(F.col("stats")) >= least).select("row.*")
