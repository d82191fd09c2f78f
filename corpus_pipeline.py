"""From raw documents to shards: classify, deduplicate, decontaminate, mix and shard.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns what
it keeps, which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from shoal.llm import decontaminate, mixing, ngram_join, quality, queries, sharding
from shoal.llm.common import table

LEAST_QUALITY = 0.3
SHARDS = 24


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key, doc_id, text, lang, source): each row as one value, so that no column of it can clash with a stage's own.

    The key is 128 bits of two hashes of all columns and of which are null, in hex: rows
    with no id or a repeated one are told apart, and rows that are equal in all share it.
    """
    nested = (ArrayType, MapType, StructType, VariantType)
    values = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if isinstance(docs.schema[c].dataType, nested) else F.col(c) for c in docs.columns]
    empty = [F.col(c).isNull() for c in docs.columns]  # hashes pass over nulls
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(salt), *values, *empty)), 16, "0") for salt in ("first", "second")]
    return docs.select(F.struct("*").alias("row"), F.concat(*halves).alias("key"), "doc_id", "text", "lang", "source")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels that aren't held out.

    Each row is judged by its own text, whatever its id, also a null or empty one; repeated
    rows share their lot. Extra columns stay as they are, whatever their names. An empty
    table gives an empty result.
    """
    labels = queries.read(spark, sf_dir, "labels").where(~queries.held_out(F.col("doc_id")))
    return quality.keep(docs, quality.fit(docs, labels), LEAST_QUALITY)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by n-grams: the one of the smallest id.

    Rows that repeat an id with texts that don't link are documents of their own; of
    those of a group, or without any words, one stays. Documents without an id all stay,
    and their texts still link others. Extra columns stay as they are, whatever their
    names. An empty table gives an empty result.
    """
    rows = keyed(docs)
    groups = ngram_join.jaccard_groups(rows, id_col="key").select("key", "n_shingles", "component_id").distinct()
    named = groups.join(rows.where("doc_id is not null").groupBy("key", "doc_id").agg(F.count("*").alias("equal")), "key")
    words = F.col("n_shingles") > 0
    firsts = named.groupBy(F.when(words, F.col("component_id")).alias("group"), F.when(~words, F.col("doc_id")).alias("alone")).agg(F.min(F.struct("doc_id", "key", "equal")).alias("first"))
    firsts = table(firsts.select("first.*"), "firsts")
    kept = one_of_equal(rows, firsts, ["doc_id", "key"])
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))


def one_of_equal(rows: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with those chosen (on, equal, ..): one row of as many as are equal. Only rows that have equals are moved for it."""
    lone, several = (chosen.where(c).drop("equal") for c in ("equal = 1", "equal > 1"))
    return rows.join(lone, on).unionByName(rows.join(several, on).dropDuplicates(["key"]))


def decontaminate_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Each row is judged by its own text, with an id or without, repeated or not; a null or
    empty text holds none. Extra columns stay as they are, whatever their names. An empty
    table gives an empty result.
    """
    rows = keyed(docs)
    leaking = decontaminate.leaks(rows, queries.read(spark, sf_dir, "benchmark"), id_col="key").select("key").distinct()
    return rows.join(table(leaking, "leaking"), "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture to target weights, as many tokens as there are; a document stands once for each epoch that takes it.

    Each row is mixed as a document of its own, with an id or without, repeated or not;
    texts without words weigh nothing. Extra columns stay as they are, whatever their
    names. An empty table gives an empty mixture.
    """
    rows = keyed(docs)
    taken = mixing.mix(rows, queries.domain_of(F.col("source")), 1.0, queries.MIX_WEIGHTS, id_col="key")
    equal = rows.groupBy("key").agg(F.count("*").alias("equal"))
    taken = table(taken.groupBy("key").agg(F.count("*").cast("int").alias("taken")).join(equal, "key"), "taken")
    # Equal rows share a key and are taken together: one of them stands for all.
    return one_of_equal(rows, taken, ["key"]).select("row", F.explode(F.sequence(F.lit(1), "taken"))).select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards along a Hilbert curve over length, language and source; adds shard, slot and curve.

    Every row has a slot of its own, with an id or without, repeated or not. Extra columns
    stay as they are, but for those named shard, slot or curve, which are replaced. An
    empty table gives an empty result.
    """
    return sharding.shard(docs, SHARDS, ["n_chars"], ["lang", "source"], "doc_id")


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate_), ("mixing sources to target weights", mix), ("sharding", shard)]

#: Trees, tiling and curves have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs, f"stage-{k}")
    return docs
