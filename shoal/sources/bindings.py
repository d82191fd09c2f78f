"""The given tables seen as the data model: DataFrames, and the same as SQL for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the bound tables, by name.
BOUND = {
    "photos": """photos AS (SELECT o_orderkey AS photo_id, o_orderdate AS ts, o_orderpriority AS device_id, o_orderstatus AS folder, o_custkey AS owner,
  n_name || ', ' || r_name AS place, CASE WHEN o_orderkey % 10 <> 0 THEN ((o_custkey * 37) % 1700) / 10.0 - 85 END AS lat,
  CASE WHEN o_orderkey % 10 <> 0 THEN ((o_custkey * 53) % 3500) / 10.0 - 175 END AS lon, o_orderkey % 17 = 0 AS is_deleted, o_orderkey % 5 = 0 AS is_video,
  CAST(o_orderkey * 7 % 900 AS DOUBLE) / 10 AS duration
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "faces": """faces AS (SELECT l_orderkey AS photo_id, l_linenumber * 1000000 + l_partkey AS face_idx, l_suppkey AS person_id, l_quantity / 100 AS area,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_extendedprice END AS sharpness FROM lineitem)""",
    "photo_people": "photo_people AS (SELECT DISTINCT l_orderkey AS photo_id, l_suppkey AS person_id FROM lineitem)",
    "persons": """persons AS (SELECT s_suppkey AS person_id, s_name AS name, CASE WHEN s_suppkey BETWEEN 51 AND 59 THEN s_suppkey - 50 WHEN s_suppkey = 50 THEN 3 END AS merged_into,
  s_suppkey % 23 = 22 AS hidden FROM supplier)""",
    "aliases": "aliases AS (SELECT n_name || ', ' || r_name AS place, CASE WHEN n_nationkey % 3 = 0 THEN 'Home ' || n_nationkey WHEN n_nationkey % 3 = 1 THEN '' END AS alias FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "canonical": """canonical AS (SELECT person_id, coalesce(merged_into, person_id) AS canonical_id FROM (SELECT s_suppkey AS person_id,
  CASE WHEN s_suppkey BETWEEN 51 AND 59 THEN s_suppkey - 50 WHEN s_suppkey = 50 THEN 3 END AS merged_into FROM supplier))""",
    "vectors": "vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)",
    "near": """near AS (SELECT a.vec_id, list_transform(range(1, 65), lambda k: (0.2 * list_extract(CAST(a.embedding AS DOUBLE[]), k) + 0.9 * list_extract(CAST(b.embedding AS DOUBLE[]), k))) AS raw, a.label
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 5), blocks AS (SELECT vec_id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS v, label FROM near)""",
}


def bound(*names: str) -> str:
    """The start of a WITH clause that defines the named tables."""
    return "WITH " + ",\n".join(BOUND[n] for n in names)


class Tables:
    """The bound tables of a folder, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def photos(self) -> DataFrame:
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(", ", "n_name", "r_name").alias("place"))
        owners = self.read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "place")
        key, owner = F.col("o_orderkey"), F.col("o_custkey")
        geo = key % 10 != 0
        return self.read("orders").join(owners, owner == F.col("c_custkey")).select(
            key.alias("photo_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("device_id"), F.col("o_orderstatus").alias("folder"), owner.alias("owner"), "place",
            F.when(geo, (owner * 37 % 1700) / 10 - 85).alias("lat"), F.when(geo, (owner * 53 % 3500) / 10 - 175).alias("lon"),
            (key % 17 == 0).alias("is_deleted"), (key % 5 == 0).alias("is_video"), ((key * 7 % 900).cast("double") / 10).alias("duration"))

    @cached_property
    def faces(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("photo_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("face_idx"), F.col("l_suppkey").alias("person_id"),
            (F.col("l_quantity") / 100).alias("area"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_extendedprice")).alias("sharpness"))

    @cached_property
    def photo_people(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id")).distinct()

    @cached_property
    def persons(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(k.alias("person_id"), F.col("s_name").alias("name"),
                                            F.when(k.between(51, 59), k - 50).when(k == 50, F.lit(3).cast("long")).alias("merged_into"), (k % 23 == 22).alias("hidden"))

    @cached_property
    def aliases(self) -> DataFrame:
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        k = F.col("n_nationkey")
        return places.select(F.concat_ws(", ", "n_name", "r_name").alias("place"), F.when(k % 3 == 0, F.concat(F.lit("Home "), k.cast("string"))).when(k % 3 == 1, F.lit("")).alias("alias"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")

    @cached_property
    def blocks(self) -> DataFrame:
        """Vectors in near groups of five: 0.2 of the own one and 0.9 of the group's first, normalised."""
        from shoal.functions.vectors import scale, unit, weighted_sum

        base = self.vectors.select(F.col("vec_id").alias("base"), F.col("v").alias("w"))
        return self.vectors.join(base, F.col("base") == F.col("vec_id") - F.col("vec_id") % 5).select("vec_id", unit(weighted_sum(scale("v", 0.2), scale("w", 0.9))).alias("v"), "label")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")
