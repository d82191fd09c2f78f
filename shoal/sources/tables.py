"""Readers and writers: media listings, sidecars, indexes, vectors, face logs, pair files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir

PHOTO = "photo_id long, path string, timestamp string, location string, lat double, lon double, person_ids array<long>, phash long, asset_id string, device_id string"
SIDECAR = "asset_id string, device_id string, created string, lat double, lon double"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet and read it again under its schema."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_media(spark: SparkSession, root: str, suffixes: Sequence[str] = ("jpg", "jpeg", "png")) -> DataFrame:
    """A1: (path, modified, length) of files of some suffixes at any depth, case of the suffix ignored, by path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike("\\.(" + "|".join(suffixes) + ")$")).select("path", F.col("modificationTime").alias("modified"), "length").orderBy("path")


def capture_meta(media: DataFrame, sidecars: DataFrame, exif: DataFrame) -> DataFrame:
    """A2: (stem, taken, lat, lon): a sidecar's date and point come before those of EXIF, then the file's own time. A sidecar's point stays without a date."""
    both = media.join(sidecars.select("stem", "created", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "stem", "left").join(exif.select("stem", "exif_ts", F.col("lat").alias("elat"), F.col("lon").alias("elon")), "stem", "left")
    return both.select("stem", F.coalesce("created", "exif_ts", "modified").alias("taken"), F.coalesce("slat", "elat").alias("lat"), F.coalesce("slon", "elon").alias("lon"))


def read_index(spark: SparkSession, path: str, schema: str = PHOTO) -> DataFrame:
    """A3: an index of JSON arrays of records; fields that old files lack are null, and no file is an empty index."""
    try:
        return spark.read.schema(schema).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def write_index(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_face_log(df: DataFrame, path: str) -> None:
    """A5: append face records (asset, face_idx, v, box); a torn append is never seen, as Spark commits whole files."""
    df.write.mode("append").parquet(path)


def last_of_log(log: DataFrame) -> DataFrame:
    """The faces of the last record of each asset, by seq."""
    last = log.groupBy("asset").agg(F.max("seq").alias("seq"))
    return log.join(last, ["asset", "seq"], "left_semi")


def split_bad_records(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) of JSON lines (value): what doesn't decode is set aside as it came. A failed read raises and changes nothing."""
    got = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return got.where(~bad).select("r.*").drop("_bad"), got.where(bad).select("value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file or of the ordered files of a folder: a line's number is the lines of the splits before its own and its place there."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))  # a row a split
    return lines.join(F.broadcast(starts), ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("pos"), F.col("value").alias("line"))


def verification_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(fold, same, name1, n1, name2, n2) of a pair file: a header of folds and size, then lines of three or four columns.

    A line's fold is its number over twice the size; its label is what its own columns say.
    """
    lines = numbered_lines(spark, path).withColumn("line", F.regexp_replace("line", "\\r$", ""))
    head = lines.where("pos = 0").select(F.split("line", "\t")[1].cast("int")).first()
    per = head[0] if head else 1
    c = F.split("line", "\t")
    rows = lines.where("pos > 0").withColumn("c", c).where(F.size("c").isin(3, 4)).withColumn("same", F.size("c") == 3)
    return rows.select(F.floor((F.col("pos") - 1) / (2 * per)).cast("int").alias("fold"), "same", F.col("c")[0].alias("name1"), F.col("c")[1].cast("int").alias("n1"),
                       F.when(F.col("same"), F.col("c")[0]).otherwise(F.col("c")[2]).alias("name2"), F.when(F.col("same"), F.col("c")[2]).otherwise(F.col("c")[3]).cast("int").alias("n2"))
