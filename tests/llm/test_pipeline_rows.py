"""Each stage of the pipeline with nulls in any column, rows alike but for nulls, repeats, clashing names and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shoal.llm import common, sharding

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "_row", "key", "equal", "_equal", "taken", "_taken", "_copy", "_tie", "tie", "_at", "at", "part", "_rank", "rank", "n", "group", "first", "id", "start", "stats", "n_shingles", "component_id", "n_tokens", "epoch", "domain"]


@pytest.fixture(scope="module")
def C():
    import corpus_pipeline

    return corpus_pipeline


def words(seed):
    random.seed(seed)
    return " ".join(f"w{random.randrange(5000)}" for _ in range(30))


def rows_of(df, columns):
    return Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def test_keys(spark, C):
    rows = [(7, "t", "xx", None, None), (7, "t", None, "xx", None), (7, None, "t", "xx", None), (7, "t", "xx", "", None), (7, "t", "xx", None, 0), (7, "t", "xx", None, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("more", F.array(F.lit(1), F.lit(None))).withColumn("map", F.create_map(F.lit("a"), F.lit(1)))
    other = df.limit(1).withColumn("more", F.array(F.lit(None), F.lit(1)))
    keys = [r[0] for r in C.keyed(df.unionByName(other)).select("key").collect()]
    assert len(set(keys)) == 6 and all(len(k) == 32 for k in keys)


@pytest.mark.parametrize("name", [n for n, _ in __import__("corpus_pipeline").STAGES])
def test_stage(spark, C, name):
    stage = dict(C.STAGES)[name]
    rows = [(7, words(1), "xx", None, 5), (7, words(1), None, "xx", 5), (8, words(2), "en", "src1", None), (None, words(3), None, None, None), (None, words(3), None, None, None), (9, None, "en", "src1", 0), (9, "", "en", "src1", 0),
            (10, words(4), "de", "src2", 1), (10, words(5), "de", "src2", 1), (11, words(6) + " x" * 40_000, "de", None, 2)]
    df = spark.createDataFrame(rows, DOC)
    for k, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(f"v{k}"))
    df = common.table(df.withColumn("nested", F.struct(F.lit(1).alias("key"))), "stage")
    out = stage(spark, df, SF)
    assert out.columns[: len(df.columns)] == df.columns
    want, got = rows_of(df.drop("nested"), df.columns[:-1]), rows_of(out.drop("nested"), df.columns[:-1])
    assert set(got) <= set(want) and got
    if name == "n-gram Jaccard join":  # of 7 one stays, of 9 one
        assert sum(got.values()) == 8 and sum(n for r, n in got.items() if r[0] == 7) == 1 and sum(n for r, n in got.items() if r[0] == 9) == 1
    if name in ("benchmark decontamination", "sharding"):
        assert got == want
    if name == "mixing sources to target weights":
        assert {r[0] for r in got} >= {8, 10}
    none = stage(spark, df.where("1 = 0"), SF)
    assert none.count() == 0 and none.columns == out.columns


def test_mix_tells_rows_alike_but_for_nulls_apart(spark, C):
    rows = [(7, words(1), "xx", None, 5), (7, words(1), None, "xx", 5)]
    df = common.table(spark.createDataFrame(rows, DOC), "alike")
    assert set(rows_of(C.mix(spark, df, SF), df.columns)) == set(rows)


def test_shards_prune(spark, C, tmp_path):
    """Written shards let a reader skip files by their minima and maxima; brute-force order by curve, id and place."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").drop("text")
    at = sharding.shard(docs, 24, ["n_chars"], ["lang", "source"], "doc_id")
    rows = at.orderBy("shard", "slot").collect()
    assert [(r["curve"], r["doc_id"]) for r in rows] == sorted((r["curve"], r["doc_id"]) for r in rows)
    assert [r["shard"] for r in rows] == [s for s in range(24) for _ in range((s + 1) * len(rows) // 24 - s * len(rows) // 24)]

    def read(place):
        """Shards that a filter on each dimension must read, of all shards and filters."""
        spans = {}
        for i, r in enumerate(rows):
            for c in ("n_chars", "lang", "source"):
                low, high = spans.get((place(i, r), c), (r[c], r[c]))
                spans[place(i, r), c] = min(low, r[c]), max(high, r[c])
        found = total = 0
        for c in ("n_chars", "lang", "source"):
            for value in {r[c] for r in rows}:
                inside = [low <= value <= high for (_, k), (low, high) in spans.items() if k == c]
                found, total = found + sum(inside), total + len(inside)
        return found / total

    hilbert, by_id = read(lambda i, r: r["shard"]), read(lambda i, r: r["doc_id"] % 24)
    assert hilbert < 0.6 * by_id
    path = f"{tmp_path}/shards"
    sharding.write_shards(at, path)
    assert rows_of(spark.read.parquet(path), ["doc_id", "slot", "shard"]) == rows_of(at, ["doc_id", "slot", "shard"])
