"""Tasks that meet hashes are as many as their work asks for, and what is empty is not met."""

import random

import pytest

from shoal.operators import graph as G
from shoal.operators import hamming as H
from test_hash_groups import around, near
from test_word_hashes import by_hand


def test_tasks_by_work(spark, monkeypatch):
    """A few bytes a row are much work, so tasks aren't made by size."""
    monkeypatch.setattr(H, "BUCKET", 1000)
    random.seed(2)
    left = spark.createDataFrame([(random.getrandbits(60),) for _ in range(5000)], "h long")
    met = H.grouped(left, None, 7, 5000 * 36, (1 << 60) - 1)
    assert met.rdd.getNumPartitions() > 100


@pytest.mark.parametrize("block", [20, 2])
def test_large_sets_of_small_groups(spark, monkeypatch, block):
    """Groups that are counted as one are counted by themselves before another way is taken."""
    for name, size in (("COPY", 0), ("BLOCK", block), ("SETS", 1)):
        monkeypatch.setattr(H, name, size, raising=False)
    random.seed(3)
    hashes = around(12, 4, 60)
    one = spark.createDataFrame([(h,) for h in hashes], "h long")
    assert (H.grouped(one, None, 2, len(hashes), (1 << 60) - 1) is None) == (block == 2)
    assert sorted(map(tuple, H.near_hashes(one, 2).collect())) == sorted((a, b, near(a, b)) for a in hashes for b in hashes if a < b and near(a, b) <= 2)


def test_nothing_stored_yet(spark, monkeypatch):
    """The first batch of a stream isn't compared with what is not there."""
    whole = H.candidates
    monkeypatch.setattr(H, "candidates", lambda left, right, most, n: whole(left, right, most, n) if n else 1 / 0)
    rows = spark.createDataFrame([(0, 0), (1, 0x7F), (2, 0x3FFF), (3, None), (4, 0)], "id long, h long")
    none = spark.createDataFrame([], "h long")
    assert H.near_hashes(rows.select("h"), 7, none.select(none.h.alias("g"))).columns == ["h", "g", "dist"]
    assert sorted(r[0] for r in H.first_come(rows, 7, none).collect()) == [0, 2, 3]


def test_long_chain(spark, monkeypatch):
    """More rounds than tables of what was kept."""
    monkeypatch.setattr(H, "TABLES", 2, raising=False)
    rows = spark.createDataFrame([(k, (1 << k) - 1) for k in range(12)], "id long, h long")
    assert sorted(r[0] for r in H.first_come(rows, 1).collect()) == list(range(0, 12, 2))


@pytest.mark.parametrize("part", [300, 1 << 16])
def test_words_beyond_a_byte(spark, monkeypatch, part):
    """A bit that more than 255 words of a text have is counted over several bytes."""
    monkeypatch.setattr(G, "PART", part)
    texts = [" ".join(f"{t}w{k}" for k in range(n)) for t, n in enumerate((254, 255, 256, 1021, 2))]
    got = G.simhash_words(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)).collect()
    assert {r["id"]: r["h"] for r in got} == {i: by_hand([t]) for i, t in enumerate(texts)}
