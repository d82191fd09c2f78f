"""Hashes that agree in a mask meet in arrays, not as rows of candidates."""

import random

import pytest

from shoal.operators import hamming as H


def near(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def around(n, flips, bits):
    base = [random.getrandbits(bits) for _ in range(n)]
    return sorted({H.signed(b ^ sum(1 << k for k in random.sample(range(bits), random.randint(0, flips)))) for b in base for _ in range(4)})


@pytest.mark.parametrize(("most", "bits", "block"), [(0, 64, 9999), (3, 64, 9999), (7, 64, 9999), (7, 60, 9999), (7, 12, 9999), (2, 64, 3)])
def test_near_pairs(spark, monkeypatch, most, bits, block):
    """All near pairs once, also where few bits vary, and where a group is larger than a block and another way is taken."""
    for name, size in (("COPY", 0), ("STEP", 50), ("BUCKET", 300), ("BLOCK", block)):
        monkeypatch.setattr(H, name, size, raising=False)
    random.seed(most + bits)
    hashes = around(60, most + 2, bits)
    one = spark.createDataFrame([(h,) for h in hashes], "h long")
    assert sorted(map(tuple, H.near_hashes(one, most).collect())) == sorted((a, b, near(a, b)) for a in hashes for b in hashes if a < b and near(a, b) <= most)
    other = around(20, most, bits) + hashes[::3]
    two = spark.createDataFrame([(h,) for h in other], "g long")
    assert sorted(map(tuple, H.near_hashes(one, most, two).collect())) == sorted((a, b, near(a, b)) for a in hashes for b in set(other) if near(a, b) <= most)
    assert H.near_hashes(one.where("1 = 0"), most).count() == 0


def test_no_rows_for_candidates(spark, monkeypatch):
    """20,000 hashes of 60 bits within 7: only near pairs leave a task, where bands make a row for some 500 candidates a hash."""
    monkeypatch.setattr(H, "COPY", 50, raising=False)
    random.seed(1)
    left = spark.createDataFrame([(random.getrandbits(60),) for _ in range(20_000)], "h long")
    assert H.grouped(left, None, 7, 20_000, (1 << 60) - 1).count() < 1000


def test_masks_that_must_agree():
    for most, n in ((0, 10**6), (3, 10**6), (7, 10**5), (7, 3 * 10**6)):
        masks = H.agreeing(most, n, (1 << 60) - 1)
        random.seed(n)
        assert masks and all(any(not d & m for m in masks) for d in (sum(1 << b for b in random.sample(range(60), most)) for _ in range(300)))
    assert H.agreeing(7, 1000, (1 << 60) - 1) == [] and H.agreeing(18, 10**6, (1 << 60) - 1) == []


def test_first_come_in_groups(spark, monkeypatch):
    """A batch against itself and what is stored, without a row for a candidate; kept as rows taken in turn."""
    monkeypatch.setattr(H, "COPY", 0, raising=False)
    monkeypatch.setattr(H, "candidates", lambda *_: 1 / 0)
    random.seed(8)
    hashes = around(60, 8, 60)
    random.shuffle(hashes)
    known, kept = hashes[:40], []
    for i, h in enumerate(hashes[40:]):
        if all(near(h, k) > 7 for k in [*known, *[x for _, x in kept]]):
            kept.append((i, h))
    got = H.first_come(spark.createDataFrame(list(enumerate(hashes[40:])), "id long, h long"), 7, spark.createDataFrame([(h,) for h in known], "h long"))
    assert sorted(r[0] for r in got.collect()) == [i for i, _ in kept] and kept
