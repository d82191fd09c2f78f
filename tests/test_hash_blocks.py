"""Hashes compared in blocks where a limit is too wide for bands."""

import random

import pytest

from shoal.operators import hamming as H


@pytest.mark.parametrize("most", [0, 14, 18, 64])
def test_blocks_find_near_pairs_only(spark, monkeypatch, most):
    monkeypatch.setattr(H, "BLOCK", 50, raising=False)
    monkeypatch.setattr(H, "STEP", 1000, raising=False)
    random.seed(most)
    base = [random.getrandbits(64) for _ in range(60)]
    hashes = sorted({H.signed(b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 12)))) for b in base for _ in range(4)} | {0, -1, 2**63 - 1, -(2**63)})
    one, two = (spark.createDataFrame([(h,) for h in some], f"{c} long") for c, some in (("h", hashes), ("g", hashes[::2])))
    want = sorted((a, b) for a in hashes for b in hashes[::2] if ((a ^ b) & (2**64 - 1)).bit_count() <= most)
    assert sorted(tuple(r) for r in H.compared(one, two, most).collect()) == want


def test_wide_limits_bring_no_lists_of_masks(spark):
    """Of 67,000 hashes within 18 bits: the plan stays short, and only near pairs are candidates."""
    one, two = (spark.createDataFrame([(h,) for h in range(1, 200)], f"{c} long") for c in "hg")
    met = H.candidates(one, two, 18, 67_000)
    assert len(met._jdf.queryExecution().optimizedPlan().toString()) < 5000
    random.seed(3)
    far = [H.signed(random.getrandbits(64)) for _ in range(400)]
    one, two = (spark.createDataFrame([(h,) for h in far], f"{c} long") for c in "hg")
    assert H.candidates(one, two, 18, 67_000).count() < 2 * len(far)
