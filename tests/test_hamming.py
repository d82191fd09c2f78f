"""The Hamming index and first-come deduplication against all pairs and rows taken in turn."""

import random

import pytest
from pyspark.sql import functions as F

from shoal.functions import vectors as V
from shoal.operators import hamming as H
from shoal.operators import maintain as M
from shoal.streaming import incremental as R


def near(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def copies(n, flips, seed, common=0):
    """Hashes around n centres; `common` low bits are the same in all."""
    random.seed(seed)
    base = [random.getrandbits(64) for _ in range(n)]
    rows = [b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, flips))) for b in base for _ in range(5)]
    low = (1 << common) - 1
    return [H.signed(x & ~low & (2**64 - 1)) for x in rows]


def frame(spark, hashes):
    return spark.createDataFrame(list(enumerate(hashes)) + [(900, None)], "id long, h long")


def brute(hashes, most):
    return {(a, b, near(x, y)) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if a < b and near(x, y) <= most}


@pytest.mark.parametrize(("most", "common", "hot"), [(0, 0, 512), (3, 0, 512), (7, 0, 512), (14, 0, 512), (20, 0, 512), (7, 40, 20), (7, 56, 3), (5, 30, 1), (64, 0, 512)])
def test_join(spark, monkeypatch, most, common, hot):
    monkeypatch.setattr(H, "HOT", hot)
    hashes = copies(60, 9, most, common)
    assert {tuple(r) for r in H.hamming_join(frame(spark, hashes), most).collect()} == brute(hashes, most)
    df = frame(spark, hashes)
    got = {tuple(r) for r in H.hamming_join(df.where("id % 2 = 0"), most, df.where("id % 2 = 1")).collect()}
    assert got == {(a, b, near(x, y)) for a, x in enumerate(hashes) for b, y in enumerate(hashes) if a % 2 == 0 and b % 2 and near(x, y) <= most}


def test_hot_values_are_looked_up_by_the_other_bits(spark, monkeypatch):
    """Hashes that agree in a band don't meet for that alone."""
    hashes = list({h for h in copies(400, 4, 3, 24)})
    one, two = (spark.createDataFrame([(h,) for h in hashes], f"{c} long") for c in "hg")
    monkeypatch.setattr(H, "HOT", 10**9)
    flat = H.candidates(one, two, 3, len(hashes)).count()
    monkeypatch.setattr(H, "HOT", 16)
    assert H.candidates(one, two, 3, len(hashes)).count() < 0.1 * flat


def test_candidates_stay_flat(spark):
    """Candidates a row of random hashes don't grow with their number: bands do."""
    random.seed(5)
    shares = []
    for n in (2000, 20_000):
        hashes = [H.signed(random.getrandbits(64)) for _ in range(n)]
        one, two = (spark.createDataFrame([(h,) for h in hashes], f"{c} long") for c in "hg")
        shares.append(H.candidates(one, two, 7, n).count() / n)
    assert shares[1] < 3 * max(shares[0], 1) and shares[1] < 0.002 * 20_000


def in_turn(rows, most, known=()):
    kept = []
    for i, h in sorted(rows, key=lambda r: r[0]):
        if h is None or all(near(h, k) > most for k in [*known, *[x for _, x in kept if x is not None]]):
            kept.append((i, h))
    return kept


def test_first_come(spark):
    for seed, flips, most in ((1, 6, 7), (2, 9, 7), (3, 3, 10), (4, 2, 0)):
        hashes = copies(25, flips, seed)
        random.shuffle(hashes)
        rows = [*enumerate(hashes), (500, hashes[0]), (501, None), (502, None)]
        df = spark.createDataFrame(rows, "id long, h long")
        assert {r[0] for r in H.first_come(df, most).collect()} == {i for i, _ in in_turn(rows, most)}
        known = hashes[3:9]
        assert {r[0] for r in H.first_come(df, most, spark.createDataFrame([(h,) for h in known], "h long")).collect()} == {i for i, _ in in_turn(rows, most, known)}
    chain = [(i, (1 << (4 * min(i, 15))) - 1 if i < 16 else None) for i in range(17)]  # each is near the next only
    assert {r[0] for r in H.first_come(spark.createDataFrame(chain, "id long, h long"), 7).collect()} == {i for i, _ in in_turn(chain, 7)}
    assert H.first_come(df.where("1 = 0"), 7).count() == 0


def test_uploads_whatever_the_batches(spark, tmp_path):
    hashes = [0, 0x7F, 0x3FFF, 0x3FFF, 0x7FFFFF, *copies(12, 8, 6)]
    want = {i for i, _ in in_turn(enumerate(hashes), 7)}
    assert {0, 2} <= want and 1 not in want
    for k, cuts in enumerate(([], [1, 2], [2, 9, 30, 31])):
        path = f"{tmp_path}/{k}"
        do = R.skip_duplicates(lambda b: b, path)
        for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(hashes)], strict=True)):
            batch = spark.createDataFrame([(i, hashes[i]) for i in range(a, b)], "id long, h long")
            do(batch, number)
            do(batch, number)  # run again
        assert {r["id"] for r in spark.read.parquet(path).collect()} == want


def test_upload_actions_in_turn(spark):
    random.seed(11)
    hashes = copies(30, 7, 9)
    index = [(1000 + i, h, i % 3 == 0) for i, h in enumerate(hashes[::4])] + [(2000, hashes[0], True), (2001, None, False)]
    uploads = [(i, h) for i, h in enumerate(hashes) if i % 4] + [(700, hashes[1]), (701, None)]
    want, added, restored = {}, [], set()
    for i, h in uploads:
        met = [] if h is None else [(near(h, g), not gone, j) for j, g, gone in [*index, *added] if g is not None and near(h, g) <= 5]
        if met:
            _, active, j = min(met)
            want[i] = (j, "skip" if active or j in restored else "restore")
            restored |= set() if active else {j}
        else:
            want[i] = (None, "add")
            added.append((i, h, False))
    got = M.upload_dedup(spark.createDataFrame(uploads, "id long, h long"), spark.createDataFrame(index, "id long, h long, is_deleted boolean")).collect()
    assert {r["upload"]: (r["match"], r["action"]) for r in got} == want
    assert {a for _, a in want.values()} == {"skip", "restore", "add"}


def test_sign_hash_of_any_width(spark):
    random.seed(2)
    rows = [(i, [random.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate((3, 64, 65, 65, 512, 512))] + [(6, None)]
    rows += [(10 + i, v) for i, v in rows]
    df = spark.createDataFrame(rows, "id long, v array<double>").select("id", V.sign_hash("v").alias("h"))
    got = dict(tuple(r) for r in df.collect())
    assert all(got[i] == got[i + 10] for i in range(7)) and got[6] is None and len({got[i] for i in range(6)}) == 6
    for i in range(2):
        bits = [int(x > 0) for x in rows[i][1]]
        assert got[i] == H.signed(int("".join(map(str, bits)), 2))
    flipped = df.sparkSession.createDataFrame([(0, [-x if k == 300 else x for k, x in enumerate(rows[4][1])])], "id long, v array<double>").select(V.sign_hash("v")).first()[0]
    assert near(flipped, got[4]) == 1
    assert H.hamming_join(df.where(F.col("id").isin(2, 12)), 0).count() == 1
