"""Counts of people dealt into parts of the caller's choice."""

from shoal.operators import people as P


def test_counts_in_parts(spark):
    seen = spark.createDataFrame([(i % 40, i % 7) for i in range(400)] + [(1, 2)] * 5, "photo_id long, person_id long")
    canonical = spark.createDataFrame([(i, 0 if i == 3 else i) for i in range(7)], "person_id long, canonical_id long")
    deleted = spark.createDataFrame([(i,) for i in range(0, 40, 9)], "photo_id long")
    held = {(i % 40, 0 if i % 7 == 3 else i % 7) for i in range(400)} | {(1, 2)}
    want = {p: len({a for a, b in held if b == p and a % 9}) for p in {b for _, b in held}}
    got = P.people_counts(seen, canonical, deleted, parts=13)
    assert {r["person_id"]: r["count"] for r in got.collect()} == want
    assert "hashpartitioning(photo_id" in (plan := got._jdf.queryExecution().toString()) and ", 13)" in plan
