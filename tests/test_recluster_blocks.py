"""Reclustering sends each vector on a fixed number of times, however many cells or prototypes there are."""

import numpy as np
import pytest
from compare import assert_same, tables

from shoal.operators import pivots as P
from shoal.operators import simjoin as J
from shoal.plans import evaluate_queries, vector_queries
from shoal.plans.registry import QUERIES, SQL

assert evaluate_queries and vector_queries


def counted(monkeypatch, module):
    sent, meet = [], module.meets
    monkeypatch.setattr(module, "meets", lambda rows, reach, guests_only=False: sent.append(rows.count()) or meet(rows, reach, guests_only))
    return sent


def test_many_prototypes_meet_blocks_that_are_written_once(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(P, "FLAT", 32)
    sent = counted(monkeypatch, J)
    x, y = np.random.default_rng(3).standard_normal((2, 300, 8))
    y = np.concatenate([y[:100], y[:10]])
    v, p = (spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], f"{key} long, v array<double>") for m, key in ((x, "vec_id"), (y, "proto")))
    for last in (False, True):
        got = {r["vec_id"]: r["proto"] for r in J.nearest_prototype(v, p, -100.0, last_wins=last).collect()}
        first = (x @ y[:100].T).argmax(1).tolist()
        assert got == {i: k + 100 * (last and k < 10) for i, k in enumerate(first)}
    assert sent == [410, 410]


@pytest.mark.parametrize("name", ["i4_recluster_people", "j3_recluster_trigger"])
def test_faces_without_groups_are_sent_once_a_step(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(P, "CELL", 8)
    monkeypatch.setattr(P, "FLAT", 64)
    sent = counted(monkeypatch, P)
    x = np.random.default_rng(4).standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = tables("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(QUERIES[name](spark, str(tmp_path)), con, SQL[name])
    assert sent and set(sent) == {400}
