"""Cells fitted on a part of the vectors still index all of them."""

import numpy as np

from shoal.operators import simjoin as J


def test_cells_of_a_sample(spark, monkeypatch):
    monkeypatch.setattr(J, "FIT", 4096, raising=False)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((1100, 16)), 4, 0) + 0.2 * rng.standard_normal((4400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    got = {(a, b): s for a, b, s in J.cell_join(df, 0.8, cells=64).collect()}
    sims = x @ x.T
    want = {(a, b) for a, b in zip(*(i.tolist() for i in np.nonzero(sims >= 0.8)), strict=True) if a < b}
    assert got.keys() <= want and len(got) >= 0.95 * len(want)
    assert all(abs(s - sims[k]) < 1e-9 for k, s in got.items())
