"""Steps whose memory doesn't grow with what they meet."""

import tracemalloc

import numpy as np

from shoal.functions import udfs as U
from shoal.operators import simjoin as J


def test_most_similar_in_strips(monkeypatch):
    monkeypatch.setattr(J, "STRIP", 7)
    monkeypatch.setattr(J, "PROTOS", 16)
    rng = np.random.default_rng(1)
    x, m = rng.integers(-2, 3, (60, 6)).astype(float), rng.integers(-2, 3, (100, 6)).astype(float)  # whole numbers: many ties
    sims = x @ m.T
    for last in (False, True):
        at, sim = J.most_similar(x, m, last)
        assert at.tolist() == (99 - sims[:, ::-1].argmax(1) if last else sims.argmax(1)).tolist() and (sim == sims.max(1)).all()


def test_prototypes_cost_no_memory():
    x, m = np.ones((3000, 8)), np.ones((20_000, 8))
    tracemalloc.start()
    J.most_similar(x, m, False)
    assert tracemalloc.get_traced_memory()[1] < 50e6  # all products at once take 480 MB
    tracemalloc.stop()


def test_detected_things_go_out_in_turn(spark, monkeypatch):
    """No frame holds more than FOUND things, and none is lost."""
    sizes, frame = [], U.pd.DataFrame
    monkeypatch.setattr(U, "FOUND", 10)
    monkeypatch.setattr(U.pd, "DataFrame", lambda rows, columns: sizes.append(len(rows)) or frame(rows, columns=columns))

    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return list(run(iter([frame({"k": [1, 2, 3], "t": [4, 0, 33]})])))

    out = U.detect(Rows(), "k", "t", lambda: lambda n: [(j, 0, 0, 1, 1, [j]) for j in range(n)])
    assert max(sizes) <= 10
    assert [(k, i) for pdf in out for k, i in zip(pdf["k"], pdf["face_idx"], strict=True)] == [(1, i) for i in range(4)] + [(3, i) for i in range(33)]
