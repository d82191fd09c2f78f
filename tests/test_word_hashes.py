"""Hashes of texts' words, counted in batches."""

import hashlib
import re

import pytest

from shoal.operators import graph as G


def by_hand(texts):
    words = [w for t in texts for w in {w for w in re.split("[ \t\n\x0b\f\r]+", t or "") if w}]
    values = [int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words]
    return sum(1 << b for b in range(60) if 2 * sum(v >> b & 1 for v in values) > len(values))


@pytest.mark.parametrize("part", [3, 1 << 16])
def test_majority_of_bits(spark, monkeypatch, part):
    monkeypatch.setattr(G, "PART", part, raising=False)
    texts = ["a b a  c\n", None, "", " \t\x0b\f\r\n", "één woord twee\x1cdrie vier", " ".join(f"w{k % 70}" for k in range(200)), "a", "b c d e", "x y"]
    rows = [*enumerate(texts), (8, "y z"), (None, "q r")]  # an id twice, and none
    got = G.simhash_words(spark.createDataFrame(rows, "id long, text string").coalesce(1)).collect()
    assert {r["id"]: r["h"] for r in got} == {i: by_hand([t for j, t in rows if j == i]) for i, _ in rows} and len(got) == 10


def test_no_row_for_a_word(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(20)], "id long, text string")
    assert "Generate" not in G.simhash_words(docs)._jdf.queryExecution().optimizedPlan().toString()
