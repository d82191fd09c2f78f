"""The Merkle manifest, whitening and byte-level BPE against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import regex
from compare import assert_same, tables
from pyspark.sql import functions as F

from shoal.llm import byte_bpe, merkle, queries, whitening

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "one two three", "en", "src1", 3), (1, "one two three", "en", "src1", 3), (1, "another", "en", None, 3), (2, None, None, None, None), (3, "", "en", "src2", 0), (4, " \t\n ", "", "src2", 4), (None, "ÉÉ", "en", "x", 1),
       (None, "ÉÉ", None, "x", 1), (5, "longer and " * 30_000, "en", "src1", 9), (6, "é ▁ x\n\na  b ", "é", "src9", 2), (-7, "neg", "en", "s", -1)]
CLASH = ["tree", "pos", "n", "h", "leaf", "kept", "block", "rank", "at", "root", "subroot", "path", "step0", "lag1", "_at", "row"]


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    said = [None if x is None else str(x) for x in row]
    return h("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in said))


def tree(leaves, fanout):
    """(root, paths) of a list of digests, level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(at):
            start = p - p % fanout
            paths[i].append(("".join(level[start:p]), "".join(level[p + 1 : start + fanout])))
            at[i] = p // fanout
        level = [h("".join(level[s : s + fanout])) for s in range(0, len(level), fanout)]
    return level[0], paths


def expected(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf([r[0], r[3], r[2], r[4], r[1]])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops[g] = tree([x[1] for x in groups[g]], fanout)
    root, above = tree([tops[g][0] for g in names], fanout)
    return sorted((repr(x[0]), x[1], tops[g][0], root, repr(path + up)) for g, up in zip(names, above, strict=True) for x, path in zip(groups[g], tops[g][1], strict=True))


def manifest(df, fanout):
    out = merkle.manifest(df, merkle.leaf_of([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]), "lang", "doc_id", [F.col("doc_id")], fanout)
    assert out.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    rows = out.withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert all(r["proof"] == h("".join(s["before"] + s["after"] for s in r["path"])) for r in rows)
    return sorted((repr(r["doc_id"]), r["leaf"], r["subroot"], r["root"], repr([tuple(s) for s in r["path"]])) for r in rows)


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 8), (3, 9), (3, 1024), (5, 5)])
def test_merkle(spark, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    random.seed(fanout)
    rows = ODD + [(random.randrange(10**6), str(i), random.choice(["en", "en", "de", None, "zz"]), "s", i) for i in range(150)] + [(10**7 + i, "t", f"l{i}", "s", i) for i in range(12)]
    df = spark.createDataFrame(rows, DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    assert manifest(df, fanout) == expected(rows, fanout)


def test_merkle_small(spark):
    for rows in ([], ODD[:1], ODD[:2], ODD[3:5]):
        assert manifest(spark.createDataFrame(rows, DOC), 2) == (expected(rows, 2) if rows else [])


def test_merkle_query(spark, tmp_path):
    out = queries.op11_merkle_manifest(spark, SF)
    assert_same(out, tables(SF), queries.OP11_SQL)
    kinds = dict(out.dtypes)
    assert {kinds[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")} == {"string"} and kinds["verified"] == "boolean"
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(ODD, DOC).write.parquet(path)
    got = queries.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD)
    for r in got:  # only claimed characters that aren't null fail
        touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] != 2
        assert r["verified"] is not touched


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, width string, n string, whitened string, at string")


def with_clash(rows):
    return [(i, v, "x", "x", "x", "x") for i, v in rows]


@pytest.mark.parametrize("kind", ["unit", "one far", "huge"])
def test_whitening(spark, monkeypatch, kind):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12)) / 12
    if kind == "one far":
        x[7] *= 1e6
    if kind == "huge":
        x = x * 1e14
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(3, [float(c) for c in x[3]]), (None, [float(c) for c in x[0]])]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    df = vectors_of(spark, with_clash(rows + odd), "double").repartition(5)
    models = whitening.fit(df, "embedding")
    assert list(models) == [12]
    exact = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(rows), [sum(c) for c in zip(*exact, strict=True)]
    centred = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in exact]
    for i in range(12):
        for j in range(12):
            assert models[12].covariance[i, j] == float(Fraction(sum(v[i] * v[j] for v in centred), n**3))
    out = whitening.whiten(df, models, "vec_id", "embedding", 8)
    got = out.collect()
    assert sorted(repr(r["vec_id"]) for r in got) == sorted(repr(i) for i, _ in rows)
    far = {repr(i): sum(a * a for a in v) for (i, _), v in zip(rows, centred, strict=True)}
    assert all((int(r["deviation"]) == far[repr(r["vec_id"])]) if far[repr(r["vec_id"])] < 10**38 else r["deviation"] is None for r in got)
    w = np.array([r["whitened"] for r in got], float)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert error < (1e-4 if kind == "one far" else 1e-9)  # one row takes a share of 1e-12 or so from the precision of the others
    assert abs(whitening.identity_error(out) - error) < 1e-9
    values, vectors = np.linalg.eigh(models[12].covariance)
    assert np.allclose(models[12].explained, values[::-1] / np.trace(models[12].covariance), rtol=1e-9)
    for r in got:
        z = np.array(centred[[repr(i) for i, _ in rows].index(repr(r["vec_id"]))], float) / n
        ours, theirs = np.array(r["whitened"]), z @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
        assert np.allclose(np.abs(ours), np.abs(theirs), rtol=1e-5, atol=1e-6)


def test_whitening_odd(spark, tmp_path):
    flat = [(i, [1.0, float(i % 2), 3.0]) for i in range(6)]
    lone, pair = [(70, [0.5] * 5)], [(80, [1.0, 2.0]), (81, [2.0, 1.0])]
    df = vectors_of(spark, with_clash(flat + lone + pair))
    models = whitening.fit(df, "embedding")
    assert {k: m.n for k, m in models.items()} == {3: 6, 5: 1, 2: 2}
    got = {r["vec_id"]: r for r in whitening.whiten(df, models, "vec_id", "embedding").collect()}
    assert all([x is None for x in got[i]["whitened"]] == [False, True, True] and abs(abs(got[i]["whitened"][0]) - 1) < 1e-9 for i in range(6))
    assert got[70]["whitened"] == [None] * 5 and got[70]["deviation"] == 0 and got[80]["deviation"] == 2 * 1024**2
    assert models[3].explained[0] == pytest.approx(1) and models[5].explained.tolist() == [0.0] * 5
    assert whitening.identity_error(whitening.whiten(df, models, "vec_id", "embedding")) < 1e-9
    df.select("vec_id", "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op12_whitening(spark, str(tmp_path)).collect()
    assert len(rows) == 6 * 3 + 5 + 2 * 2 and all(r["explained"] is not None and r["identity_error"] < 1e-9 for r in rows)
    df.where("1 = 0").select("vec_id", "embedding").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op12_whitening(spark, f"{tmp_path}/none").count() == 0


def test_whitening_query(spark):
    rows = queries.op12_whitening(spark, SF).toPandas()
    x = np.floor(1024 * np.array([r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select(F.col("embedding").cast("array<double>")).collect()])) + 100_000
    z = x - x.mean(0)
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    w = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(w), np.abs(z @ vectors[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])), atol=1e-6)
    assert np.allclose(rows.sort_values(["vec_id", "component"])["explained"].to_numpy()[:8], values[::-1][:8] / values.sum())
    assert (rows["n"] == len(x)).all() and rows["identity_error"].nunique() == 1 and rows["identity_error"].iloc[0] < 1e-9
    far = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    assert np.allclose(rows.sort_values(["vec_id", "component"])["deviation"].to_numpy()[::8].astype(float), far, rtol=1e-12)


RANKS = queries.tokenizer("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = ["", " ", "a", "it's  the 'end<|endoftext|>'ve", "日本語のテキスト。と 12 ３４", "x" * 100_000, " " * 5000, " " * 5000 + "y", "\n" * 4097 + "'s", "a" + "\t " * 3000 + "　é", "word " * 30_000, "a " * 9000, "🙂" * 40_000,
         "one\x1c\x1d two\x85three", "end   "]


def brute(enc, text):
    return [t for piece in regex.findall(PATTERN, text) for t in enc._encode_single_piece(piece)]


def test_byte_bpe_parts(monkeypatch):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    random.seed(3)
    alphabet = ["a", "Z", "é", "語", " ", "  ", "\n", "\t", "　", "'", "'s", "1", "²", "!", "。", "́", "🙂", "\x1c"]
    for long_run, most in ((4096, 65_536), (2, 3), (3, 1), (5, 20)):
        monkeypatch.setattr(byte_bpe, "RUN", regex.compile(rf"\s{{{long_run},}}+"))
        monkeypatch.setattr(byte_bpe, "LONG_RUN", long_run)
        for _ in range(300):
            text = "".join(random.choices(alphabet, k=random.randrange(60)))
            cuts = list(byte_bpe.parts(text, most))
            assert "".join(p for p, _ in cuts) == text
            got = [t for p, alone in cuts if p for t in (enc._encode_single_piece(p) if alone else enc.encode_ordinary(p))]
            assert got == brute(enc, text) == enc.encode_ordinary(text), repr(text)
    huge = "a" + " " * 1_500_000 + "b"
    assert len(byte_bpe.tokens_of(enc, huge)) == 4 * len(brute(enc, huge))


def test_byte_bpe(spark, tmp_path):
    enc = byte_bpe.encoding(RANKS, PATTERN)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (50, None), (3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, tokens string, decoded string, n_tokens string")
    encoded = byte_bpe.encode(df, RANKS, PATTERN)
    want = sorted((repr(i), enc.encode_ordinary(t or "") if len(t or "") < 10**5 else brute(enc, t)) for i, t in rows)
    got = sorted((repr(r["doc_id"]), np.frombuffer(r["tokens"], "<u4").tolist()) for r in encoded.collect())
    assert got == want
    assert all(r["n_tokens"] * 4 == len(r["tokens"]) for r in encoded.collect())
    back = sorted((repr(r["doc_id"]), bytes(r["decoded"])) for r in byte_bpe.decode(encoded, RANKS, PATTERN).collect())
    assert back == sorted((repr(i), (t or "").encode()) for i, t in rows)
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'6180C3A9' AS string) AS text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(broken, RANKS, PATTERN), RANKS, PATTERN).first()["decoded"]) == "a�é".encode()
    nothing = spark.createDataFrame([(None,)], "tokens binary").selectExpr("1L AS doc_id", "tokens")
    assert bytes(byte_bpe.decode(nothing, RANKS, PATTERN).first()["decoded"]) == b""
    assert byte_bpe.decode(byte_bpe.encode(df.where("1 = 0"), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_byte_bpe(spark, str(tmp_path)).collect():
        ids, text = next((t, b) for (i, t), (_, b) in zip(want, back, strict=True) if i == repr(r["doc_id"]))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest())
