"""Each operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, tables
from pyspark.sql import functions as F

from shoal.llm import common, decontaminate, embedding_dedup, line_dedup, mixing, ngram_join, quality, queries, sharding, token_counts, url_filter, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: An id that repeats, one that is missing, no text, an empty one, one without words, a very long one.
ODD = [(1, "one two three four five six", "en", "src1", 3), (1, "one two three four five six", "en", "src1", 3), (2, None, None, None, None), (3, "", "en", "src2", 0), (4, " \t\n ", "de", "src2", 4),
       (None, "ONE two  three four five six", "en", "x", 1), (5, "longer and " * 30_000, "en", "src1", 9), (6, "é ▁ x\n\na  b ", "fr", "src9", 2)]
CLASH = ["stats", "label", "hash", "key", "block", "rank", "curve", "shard", "n", "chunk", "row", "domain", "order", "bucket", "v", "score"]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none_of(df):
    return df.where("1 = 0")


def test_components(spark):
    random.seed(1)
    edges = [tuple(random.sample(range(80), 2)) for _ in range(60)] + [(3, 3)] + [(200 + i, 201 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in common.connected_components(spark.createDataFrame(edges + edges[:9], "a long, b long")).collect())
    assert got == {x: find(x) for x in root}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_hash(values):
    """Polynomial in the odd base, modulo 2**64, and its bits mixed."""
    mix = lambda h: (lambda x: x ^ (x >> 29))((h ^ (h >> 32)) * 0xBF58476D1CE4E5B9 % 2**64)
    return mix(sum(v * pow(0x9E3779B97F4A7C15, k, 2**64) for k, v in enumerate(values)) % 2**64), mix


def brute_chunks(text):
    """(bytes but for blanks at the ends, bytes with the blanks after them, number of parts) of a text's chunks, one word, line and window after the other."""
    data, mix = (text or "").encode(), brute_hash([])[1]
    letters = [mix((x + 1) * 0x9E3779B97F4A7C15 % 2**64) for x in range(256)]
    hash_of = lambda piece: brute_hash([letters[x] for x in piece])[0]
    parts, at = [], 0  # (start, end, hash, line, whole line)
    for number, line in enumerate(data.split(b"\n")):
        words = [(at + m.start(), at + m.end()) for m in re.finditer(rb"[^\x00-\x20]+", line)]
        h = [hash_of(data[i:j]) for i, j in words]
        cuts = [0] + [k for k in range(2, len(words) - 1) if h[k] < h[k - 1] and h[k] < h[k + 1]] + [len(words)]
        spans = [(words[i][0], words[j - 1][1]) for i, j in zip(cuts, cuts[1:]) if i < j]
        parts += [(i, j, hash_of(data[i:j]), number, len(spans) == 1) for i, j in spans]
        at += len(line) + 1
    h, rolled, run, starts = [p[2] for p in parts], [0], 0, [0]
    rolled += [brute_hash([h[k - 1], h[k]])[0] for k in range(1, len(h))]
    same = [k > 0 and h[k] == h[k - 1] and parts[k][4] and parts[k - 1][4] for k in range(len(h))]
    for k in range(1, len(parts)):
        run = run if same[k] else k
        if 2 <= k < len(parts) - 1 and rolled[k] < rolled[k - 1] and rolled[k] < rolled[k + 1] or same[k] and k + 1 < len(parts) and same[k + 1] and (k - run) % 4 == 0:
            starts.append(k)
    starts.append(len(parts))
    heads = [0] + [parts[k][0] for k in starts[1:-1]] + [len(data)]
    return [(data[parts[i][0] : parts[j - 1][1]], data[heads[c] : heads[c + 1]], j - i) for c, (i, j) in enumerate(zip(starts, starts[1:])) if i < j]


def brute_dedup(rows):
    """(text, removed chunks, removed parts) of each document of unlike ids, which are taken in order."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        pieces = brute_chunks(text)
        gone = []
        for chunk, _, size in pieces:
            gone.append(size >= 2 and chunk in seen)
            seen |= {chunk} if size >= 2 else set()
        left = b"".join(p[1] for p, g in zip(pieces, gone) if not g).decode() if pieces else text
        out[doc] = (left, sum(gone), sum(p[2] for p, g in zip(pieces, gone) if g))
    return out


def test_line_dedup(spark, docs, odd):
    lines = lambda *k: "\n".join(f"line number {i} of the passage" for i in k)
    more = [(900_001, lines(*range(20))), (900_002, "intro\n" + lines(*range(20)) + "\nend"), (900_003, lines(*range(20, 40))), (900_004, None), (900_005, ""), (900_006, " \n\t "), (900_007, "\n\n a b\n" + "spam\n" * 9)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r["doc_id"]: (r["text"], r["removed_chunks"], r["removed_lines"]) for r in line_dedup.dedup(rows).collect()}
    want = brute_dedup([tuple(r) for r in rows.collect()])
    assert got == want and sum(w[1] for w in want.values()) > 100
    assert got[900_001][1] == 0 and got[900_002][1] >= 3  # a shifted passage is cut alike
    assert sorted(str(r["text"]) for r in line_dedup.dedup(odd).collect()) == sorted(str(r[1]) for r in ODD)
    assert line_dedup.dedup(none_of(docs)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_of_few_words(spark, seed):
    """Lines of any length out of few words: ties of hashes, runs of equal lines, blanks of all kinds."""
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice(["a", "b", "cc", "é"][: rng.randint(1, 4)]) + rng.choice([" ", "  ", "\n", "\n", "\t\n ", "\r\n"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    got = {r["doc_id"]: (r["text"], r["removed_chunks"], r["removed_lines"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_dedup(rows)


def test_line_dedup_borders_know_no_line_length():
    """Two lines of 8 words that recur between others lose as many chunks with words of 3 letters (31 bytes a line) as of 4 (39), 5 (47) or 9 (79)."""
    rng = random.Random(7)
    gone = {}
    for size in (3, 4, 5, 9):
        line = lambda: " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(8))
        found = 0
        for _ in range(400):
            passage = f"{line()}\n{line()}"
            one, two = ({c[0] for c in brute_chunks(f"{line()}\n{passage}\n{line()}") if c[2] >= 2} for _ in "ab")
            found += bool(one & two)
        gone[size] = found / 400
    assert min(gone.values()) > 0.4 and max(gone.values()) - min(gone.values()) < 0.1, gone


def test_line_dedup_of_rows_that_share_an_id(spark):
    """A first occurrence stays although another row of its document holds a later one at the same place."""
    one, two = ("\n".join(f"{w} {k} of some words here" for k in range(12)) for w in ("first", "second"))
    rows = [(1, one), (5, one), (5, two), (9, two), (None, two)]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert (1, one) in got and (5, two) in got and (5, "") in got and (9, "") in got and (0, two) in got


def test_line_dedup_compares_bytes(spark, monkeypatch):
    class Same:
        @staticmethod
        def xxh64_intdigest(data):
            return 7

    monkeypatch.setattr(line_dedup, "xxhash", Same)
    rows = [(1, "a\nb\nc\nd"), (2, "e\nf\ng\nh"), (3, "a\nb\nc\nd")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "a\nb\nc\nd" and got[2] == "e\nf\ng\nh" and got[3] == ""


def test_line_dedup_finds_passages_of_50_words(spark):
    random.seed(5)
    words = lambda n: [f"w{random.randrange(3000)}" for _ in range(n)]
    rows, planted = [], {}
    for k in range(150):
        passage, step = words(random.randint(50, 100)), (1000, 20, 10, 5)[k % 4]
        passage = ("\n" if step < 1000 else " ").join(" ".join(passage[i : i + step]) for i in range(0, len(passage), step))
        for doc in (k, 1000 + k):  # other neighbours each time, within the line or on other lines
            rows.append((doc, " ".join(words(25)) + (" " if k % 8 < 4 else "\n") + passage + (" " if k % 8 < 4 else "\n") + " ".join(words(25))))
        planted[1000 + k] = len(passage.split())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = {d: planted[d] + 50 - len(got[d].split()) for d in planted}
    assert min(removed.values()) > 0 and all(removed[d] <= n for d, n in planted.items())
    assert sum(removed.values()) >= 0.7 * sum(planted.values())
    assert all(got[d] == t for d, t in rows if d < 1000)


def test_line_dedup_rows_without_borders(spark):
    rows = [(1, "spam\n" * 40), (2, "one line\n" + "spam\n" * 40), (3, "\u00a0 x\ty " * 3), (4, None), (None, "spam\n" * 40), (5, "  "), (5, "spam\n" * 40)]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    left = {(r["doc_id"], r["n_lines"]): r["text"] for r in got}
    assert left[(1, 40)].count("spam") <= 12 and left[(2, 41)].count("spam") <= 12 and left[(None, 40)] == "spam\n" * 40
    assert [r["text"] for r in got if r["doc_id"] == 3] == [rows[2][1]]  # a short line is cut like others, so it may be several parts
    assert left[(4, 0)] is None and left[(5, 1)] == "  "


def test_token_counts(spark, docs, odd):
    import sentencepiece

    model = queries.tokenizer()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    for df in (docs, odd):
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, model, rows=500).collect())
        assert got == sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(sp.encode(r["text"] or ""))) for r in df.select("doc_id", "text").collect())
    assert token_counts.token_counts(none_of(docs), model).count() == 0
    random.seed(5)
    lengths = token_counts.Lengths(model, {})
    for _ in range(300):
        text = "".join(random.choice([" ", "  ", "a", "é", "▁", "\n", "the", "<s>", "½", "　", ".", "x" * 70]) for _ in range(random.randint(0, 20)))
        assert (sum(map(lengths.__getitem__, token_counts.pieces(text))) if text else 0) == len(sp.encode(text))


def brute_tiles(item, text, least):
    """Greedy tiling by looking at all pairs of places: (start in item, start in text, length) of each tile."""
    used_i, used_t, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] != 0 and i + k not in used_i and j + k not in used_t:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        if k < least:
            return out
        used_i |= set(range(i, i + k))
        used_t |= set(range(j, j + k))
        out.append((i, j, k))


@pytest.mark.parametrize("pairs", [1 << 20, 3])
def test_tiles_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    random.seed(2)
    for _ in range(150):
        kinds = random.randint(1, 4)
        item = [random.randint(1, kinds) for _ in range(random.randint(0, 24))]
        text = [random.randint(0, kinds) for _ in range(random.randint(0, 40))]
        assert decontaminate.tile(np.array(item, np.int64), np.array(text, np.int64), 3) == brute_tiles(item, text, 3)


def test_windows_roll():
    ids = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5, 9])
    for width in range(1, 12):
        h = decontaminate.windows(ids, width)
        for a in range(len(h)):
            for b in range(len(h)):
                assert (h[a] == h[b]) == (ids[a : a + width] == ids[b : b + width]).all()
    assert len(decontaminate.windows(ids, 12)) == 0


def test_tiles_of_repeated_phrases():
    phrase = np.arange(1, 9)
    tiles = decontaminate.tile(np.tile(phrase, 50), np.tile(phrase, 2000), 5)
    assert tiles == [(0, 0, 400)]


def test_leaks_counts_equal_tiling(spark):
    """n_covered and n_tiles of reordered, cut and interleaved passages are those of the brute force."""
    random.seed(5)
    words = [f"w{k}" for k in range(12)]
    items = {k: [random.choice(words) for _ in range(random.randint(5, 30))] for k in range(4)}
    texts = {}
    for d in range(40):
        source, out = random.choice(list(items.values())), []
        for _ in range(random.randint(1, 5)):
            a = random.randrange(len(source))
            out += source[a : a + random.randint(3, 20)] + ["other"] * random.randint(0, 2)
        texts[d] = out
    docs = spark.createDataFrame([(d, " ".join(x)) for d, x in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    number = {w: k + 1 for k, w in enumerate(words)}
    want = {}
    for d, text in texts.items():
        for k, item in items.items():
            tiles = brute_tiles([number[w] for w in item], [number.get(w, 0) for w in text], 5)
            covered = sum(t[2] for t in tiles)
            if 2 * covered >= len(item):
                want[d, k] = (len(item), covered, len(tiles))
    got = {(r["doc_id"], r["item_id"]): (r["n_tokens"], r["n_covered"], r["n_tiles"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and len(want) > 5


def test_leaks(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    items = {r["item_id"]: decontaminate.tokens(r["text"]) for r in bench.collect()}
    want = set()
    for doc, text in docs.select("doc_id", "text").collect():
        words = decontaminate.tokens(text)
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for k, item in items.items():
            hit = {p for i in range(len(item) - 4) if tuple(item[i : i + 5]) in grams for p in range(i, i + 5)}
            if 2 * len(hit) >= len(item):
                want.add((doc, k))
    assert got == want and got
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, block_tokens=200).collect()} == want  # in blocks
    k, item = max(items.items(), key=lambda x: len(x[1]))
    third = len(item) // 3
    turned = " ".join(["clean"] * 50 + item[2 * third :] + ["between"] + item[third : 2 * third] + item[:third])
    planted = spark.createDataFrame([(7, turned), (8, " ".join(item[:third])), (9, "nothing of the kind at all")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.leaks(planted, bench).collect()] == [(7, k, 1.0)]
    short = spark.createDataFrame([(1, "one two"), (2, None), (3, "one two three four five six")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in decontaminate.leaks(odd, short).collect()) == [(0, 3), (1, 3), (1, 3)]
    assert decontaminate.leaks(none_of(docs), bench).count() == decontaminate.leaks(docs, none_of(bench)).count() == 0


def brute_groups(rows, percent=75, width=5):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: (len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)}


@pytest.mark.parametrize("shingles", [1 << 18, 600])  # of a block: all in one, and groups of near copies in many
def test_jaccard_groups(spark, docs, odd, shingles, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", shingles)
    random.seed(4)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(90)]
    near = []
    for k in range(120):  # one group of near copies, some of which link with none
        copy = list(base)
        for _ in range(random.randint(0, 5)):
            copy[random.randrange(len(copy))] = random.choice(words)
        near.append((700_000 + k, " ".join(copy)))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + near + [(800_000, "a b"), (800_001, "A  b"), (800_002, "a b c"), (800_003, None), (800_004, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(odd).collect())
    assert found == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 5 - 3, 5), (6, 1, 6)]
    assert ngram_join.jaccard_groups(none_of(docs)).count() == 0


def test_texts_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(64)]
    between = [*words[:57], *"abcdefg"]  # 53 of 67 shingles with either end, which share 46 of 74
    rows = [(1, " ".join(words)), (2, " ".join([*"tuvwxyz", *between[7:]])), (None, " ".join(between)), (None, " ".join(between))]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None), (0, None), (1, 1), (2, 1)]
    apart = ngram_join.jaccard_groups(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert sorted(r["component_id"] for r in apart) == [1, 2]


def test_shingles_of_whole_texts():
    hasher = ngram_join.Hasher(5)
    text = " ".join(f"w{i}" for i in range(300_000))  # longer than a slice
    a, b, c = hasher.sets(pa.array(["x y z", text, text.upper() + "\n"]))
    assert (len(a), len(b)) == (1, 299_996) and (b == c).all()


def test_automaton_equals_globs():
    import re

    random.seed(6)
    globs = ["".join(random.choice("ab/*%?") for _ in range(random.randint(1, 30))) for _ in range(40)] + ["\\*a*", ""]
    texts = ["".join(random.choice("ab/*") for _ in range(random.randint(0, 40))) for _ in range(200)] + [""]

    def as_regex(g):
        out, i = "", 0
        while i < len(g):
            if g[i] == "\\":
                i += 1
                out += re.escape(g[i])
            else:
                out += {"*": ".*", "%": "[^/]*", "?": "."}.get(g[i], re.escape(g[i]))
            i += 1
        return re.compile(out, re.S)

    want = [[bool(as_regex(g).fullmatch(t)) for g in globs] for t in texts]
    assert url_filter.Automaton(globs).words > 1
    assert url_filter.Automaton(globs).match([t.encode() for t in texts]).tolist() == want


def test_url_filter_edges(spark):
    urls = ["http://A.Example.net/en/x?y", "https://example.net/de/", "https://example.net", "http://notnet/", "https://x.org/fr/1", "org/fr/", None, "", "https://e.com/a.net/", "http://example.com/de/#x", "https://cheap-pills.org/x", "http://a.b/" + "c" * 100_000 + ".exe"]
    df = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls)] + [(None, "http://x.net/", "c", "d")], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, url_filter.default_rules()).collect()}
    assert got == {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: ("org/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
                   9: ("example.com/de/", "block"), 10: (None, "block"), 11: (None, "block"), None: ("net/", "block")}
    assert url_filter.filter_urls(none_of(df), []).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_loser_tree():
    random.seed(7)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((random.randint(0, 50),) for _ in range(random.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 1200
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://b.com/1", page), (2, "http://a.com/2", page), (3, "http://a.com/1", page), (4, None, None), (5, "http://a b.com/\r\nx", tricky), (6, "http://a.com/1", "short"), (7, "http://z.com", "short"),
             (8, "http://big.com/", "é" * 100_000), (9, "http://a.com/9", "y" * 5_000_000), (None, "http://n.com/", page), (2, "http://a.com/2", page)]
    df = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, payload string, digest int")
    warc.write(df, str(tmp_path / "w"))
    got = warc.read_captures(spark, str(tmp_path / "w")).collect()
    assert [(r["url_key"], r["captured"]) for r in got] == sorted((r["url_key"], r["captured"]) for r in got)
    import hashlib

    bodies = sorted((p[0] or 0, len((p[2] or "").encode()), hashlib.sha1((p[2] or "").encode()).hexdigest()) for p in pages)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == bodies
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (6, "response", None), (7, "response", None), (None, "response", None)} <= kinds
    index = common.table(warc.read_captures(spark, str(tmp_path / "w")), "index")
    again = {(r["archive"], r["offset"]): r for r in warc.fetch(spark, str(tmp_path / "w"), index.unionByName(index)).collect()}
    assert len(again) == len(pages)
    for r in index.collect():
        one = again[r["archive"], r["offset"]]
        assert one["record_type"] == r["record_type"]
        assert one["payload"] is None if r["record_type"] == "revisit" else hashlib.sha1(one["payload"]).hexdigest() == r["payload_digest"]
    places = spark.createDataFrame([(index.first()["archive"], 1), (index.first()["archive"], None), (None, 0)], "archive string, offset long")
    assert warc.fetch(spark, str(tmp_path / "w"), places).count() == warc.fetch(spark, str(tmp_path / "w"), none_of(index)).count() == 0
    warc.write(none_of(df), str(tmp_path / "none"))
    assert warc.read_captures(spark, str(tmp_path / "none")).count() == 0


def test_captures_in_order_over_ranges(spark, tmp_path, monkeypatch):
    """One URL with most captures, ties and all, is cut into ranges of bounded size."""
    monkeypatch.setattr(warc, "RANGE", 60)
    pages = [(k % 150, "http://hot.com/" if k % 3 else f"http://h{k % 7}.com/{k % 5}", f"page {k % 20}") for k in range(600)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    warc.write(df, str(tmp_path / "w"), captured=F.timestamp_seconds(F.lit(0)))
    out = warc.read_captures(spark, str(tmp_path / "w")).withColumn("part", F.spark_partition_id())
    rows = out.collect()
    keys = [(r["url_key"], r["captured"], r["page_id"], r["archive"], r["offset"]) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == 600
    sizes = [sum(r["part"] == p for r in rows) for p in {r["part"] for r in rows}]
    assert len(sizes) == 10 and max(sizes) < 120


def test_mixing(spark, docs, odd):
    weights = ({"domain0": 3}, {"en": 4}, {"src0": 2})
    got = mixing.mix(docs, queries.domain_of(F.col("source")), 1.0, weights).collect()
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in docs.select("doc_id", "text").collect()}
    leaves = collections.defaultdict(list)
    for r in docs.collect():
        leaves[f"domain{int(r['source'][3:]) % 4}", r["lang"], r["source"]].append(r["doc_id"])
    cap = {leaf: 4 * sum(words[d] for d in ids) for leaf, ids in leaves.items()}

    def shares(parent, given):
        """Water filling by trial: children fill up one at a time, in the order in which their caps are reached."""
        depth = len(parent)
        kids = sorted({leaf[: depth + 1] for leaf in leaves if leaf[:depth] == parent})
        caps = {k: sum(c for leaf, c in cap.items() if leaf[: depth + 1] == k) for k in kids}
        w = {k: weights[depth].get(k[-1], 1) for k in kids}
        out, left, open_ = {}, given, set(kids)
        while open_:
            total = sum(w[k] for k in open_)
            full = [k for k in open_ if caps[k] * total <= left * w[k]]
            if not full:
                out |= {k: min(int(left * w[k] // total), caps[k]) for k in open_}
                break
            k = min(full, key=lambda k: (caps[k] / w[k], k))
            out[k] = caps[k]
            left -= caps[k]
            open_.remove(k)
        return out

    budget = {(): min(sum(words.values()), sum(cap.values()))}
    for depth in range(3):
        for parent in [p for p in budget if len(p) == depth]:
            budget |= shares(parent, budget[parent])
    taken = collections.defaultdict(list)
    for r in got:
        leaf = (r["domain"], r["lang"], r["source"])
        assert abs(r["leaf_budget"] - budget[leaf]) <= 1
        taken[leaf, r["epoch"]].append(r["doc_id"])
    import hashlib

    for leaf, ids in leaves.items():
        b = next((r["leaf_budget"] for r in got if (r["domain"], r["lang"], r["source"]) == leaf), 0)
        tokens = sum(words[d] for d in ids)
        whole = b // tokens
        for e in range(whole):
            assert sorted(taken[leaf, e]) == sorted(ids)
        left, prefix = b - whole * tokens, []
        for d in sorted(ids, key=lambda d: hashlib.md5(f"0|{whole}|{d}".encode()).hexdigest()):
            left -= words[d]
            if left < 0:
                break
            prefix.append(d)
        if b - whole * tokens > 0:
            assert sorted(taken[leaf, whole]) == sorted(prefix)
    assert mixing.mix(odd, F.lit(None), 1.0).count() > 0
    assert mixing.mix(none_of(docs), F.lit("d"), 1.0).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((150, 24))
    x = np.concatenate([centre, centre[:80] + 0.25 * rng.standard_normal((80, 24)), centre[:1] + 0.2 * rng.standard_normal((120, 24)), np.repeat(centre[3:4], 9, 0)])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [1.0, None] * 12), (905, [1.0, 2.0]), (906, [float("inf")] + [1.0] * 23), (None, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("v", F.lit(2)).withColumn("block", F.lit(3))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], label[near[i]].min() if near[i].any() else label[i]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    found = sum(got[i][0] for i in range(len(x)))
    assert found <= near.sum() and found >= 0.99 * near.sum()
    assert {i: got[i][:2] for i in range(len(x))} == {i: (near[i].sum(), label[i]) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in range(900, 907)) and got[None] == (0, None, False)
    assert embedding_dedup.near_vectors(none_of(df)).count() == 0


def test_near_vectors_of_several_lengths_and_repeated_ids(spark, monkeypatch):
    """Each length is joined by itself, in several blocks; two vectors of one id have their own links each."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = []
    for d, n in ((24, 60), (7, 40), (1, 5)):
        x = rng.standard_normal((n, d))
        x = np.concatenate([x, x[: n // 2] * (1 + 0.05 * rng.standard_normal((n // 2, d))), x[:3]])
        rows += [(len(rows) + k, v.tolist()) for k, v in enumerate(x)]
    rows += [(0, rows[70][1]), (0, rows[160][1]), (1, rows[1][1])]
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [[j for j in range(len(rows)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(rows))]
    label = [i for i, _ in rows]
    while (new := [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]) != label:
        label = new
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == sorted((rows[i][0], len(near[i]), label[i]) for i in range(len(rows)))


def test_collisions_and_calibration():
    plan = embedding_dedup.calibrate(64, 0.9)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    other = rng.standard_normal((2000, 64))
    other -= (other * a).sum(1)[:, None] * a
    b = 0.9 * a + 0.19**0.5 * other / np.linalg.norm(other, axis=1)[:, None]  # cosine exactly 0.9
    codes = [embedding_dedup.quantised(v @ plan.directions.T, plan.window).T for v in (a, b)]
    met = [len(embedding_dedup.collisions(codes[0][:, k : k + 1], codes[1][:, k : k + 1], plan.count)[0]) for k in range(2000)]
    assert np.mean(met) >= 0.99
    far = embedding_dedup.collisions(codes[0], np.ascontiguousarray(np.roll(codes[0], 1, axis=1)), plan.count)
    assert len(far[0]) < 0.02 * 2000 * 2000


def test_hilbert_curve():
    for dims, bits in ((2, 3), (3, 2)):
        axes = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = sharding.hilbert(axes, bits)
        assert sorted(index) == list(range(len(axes)))
        path = axes[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()  # each step goes to a neighbour


def test_sharding(spark, docs, odd):
    rows = queries.op9_hilbert_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    by = collections.defaultdict(list)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        by[r["shard"]].append(r["slot"])
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
    sizes = [len(by[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["curve"], r["doc_id"]) for r in order] == sorted((r["curve"], r["doc_id"]) for r in rows)
    few = sharding.shard(odd, 24, ["n_chars"], ["lang", "source"], "doc_id").collect()
    assert len({r["shard"] for r in few}) == len(ODD) == len(few)
    assert sharding.shard(none_of(docs), 24, ["n_chars"], ["lang"], "doc_id").count() == 0


def test_quality_held_out(spark, odd):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op10_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    held = [(rows[d]["predicted"], q) for d, q in labels.items() if rows[d]["held_out"]]
    assert len(held) > 50 and sum(p == q for p, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    good = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (1, 1)], "doc_id long, quality int")
    model = quality.fit(odd, good, max_labelled=10)
    assert quality.score(odd, model).count() == len(ODD)
    kept = quality.keep(odd, quality.constant(0.9), 0.3)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality.fit(odd, none_of(good)).rules == [] and quality.score(none_of(odd), model).count() == 0


def test_rules_of_a_forest():
    said = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 > 2.0)\n      Predict: 0.0\n     Else (feature 1 <= 2.0)\n      Predict: 1.0\n    Else (feature 3 > 0.5)\n     Predict: 1.0\n"
    assert {r.conditions for r in quality.rules_of(said)} == {((3, False, 0.5),), ((1, True, 2.0), (3, False, 0.5)), ((1, False, 2.0), (3, False, 0.5)), ((3, True, 0.5),)}


@pytest.mark.parametrize("name", ["op7_source_mix", "op5_url_filter", "op6_warc", "op8_embedding_dedup", "op4_ngram_join"])
def test_queries_equal_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF), tables(SF), queries.oracle_sql()[name])


def test_pipeline(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = common.table(C.classify(spark, docs, SF), "one")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    wrong = [d for d, q in labels.items() if (d in ids(one)) != (q == 1)]
    assert one.columns == docs.columns and len(wrong) <= 0.05 * len(labels)
    two = common.table(C.deduplicate(spark, one, SF), "two")
    groups = brute_groups([tuple(r) for r in one.select("doc_id", "text").collect()])
    assert ids(two) == {c for _, c in groups.values()} and two.count() == len(ids(two))
    three = common.table(C.decontaminate_(spark, two, SF), "three")
    leaking = ids(decontaminate.leaks(two, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert ids(three) == ids(two) - leaking
    four = common.table(C.mix(spark, three, SF), "four")
    assert four.columns == docs.columns and ids(four) <= ids(three)
    five = C.shard(spark, four, SF)
    assert five.count() == four.count() and ids(five) == ids(four)
    assert C.run(spark, SF).count() == five.count()


def test_pipeline_null_and_repeated_ids(spark):
    import corpus_pipeline as C

    random.seed(9)
    a, b, c, d, e = (" ".join(f"w{random.randrange(5000)}" for _ in range(30)) for _ in range(5))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"]

    def stage(f, *rows):
        docs = common.table(spark.createDataFrame([(i, t, "en", "src1", 5) for i, t in rows], DOC), "stage")
        out = f(spark, docs, SF)
        assert out.columns[:5] == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    same = lambda *rows: sorted(rows, key=str)
    got = stage(C.deduplicate, (1, a), (7, a), (7, b), (None, a), (None, c), (None, c), (8, d), (8, e), (8, e), (9, ""), (9, None), (None, ""))
    assert [r for r in got if r[0] != 9] == same((1, a), (7, b), (None, a), (None, c), (None, c), (8, d), (8, e), (None, "")) and len(got) == 9
    assert stage(C.decontaminate_, (None, leak), (None, a), (7, leak), (7, b), (8, leak)) == same((None, a), (7, b))
    rows = [(None, a), (None, b), (None, b), (7, a), (7, c), (7, c), (8, d)]
    assert stage(C.mix, *rows) == same(*rows)
    assert stage(C.shard, *rows) == same(*rows)
