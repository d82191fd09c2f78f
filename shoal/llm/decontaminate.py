"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared token seeds (runs of `min_match` tokens).
A pair whose seeds could cover enough of the item is tiled: running Karp-Rabin finds
the longest common runs that are still unmarked, marks them in both texts and goes on
to shorter ones. Tiles may lie in any order, so reordered passages count in full. A
document leaks an item when its tiles cover at least `coverage` of the item's tokens.

The benchmark is the small side: it is taken in blocks of at most `block_tokens`
tokens (counted first), each broadcast in turn against all documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share, shared

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so windows of a product hash differ in their last tokens too
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Rows turned into token arrays at once.
SLICE = 256
#: Pairs of equal windows looked at at once; a window that repeats more often in a text takes as many more.
PAIRS = 1 << 20


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Rolling hash of every run of `width` ids (modulo 2**64): differences of running sums, whatever the width."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = ids.astype(np.uint64)
    mixed = (mixed ^ (mixed << np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    down = np.full(len(ids), INVERSE)
    down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * np.cumprod(down))])
    up = np.full(n, BASE)
    up[0] = np.uint64(pow(int(BASE), width - 1, 1 << 64))
    return (sums[width:] - sums[:-width]) * np.cumprod(up)


def tile(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two id arrays: (start in item, start in text, length) of each tile.

    Each tile is the longest common run that is still unmarked in both. Id 0 is no token
    and matches nothing. Ties go to the earliest start in the item, then the text. Spans
    halve, so that the long runs are found among few windows; what an earlier tile leaves
    of a run goes back among the others.
    """
    used_i, used_t = item == 0, text == 0
    out: list[tuple[int, int, int]] = []
    span = min_match
    while span * 2 <= len(item):
        span *= 2
    while True:
        runs = [(-n, i, j) for n, i, j in _matches(item, text, used_i, used_t, span)]
        heapq.heapify(runs)
        while runs:
            n, i, j = heapq.heappop(runs)
            taken = used_i[i : i - n] | used_t[j : j - n]
            if not taken.any():
                used_i[i : i - n] = used_t[j : j - n] = True
                out.append((i, j, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= span:
                    heapq.heappush(runs, (a - b, i + a, j + a))
        if span == min_match:
            return out
        span = max(min_match, span // 2)


def _free(used: np.ndarray, span: int) -> np.ndarray:
    """Starts of the runs of `span` tokens without a marked one."""
    before = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(before[span:] == before[:-span])


def _matches(item: np.ndarray, text: np.ndarray, used_i: np.ndarray, used_t: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked common runs of at least `span`: (length, start in item, start in text).

    Pairs of equal windows are laid out PAIRS at a time; only those at either end of a
    run are kept, and ends follow their starts along each diagonal.
    """
    hi, ht = windows(item, span), windows(text, span)
    if not len(hi) or not len(ht):
        return []
    at_i, at_t = _free(used_i, span), _free(used_t, span)
    at_t = at_t[np.isin(ht[at_t], hi[at_i])]
    if not len(at_t):
        return []
    at_t = at_t[np.argsort(ht[at_t], kind="stable")]
    low, high = (np.searchsorted(ht[at_t], hi[at_i], side) for side in ("left", "right"))
    # The token before the first and after the last place is marked, so runs end there.
    free_i, free_t = (np.concatenate([[False], ~used, [False]]) for used in (used_i, used_t))
    ids_i, ids_t = (np.concatenate([[0], ids, [0]]) for ids in (item, text))
    goes_on = lambda i, j: free_i[i + 1] & free_t[j + 1] & (ids_i[i + 1] == ids_t[j + 1])
    starts, ends = [], []
    upto = np.cumsum(high - low)
    first = 0
    while first < len(at_i):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, "right")))
        n = (high - low)[first:last]
        i = np.repeat(at_i[first:last], n)
        j = at_t[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[first:last], n)]
        for found, edge in ((starts, ~goes_on(i - 1, j - 1)), (ends, ~goes_on(i + span, j + span))):
            found.append(np.stack([j[edge] - i[edge], i[edge]]))
        first = last
    starts, ends = (x[:, np.lexsort(x[::-1])] for x in (np.concatenate(starts, 1), np.concatenate(ends, 1)))
    if starts.shape != ends.shape or (starts[0] != ends[0]).any():
        raise ValueError("two windows of unlike tokens have one hash")
    return [(e - i + span, i, d + i) for d, i, e in zip(starts[0].tolist(), starts[1].tolist(), ends[1].tolist(), strict=True)]


class Seeds:
    """A block of benchmark items: ids of its words, and where each seed occurs."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.min_match = min_match
        self.names, self.items = [], []
        hashes, owners, places = [], [], []
        for name, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)], np.int64)
            h = windows(ids, min_match)
            if len(h):
                hashes.append(h)
                owners.append(np.full(len(h), len(self.items)))
                places.append(np.arange(len(h)))
                self.names.append(name)
                self.items.append(ids)
        self.hashes, self.owners, self.places = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (owners, np.int64), (places, np.int64)))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order], self.places[order]

    def candidates(self, ids: np.ndarray, hits: np.ndarray, coverage: float) -> Iterator[int]:
        """Items of which the seeds at `hits` could cover enough: a bound from above on what tiles cover."""
        found = np.unique(windows(ids, self.min_match)[hits])
        low, high = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)]) if len(found) else np.zeros(0, np.int64)
        for item in np.unique(self.owners[at]):
            covered = np.zeros(len(self.items[item]), bool)
            for p in self.places[at[self.owners[at] == item]]:
                covered[p : p + self.min_match] = True
            if covered.sum() >= coverage * len(covered):
                yield int(item)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, min_match: int = 5, block_tokens: int = 2_000_000,
          id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, item_col, n_tokens, n_covered, n_tiles, coverage) of each document row and item it leaks.

    Tokens are runs of word characters, case ignored. Items of fewer than `min_match`
    tokens, null and empty texts match nothing. Repeated documents and items are each
    reported. An empty table on either side gives an empty result; columns besides
    those named are ignored, whatever their names. Texts are read whole.
    """
    spark = docs.sparkSession
    small = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n_tokens = small.agg(F.sum(F.regexp_count("text", F.lit(r"(?U)\w+")))).first()[0] or 0
    blocks = max(1, -(-n_tokens // max(1, block_tokens // 2)))  # even blocks hold half the bound
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("text"))
    kinds = dict(rows.dtypes)[id_col], dict(small.dtypes)["item"]
    names = [id_col, item_col, "n_tokens", "n_covered", "n_tiles", "coverage"]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}, n_tokens int, n_covered int, n_tiles int, coverage double"
    found = None
    for b in range(blocks):
        block = small.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else small
        held = [(r[0], r[1]) for r in block.collect()]  # at most about block_tokens tokens
        part = rows.mapInArrow(_tiler(share(spark, Seeds(held, min_match)), coverage, names), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _tiler(sent: Broadcast, coverage: float, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = shared(sent, Seeds)
        known, width = seeds.vocabulary.get, seeds.min_match
        for batch in batches:
            out = []
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                # The texts of a slice stand in one id array, 0 between them.
                ids = [[known(w, 0) for w in tokens(t)] if t else [] for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(x) + 1 for x in ids])
                flat = np.zeros(int(ends[-1]), np.int64)
                for x, e in zip(ids, ends, strict=True):
                    flat[e - 1 - len(x) : e - 1] = x
                unknown = np.concatenate([[0], np.cumsum(flat == 0)])
                at = np.flatnonzero(unknown[width:] == unknown[:-width]) if len(flat) >= width else np.zeros(0, np.int64)
                if not len(at):
                    continue
                h = windows(flat, width)[at]
                place = np.searchsorted(seeds.hashes, h)
                at = at[(place < len(seeds.hashes)) & (seeds.hashes[np.minimum(place, len(seeds.hashes) - 1)] == h)] if len(seeds.hashes) else at[:0]
                for d in np.unique(np.searchsorted(ends, at, "right")):
                    x = np.array(ids[d], np.int64)
                    begin = ends[d] - 1 - len(x)
                    for item in seeds.candidates(x, at[(at >= begin) & (at < ends[d])] - begin, coverage):
                        tiles = tile(seeds.items[item], x, width)
                        covered, n = sum(t[2] for t in tiles), len(seeds.items[item])
                        if covered >= coverage * n:
                            out.append((part.column(0)[int(d)].as_py(), seeds.names[item], n, covered, len(tiles), covered / n))
            if out:
                columns = list(zip(*out, strict=True))
                types = [batch.schema.field(0).type, None, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run
