"""N-gram Jaccard join by rare-first prefix filtering.

A document is its set of word shingles. Shingles are ordered rarest first, so two sets
that are similar enough share one in their short prefixes; classes of equal sets are
joined on the prefix shingles they share, length, positional and suffix filters cut the
candidates, and a pair that is left is compared once.

How often a shingle occurs is counted, by hash range, over all documents. First half of
the hashes are counted and each chunk of documents is told which of its shingles occur
elsewhere: a class with more of its own than a link allows is settled, and that is most
documents. For those left all shingles are counted among themselves, which gives the
order; a set's own shingles head its prefix and needn't move. Counts go by 32 bits of
the hash and those of the range, so a count can be too high: it decides the order (any
is right) or keeps a class in, never what is compared.

Links are wanted for components, so pairs that are connected already aren't compared:
first each class meets one hub, then each meets the blocks of other groups with which it
shares a prefix shingle. That step is complete, and it yields links only, however large a
group of near copies is. Links within a component are neither all verified nor counted.

A shingle is a 64-bit hash of its words, a class is a 128-bit hash of its shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, LongType

from .common import connected_components, drop, release, table

MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Classes a task remembers to have sent, at most.
CACHE_CLASSES = 200_000
#: Bytes of text whose words are hashed at once, unless one text is longer.
SLICE_BYTES = 1 << 20
#: Sampled shingles of a chunk and shingles of a pack, about.
CHUNK_SHINGLES, PACK_SHINGLES = 1 << 20, 1 << 18
#: Below it, occurrences are told exactly.
EXACT = 128
#: Shingles of the sets of a block, about.
BLOCK_SHINGLES = 1 << 16
#: Classes whose ids are sent to all tasks at most (40 MB); more of them are joined by a shuffle of the texts.
BROADCAST_CLASSES = 1_000_000
#: Bins of the suffix filter: the upper byte of a hash.
BINS = 256


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIXER
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Shingle sets of texts: A-Z are lower-cased, words are what ASCII blanks part.

    A word's hash is the difference of two prefix sums of its bytes' values times powers
    of an odd number, divided by the power at its start, all modulo 2**64; so the words
    of many texts are hashed together.
    """

    def __init__(self, width: int):
        self.width = width
        rng = np.random.default_rng(20_240_607)
        values = rng.integers(0, 1 << 64, 256, np.uint64)
        values[65:91] = values[97:123]
        self.values = values
        self.base = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            self.powers, self.inverse = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (self.base, pow(self.base, -1, 1 << 64)))

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text of a column, in its order."""
        column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
            yield from self._slice(data[at[first] : at[last]], at[first : last + 1] - at[first])
            first = last

    def _slice(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        n = len(data)
        self._grow(n + 1)
        word = ~self.blank[data]
        cut = np.zeros(n + 1, bool)  # a text begins here
        cut[at] = True
        cut[0] = cut[n] = True
        begin = np.flatnonzero(word & (cut[:n] | ~np.concatenate([[False], word[: n - 1]]))) if n else np.zeros(0, np.int64)
        end = np.flatnonzero(word & (cut[1:] | ~np.concatenate([word[1:], [False]]))) + 1 if n else begin
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        words = mixed((sums[end] - sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))
        places = np.searchsorted(begin, at)
        rolled = np.full(max(0, len(words) - self.width + 1), self.width, np.uint64)
        for k in range(self.width):
            rolled = rolled * MULTIPLIER + words[k : k + len(rolled)]
            rolled ^= rolled >> np.uint64(29)
        rolled = mixed(rolled)
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            if b - a >= self.width:
                s = np.sort(rolled[a : b - self.width + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:  # the whole sequence, told from others by its length
                h = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    h = h * MULTIPLIER + words[k]
                    h ^= h >> np.uint64(29)
                yield mixed(h)
            else:
                yield np.zeros(0, np.uint64)


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str], whole: bool = True) -> Iterator[pa.Table]:
    """The rows of each key in turn, of batches that are sorted by it. If not whole, rows without a key come batch by batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            values = pc.fill_null(batch.column(k), -1).to_numpy(zero_copy_only=False)
            changes |= values[1:] != values[:-1]
        edges = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and (key != last or not whole and key[0] is None):
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def cut(hashes: np.ndarray, idx: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(range, the 32 bits below the range's, idx) of hashes for each of 2**bits ranges that has some."""
    order = np.argsort(hashes)
    ranges = (hashes[order] >> np.uint64(64 - bits)).astype(np.int64)
    tags, idx = ((hashes[order] << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32), idx[order]
    edges = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(ranges) else np.zeros(1, int)
    return [(int(ranges[a]), tags[a:b].tobytes(), idx[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def describe(width: int, bits: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) -> a row a document (id, n, two halves of the class), and for each chunk of them its sampled shingles by range.

    A class that a task has met is counted in the chunk of its first document there;
    `local` is its place in that chunk. The sample is half of all hashes.
    """
    names = ["range", "chunk", "tags", "idx", "doc_id", "n", "k1", "k2", "local", "sampled", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met, held, size = Hasher(width), set(), [], 0
        chunk = TaskContext.get().partitionId() << 32

        def pieces() -> pa.RecordBatch:
            owners = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            ranges, tags, idx = zip(*cut(np.concatenate(held), owners, bits), strict=True)
            of = pa.array(ranges, pa.int32())
            none = [pa.nulls(len(of), t) for t in (id_type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            return pa.RecordBatch.from_arrays([of, pa.array([chunk] * len(of), pa.int64()), pa.array(tags, pa.binary()), pa.array(idx, pa.binary()), *none, of], names=names)

        for batch in batches:
            docs = []
            for s in hasher.sets(batch.column(1)):
                k = xxhash.xxh3_128_intdigest(s.tobytes())
                k1, k2 = signed(k >> 64), signed(k & (1 << 64) - 1)
                if len(s) and k not in met:
                    if len(met) >= CACHE_CLASSES:
                        met.clear()
                    met.add(k)
                    picked = s[(s & np.uint64(1)) == 0]
                    docs.append((len(s), k1, k2, chunk, len(held), len(picked)))
                    held.append(picked)
                    size += len(picked)
                    if size >= CHUNK_SHINGLES or len(held) == 1 << 16:
                        if size:
                            yield pieces()
                        chunk, held, size = chunk + 1, [], 0
                else:
                    docs.append((len(s), k1, k2, None, None, None))
            if docs:
                n, k1, k2, chunks, local, sampled = (pa.array(c, t) for c, t in zip(zip(*docs, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))
                to = pa.array(np.arange(len(docs), dtype=np.int32) & ((1 << bits) - 1))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(docs), pa.int32()), chunks, *[pa.nulls(len(docs), pa.binary())] * 2, batch.column(0), n, k1, k2, local, sampled, to], names=names)
        if size:
            yield pieces()

    return run


def level(n: np.ndarray) -> np.ndarray:
    """A number of occurrences as a byte: itself below EXACT, then four steps a doubling."""
    return np.where(n < EXACT, n, np.minimum(255, EXACT + 4 * np.log2(np.maximum(n, EXACT) / EXACT))).astype(np.uint8)


def tally(idx_type: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the tags of each range; a chunk is told which of its items occur more than once, and how often.

    Rows come sorted by range, so a task holds one range. Rows without a range pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["range"], whole=False):
            schema, rest = part.schema, part.schema.names[4:-1]
            names = ["chunk", "items", "idx", "levels", *rest]
            if part.column("range")[0].as_py() is None:
                none = [pa.nulls(len(part), t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield from pa.Table.from_arrays([part.column("chunk"), *none, *[part.column(c) for c in rest]], names=names).to_batches()
                continue
            tags = [np.frombuffer(t, np.uint32) for t in part.column("tags").to_pylist()]
            idx = [np.frombuffer(i, idx_type) for i in part.column("idx").to_pylist()]
            lengths = np.array([len(t) for t in tags])
            every = np.concatenate(tags)
            order = np.argsort(every, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
            n = np.diff(np.append(starts, len(every)))
            levels = np.empty(len(every), np.uint8)
            levels[order] = np.repeat(level(n), n)
            told = []
            for i, found in zip(idx, np.split(levels, np.cumsum(lengths)[:-1]), strict=True):
                told.append((i[found > 1].tobytes(), found[found > 1].tobytes()))
            columns = [part.column("chunk"), pa.array(lengths, pa.int32()), *[pa.array(c, pa.binary()) for c in zip(*told, strict=True)]]
            yield from pa.Table.from_arrays([*columns, *[pa.nulls(len(part), schema.field(c).type) for c in rest]], names=names).to_batches()

    return run


def gathered(part: pa.Table, idx_type: type, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(idx, levels) of what a chunk of `size` items was told, in order of idx. Raises if the answers aren't of these items."""
    if (n := pc.sum(part.column("items")).as_py() or 0) != size:
        raise RuntimeError(f"a chunk of {size} shingles was told about {n}: its rows came in another order when a task ran anew")
    idx, levels = (np.frombuffer(b"".join(x for x in part.column(c).to_pylist() if x), t) for c, t in (("idx", idx_type), ("levels", np.uint8)))
    order = np.argsort(idx, kind="stable")
    return idx[order], levels[order]


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers and classes of each chunk -> (k1, k2, n, sampled, repeated, few): sampled shingles that occur more than once, and how often those below EXACT do."""
    for part in grouped(batches, ["chunk"]):
        docs = part.filter(pc.is_valid(part.column("local"))).sort_by("local")
        idx, levels = gathered(part, np.uint16, pc.sum(docs.column("sampled")).as_py() or 0)
        n = np.bincount(idx, minlength=len(docs))
        kept = levels < EXACT
        offsets = np.concatenate([[0], np.cumsum(np.bincount(idx[kept], minlength=len(docs)))]).astype(np.int32)
        few = pa.ListArray.from_arrays(pa.array(offsets), pa.array(levels[kept].astype(np.int8)))
        columns = [docs.column(c).combine_chunks() for c in ("k1", "k2", "n", "sampled")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), few], names=["k1", "k2", "n", "sampled", "repeated", "few"])


def sets_of(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(node, k1, k2, text) -> (node, k1, k2, shingles) of the texts that are of the class named; without a node, of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        for batch in batches:
            out = []
            for node, k1, k2, s in zip(*(batch.column(c).to_pylist() for c in range(3)), hasher.sets(batch.column(3)), strict=True):
                # An id that repeats with other texts comes along with them; its class tells them apart.
                data = s.tobytes()
                k = xxhash.xxh3_128_intdigest(data)
                own = signed(k >> 64), signed(k & (1 << 64) - 1)
                if own == (k1, k2) or node is None and len(s):
                    out.append((node, *own, data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "k1", "k2", "shingles"])

    return run


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles), sorted by node -> packs of sets (pack, nodes, lengths, shingles); a node that repeats counts once."""
    at, last, nodes, sets, size = TaskContext.get().partitionId() << 32, None, [], [], 0

    def packed() -> pa.RecordBatch:
        row = {"pack": pa.array([at], pa.int64()), "nodes": pa.array([np.array(nodes, np.int64).tobytes()], pa.binary()),
               "lengths": pa.array([np.array([len(s) // 8 for s in sets], np.int32).tobytes()], pa.binary()), "shingles": pa.array([b"".join(sets)], pa.binary())}
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != last:
                last = node
                nodes.append(node), sets.append(data)
                size += len(data)
                if size >= 8 * PACK_SHINGLES:
                    yield packed()
                    at, nodes, sets, size = at + 1, [], [], 0
    if nodes:
        yield packed()


def packed_pieces(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs -> their shingles by range; idx is the place in the pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(data, np.uint64)
                ranges, tags, idx = zip(*cut(s, np.arange(len(s), dtype=np.uint32), bits), strict=True)
                to = pa.array(ranges, pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([at] * len(to), pa.int64()), pa.array(tags, pa.binary()), pa.array(idx, pa.binary()), to], names=["range", "chunk", "tags", "idx", "to"])

    return run


def prefixes(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pack and its answers -> (hash, key, n, pos): what other sets hold too of each set's prefix, rarest first.

    The prefix is as long as any partner of at least percent / 100 similarity requires;
    pos is the place in the rare-first order. A set's own shingles come first and join nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["chunk"]):
            own = part.filter(pc.is_valid(part.column("nodes"))).to_pylist()[0]
            nodes, n, s = np.frombuffer(own["nodes"], np.int64), np.frombuffer(own["lengths"], np.int32).astype(np.int64), np.frombuffer(own["shingles"], np.uint64)
            idx, levels = gathered(part, np.uint32, len(s))
            owner = np.repeat(np.arange(len(nodes)), n)[idx]
            order = np.lexsort((s[idx], levels, owner))
            owner, hashes = owner[order], s[idx][order]
            held = np.bincount(owner, minlength=len(nodes))
            pos = np.arange(len(owner)) - (np.cumsum(held) - held)[owner] + (n - held)[owner]
            early = pos < (n - -(-percent * n // 100) + 1)[owner]
            owner = owner[early]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[early].view(np.int64)), pa.array(nodes[owner]), pa.array(n[owner].astype(np.int32)), pa.array(pos[early].astype(np.int32))], names=["hash", "key", "n", "pos"])

    return run


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs -> (key, shingles)."""
    for batch in batches:
        for nodes, lengths, data in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            ends = 8 * np.cumsum(np.frombuffer(lengths, np.int32).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(nodes, np.int64)), pa.array([data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())], names=["key", "shingles"])


def enough(a_n: Column, b_lo: Column, b_hi: Column, a_pos: Column, p_lo: Column, p_hi: Column, percent: int) -> Column:
    """Length and positional filter for a set and any of some (lengths b_lo to b_hi) that share a shingle with it, at these places of the common order."""
    fits = (100 * F.least(a_n, b_hi) >= percent * b_lo) & (100 * b_hi >= percent * a_n)
    need = F.ceil(F.lit(percent) * (a_n + F.greatest(b_lo, F.ceil(F.lit(percent) * a_n / 100))) / F.lit(100 + percent))
    most = F.least(a_pos, p_hi) + F.least(a_n - a_pos, b_hi - p_lo)
    return fits & (most >= need)


def index_prefix(n: Column, percent: int) -> Column:
    """Length of the prefix of the shorter set of a pair that must meet the prefix of the longer one."""
    return n - F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent)) + 1


def bins(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of BINS equal parts of the hash range."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS).astype(np.uint32)


def check(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows (side, key, hub, own, shingles) -> links (a, b) of the first side's classes with the second's.

    A pair passes the length filter, then the suffix filter (sets that share enough can't
    differ much in the parts of the hash range), then its sets are compared, once: not if
    one is the other's hub, and within one group only from the smaller key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["label", "yb", "xb"]):
            first = pc.equal(part.column("side"), 0)
            out = []
            (xs, x_hubs, x_own, x_sets), (ys, y_hubs, _, y_sets) = (
                [*(side.column(c).to_numpy() for c in ("key", "hub", "own")), [np.frombuffer(s, np.uint64) for s in side.column("shingles").to_pylist()]] for side in (part.filter(first), part.filter(pc.invert(first))))
            if not len(xs) or not len(ys):
                continue
            n, binned = np.array([len(s) for s in y_sets]), np.stack([bins(s) for s in y_sets])
            for x, hub, own, one in zip(xs, x_hubs, x_own, x_sets, strict=True):
                at = np.flatnonzero((100 * np.minimum(n, len(one)) >= percent * np.maximum(n, len(one))) & (ys != x) & (ys != hub) & (y_hubs != x) & (~own | (x < ys)))
                least = np.minimum(bins(one), binned[at]).sum(1)
                for j in at[100 * least >= percent * (len(one) + n[at] - least)].tolist():
                    both = len(one) + n[j] - len(np.union1d(one, y_sets[j]))
                    if 100 * both >= percent * (len(one) + n[j] - both):
                        out.append((min(x, ys[j]), max(x, ys[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


def verified(xs: DataFrame, ys: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links between the classes of xs and of ys (label, yb, xb, key, hub, own) with the same label and blocks; a task holds one block of each."""
    sides = xs.withColumn("side", F.lit(0)).unionByName(ys.withColumn("side", F.lit(1)))
    met = sides.join(sets, "key").repartition("label", "yb", "xb").sortWithinPartitions("label", "yb", "xb")
    return table(met.select("label", "yb", "xb", "side", "key", "hub", "own", "shingles").mapInArrow(check(percent), "a long, b long"), name)


def part_of(key: str, n: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.col(n) if isinstance(n, str) else n).cast("int")


def parts(shingles: Column) -> Column:
    """In how many blocks classes of so many shingles in all go."""
    return F.ceil(shingles / BLOCK_SHINGLES)


def hubs_of(shared: DataFrame, percent: int) -> DataFrame:
    """(key, n, hub): for each class the hub it shares most prefix shingles with.

    The hub of a shingle is the class whose prefix shingles are shared most in all: of near
    copies the one nearest to all others.
    """
    sizes = shared.groupBy("hash").agg(F.count("*").alias("c")).where("c > 1")
    known = shared.join(sizes, "hash").groupBy("key").agg(F.sum("c").alias("fame"))
    hubs = shared.join(known, "key").groupBy("hash").agg(F.max_by(F.struct("key", "n", "pos"), F.struct("fame", "key")).alias("hub"))
    fits = enough(F.col("n"), F.col("hub.n"), F.col("hub.n"), F.col("pos"), F.col("hub.pos"), F.col("hub.pos"), percent)
    near = shared.join(hubs, "hash").where((F.col("key") != F.col("hub.key")) & fits)
    best = near.groupBy("key", "n", F.col("hub.key").alias("hub")).agg(F.count("*").alias("c"))
    return table(best.groupBy("key", "n").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")), "hubs")


def hub_links(hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """First links: each class with its hub; of two that are each other's hubs one side asks."""
    split = hubs.groupBy("hub").agg(parts(F.sum("n")).alias("parts"))
    back = hubs.select(F.col("key").alias("hub"), F.col("hub").alias("key"), F.lit(True).alias("mutual"))
    asked = hubs.join(back, ["key", "hub"], "left").where("mutual is null or key < hub")
    rest = [F.lit(0).alias("yb"), F.lit(-1).cast("long").alias("hub"), F.lit(False).alias("own")]
    xs = asked.join(split, "hub").select(F.col("hub").alias("label"), part_of("key", "parts").alias("xb"), "key", *rest)
    ys = split.select(F.col("hub").alias("label"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("xb"), F.col("hub").alias("key"), *rest)
    return verified(xs, ys, sets, percent, "links")


def last_links(shared: DataFrame, hubs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All links that aren't within a component yet: a class meets the blocks of other groups that hold its prefix shingles.

    Groups are components and, of the classes left alone, those that have the same hub. A
    class meets a block if they share a prefix shingle at places and lengths that allow a
    link; between groups the smaller one asks. What a task holds is two blocks of sets.
    """
    nodes = shared.select("key", "n").distinct().join(hubs.select("key", "hub"), "key", "left").join(labels.toDF("key", "component"), "key", "left")
    label = F.when(F.col("component").isNotNull(), F.col("component") * 2).otherwise(F.coalesce("hub", "key") * 2 + 1)
    nodes = nodes.select("key", "n", F.coalesce("hub", F.lit(-1)).alias("hub"), label.alias("label"))
    sizes = nodes.groupBy("label").agg(F.count("*").alias("size"), parts(F.sum("n")).alias("parts"))
    nodes = table(nodes.join(sizes, "label").withColumn("yb", part_of("key", "parts")), "nodes")
    rows = shared.join(nodes.select("key", "label", "size", "yb"), "key")
    held = rows.groupBy("hash", "label", "size", "yb").agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("pos").alias("p_lo"), F.max("pos").alias("p_hi"))
    x, y = rows.alias("x"), held.alias("y")
    asks = (F.struct("y.size", "y.label") > F.struct("x.size", "x.label")) | ((F.col("x.label") == F.col("y.label")) & (F.col("x.label") % 2 != 0) & (F.col("x.size") > 1))
    fits = enough(F.col("x.n"), F.col("y.n_lo"), F.col("y.n_hi"), F.col("x.pos"), F.col("y.p_lo"), F.col("y.p_hi"), percent)
    early = (F.col("x.pos") < index_prefix(F.col("x.n"), percent)) | (F.col("y.p_lo") < index_prefix(F.col("y.n_hi"), percent))
    met = x.join(y, (F.col("x.hash") == F.col("y.hash")) & asks & fits & early).select("x.key", F.col("x.label").alias("from"), F.col("x.n").alias("n"), F.col("y.label").alias("label"), F.col("y.yb").alias("yb")).distinct()
    met = table(met, "met")
    split = table(met.groupBy("label", "yb").agg(parts(F.sum("n")).cast("int").alias("x_parts")), "split")
    own = (F.col("from") == F.col("label")).alias("own")
    xs = met.join(split, ["label", "yb"]).join(nodes.select("key", "hub"), "key").select("label", "yb", part_of("key", "x_parts").alias("xb"), "key", "hub", own)
    ys = nodes.join(split, ["label", "yb"]).select("label", "yb", F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1)).alias("xb"), "key", "hub", F.lit(False).alias("own"))
    links = verified(xs, ys, sets, percent, "more")
    drop(met), drop(split), drop(nodes)
    return links


def components(shared: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, component) of the classes in `shared` (hash, key, n, pos)."""
    hubs = hubs_of(shared, percent)
    links = hub_links(hubs, sets, percent)
    release(shared.sparkSession)
    labels = connected_components(links)
    more = last_links(shared, hubs, sets, labels, percent)
    return connected_components(links.unionByName(more)) if not more.isEmpty() else labels


def counted(pieces: DataFrame, idx_type: type, schema: str) -> DataFrame:
    """Pieces dealt out by range and counted there."""
    return pieces.repartition("to").sortWithinPartitions("range").mapInArrow(tally(idx_type), schema)


def linkable(census: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, k1, k2, rep): classes whose sampled shingles leave room for a link.

    A shingle is a class's own if it occurs as often as chunks hold the class; a class
    with more than 1 - percent / 100 of its shingles its own links with nothing.
    """
    chunks = census.where("chunk is not null").select("chunk", "items", "idx", "levels", "k1", "k2", "n", "local", "sampled")
    told = chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(repeats, "k1 long, k2 long, n int, sampled int, repeated int, few array<tinyint>")
    per = told.groupBy("k1", "k2").agg(F.count("*").alias("m"), *[F.first(c).alias(c) for c in ("n", "sampled", "repeated", "few")])
    own = F.when(F.col("m") == 1, F.col("sampled") - F.col("repeated")).otherwise(F.size(F.filter("few", lambda c: c == F.col("m"))))
    return table(per.where(100 * (F.col("n") - own) >= percent * F.col("n")).join(classes, ["k1", "k2"]).select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "rep"), "linkable")


def packs_of(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The sets of the wanted classes in packs, each from its first document (or, if none has an id, from any)."""
    kind = "node long, k1 long, k2 long, shingles binary"
    firsts = wanted.where("rep is not null").select(F.col("rep").alias("doc_id"), "node", "k1", "k2")
    if wanted.count() <= BROADCAST_CLASSES:
        firsts = F.broadcast(firsts)
    named = rows.join(firsts, "doc_id").select("node", "k1", "k2", "text").mapInArrow(sets_of(width), kind)
    blank = F.lit(None).cast("long")
    nameless = rows.where("doc_id is null").select(blank.alias("node"), blank.alias("k1"), blank.alias("k2"), "text").mapInArrow(sets_of(width), kind)
    nameless = nameless.drop("node").join(wanted.where("rep is null").select("node", "k1", "k2"), ["k1", "k2"])
    sets = named.select("node", "shingles").unionByName(nameless.select("node", "shingles"))
    return table(sets.repartition("node").sortWithinPartitions("node").mapInArrow(pack, "pack long, nodes binary, lengths binary, shingles binary"), "packs")


def shared_prefixes(packs: DataFrame, percent: int, bits: int) -> DataFrame:
    """(hash, key, n, pos) of the prefix shingles that other classes hold too."""
    answers = counted(packs.select("pack", "shingles").mapInArrow(packed_pieces(bits), "range int, chunk long, tags binary, idx binary, to int"), np.uint32, "chunk long, items int, idx binary, levels binary")
    both = answers.unionByName(packs.withColumnRenamed("pack", "chunk"), allowMissingColumns=True)
    return table(both.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(prefixes(percent), "hash long, key long, n int, pos int"), "shared")


def jaccard_groups(df: DataFrame, percent: int = 75, width: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_shingles long, class_id, component_id) of each row of df.

    Two rows link when 100 * shared >= percent * united over their sets of `width`-word
    shingles (fewer words: all of them as one). class_id is the smallest id with the same
    set, component_id the smallest that links lead to, itself included. Null and empty
    texts and those without words have no shingles and stand alone. Ids are of any type
    with an order (whole numbers come back as long); rows that repeat an id share its
    component, a row without an id has none (its text still links others). Other columns are ignored, whatever their names. An
    empty table gives an empty result.
    """
    spark = df.sparkSession
    # Ranges of the hash, a few for each shuffle partition: what a task counts at once.
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    kind = df.schema[id_col].dataType
    kind = LongType() if isinstance(kind, IntegralType) else kind
    rows = df.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text"))
    doc = f"doc_id {kind.simpleString()}, n int, k1 long, k2 long, local int, sampled int"
    pieces = rows.mapInArrow(describe(width, bits, to_arrow_type(kind)), f"range int, chunk long, tags binary, idx binary, {doc}, to int")
    census = table(counted(pieces, np.uint16, f"chunk long, items int, idx binary, levels binary, {doc}"), "census")
    release(spark)
    docs = census.where("k1 is not null").select("doc_id", "n", "k1", "k2")
    classes = table(docs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    wanted = linkable(census, classes, percent)
    release(spark)
    packs = packs_of(rows, wanted, width)
    release(spark)
    shared = shared_prefixes(packs, percent, bits)
    sets = packs.select("nodes", "lengths", "shingles").mapInArrow(unpack, "key long, shingles binary")
    labels = components(shared, sets, percent)
    drop(shared), drop(packs)
    named = classes.join(wanted.select("k1", "k2", "node"), ["k1", "k2"], "left").join(labels.toDF("node", "label"), "node", "left")
    least = named.where("label is not null").groupBy("label").agg(F.min("rep").alias("component"))
    named = table(named.join(least, "label", "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("component")), "named")
    out = docs.join(named, ["k1", "k2"], "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
