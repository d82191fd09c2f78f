"""Removal of repeated passages in chunks with content-defined borders.

A text is a row of parts: its lines, cut where a word's hash is below those of the words
beside it. A hash rolls over the hashes of the parts, WINDOW at a time; where it is below
both of its neighbours, a chunk begins in the middle of the window. So a border depends on
a few words around it and on nothing before them, and a passage is cut alike wherever it
stands, but for its ends. Hashes find chunks that may occur more than once anywhere; those
are grouped by their bytes, and all but the first of a group (by document, then place) go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A chunk is so many parts at least, about three on average; so is a part in words.
LEAST = 2
#: The rolling hash spans so many parts.
WINDOW = 2
#: A line that stands many times in a row has a border after each so many.
RUN = 4
#: Bytes up to this one are blanks.
BLANK = 32
#: Bytes of text in work at once, unless one text is longer.
SLICE_BYTES = 1 << 20
BASE, MIXER = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
#: The bitmap that tells which chunks may be repeated: 2**26 bits.
BITMAP_BITS = 26


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIXER
    return h ^ (h >> np.uint64(29))


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
#: Powers of BASE and of its inverse (modulo 2**64), as many as the longest slice so far took.
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    if len(POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            POWERS[k] = np.multiply.accumulate(out)
    return POWERS


class Rolling:
    """Hashes of any runs of `values` (hashes of bytes or of parts): the same for the same values, wherever they stand."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def below(h: np.ndarray) -> np.ndarray:
    """Which hashes are below both of their neighbours; the two at the ends aren't."""
    out = np.zeros(len(h), bool)
    out[1:-1] = (h[1:-1] < h[:-2]) & (h[1:-1] < h[2:])
    return out


def alike(owner: np.ndarray, by: int) -> np.ndarray:
    """Which entries have an owner that the entry `by` places on has too."""
    out = np.zeros(len(owner), bool)
    if by > 0:
        out[:-by] = owner[:-by] == owner[by:]
    else:
        out[-by:] = owner[-by:] == owner[:by]
    return out


def firsts(owner: np.ndarray) -> np.ndarray:
    return ~alike(owner, -1)


def borders(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries a piece begins at: the first of an owner, and where the hash is below both neighbours', with LEAST entries of the owner on either side."""
    return firsts(owner) | below(h) & alike(owner, -LEAST) & alike(owner, LEAST - 1)


def chunk_starts(h: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which parts begin a chunk, by the hashes and texts of the parts and which are whole lines; no chunk is of one part, unless its text is."""
    rolled = np.zeros(len(h), np.uint64)
    at = np.arange(len(h))
    half = WINDOW // 2
    mid = at[half : len(h) - (WINDOW - half) + 1]
    rolled[mid] = Rolling(h).of(mid - half, mid - half + WINDOW)
    again = ~firsts(h) & ~firsts(owner) & whole
    again[1:] &= whole[:-1]
    turn = at - np.maximum.accumulate(np.where(again, 0, at))
    again[:-1] &= again[1:].copy()  # the part after a border is alike too, so that no chunk is of one part
    return borders(rolled, owner) | again & (turn % RUN == 0) & alike(owner, 1)


class Layout(NamedTuple):
    """Parts and chunks of texts: where parts start, of which text each chunk is, its first part, its number of parts and its bytes but for blanks at the ends."""

    part_start: np.ndarray
    part_text: np.ndarray
    text: np.ndarray
    part: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray


def layout(data: np.ndarray, ends: np.ndarray) -> Layout:
    """The layout of texts that stand one after the other in `data`, each up to its end. Texts of blanks have no parts."""
    solid = data > BLANK
    full = np.diff(ends, prepend=0) > 0
    begun, done = solid.copy(), solid.copy()
    begun[1:] &= ~solid[:-1]
    done[:-1] &= ~solid[1:]
    heads, tails = (ends - np.diff(ends, prepend=0))[full], ends[full] - 1
    begun[heads], done[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(begun), np.flatnonzero(done) + 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Layout(none, none, none, none, none, none, none)
    rolling = Rolling(LETTERS[data])
    text = np.searchsorted(ends, start, "right")
    line = np.searchsorted(np.flatnonzero(data == 10), start) + text  # grows with lines and texts
    fresh = firsts(line)
    word = np.flatnonzero(borders(rolling.of(start, end), line))
    part_end = end[np.append(word[1:], len(start)) - 1]
    part_start, part_text = start[word], text[word]
    whole = fresh[word] & np.append(fresh[word][1:], True)
    part = np.flatnonzero(chunk_starts(rolling.of(part_start, part_end), part_text, whole))
    size = np.diff(np.append(part, len(word)))
    return Layout(part_start, part_text, part_text[part], part, size, part_start[part], part_end[part + size - 1])


def bit_of(h: np.ndarray) -> np.ndarray:
    """A hash's place in the bitmap: its highest BITMAP_BITS bits."""
    return (h.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def bitmap(repeated: DataFrame) -> np.ndarray:
    """Which places of the bitmap the repeated hashes take: 8 MB, whatever the corpus; more hashes only pass more chunks on."""
    word = F.shiftrightunsigned("hash", 64 - BITMAP_BITS + 3).alias("byte")
    bit = F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - BITMAP_BITS}) & 7 as int))")
    found = repeated.groupBy(word).agg(F.bit_or(bit).cast("int").alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP_BITS - 3, np.uint8)
    out[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return out


def may_repeat(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bit_of(h)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends) of runs of texts of about SLICE_BYTES; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[at[row] : at[upto]], at[row + 1 : upto + 1] - at[row]
        row = upto


def places(text: np.ndarray) -> np.ndarray:
    """The place of each chunk in its text."""
    fresh = firsts(text)
    return np.arange(len(text)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(text) else text


def hashed(data: np.ndarray, found: Layout) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which, bytes, hash) of the chunks of LEAST parts or more."""
    which = np.flatnonzero(found.size >= LEAST)
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(found.start[which].tolist(), found.end[which].tolist(), strict=True)]
    return which, texts, np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)


def cut(sent: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text) -> the hashes of the chunks, or with a bitmap (id, place, hash, bytes) of those that may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, ends in slices(batch.column(1)):
                found = layout(data, ends)
                which, texts, h = hashed(data, found)
                if sent is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], names=["hash"])
                    continue
                keep = np.flatnonzero(may_repeat(sent.value, h))
                docs = batch.column(0).take(pa.array(row + found.text[which[keep]]))
                at = pa.array(places(found.text)[which[keep]], pa.int32())
                yield pa.RecordBatch.from_arrays([docs, at, pa.array(h[keep]), pa.array([texts[k] for k in keep.tolist()], pa.binary())], names=["doc", "place", "hash", "chunk"])

    return run


def later(kept: pa.Array, row: np.ndarray, place: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which chunks (row, place, hash) aren't among the kept (place, hash) of their row."""
    of = np.repeat(np.arange(len(kept)), kept.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    held = kept.flatten()
    first = np.rec.fromarrays([of, held.field(0).to_numpy(zero_copy_only=False).astype(np.int64), held.field(1).to_numpy(zero_copy_only=False).astype(np.int64)])
    return ~np.isin(np.rec.fromarrays([row, place, h]).view("V24"), first.view("V24"))


def rebuild(sent: Broadcast, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, kept) -> the text that is left, and counts. Of the chunks that may be repeated all go but those kept: first ones, and such as occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, ends in slices(batch.column(1)):
                n = len(ends)
                found = layout(data, ends)
                n_chunks = np.bincount(found.text, minlength=n)
                k, _, h = hashed(data, found)
                known = batch.column(0).slice(row, n).is_valid().to_numpy(zero_copy_only=False)
                may = may_repeat(sent.value, h) & known[found.text[k]]
                k, h = k[may], h[may]
                k = k[later(batch.column(2).slice(row, n), found.text[k], places(found.text)[k], h)]
                of = found.text[k]
                # A chunk goes with the blanks after it, a text's first one also with those before it.
                heads = ends - np.diff(ends, prepend=0)
                begin = np.where(firsts(found.text), heads[found.text], found.start)
                close = np.where(alike(found.text, 1), np.append(begin[1:], 0), ends[found.text])
                away = np.zeros(len(data) + 1, np.int32)
                np.add.at(away, begin[k], 1)
                np.add.at(away, close[k], -1)
                stay = np.cumsum(away)[:-1] == 0
                left = np.concatenate([[0], np.cumsum(stay)])[np.concatenate([[0], ends])]
                text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(left.astype(np.int64).tobytes()), pa.py_buffer(data[stay].tobytes())]).cast(pa.string())
                if batch.column(1).null_count:
                    text = pc.if_else(batch.column(1).slice(row, n).is_null(), pa.scalar(None, pa.string()), text)
                blank = (n_chunks == 0) & (ends > heads)  # texts of blanks: one part, one chunk
                counts = [np.bincount(found.part_text, minlength=n) + blank, n_chunks + blank, np.bincount(of, minlength=n), np.bincount(of, found.size[k], n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), text, *(pa.array(c.astype(np.int32)) for c in counts)], names=names)

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, text, n_lines, n_chunks, removed_chunks, removed_lines) of each row of df.

    Lines are counted in parts, as they are cut. Of every chunk of at least LEAST parts
    that occurs more than once, over all texts, the occurrence of the smallest (id, place)
    stays and the others go; chunks are the same when their bytes are, blanks at their two
    ends aside. What is repeated stays only near the ends of a passage, where chunks hold
    words of its neighbours. A word over and over within a line has no borders and is one
    piece; words are what stands between blanks (bytes up to 32). Null and empty texts
    stay as they are. Ids are whole numbers; rows that repeat an id are one document of
    which every row keeps its firsts; rows without an id neither lose
    nor cost anything. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    known = rows.where("doc is not null")
    at = F.struct("doc", "place")
    repeated = known.mapInArrow(cut(None), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    sent = df.sparkSession.sparkContext.broadcast(bitmap(repeated))
    texts = known.mapInArrow(cut(sent), "doc long, place int, hash long, chunk binary")
    # Partial minima: however common a chunk is, a task sends it once. Only the first ones go back, by document.
    first = texts.groupBy("hash", "chunk").agg(F.min(F.struct("doc", "place")).alias("at"))
    kept = first.groupBy("at.doc").agg(F.collect_set(F.struct("at.place", "hash")).alias("kept"))
    names = [id_col, "text", "n_lines", "n_chunks", "removed_chunks", "removed_lines"]
    # Rows without an id meet no kept chunks, and lose none.
    others = rows.where("doc is null").withColumn("kept", F.lit(None).cast("array<struct<place: int, hash: bigint>>"))
    return known.join(kept, "doc", "left").unionByName(others).mapInArrow(rebuild(sent, names), f"`{id_col}` long, text string, n_lines int, n_chunks int, removed_chunks int, removed_lines int")
