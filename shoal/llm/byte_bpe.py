"""Byte-level BPE: texts to token ids and back, by the tiktoken library and a local file of ranks.

The pattern cuts a text into pre-tokens and each is merged by rank on its bytes. Long
texts are cut first, where any lexing must have a border: before white space that
follows something else, since no alternative of the pattern goes on from there. A run
of white space too long for the library's regular expressions is a pre-token by
itself, but for its last character if something follows, and is merged without them.
Ids are decoded to raw bytes, so tokens that hold parts of characters come back whole.

A task holds one batch of texts; nothing is shuffled and only the ranks are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters after which a long text is cut at the next safe place.
PART = 65_536
#: White space of so many characters is a pre-token that goes past the library's regular expressions.
LONG_RUN = 4096
#: Output bytes after which a batch is sent on.
BATCH_BYTES = 8 << 20

SAFE = regex.compile(r"(?<=\S)(?=\s)")
RUN = regex.compile(rf"\s{{{LONG_RUN},}}+")


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The library's encoder for the text of a rank file; made once a worker."""
    import base64

    import tiktoken

    lines = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks={base64.b64decode(token): int(rank) for token, rank in lines}, special_tokens={})


def parts(text: str, most: int = PART) -> Iterator[tuple[str, bool]]:
    """(part, alone): the parts of a text in order; alone says that a part is one pre-token."""
    at = 0
    if len(text) >= LONG_RUN:
        for run in RUN.finditer(text):
            start, end = run.span()
            end -= end < len(text)  # the last blank belongs to what follows
            yield from ((part, False) for part in cut(text[at:start], most))
            yield text[start:end], True
            at = end
    yield from ((part, False) for part in cut(text[at:] if at else text, most))


def cut(text: str, most: int) -> Iterator[str]:
    at = 0
    while len(text) - at > most and (border := SAFE.search(text, at + most)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:] if at else text


def tokens_of(enc, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    ids: list[int] = []
    for part, alone in parts(text):
        if part:
            ids += enc._encode_single_piece(part) if alone else enc.encode_ordinary(part)
    return np.array(ids, "<u4").tobytes()


def sent_on(batch: pa.RecordBatch, columns: list[int], made: Iterator[tuple], kinds: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Some columns of a batch and what is made of its rows, in batches of bounded size. A made row ends with its number of bytes."""
    start, size, rows = 0, 0, []
    for k, (*row, n) in enumerate(made):
        rows.append(row)
        size += n
        if size > BATCH_BYTES or k + 1 == batch.num_rows:
            own = [batch.column(c).slice(start, len(rows)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=names)
            start, size, rows = k + 1, 0, []


def encode(df: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens long, tokens binary) for each row of df, with its repeats: the ids of the whole text, 4 bytes each.

    No special tokens: their strings are ordinary text. A null or empty text has no tokens
    (0 and empty bytes); bytes that aren't UTF-8 stand as the replacement character. A null
    id stays null; other columns of df are ignored, whatever their names. An empty table
    gives an empty result.
    """
    sent = df.sparkSession.sparkContext.broadcast((ranks, pattern))  # the rank file: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*sent.value)
        for batch in batches:
            made = ((len(t := tokens_of(enc, x.as_py().decode("utf-8", "replace") if x.is_valid else "")) // 4, t, len(t)) for x in batch.column(1))
            yield from sent_on(batch, [0], made, [pa.int64(), pa.binary()], [id_col, "n_tokens", "tokens"])

    rows = df.select(F.col(id_col), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, tokens binary")


def decode(encoded: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(id_col, n_tokens long, tokens binary, decoded binary): the raw bytes that the ids of a column of packed tokens stand for.

    Null tokens decode to no bytes. An id that no token has, or bytes that aren't whole ids, fail the job.
    """
    sent = encoded.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(*sent.value)
        for batch in batches:
            made = ((b := enc.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist()), len(b)) for x in batch.column(2))
            yield from sent_on(batch, [0, 1, 2], made, [pa.binary()], [id_col, "n_tokens", "tokens", "decoded"])

    rows = encoded.select(F.col(id_col), (F.coalesce(F.octet_length(tokens), F.lit(0)) / 4).cast("long").alias("n_tokens"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, tokens binary, decoded binary")
