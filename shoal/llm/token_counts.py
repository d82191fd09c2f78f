"""Token counts by a two-tier lookup on the map side.

Tier one is a broadcast table from frequent pre-tokens to their token counts; tier
two is a bounded cache in each worker, filled by encoding what the table misses.
Texts never leave their task and no pre-token is shuffled: the frequent table comes
from bounded per-task summaries (only pre-tokens above a share of the task's own).

The model must merge nothing across a pre-token border. For a sentencepiece BPE
model that is so when white space is a piece's prefix only; `split_safe` checks it
on the vocabulary, and texts go to the encoder whole where it fails.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task reports a pre-token seen in at least one of so many of its own.
SHARE = 20_000
#: Rows of the broadcast table at most (a pre-token of up to 64 bytes and a count each).
TABLE_ROWS = 65_536
#: Entries of a worker's cache; it starts anew beyond that. Longer pre-tokens aren't kept.
CACHE_ROWS, CACHE_CHARS = 200_000, 64


def split_safe(model: bytes) -> bool:
    """Whether encoding each ' '-led piece of a text by itself gives the whole text's tokens."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    probe = "ﬁＡ é x  y"
    plain = sp.decode(sp.encode(probe)) == probe
    inner = re.compile("[^▁]▁")
    return plain and not any(inner.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


class Lengths(dict):
    """Pre-token -> number of tokens, encoding on a miss. Bounded."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece

        super().__init__(frequent)
        self.frequent, self.encode = frequent, sentencepiece.SentencePieceProcessor(model_proto=model).encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) or 1  # an empty part is a last blank
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ROWS + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def pieces(text: str) -> list[str]:
    """Parts of a text that the encoder treats apart: each word takes the blank before it as its prefix.

    Runs of several blanks merge with each other and the word behind them, so they stay in one part.
    The encoder itself puts a blank before a part, hence the part's own first blank goes.
    """
    if "  " not in text and "▁" not in text and text[:1] != " ":
        return text.split(" ")
    return BORDER.split(" " + text.replace("▁", " "))[1:]


#: The first blank of a run; the others belong to what follows.
BORDER = re.compile("(?<! ) ")


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequent pre-tokens of a task, by lossy counting: at most 8 x SHARE counters are held."""
    seen: Counter[str] = Counter()
    total, floor = 0, 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words = pieces(text)
                total += len(words)
                seen.update(words)
                if len(seen) > 8 * SHARE:
                    floor += 1
                    while len(seen) > 4 * SHARE:
                        seen = Counter({w: n - 1 for w, n in seen.items() if n > 1})
    least = max(2, total // SHARE)
    rows = [(w, n) for w, n in seen.items() if n >= least and len(w) <= CACHE_CHARS]
    yield pa.RecordBatch.from_pydict({"word": pa.array([r[0] for r in rows], pa.string()), "n": pa.array([r[1] for r in rows], pa.int64())})


def frequent_words(df: DataFrame, text: str, rows: int = TABLE_ROWS) -> list[str]:
    """The `rows` most frequent pre-tokens at most, from all rows of df. Which they are changes speed only."""
    said = df.select(F.col(text).cast("string")).mapInArrow(summaries, "word string, n long")
    top = said.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(rows)
    return [r[0] for r in top.select("word").collect()]


def token_counts(df: DataFrame, model: bytes, id_col: str = "doc_id", text: str = "text", rows: int = TABLE_ROWS) -> DataFrame:
    """(id_col, n_bytes long, n_tokens long) for each row of df, in its order and with its repeats.

    Tokens are those of the whole text without added special tokens. A null text counts
    as empty (0 bytes, 0 tokens); a null id stays null; other columns of df are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark = df.sparkSession
    safe = split_safe(model)
    table: dict[str, int] = {}
    if safe:
        lengths = Lengths(model, {})
        table = {w: lengths[w] for w in frequent_words(df, text, rows)}
    sent = spark.sparkContext.broadcast((model, table))  # at most `rows` short strings and the model file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = sent.value
        lengths = Lengths(model, frequent)
        of = lengths.__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if safe:
                n = [sum(map(of, pieces(t))) if t else 0 for t in texts]
            else:
                n = [len(lengths.encode(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    rows_in = df.select(F.col(id_col), F.col(text).cast("string").alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(rows_in.dtypes)[id_col]
    return rows_in.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
