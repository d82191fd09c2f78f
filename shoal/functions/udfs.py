"""User functions over batches: encoders, detectors, and extraction that survives bad items. No model ships."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Things found that a task holds at once.
FOUND = 4096

Encoder = Callable[[Sequence[Any]], Sequence[Sequence[float]]]


def encoder_udf(load: Callable[[], Encoder], batch: int = 64) -> Callable[[str | Column], Column]:
    """K1: a column function from items to unit vectors; `load` makes the encoder once a task."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in batches:
            out: list[list[float]] = []
            for k in range(0, len(s), batch):
                v = np.asarray(model(s.iloc[k : k + batch].tolist()), float)
                out += (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-10)).tolist()
            yield pd.Series(out)

    return encode


def detect(df: DataFrame, key: str, item: str, load: Callable[[], Callable[[Any], list[tuple[float, float, float, float, float, list[float]]]]]) -> DataFrame:
    """K2: one row for each thing a user's detector finds in an item: (key, face_idx, score, x, y, w, h, v)."""

    columns = [key, "face_idx", "score", "x", "y", "w", "h", "v"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = load()
        for pdf in batches:
            rows = []
            for k, it in zip(pdf[key], pdf[item], strict=True):
                for i, (s, x, y, w, h, v) in enumerate(find(it)):
                    rows.append((k, i, float(s), float(x), float(y), float(w), float(h), list(map(float, v))))
                    if len(rows) == FOUND:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return df.select(key, item).mapInPandas(run, f"{key} long, face_idx int, score double, x double, y double, w double, h double, v array<double>")


def extract(df: DataFrame, key: str, item: str, load: Callable[[], Callable[[Any], list[float]]], block: int = 256) -> DataFrame:
    """K3: (key, v, error): a user's function on each item; one that fails gives its error and leaves its neighbours alone.

    A block of items runs in a process of its own, which ends with it and so gives back
    what the function leaks. A block whose process dies is halved until the item that kills
    it is alone, which then has that as its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), block):
                part = pdf.iloc[s : s + block]
                v, error = zip(*isolated(load, part[item].tolist()), strict=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "v": pd.Series(list(v), dtype=object), "error": pd.Series(list(error), dtype=object)})

    return df.select(key, item).mapInPandas(run, f"{key} long, v array<double>, error string")


def isolated(load: Callable[[], Callable[[Any], list[float]]], items: list) -> list[tuple[list[float] | None, str | None]]:
    """(result, error) of each item, worked on in a child process; of halves if it dies."""
    receive, send = FORK.Pipe(duplex=False)
    child = FORK.Process(target=worked, args=(send, load, items))
    child.start()
    send.close()
    try:
        return receive.recv()
    except EOFError:  # the child ended without an answer
        child.join()
        if len(items) == 1:
            return [(None, f"the worker ended with code {child.exitcode}")]
        half = len(items) // 2
        return isolated(load, items[:half]) + isolated(load, items[half:])
    finally:
        child.join()
        receive.close()


FORK = multiprocessing.get_context("fork")


def worked(send: Any, load: Callable[[], Callable[[Any], list[float]]], items: list) -> None:
    f, out = load(), []
    for it in items:
        try:
            out.append((list(map(float, f(it))), None))
        except Exception as e:  # any error of the user's function belongs to its item
            out.append((None, f"{type(e).__name__}: {e}"))
    send.send(out)
    send.close()


def hashing_encoder(width: int = 16) -> Encoder:
    """A stand-in encoder for tests: words fall into places by their hash."""
    import zlib

    def encode(texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts, strict=True):
            for w in (text or "").split():
                h = zlib.crc32(w.encode())
                row[h % width] += 1 if h >> 16 & 1 else -1
        return out

    return encode
