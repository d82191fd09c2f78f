"""Groups taken in turn within partitions: many small groups a batch, for steps that are sequential inside a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, in frames that hold every key's rows together: one batch and the key it ends in at most."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        keys = pdf[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        last = cuts[-1] if len(cuts) else 0
        held = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last]
    if held is not None and len(held):
        yield held


def edges(keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def in_turn(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f of the rows of each key. Rows are partitioned and sorted by key, so a task holds one batch and the key it ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, key):
            at = edges(pdf[key].to_numpy())
            yield pd.concat([f(pdf.iloc[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], ignore_index=True)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
