"""Whitening of embeddings by a covariance from squares only.

Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b), so the variances of the dimensions and of
their pairwise sums give every cross-covariance. Components are quantised to integers
and all sums are exact: a first pass adds up the dimensions, a second one the squares
of what is left of each dimension, and each sum of two, about its centre. The centre of
the second pass is the integer nearest the mean, so that squares stay small; the rest
of the centring is exact too (the squares about the mean are those about the centre less
r^2/n, r being what is left of the sum). The driver holds a number for each pair of
dimensions, whatever the rows, and takes eigenvectors of the matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quantisation: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Rows that a task squares at once.
ROWS = 2048
#: Sums travel as limbs of so many bits, which Spark adds each by itself.
LIMB = 40


@dataclass
class Model:
    """What whitening needs of the vectors of one length."""

    n: int
    centres: list[int]
    """The integers nearest the means."""
    left: list[int]
    """Of each dimension, the sum less n times the centre."""
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    """Eigenvectors as columns, by falling eigenvalue."""

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros(len(self.values))

    def usable(self) -> np.ndarray:
        """Which components have a variance above the rounding of the matrix; the others can't be scaled."""
        return self.values > len(self.values) * np.finfo(float).eps * max(float(self.values.max(initial=0.0)), 0.0)

    def projector(self, components: int) -> np.ndarray:
        """Columns that whiten centred rows; NaN for what can't be scaled."""
        k = min(components, len(self.values))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.usable()[:k], self.vectors[:, :k] / np.sqrt(np.maximum(self.values[:k], 0)), np.nan)


def quantised(flat: np.ndarray) -> np.ndarray:
    """x of components: int64, or Python integers where one is too large for squares of sums in 64 bits."""
    scaled = np.floor(flat * SCALE)
    if len(flat) and np.abs(scaled).max() >= 2**24:
        return np.array([int(x) + SHIFT for x in scaled.ravel()], object).reshape(flat.shape)
    return scaled.astype(np.int64) + SHIFT


def blocks(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, x) of the rows of a batch, those of one length together and ROWS at most."""
    column = batch.column(at)
    widths = np.diff(column.offsets.to_numpy())
    flat, start = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for s in range(0, len(rows), ROWS):
            some = rows[s : s + ROWS]
            yield int(width), some, quantised(flat[start[some][:, None] + np.arange(width)])


def finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not empty and holds finite numbers only."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)))


def limbs(totals: Iterator[tuple[int, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Exact totals (width, i, j, total) as rows of signed limbs, in batches of bounded size."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["width", "i", "j", "limb", "part"])

    for width, i, j, total in totals:
        sign, rest, k = (-1 if total < 0 else 1), abs(total), 0
        while rest:
            rows.append((width, i, j, k, sign * (rest & ((1 << LIMB) - 1))))
            rest >>= LIMB
            k += 1
        if len(rows) > 50_000:
            yield batch()
            rows.clear()
    yield batch()


def gathered(parts: DataFrame) -> dict[tuple[int, int, int], int]:
    """Sums over all tasks: a number for each pair of dimensions at most."""
    out: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("width", "i", "j", "limb").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("part")).toLocalIterator():
        key = (r["width"], r["i"], r["j"])
        out[key] = out.get(key, 0) + (int(r["part"]) << (LIMB * r["limb"]))
    return out


LIMBS = "width int, i int, j int, limb int, part long"


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows and sums of each dimension: (width, -1, -1) counts, (width, i, i) adds x."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        for width, rows, x in blocks(batch, 0):
            held = totals.setdefault(width, [0] * (width + 1))
            for i, t in enumerate([*(int(t) for t in x.sum(0)), len(rows)]):
                held[i] += t
    yield from limbs((width, i, i, t) for width, held in totals.items() for i, t in zip([*range(width), -1], held, strict=True))


def squared(centres: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's squares about the centres: (width, i, i) of dimensions, (width, i, j) of sums of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: dict[int, np.ndarray] = {}  # low and high halves
        large: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in blocks(batch, 0):
                u = about(x, centres.value[width])
                if u.dtype == object:
                    held = large.setdefault(width, np.zeros((width, width), object))
                else:
                    held = small.setdefault(width, np.zeros((2, width, width), np.int64))
                for i in range(width):
                    pair = u[:, i : i + 1] + u[:, i:]
                    pair[:, 0] = u[:, i]
                    t = (pair * pair).sum(0)
                    if u.dtype == object:
                        held[i, i:] += t
                    else:
                        held[0, i, i:] += t & ((1 << LIMB) - 1)
                        held[1, i, i:] += t >> LIMB
        places = [(width, i, j) for width in {*small, *large} for i in range(width) for j in range(i, width)]
        yield from limbs(
            (w, i, j, (int(small[w][0, i, j]) + (int(small[w][1, i, j]) << LIMB) if w in small else 0) + (large[w][i, j] if w in large else 0)) for w, i, j in places)

    return run


def about(x: np.ndarray, centres: list[int]) -> np.ndarray:
    """x less its centres: int64 as long as a sum of ROWS squares of sums of two fits, else Python integers."""
    u = x - np.array(centres)
    return u if u.dtype == object or np.abs(u).max() < 2**24 else u.astype(object)


def fit(df: DataFrame, vector: str) -> dict[int, Model]:
    """A model for the finite vectors of each length, by length; none for an empty table.

    Rows all count, repeated ones too. The driver holds d * (d + 1) / 2 numbers a length d.
    """
    vectors = finite(df, vector).select(F.col(vector).cast("array<double>").alias("v"))
    sums: dict[int, dict[int, int]] = {}
    for (width, i, _), t in gathered(vectors.mapInArrow(added, LIMBS)).items():
        sums.setdefault(width, {})[i] = t
    counts = {width: s[-1] for width, s in sums.items()}
    totals = {width: [s.get(i, 0) for i in range(width)] for width, s in sums.items()}
    centres = {width: [round(Fraction(t, counts[width])) for t in totals[width]] for width in totals}
    sent = df.sparkSession.sparkContext.broadcast(centres)
    squares = gathered(vectors.mapInArrow(squared(sent), LIMBS))
    models = {}
    for width, n in counts.items():
        left = [t - n * m for t, m in zip(totals[width], centres[width], strict=True)]
        # n times the squares about the mean, an integer; of a dimension (i, i) and of the sum of two (i, j).
        var = lambda i, j, n=n, left=left, width=width: n * squares.get((width, i, j), 0) - (left[i] + (left[j] if j != i else 0)) ** 2
        own = [var(i, i) for i in range(width)]
        cov = np.empty((width, width))
        for i in range(width):
            cov[i, i] = own[i] / n**2
            for j in range(i + 1, width):
                cov[i, j] = cov[j, i] = (var(i, j) - own[i] - own[j]) / (2 * n**2)  # integers divide to the nearest double
        values, vectors_ = np.linalg.eigh(cov)
        models[width] = Model(n, centres[width], left, cov, values[::-1].copy(), vectors_[:, ::-1].copy())
    return models


def deviations(u: np.ndarray, model: Model) -> list[int]:
    """Of each row, the exact sum of squares of n * x - S = n * u - left."""
    far = max(int(np.abs(u).max()) * model.n + max(map(abs, model.left)), 1)
    if u.dtype == object or far**2 * u.shape[1] >= 2**63:
        u = u.astype(object)
    y = u * model.n - np.array(model.left)
    return [int(t) for t in (y * y).sum(1)]


def whiten(df: DataFrame, models: dict[int, Model], id_col: str, vector: str, components: int = 8) -> DataFrame:
    """(id_col, width int, n long, deviation decimal(38,0), whitened array<double>) for each row with a finite vector.

    whitened holds the projections on the first components of the row's length over their
    deviations, null for a component without variance. deviation is the exact sum of
    (n * x - S)^2, null beyond 38 digits. Rows whose vector is null, empty or not finite
    are left out; null and repeated ids stay as they are; other columns are ignored.
    """
    sent = df.sparkSession.sparkContext.broadcast(models)
    rows = finite(df, vector).select(F.col(id_col), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, x in blocks(batch, 1):
                model = sent.value[width]
                u = about(x, model.centres)
                w = (u.astype(float) - np.array(model.left, float) / model.n) @ model.projector(components)
                far = [d if d < 10**38 else None for d in deviations(u, model)]
                flat = pa.array(w.ravel(), from_pandas=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                own = [pa.array([k] * len(at), t) for k, t in ((width, pa.int32()), (model.n, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *own, pa.array(far, pa.decimal128(38, 0)), lists], names=[id_col, "width", "n", "deviation", "whitened"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, width int, n long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame) -> float:
    """The largest absolute entry of the covariance of whiten()'s rows less the identity, over all lengths; 0 without rows.

    Components without variance (null) don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            width, column = batch.column(0).to_numpy(), batch.column(2)
            flat, start = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for of in np.unique(width).tolist():
                rows = np.flatnonzero(width == of)
                w = flat[start[rows][:, None] + np.arange(start[rows[0] + 1] - start[rows[0]])]
                held = totals.setdefault(of, np.zeros((w.shape[1] + 1, w.shape[1])))
                held[:-1] += w.T @ w
                held[-1] += w.sum(0)
        rows = [(of, i, j, float(x)) for of, t in totals.items() for i, row in enumerate(t, -len(t) + 1) for j, x in enumerate(row)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["width", "i", "j", "t"])

    rows = whitened.select("width", "n", "whitened")
    count = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.first("n").alias("n")).collect()}  # a row a length
    sums = rows.mapInArrow(run, "width int, i int, j int, t double").groupBy("width", "i", "j").agg(F.sum("t").alias("t"))
    total = {(r["width"], r["i"], r["j"]): r["t"] / count[r["width"]] for r in sums.collect()}  # (k + 1) * k numbers a length
    k = {of: 1 + max(j for w, _, j in total if w == of) for of in count}
    entries = [t - total[w, 0, i + k[w]] * total[w, 0, j] - (i + k[w] == j) for (w, i, j), t in total.items() if i < 0]
    return max((abs(e) for e in entries if e == e), default=0.0)
