"""Leading components of a table of rows by block power iteration.

Rows are sparse, (at array<int>, value array<double>), or dense, (features array<double>). A pass over them multiplies AᵀA
with a narrow block of vectors, A being the rows with each column shifted and scaled: a task keeps one block of columns x
vectors, and the blocks are added up by column, so no product of columns by columns and no dense row is ever made. The
driver keeps the blocks of a few passes, whose span holds the wanted vectors ever better, and solves the small problem on
this span. It ends when every wanted pair satisfies its equation to the stated accuracy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Vectors of a block beyond those wanted.
SPARE = 10
#: Columns of the span on the driver at most, before it is cut back to its best vectors.
MOST_VECTORS = 480
#: Residual of each pair, relative to the largest value, at which the iteration ends; and passes at most.
ACCURACY, MOST_PASSES = 1e-9, 60
#: Entries of sparse rows multiplied at once inside a task.
ENTRIES_AT_ONCE = 50_000

Work = Callable[[np.ndarray, np.ndarray], None]


def is_sparse(rows: DataFrame) -> bool:
    return "at" in rows.columns


def content(rows: DataFrame) -> list[str]:
    return ["at", "value"] if is_sparse(rows) else ["features"]


class Part:
    """Some rows, dense or sparse, with the two products that are needed."""

    def __init__(self, batch: pa.RecordBatch, sparse: bool, width: int):
        self.sparse, self.width, self.n = sparse, width, batch.num_rows
        if not sparse:
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            self.dense = values.astype(np.float64, copy=False).reshape(self.n, width)
            return
        lengths = np.asarray(batch.column("at").value_lengths().fill_null(0))
        self.at = batch.column("at").flatten().to_numpy(zero_copy_only=False)
        self.value = batch.column("value").flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), lengths)

    def chunks(self) -> Iterator[slice]:
        return (slice(s, s + ENTRIES_AT_ONCE) for s in range(0, len(self.at), ENTRIES_AT_ONCE))

    def times(self, block: np.ndarray) -> np.ndarray:
        """Rows x block."""
        if not self.sparse:
            return self.dense @ block
        out = np.zeros((self.n, block.shape[1]))
        for own in self.chunks():
            row = self.row[own]
            starts = np.flatnonzero(np.diff(row, prepend=-1))  # rows come in order
            out[row[starts]] += np.add.reduceat(self.value[own, None] * block[self.at[own]], starts)
        return out

    def add_transposed(self, total: np.ndarray, z: np.ndarray) -> None:
        """``total`` += rowsᵀ x z."""
        if not self.sparse:
            total += self.dense.T @ z
            return
        for own in self.chunks():
            order = np.argsort(self.at[own], kind="stable")
            at, row, value = self.at[own][order], self.row[own][order], self.value[own][order]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            total[at[starts]] += np.add.reduceat(value[:, None] * z[row], starts)


@dataclass(frozen=True)
class Columns:
    """Number of rows, and mean and root of the mean square of each column."""

    n: int
    mean: np.ndarray
    rms: np.ndarray

    @property
    def scale(self) -> np.ndarray:
        """One over the standard deviation; columns that do not vary get zero."""
        sd = np.sqrt(np.maximum(self.rms**2 - self.mean**2, 0.0))
        varies = sd > 1e-6 * self.rms  # a difference of sums keeps about half the digits
        return np.where(varies, 1.0 / np.where(varies, sd, 1.0), 0.0)


def columns(rows: DataFrame, width: int) -> Columns:
    """One aggregation by column, absent entries counting as zero."""
    if is_sparse(rows):
        each = rows.select(F.explode(F.arrays_zip("at", "value")).alias("e")).select(F.col("e.at").alias("i"), F.col("e.value").alias("v"))
    else:
        each = rows.select(F.posexplode("features").alias("i", "v"))
    n = rows.count()
    sums, squares = np.zeros(width), np.zeros(width)
    for r in each.groupBy("i").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).collect():  # one row for each column
        sums[r["i"]], squares[r["i"]] = r["s"], r["q"]
    return Columns(n, sums / max(n, 1), np.sqrt(squares / max(n, 1)))


def times_block(rows: DataFrame, block: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """AᵀA x block for A = (rows - shift) * scale, added up by column over all tasks."""
    sparse, (width, b) = is_sparse(rows), block.shape
    scaled = scale[:, None] * block
    shipped = rows.sparkSession.sparkContext.broadcast((scaled, shift @ scaled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, offset = shipped.value
        total = np.zeros((width + 1, b))  # the last row adds up the products, for the shift
        for batch in batches:
            if batch.num_rows:
                part = Part(batch, sparse, width)
                z = part.times(vectors) - offset
                part.add_transposed(total[:width], z)
                total[width] += z.sum(axis=0)
        at = np.flatnonzero(total.any(axis=1))
        for start in range(0, len(at), 1024):
            own = at[start : start + 1024]
            values = pa.FixedSizeListArray.from_arrays(pa.array(total[own].ravel()), b).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"i": pa.array(own, pa.int32()), "v": values})

    parts = rows.select(*content(rows)).mapInArrow(run, "i int, v array<double>")
    sums = parts.groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("v")).select("i", vector_to_array("v").alias("v")).toArrow()
    out = np.zeros((width + 1, b))
    if sums.num_rows:  # a row of b numbers for each column
        out[sums["i"].to_numpy()] = sums["v"].combine_chunks().flatten().to_numpy().reshape(-1, b)
    shipped.destroy()
    return scale[:, None] * (out[:width] - np.outer(shift, out[width]))


def orthonormal(block: np.ndarray, against: np.ndarray | None) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the span of ``against``."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    if against is not None:
        for _ in range(2):
            block = block - against @ (against.T @ block)
    q, r = np.linalg.qr(block)
    fresh = np.abs(np.diag(r)) > 1e-8
    q = q[:, fresh]
    if against is not None and q.shape[1]:
        q = np.linalg.qr(q - against @ (against.T @ q))[0]
    return q


def leading(rows: DataFrame, width: int, k: int, shift: np.ndarray | None = None, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of AᵀA, falling, and orthonormal eigenvectors as columns, their largest entries positive.

    The span starts from a fixed random block. Its image under AᵀA is known from the passes, so the residuals cost nothing
    more. Beyond ``MOST_VECTORS`` it is cut back to its best vectors and grows again from their residuals.
    """
    shift, scale = np.zeros(width) if shift is None else shift, np.ones(width) if scale is None else scale
    k = min(k, width)
    size = width if width <= 2 * (k + SPARE) else k + SPARE  # a narrow table is solved in one pass
    fresh = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, size)))[0]
    span, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(MOST_PASSES):
        span = np.hstack([span, fresh])
        images = np.hstack([images, times_block(rows, fresh, shift, scale)])
        small = span.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, seen = span @ turn[:, :size], images @ turn[:, :size]
        rest = seen - vectors * values[:size]
        done = np.linalg.norm(rest[:, :k], axis=0).max() <= ACCURACY * max(values[0], 0.0) or span.shape[1] >= width
        if done:
            break
        if span.shape[1] + size > MOST_VECTORS:
            span, images, fresh = vectors, seen, rest
        else:
            fresh = images[:, -fresh.shape[1] :]
        fresh = orthonormal(fresh, span)[:, : width - span.shape[1]]
        if not fresh.shape[1]:  # the span is closed
            break
    else:
        raise ArithmeticError(f"components not found to {ACCURACY} in {MOST_PASSES} passes")
    values, vectors = np.maximum(values[:k], 0.0), vectors[:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors * np.where(signs == 0, 1.0, signs)


def project(rows: DataFrame, loadings: np.ndarray, shift: np.ndarray | None = None, keep: Sequence[str] = ("cell_id",)) -> DataFrame:
    """``keep`` columns and features, (row - shift) times loadings."""
    sparse, width = is_sparse(rows), loadings.shape[0]
    shipped = rows.sparkSession.sparkContext.broadcast((loadings, np.zeros(loadings.shape[1]) if shift is None else shift @ loadings))
    names, types = list(keep), dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, offset = shipped.value
        for batch in batches:
            if batch.num_rows:
                out = Part(batch, sparse, width).times(m) - offset
                values = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), m.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in names}, "features": values})

    schema = ", ".join([f"`{c}` {types[c]}" for c in names] + ["features array<double>"])
    return rows.select(*names, *content(rows)).mapInArrow(run, schema)
