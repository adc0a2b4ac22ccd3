"""Whitening of embeddings by a bidiagonal qd solver.

Embeddings vary most in a few directions that all share; whitening projects on the directions of largest
variance and divides by the spread. Vectors are put on an integer grid first, so that sums are exact. Centred rows are
reduced block by block to triangular factors, which are stacked and reduced again in a tree until one is left: the
covariance is never formed, so small singular values keep their digits. The driver works on this one factor, a square of
the vectors' length: Householder reflections make it bidiagonal, dqds finds the singular values, and a twisted
factorisation gives each wanted direction from its value. Values too close to tell apart get an orthonormal basis of their
common space by inverse iteration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace, lists, map_batches

# fixed values
GRID = 256
N_COMPONENTS = 4
EPS = np.finfo(float).eps
#: Length of vectors at most: the driver holds one square of this side.
MOST_DIMENSIONS = 4096
#: Rows reduced at once, and factors stacked in a step of the tree.
BLOCK_ROWS, FAN = 2048, 8
#: Off-diagonal entries below this (squared, relative) are taken as zero.
NEGLIGIBLE = (16 * EPS) ** 2
#: Relative distance of values below which directions come from their common space.
CLOSE = 1e-3
#: Values below this times the largest have no direction.
VANISHING = 1e-14


def on_grid(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) with x the little-endian 64-bit entries of floor(256 * vector), and the vectors' length.

    Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and so are vectors of another length
    than most have (the longer of two lengths equally frequent).
    """
    entry = F.col(vector)
    sound = entry.isNotNull() & (F.size(entry) > 0) & F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    clean = rows.filter(F.coalesce(sound, F.lit(False)))
    most = clean.groupBy(F.size(entry).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; the limit is {MOST_DIMENSIONS}")

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            held = batch.column(1)
            flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, d)
            grid = np.floor(GRID * flat)
            x = np.clip(grid, -(2.0**63), 2.0**63 - 1024).astype("<i8")
            return {"key": batch.column(0), "x": pa.array([row.tobytes() for row in x], pa.binary())}

        return work

    chosen = clean.filter(F.size(entry) == d).select(F.col(key).alias("key"), entry.alias("v"))
    return map_batches(chosen, start, f"key {dict(rows.dtypes)[key]}, x binary", rows=4096), d


def matrix(column: pa.Array, d: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, d)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, np.int64), 0
        for batch in batches:
            total += matrix(batch.column(0), d).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": lists([total], pa.int64())})

    parts = fit.select("x").mapInArrow(run, "n long, sums array<long>")
    each = parts.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = {r["i"]: r for r in each.collect()}  # one row for each dimension
    return (found[0]["n"] if found else 0), [found[i]["s"] if found else 0 for i in range(d)]


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper factor of a QR decomposition, padded with zero rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def blockwise_qr(fit: DataFrame, d: int, mean: np.ndarray, ws: Workspace) -> np.ndarray:
    """R of the QR decomposition of all centred rows: per task block after block, then by a tree of stacked factors."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, n = np.zeros((0, d)), [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(matrix(batch.column(0).slice(start, BLOCK_ROWS), d) - mean)
                n += len(held[-1])
                if n >= BLOCK_ROWS:
                    r, held, n = triangle(np.vstack([r, *held])), [], 0
        r = triangle(np.vstack([r, *held])) if held else r
        if len(r):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def stack(table: pa.Table) -> pa.Table:
        table = table.sort_by("part").combine_chunks()
        part = table["part"][0].as_py() // FAN
        r = triangle(matrix(table["r"].combine_chunks(), d, "<f8"))
        return pa.table({"part": pa.array([part], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    schema = "part long, r binary"
    level = ws.keep(fit.select("x").mapInArrow(reduce_rows, schema), "factors")
    while (n := level.count()) > 1:
        last = level.agg(F.max("part")).first()[0]
        near = F.floor(F.col("part") / FAN) if last >= FAN else F.lit(0)
        above = ws.keep(level.groupBy(near.alias("group")).applyInArrow(stack, schema), "factors")
        ws.drop(level)
        level = above
    if not n:
        return np.zeros((d, d))
    return np.frombuffer(level.first()["r"], "<f8").reshape(d, d).copy()


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit v (or zeros) with (I - 2vvᵀ)x = (alpha, 0, ...), and alpha."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0 or not x[1:].any():
        return np.zeros(len(x)), float(x[0])
    alpha = -math.copysign(norm, x[0])
    v = x.copy()
    v[0] -= alpha
    return v / np.linalg.norm(v), alpha


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and superdiagonal of B = UᵀRV, and the reflections that make up V."""
    a = square.copy()
    d = len(a)
    diagonal, above, rights = np.zeros(d), np.zeros(max(d - 1, 0)), []
    for k in range(d):
        v, diagonal[k] = reflector(a[k:, k])
        a[k:, k + 1 :] -= 2 * np.outer(v, v @ a[k:, k + 1 :])
        if k < d - 1:
            w, above[k] = reflector(a[k, k + 1 :])
            a[k + 1 :, k + 1 :] -= 2 * np.outer(a[k + 1 :, k + 1 :] @ w, w)
            rights.append(w)
    return diagonal, above, rights


def step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform, with the sum of 1/d of its diagonal; None if the shift is above the least value."""
    d = q[0] - shift
    new_q, new_e, inverse = [], [], 0.0
    for i in range(len(e)):
        if d < 0:
            return None
        inverse += 1 / d if d else math.inf
        new_q.append(d + e[i])
        t = q[i + 1] / new_q[-1] if new_q[-1] else 0.0
        new_e.append(e[i] * t)
        d = d * t - shift if new_q[-1] else q[i + 1] - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e, inverse + (1 / d if d else math.inf)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, falling.

    Unshifted transforms alternate with shifted ones. The reciprocal of the sum of 1/d is Newton's bound from below for the
    least value, so the shift is safe, and it closes in quadratically as the last off-diagonal entry vanishes.
    """
    found: list[float] = []
    todo = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        if len(q) > 1 and q[0] < q[-1]:
            q, e = q[::-1], e[::-1]  # the least values are found at the end
        sweeps, most = 0, 60 * len(q) + 200
        while q:
            if len(q) == 1:
                found.append(moved + q.pop())
                break
            if e[-1] <= NEGLIGIBLE * (moved + q[-1]) or e[-1] <= NEGLIGIBLE * q[-2] * min(1.0, q[-1] / q[-2] if q[-2] else 0.0) or e[-1] < 1e-290:
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= NEGLIGIBLE * moved or e[i] <= NEGLIGIBLE * min(q[i], q[i + 1])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if sweeps > most:
                raise ArithmeticError("dqds does not converge")
            sweeps += 1
            q, e, inverse = step(q, e, 0.0)
            shift = (1 - 4 * EPS) / inverse if 0 < inverse < math.inf else 0.0
            if shift > EPS * moved and (further := step(q, e, shift)) is not None:
                q, e, _ = further
                moved += shift
    return np.array(sorted(found, reverse=True))


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of BᵀB for an eigenvalue, from a factorisation that runs from both ends to the best middle."""
    n = len(diagonal)
    tiny = EPS * EPS * max(value, 1e-300)
    a = np.where(diagonal == 0, math.sqrt(tiny), diagonal)
    pivot, low = a * a, above / a[:-1]  # BᵀB = L diag(pivot) Lᵀ
    down, up = np.zeros(n - 1), np.zeros(n - 1)
    s, p = np.zeros(n), np.zeros(n)
    s[0], p[-1] = -value, pivot[-1] - value
    for i in range(n - 1):
        top = s[i] + pivot[i]
        top = top if abs(top) > tiny else tiny
        down[i] = pivot[i] * low[i] / top
        s[i + 1] = down[i] * low[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        bottom = pivot[i] * low[i] * low[i] + p[i + 1]
        bottom = bottom if abs(bottom) > tiny else tiny
        ratio = pivot[i] / bottom
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def common_space(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors, as columns, of values that lie close together: inverse iteration, then rotated apart."""
    b = np.diag(diagonal) + np.diag(above, 1)
    t = b.T @ b
    shifted = t - np.eye(len(t)) * (values[0] + max(4 * (values[0] - values[-1]), 1e-10 * values[0]))
    x = np.linalg.qr(np.random.default_rng(len(t)).standard_normal((len(t), len(values))))[0]
    for _ in range(12):
        x = np.linalg.qr(np.linalg.solve(shifted, x))[0]
    u, _, _ = np.linalg.svd(x.T @ b.T, full_matrices=False)
    return x @ u


def directions(square: np.ndarray, k: int = N_COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of R, falling, and the right singular vectors of the first ``k`` that do not vanish."""
    if not len(square):
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(square).max()) or 1.0
    diagonal, above, rights = bidiagonal(square / scale)
    values = dqds(diagonal, above)
    wanted = min(k, int((values > VANISHING * values[0]).sum())) if values[0] > 0 else 0
    columns: list[np.ndarray] = []
    while len(columns) < wanted:
        first = last = len(columns)
        while last + 1 < len(values) and values[last] - values[last + 1] < CLOSE * values[last]:
            last += 1
        if last == first:
            columns.append(twisted(diagonal, above, values[first]))
        else:
            columns.extend(common_space(diagonal, above, values[first : last + 1]).T)
    z = np.array(columns[:wanted]).reshape(wanted, len(square)).T
    for place in range(len(rights) - 1, -1, -1):
        w = rights[place]
        z[place + 1 :] -= 2 * np.outer(w, w @ z[place + 1 :])
    if wanted:  # "either sign": the largest entry is positive
        z = z * np.where(z[np.abs(z).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)
    return values * scale * scale, z


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)², exact; null where it does not fit 64 bits."""
    with np.errstate(over="ignore"):
        apart = n * x - sums  # exact modulo 2**64, and so is the sum of squares
        exact = (apart * apart).sum(axis=1)
    rough = ((n * x.astype(float) - sums.astype(float)) ** 2).sum(axis=1)
    return [int(v) if r < 2.0**63 else None for v, r in zip(exact, rough, strict=True)]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = N_COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each sound vector and component.

    The fit list is each distinct vector on the grid once; ``n`` is its length. ``whitened`` is the centred vector along
    the component over its spread, ``deviation`` its exact squared distance to the mean times n², ``explained`` the
    component's share of the variance, ``identity_error`` how far the covariance of the whitened fit list is off.

    Unsound vectors (see ``on_grid``) give no rows; null keys are keys like any other and repeated rows give repeated
    results. Directions without variance are left out: fewer than ``k`` components where the fit list spans fewer, and no
    rows for an empty table or one distinct vector. Only the two named columns are read, so others cannot clash.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "whitening")
    grid, d = on_grid(rows, key, vector)
    kind = dict(rows.dtypes)[key]
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not d:
        return spark.createDataFrame([], schema)
    grid = ws.keep(grid, "grid")
    fit = ws.keep(grid.select("x").distinct(), "fit")
    n, sums = column_sums(fit, d)
    mean = np.array([s / n for s in sums])
    values, axes = directions(blockwise_qr(fit, d, mean, ws), k)
    wanted = axes.shape[1]
    if not wanted:
        return spark.createDataFrame([], schema)
    scaled = axes / np.sqrt(values[:wanted] / n)
    explained = values[:wanted] / math.fsum(values)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wanted + wanted * wanted)
        for batch in batches:
            z = (matrix(batch.column(0), d) - mean) @ scaled
            total += np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array(total)})

    parts = fit.mapInArrow(products, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # k + k² rows
    whole = np.array([r["s"] for r in sorted(parts)]) / n
    means, gram = whole[:wanted], whole[wanted:].reshape(wanted, wanted)
    error = float(np.abs(gram - np.outer(means, means) - np.eye(wanted)).max())
    exact = np.array(sums, np.int64)

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            x = matrix(batch.column(1), d)
            rows_out = pa.array(np.repeat(np.arange(len(x)), wanted))
            return {
                key: batch.column(0).take(rows_out),
                "component": pa.array(np.tile(np.arange(1, wanted + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(x) * wanted, n)),
                "deviation": pa.array(deviations(x, n, exact), pa.int64()).take(rows_out),
                "whitened": pa.array(((x - mean) @ scaled).ravel()),
                "explained": pa.array(np.tile(explained, len(x))),
                "identity_error": pa.array(np.full(len(x) * wanted, error)),
            }

        return work

    return map_batches(grid, start, schema, rows=4096)

