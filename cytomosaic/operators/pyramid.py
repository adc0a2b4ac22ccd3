"""Pairs of points counted by type and distance bin, without listing pairs whose bin their tiles already tell.

Points stand on a pyramid of square tiles, each level's tile four of the level below. Where two tiles lie so that all
distances between them fall into one bin, their pairs are counted by products of type counts; where they lie farther apart
than the last radius, not at all; else their children are looked at, and pairs of the lowest tiles are listed. On a regular
pyramid all this depends on the offset of two tiles and on the place of a tile within its parent alone, so the walk is
worked out beforehand, as one list of offsets for each level.

Tiles of a level meet in square blocks of them: a tile goes to its own block and to those within reach of the offsets, a few
copies whatever the radius, and the offsets are applied inside the block's task. What is shuffled are tiles and points, never
a row for each tile and offset.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.operators.skew import sliced_sides

# fixed values
#: Points that a lowest tile should hold on average: below, products would count as many rows as a listing.
POINTS_PER_TILE = 4.0
#: The last radius must be at least so many lowest tiles wide, or pairs are listed.
LEAST_STEPS = 8
#: The last radius is at most so many lowest tiles wide; the tables of offsets are that many thousand rows.
MOST_STEPS = 512
#: Bounds of distances are widened by this share, more than rounding moves a distance.
SLACK = 1e-9
#: Bits of a block's width in tiles, least and most.
LEAST_BITS, MOST_BITS = 6, 8
#: Rows of one side of a block that a task holds; a block with more is met by slices.
BLOCK_ROWS = 400_000
#: Pairs listed at once inside a task, and types up to which rows of tiles are summed by type beforehand.
PAIRS_AT_ONCE, SUMMED_TYPES = 1_000_000, 64
#: Entries up to which a task counts in an array of types x types x bins.
DENSE_COUNTS = 4_000_000


@dataclass(frozen=True)
class Walk:
    """``levels[l]`` holds (place x, place y, dx, dy, step): pairs of tiles of ``leaf * 2**l`` settled by products, the place being
    that of the first within its parent. ``listed`` holds (dx, dy) of pairs of lowest tiles whose points are compared."""

    leaf: float
    levels: tuple[tuple[tuple[int, int, int, int, int], ...], ...]
    listed: tuple[tuple[int, int], ...]


def _bin(dx: int, dy: int, size: float, radii: Sequence[float]) -> int | None:
    """The bin (from 1) of all distances between two tiles, 0 if all are beyond the last radius, None if they differ."""
    near = size * math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0)) * (1 - SLACK)
    far = size * math.hypot(abs(dx) + 1, abs(dy) + 1) * (1 + SLACK)
    for step, radius in enumerate(radii, 1):
        if far <= radius:
            return step
        if near <= radius:
            return None
    return 0


def walk(radii: Sequence[float], leaf: float) -> Walk:
    """The walk down from tiles as wide as the last radius; ``leaf`` is a power of two, so that tiles nest and are exact.

    Of a tile and another only the order with the later one (by x, then y) second is named.
    """
    top = max(0, math.ceil(math.log2(radii[-1] / leaf)))
    places = [(x, y) for x in (0, 1) for y in (0, 1)]
    open_pairs = {(px, py, dx, dy) for px, py in places for dx in range(-2, 3) for dy in range(-2, 3)}
    levels: list[tuple] = [()] * (top + 1)
    left: set[tuple[int, int]] = set()
    for level in range(top, -1, -1):
        bins = {d: _bin(*d, leaf * 2**level, radii) for d in {pair[2:] for pair in open_pairs}}
        levels[level] = tuple(sorted((*pair, bins[pair[2:]]) for pair in open_pairs if bins[pair[2:]] and pair[2:] >= (0, 0)))
        # an undecided pair has undecided parents, so it is reached from any place
        left = {d for d, step in bins.items() if step is None}
        open_pairs = {
            (cx, cy, 2 * dx + ox - cx, 2 * dy + oy - cy) for dx, dy in left for cx, cy in places for ox, oy in places
        }
    return Walk(leaf, tuple(levels), tuple(sorted(d for d in left if d >= (0, 0))))


def leaf_size(points: DataFrame, radius: float, by: Sequence[str] = ()) -> float | None:
    """Width of the lowest tiles for these points, or None where the radius holds so few that listing pairs is less work."""
    tiles = points.groupBy(*by, F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)).agg(F.count(F.lit(1)).alias("_n"))
    n_tiles, n = tiles.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n:
        return None
    leaf = 2.0 ** math.floor(math.log2(radius * math.sqrt(POINTS_PER_TILE * n_tiles / n)))
    return None if leaf * LEAST_STEPS > radius else max(leaf, 2.0 ** math.ceil(math.log2(radius / MOST_STEPS)))


@dataclass(frozen=True)
class Run:
    """Offsets (dx, low..high) with the same result, for tiles at the places (None: any); step 0: distances decide."""

    place: tuple[int, int] | None
    dx: int
    low: int
    high: int
    step: int

    @property
    def within(self) -> bool:
        return self.dx == self.low == self.high == 0


def runs(offsets: Sequence[tuple[tuple[int, int] | None, int, int, int]]) -> list[Run]:
    """(place, dx, dy, step) with neighbouring dy put together; a tile's offset to itself stands alone."""
    out: list[Run] = []
    for place, dx, step, dy in sorted(((p, dx, step, dy) for p, dx, dy, step in offsets), key=lambda v: (v[0] or (0, 0), *v[1:])):
        last = out[-1] if out else None
        joins = last and (last.place, last.dx, last.step, last.high) == (place, dx, step, dy - 1) and not last.within and (dx, dy) != (0, 0)
        if joins:
            out[-1] = Run(place, dx, last.low, dy, step)
        else:
            out.append(Run(place, dx, dy, dy, step))
    return out


def _codes(left: pa.Table, right: pa.Table) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Type names in order and the numbers of both sides' rows; the order is the same in every task."""
    both = pa.chunked_array([*left["cell_type"].chunks, *right["cell_type"].chunks]).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    names = both.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    code = rank[both.indices.to_numpy(zero_copy_only=False)]
    return [names[i] for i in order], code[: left.num_rows], code[left.num_rows :]


def _totals(key: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of weights by key."""
    if len(weight) * float(weight.max(initial=0)) < 2.0**53:  # doubles are exact
        return np.bincount(key, weight, size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, key, weight)
    return out


def count_block(left: pa.Table, right: pa.Table, plan: Sequence[Run], radii: Sequence[float]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Type names, keys (step, type of the left, type of the right as one number) and pairs, of one block's rows."""
    names, a_type, b_type = _codes(left, right)
    n_types, n_steps = len(names), len(radii) + 1
    a, b = ({c: side[c].to_numpy() for c in side.column_names if c in ("_tx", "_ty", "x", "y", "n")} for side in (left, right))
    order = np.lexsort((b["_ty"], b["_tx"]))
    b, b_type = {c: v[order] for c, v in b.items()}, b_type[order]
    # rows of tiles with room for each offset on both sides, so that a run of tiles is a run of numbers
    reach = max(max(abs(r.low), abs(r.high)) for r in plan)
    x0, y0 = min(a["_tx"].min(), b["_tx"].min()), min(a["_ty"].min(), b["_ty"].min()) - reach
    high = int(max(a["_ty"].max(), b["_ty"].max()) + reach + 1 - y0)
    wide = int(max(a["_tx"].max() + max(r.dx for r in plan), b["_tx"].max()) + 1 - x0)
    at = (a["_tx"] - x0) * high + a["_ty"] - y0
    start = np.searchsorted((b["_tx"] - x0) * high + b["_ty"] - y0, np.arange(wide * high + 1))
    before = None
    if n_types <= SUMMED_TYPES and any(r.step and not r.within for r in plan):
        before = np.zeros((len(b_type) + 1, n_types), np.int64)
        before[np.arange(1, len(b_type) + 1), b_type] = b["n"]
        np.cumsum(before, axis=0, out=before)
    size = n_steps * n_types * n_types
    counts = np.zeros(size if size <= DENSE_COUNTS else 0, np.int64)
    keys, sums = [], []

    def note(key: np.ndarray, weight: np.ndarray) -> None:
        if len(counts):
            counts[:] += _totals(key, weight, size)
        elif len(key):
            found, place = np.unique(key, return_inverse=True)
            keys.append(found)
            sums.append(_totals(place, weight, len(found)))

    by_type = np.argsort(a_type, kind="stable")
    place_of = (a["_tx"] & 1) * 2 + (a["_ty"] & 1)
    chosen = {None: by_type} | {(p // 2, p % 2): by_type[place_of[by_type] == p] for p in range(4)}
    for run in plan:
        rows = chosen[run.place]
        if not len(rows):
            continue
        first, last = (start[at[rows] + run.dx * high + dy] for dy in (run.low, run.high + 1))
        if run.step and not run.within and before is not None:
            met = (before[last] - before[first]) * a["n"][rows][:, None]
            heads = np.flatnonzero(np.diff(a_type[rows], prepend=-1))
            met = np.add.reduceat(met, heads)
            counts.reshape(n_steps, n_types, n_types)[run.step, a_type[rows][heads]] += met
            continue
        length = last - first
        done = np.cumsum(length)
        cut = 0
        while cut < len(rows):  # whole rows of the left, about so many pairs at once
            stop = max(int(np.searchsorted(done, (done[cut - 1] if cut else 0) + PAIRS_AT_ONCE, "right")), cut + 1)
            n = length[cut:stop]
            i = np.repeat(rows[cut:stop], n)
            j = np.arange(len(i)) + np.repeat(first[cut:stop] - (np.cumsum(n) - n), n)
            cut = stop
            step = run.step
            if not step:
                distance = np.hypot(a["x"][i] - b["x"][j], a["y"][i] - b["y"][j])
                near = distance <= radii[-1]
                i, j = i[near], j[near]
                step = np.searchsorted(np.asarray(radii), distance[near], "left") + 1
            weight = a["n"][i] * b["n"][j]
            kind = (a_type[i], b_type[j])
            if run.within:
                # within one tile each pair is met twice, and equal cells meet themselves
                less, own = kind[0] < kind[1], kind[0] == kind[1]
                if not run.step:
                    for c in ("y", "x"):
                        u, v = a[c][i], b[c][j]
                        less, own = (u < v) | ((u == v) & less), own & (u == v)
                weight = np.where(own, a["n"][i] * (a["n"][i] - 1) // 2, np.where(less, weight, 0))
            note((step * n_types + kind[0]) * n_types + kind[1], weight)
    if len(counts):
        keys, sums = [np.flatnonzero(counts)], [counts[counts != 0]]
    empty = np.zeros(0, np.int64)
    return names, np.concatenate([empty, *keys]), np.concatenate([empty, *sums])


def _met(rows: DataFrame, plan: list[Run], radii: Sequence[float], by: Sequence[str], own: Column) -> DataFrame:
    """(by, type_a, type_b, step, n) of rows (by, _tx, _ty, cell_type, n, ...) against themselves at the offsets of a plan."""
    reach_x, reach_y = max(r.dx for r in plan), max(max(abs(r.low), abs(r.high)) for r in plan)
    bits = min(max((2 * max(reach_x, reach_y, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)

    def block(at: Column) -> Column:
        return F.shiftright(at, bits)

    def blocks(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(block(low), block(high)))

    tx, ty = F.col("_tx"), F.col("_ty")
    here = rows.withColumns({"_bx": block(tx), "_by": block(ty)})
    # columns of their own for the other side, as Spark tells the sides of a cogroup apart by them
    there = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("_bx", blocks(tx - reach_x, tx)).withColumn("_by", blocks(ty - reach_y, ty + reach_y))
    keys = [*by, "_bx", "_by"]
    sides = sliced_sides(here, there, keys, own, own, BLOCK_ROWS)
    if sides:
        (here, there), keys = sides, [*keys, "_ls", "_rs"]
    radii, by = [float(r) for r in radii], list(by)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = [left.schema.field(c) for c in by]
        schema = pa.schema([*fields, ("type_a", pa.string()), ("type_b", pa.string()), ("step", pa.int32()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        names, key, n = count_block(left, right, plan, radii)
        kinds, step = key % len(names) ** 2, key // len(names) ** 2
        slide = [left[c].take(pa.array(np.zeros(len(key), np.int64))) for c in by]
        named = [pa.array(names, pa.string()).take(pa.array(k)) for k in (kinds // len(names), kinds % len(names))]
        return pa.table([*slide, *named, pa.array(step, pa.int32()), pa.array(n)], schema=schema)

    types = dict(rows.dtypes)
    columns = ", ".join(f"`{c}` {types[c]}" for c in by)
    met = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(
        meet, f"{columns}{', ' if columns else ''}type_a string, type_b string, step int, n long"
    )
    a, b = F.col("type_a"), F.col("type_b")
    return met.select(*by, F.least(a, b).alias("type_a"), F.greatest(a, b).alias("type_b"), "step", "n")


def binned_pairs(points: DataFrame, radii: Sequence[float], leaf: float, by: Sequence[str]) -> DataFrame:
    """(by, type_a, type_b, step, n): unordered pairs of cells by the bin of their distance, with type_a <= type_b.

    ``points`` = (by, x, y, cell_type, n, point), where ``point`` is the place and type, and ``n`` the cells that share them.
    ``radii`` rise; step i is for distances above the radius before and up to radius i.
    """
    plan = walk(radii, leaf)
    placed = points.dropna(subset=list(by)).select(
        *by, "x", "y", "cell_type", "n", F.floor(F.col("x") / leaf).alias("_tx"), F.floor(F.col("y") / leaf).alias("_ty")
    )
    parts = []
    for level, settled in enumerate(plan.levels):
        if not settled:
            continue
        up = [F.shiftright(c, level).alias(c) for c in ("_tx", "_ty")]
        counts = placed.select(*by, *up, "cell_type", "n").groupBy(*by, "_tx", "_ty", "cell_type").agg(F.sum("n").alias("n"))
        offsets = [((px, py), dx, dy, step) for px, py, dx, dy, step in settled]
        parts.append(_met(counts, runs(offsets), radii, by, F.struct("_tx", "_ty", "cell_type")))
    if plan.listed:
        parts.append(_met(placed, runs([(None, dx, dy, 0) for dx, dy in plan.listed]), radii, by, F.struct("x", "y", "cell_type")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy(*by, "type_a", "type_b", "step").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
