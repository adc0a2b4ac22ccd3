"""Polygon expressions. A ring is an array of struct(x, y) without a repeated closing vertex required.

A segment is struct(x0, y0, x1, y1, s) running left to right, ``s`` = +1 or -1 for the ring's own direction; ``m`` is
its slope. Vertical edges enclose no area under them and are left out of segment lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOUCH = 1e-9  # fixed value: overlap areas up to this count as touching only
ROWS_AT_ONCE = 4_000  # rows whose outlines are handled at once inside a task


FIELDS, BOX = ("x0", "y0", "x1", "m", "s"), ("x0", "x1", "y0", "y1")
SEGMENTS = "array<struct<x0: double, y0: double, x1: double, m: double, s: double>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def next_vertex(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def ring_edges(ring) -> Column:
    """All edges as struct(x0, y0, x1, y1) in ring order, closing edge included."""
    ring = _c(ring)

    def edge(v: Column, i: Column) -> Column:
        w = next_vertex(ring, i)
        return F.struct(v.x.alias("x0"), v.y.alias("y0"), w.x.alias("x1"), w.y.alias("y1"))

    return F.transform(ring, edge)


def segments(ring) -> Column:
    def oriented(e: Column) -> Column:
        forward = e.x0 < e.x1
        slope = (e.y1 - e.y0) / (e.x1 - e.x0)
        return F.when(
            forward,
            F.struct(e.x0.alias("x0"), e.y0.alias("y0"), e.x1.alias("x1"), slope.alias("m"), F.lit(1.0).alias("s")),
        ).otherwise(F.struct(e.x1.alias("x0"), e.y1.alias("y0"), e.x0.alias("x1"), slope.alias("m"), F.lit(-1.0).alias("s")))

    return F.transform(F.filter(ring_edges(ring), lambda e: e.x0 != e.x1), oriented)


def area_under_lower(e: dict[str, Column], f: dict[str, Column], base: Column, left: Column, right: Column) -> Column:
    """Signed area between ``base`` and the lower one of two segments over a stretch of x that both span.

    Summed over all segment pairs of two simple polygons this is their common area, up to its sign: a polygon is the
    signed sum of the regions under its segments, and the region under two segments is the one under the lower of them.
    Segments are dicts of the fields of ``segments``; ``base`` is any height at or below both polygons.
    """

    def height(s: dict[str, Column], x: Column) -> Column:
        return s["y0"] + s["m"] * (x - s["x0"])

    e0, f0, e1, f1 = height(e, left), height(f, left), height(e, right), height(f, right)
    gap0, gap1 = e0 - f0, e1 - f1
    straight = (F.least(e0, f0) + F.least(e1, f1)) / 2
    at = F.try_divide(gap0, gap0 - gap1)  # where they cross, as a share of the stretch
    meet = e0 + at * (e1 - e0)
    bent = at * (F.least(e0, f0) + meet) / 2 + (1 - at) * (meet + F.least(e1, f1)) / 2
    mean = F.when(gap0 * gap1 < 0, bent).otherwise(straight)
    return e["s"] * f["s"] * (right - left) * (mean - base)


def polygon_area(ring) -> Column:
    """Shoelace area, taken from the first vertex as origin."""
    ring = _c(ring)
    ox, oy = F.get(ring, F.lit(0)).x, F.get(ring, F.lit(0)).y
    return F.abs(
        F.aggregate(
            ring_edges(ring),
            F.lit(0.0),
            lambda s, e: s + ((e.x0 - ox) * (e.y1 - oy) - (e.x1 - ox) * (e.y0 - oy)),
        )
    ) / 2


def translate(ring, dx, dy) -> Column:
    dx, dy = _c(dx), _c(dy)
    return F.transform(_c(ring), lambda v: F.struct((v.x + dx).alias("x"), (v.y + dy).alias("y")))


def strictly_inside(x, y, edges) -> Column:
    """True if the point lies inside the ring given by its edges; points on an edge are not inside."""
    x, y, edges = _c(x), _c(y), _c(edges)

    def turn(e: Column) -> Column:
        return (e.x1 - e.x0) * (y - e.y0) - (e.y1 - e.y0) * (x - e.x0)

    def on_edge(e: Column) -> Column:
        return (
            (turn(e) == 0)
            & x.between(F.least(e.x0, e.x1), F.greatest(e.x0, e.x1))
            & y.between(F.least(e.y0, e.y1), F.greatest(e.y0, e.y1))
        )

    def crosses(e: Column) -> Column:
        spans = (e.y0 <= y) != (e.y1 <= y)
        return spans & ((turn(e) > 0) == (e.y1 > e.y0))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, on_edge)


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b in Spark's order of numbers, where NaN is the largest."""
    return (a > b) | (np.isnan(a) & ~np.isnan(b))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_over(a, 0.0) & (b < 0)) | ((a < 0) & _over(b, 0.0))


def _edge_pairs(of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges of one ring, each once, a step apart at a time; ``of`` is the ring of each edge, in order."""
    left = np.arange(len(of))
    step = 1
    while True:
        left = left[left + step < len(of)]
        left = left[of[left + step] == of[left]]
        if not len(left):
            return
        yield left, left + step
        step += 1


def crossing_rings(edges: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``self_intersecting`` for rings 0 to n - 1 with the edges (x0, y0, x1, y1) of all of them one after another."""
    x0, y0, x1, y1 = edges
    dx, dy = x1 - x0, y1 - y0
    out = np.zeros(n, bool)
    for i, j in _edge_pairs(of):
        def sides(e: np.ndarray, f: np.ndarray) -> np.ndarray:
            at, x, y = (dx[e], dy[e]), x0[e], y0[e]
            return _apart(*[at[0] * (py[f] - y) - at[1] * (px[f] - x) for px, py in ((x0, y0), (x1, y1))])

        met = sides(i, j)
        i, j = i[met], j[met]
        out[of[i[sides(j, i)]]] = True
    return out


def even_odd_segments(ring: np.ndarray) -> np.ndarray:
    """Segments (x0, y0, x1, m, s) whose signed regions add up to the points that the ring winds around an odd number of
    times, however it crosses or covers itself."""
    ends = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1).astype(float)
    return even_odd_rings(ends.T, np.zeros(len(ends), np.int64))[0].T


def even_odd_rings(edges: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``even_odd_segments`` of many rings, whose edges (x0, y0, x1, y1) stand one after another, and the ring of each segment.

    Between two neighbouring vertices or crossings in x, edges keep their order; counted from above, each first one opens
    the inside and each second one closes it. Stretches of an edge with the same sign are joined.
    """
    upright = edges[0] == edges[2]
    edges, of = edges[:, ~upright], of[~upright]
    if not len(of):
        return np.zeros((5, 0)), of
    x0, y0, x1, y1 = np.where(edges[0] < edges[2], edges, edges[[2, 3, 0, 1]])
    slope = (y1 - y0) / (x1 - x0)
    cuts, ring = [x0, x1], [of, of]
    for i, j in _edge_pairs(of):  # where an edge meets the later ones
        left, right = np.maximum(x0[i], x0[j]), np.minimum(x1[i], x1[j])
        facing = left < right
        i, j, left, right = i[facing], j[facing], left[facing], right[facing]
        above = [(y0[i] - y0[j]) + slope[i] * (x - x0[i]) - slope[j] * (x - x0[j]) for x in (left, right)]
        meet = above[0] * above[1] < 0
        cuts.append(left[meet] + (right[meet] - left[meet]) * above[0][meet] / (above[0] - above[1])[meet])
        ring.append(of[i[meet]])
    # the different cuts of each ring in order, and the number among them of each edge's ends
    every, ring = np.concatenate(cuts), np.concatenate(ring)
    order = np.lexsort((every, ring))
    new = np.concatenate([[True], (np.diff(every[order]) != 0) | (np.diff(ring[order]) != 0)])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = every[order][new]
    first, last = place[: len(x0)], place[len(x0) : 2 * len(x0)]
    edge = np.repeat(np.arange(len(x0)), last - first)
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(last - first) - last, last - first)
    height = y0[edge] + slope[edge] * ((at[slab] + at[slab + 1]) / 2 - x0[edge])
    order = np.lexsort((edge, -height, slab))
    rank = np.arange(len(order)) - np.searchsorted(slab[order], slab[order])
    sign = np.empty(len(order))
    sign[order] = 1.0 - 2.0 * (rank % 2)
    begins = np.flatnonzero((np.diff(edge, prepend=-1) != 0) | (np.diff(sign, prepend=0) != 0))
    stops = np.append(begins[1:], len(edge)) - 1
    e, left, right = edge[begins], at[slab[begins]], at[slab[stops] + 1]
    return np.stack([left, y0[e] + slope[e] * (left - x0[e]), right, slope[e], sign[begins]]), of[e]


def _outlined(rings: pa.ListArray) -> dict[str, pa.Array]:
    """The columns that ``with_outlines`` adds."""
    n = len(rings)
    bounds = rings.offsets.to_numpy().astype(np.int64)
    points = rings.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(n), sizes)
    x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    unknown = rings.is_null().to_numpy(zero_copy_only=False).copy()  # no ring, or one with a missing place
    unknown[of[np.logical_or(*[points.field(c).is_null().to_numpy(zero_copy_only=False) for c in ("x", "y")])]] = True
    after = np.arange(1, len(of) + 1)
    after[bounds[1:][sizes > 0] - 1] = bounds[:-1][sizes > 0]
    edges = np.stack([x, y, x[after], y[after]])
    whole = ~np.isnan(edges).any(0) | ~unknown[of]
    crossing = crossing_rings(edges[:, whole], of[whole], n)
    some = sizes > 0

    def bound(least: np.ufunc, v: np.ndarray) -> pa.Array:
        out = np.zeros(n)
        out[some] = least.reduceat(v, bounds[:-1][some]) if some.any() else []
        return pa.array(out, mask=~some)

    # segments of simple rings as they stand, of crossing ones by the even-odd rule
    x0, y0, x1, y1 = edges
    fits = ~(crossing | unknown)[of] & (_over(x0, x1) | _over(x1, x0))
    x0, y0, x1, y1, ring = x0[fits], y0[fits], x1[fits], y1[fits], of[fits]
    forward, slope = _over(x1, x0), (y1 - y0) / (x1 - x0)
    plain = np.stack([np.where(forward, x0, x1), np.where(forward, y0, y1), np.where(forward, x1, x0), slope, np.where(forward, 1.0, -1.0)])
    crossed = (crossing & ~unknown)[of]
    made, made_ring = even_odd_rings(edges[:, crossed], of[crossed])
    ring = np.concatenate([ring, made_ring])
    order = np.argsort(ring, kind="stable")
    columns = [pa.array(c[order]) for c in np.concatenate([plain, made], axis=1)]
    offsets = pa.array(np.searchsorted(ring[order], np.arange(n + 1)).astype(np.int32))
    return {
        "seg": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, FIELDS)),
        "crossing": pa.array(crossing, mask=unknown & ~crossing),
        "box": pa.StructArray.from_arrays([bound(f, c) for c in (x, y) for f in (np.fmin, np.maximum)], BOX, mask=pa.array(unknown)),
    }


def with_outlines(rings: DataFrame) -> DataFrame:
    """Adds to rings (ring and other columns) the column ``crossing``, as ``self_intersecting`` tells it, the segments ``seg``: those of
    ``segments``, and for rings that cross themselves those of the points that they wind around an odd number of times, and
    the ``box``. Rings with a missing place have no box and no segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                with np.errstate(all="ignore"):
                    made = _outlined(part.column(part.schema.get_field_index("ring")))
                yield pa.RecordBatch.from_pydict({**dict(zip(part.schema.names, part.columns, strict=True)), **made})

    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rings.schema.fields]
    return rings.mapInArrow(run, ", ".join([*given, f"seg {SEGMENTS}", "crossing boolean", "box struct<x0: double, x1: double, y0: double, y1: double>"]))


def self_intersecting(ring) -> Column:
    """True if two edges of the ring cross at a point inside both; such rings have no simple inside."""

    def side(e: Column, px: Column, py: Column) -> Column:
        return (e.x1 - e.x0) * (py - e.y0) - (e.y1 - e.y0) * (px - e.x0)

    def apart(a: Column, b: Column) -> Column:
        return ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))

    def cross(e: Column, f: Column) -> Column:
        return apart(side(e, f.x0, f.y0), side(e, f.x1, f.y1)) & apart(side(f, e.x0, e.y0), side(f, e.x1, e.y1))

    def any_cross(edges: Column) -> Column:
        return F.exists(edges, lambda e: F.exists(edges, lambda f: cross(e, f)))

    # a one-element array binds the edge list once for both loops
    return F.exists(F.array(ring_edges(ring)), any_cross)
