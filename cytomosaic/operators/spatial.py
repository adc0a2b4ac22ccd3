"""Joins by position: neighbours within a radius, overlapping polygons, points in regions, patches.

All use square tiles as equi-join keys, so Spark hashes tiles over tasks; tiles that hold too many rows are cut into
bounded slices (see ``skew``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.functions import geometry as G
from cytomosaic.operators.cells import majority_label
from cytomosaic.operators.skew import sliced_join
from cytomosaic.session import cut_lineage

# fixed values
PATCH_WIDTH = 1200.0
MIN_PATCH_TRANSCRIPTS = 10
UNMATCHED = "Unassigned"

# own tile, then one of each pair of opposite neighbours
_FORWARD = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def _tile(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size)))


def neighbour_pairs(
    points: DataFrame, radius: float, id_col: str = "cell_id", carry: Sequence[str] = (), by: Sequence[str] = (),
    rows_per_slice: int = 5_000,
) -> DataFrame:
    """Each unordered pair of points at most ``radius`` apart, once: (a_<id>, b_<id>, distance) and carried columns.

    Columns in ``by`` must be equal on both sides.
    """
    placed = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())

    def side(prefix: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{prefix}_{c}") for c in (id_col, "x", "y", *carry)]
        return placed.select(*by, *renamed, _tile(F.col("x"), radius).alias("_tx"), _tile(F.col("y"), radius).alias("_ty"))

    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _FORWARD])
    here = side("a")
    there = side("b").withColumn("_step", F.explode(steps))
    there = (
        there.withColumn("_tx", F.col("_tx") + F.col("_step.dx"))
        .withColumn("_ty", F.col("_ty") + F.col("_step.dy"))
        .withColumn("_same", (F.col("_step.dx") == 0) & (F.col("_step.dy") == 0))
        .drop("_step")
    )
    a_id, b_id = F.col(f"a_{id_col}"), F.col(f"b_{id_col}")
    met = sliced_join(here, there, [*by, "_tx", "_ty"], a_id, b_id, rows_per_slice)
    distance = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    return (
        met.filter(~F.col("_same") | (a_id < b_id))
        .withColumn("distance", distance)
        .filter(F.col("distance") <= radius)
        .drop("_tx", "_ty", "_same", "a_x", "a_y", "b_x", "b_y")
    )


def neighbour_graph(cells: DataFrame, radius: float, carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Symmetric edge table (cell_id, neighbour_id, distance): every pair in both directions."""
    pairs = neighbour_pairs(cells, radius, carry=carry, by=by)

    def direction(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"{own}_cell_id").alias("cell_id"), F.col(f"{other}_cell_id").alias("neighbour_id"), F.col("distance"),
            *[F.col(f"{own}_{c}").alias(c) for c in carry], *[F.col(f"{other}_{c}").alias(f"neighbour_{c}") for c in carry],
        )

    return pairs.select(*by, F.inline(F.array(direction("a", "b"), direction("b", "a"))))


def _within(queries: DataFrame, points: DataFrame, radius: float, by: Sequence[str] = (), rows_per_slice: int = 5_000) -> DataFrame:
    """(by, query_id, ref_id, distance) of every point at most ``radius`` from a query, the query itself left out."""
    around = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    q = queries.select(
        *by, F.col("cell_id").alias("query_id"), F.col("x").alias("_qx"), F.col("y").alias("_qy"), F.explode(around).alias("_s")
    ).select(
        *by, "query_id", "_qx", "_qy", (_tile(F.col("_qx"), radius) + F.col("_s.dx")).alias("_tx"), (_tile(F.col("_qy"), radius) + F.col("_s.dy")).alias("_ty")
    )
    p = points.select(
        *by, F.col("cell_id").alias("ref_id"), F.col("x").alias("_px"), F.col("y").alias("_py"),
        _tile(F.col("x"), radius).alias("_tx"), _tile(F.col("y"), radius).alias("_ty"),
    )
    met = sliced_join(q, p, [*by, "_tx", "_ty"], F.col("query_id"), F.col("ref_id"), rows_per_slice)
    return met.filter(F.col("query_id") != F.col("ref_id")).select(
        *by, "query_id", "ref_id", F.hypot(F.col("_qx") - F.col("_px"), F.col("_qy") - F.col("_py")).alias("distance")
    ).filter(F.col("distance") <= radius)


def nearest_graph(cells: DataFrame, k: int, radius: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest other cells of each cell: (by, cell_id, neighbour_id, distance, place), ties by id.

    Columns in ``by`` (the slide, say) must be equal on both sides.

    A cell with ``k`` others inside a radius has its nearest ones among those. The others are tried again with twice the
    radius, so the work follows the local density and the result is exact. The number of rounds is at most the logarithm
    of the tissue's extent over the first radius, which is guessed from the densest part.
    """
    by = list(by)
    cells = cells.select(*by, "cell_id", "x", "y").dropna()
    # of cells in one spot only the first ids can be chosen by any cell, so the others need not be offered
    spot = F.row_number().over(W.Window.partitionBy(*by, "x", "y").orderBy("cell_id"))
    points = cut_lineage(cells.withColumn("_spot", spot).filter(F.col("_spot") <= k + 1).drop("_spot"))
    x0, x1, y0, y1, n = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    width, height = (x1 or 0) - (x0 or 0), (y1 or 0) - (y0 or 0)
    extent = math.hypot(width, height) or 1.0
    if radius is None:
        area = max(width * height, 1e-12)
        radius = min(max(1.5 * math.sqrt(area * (k + 1) / (math.pi * max(n, 1))), extent * 1e-6), extent)
        tiles = points.groupBy(*by, _tile(F.col("x"), radius).alias("_tx"), _tile(F.col("y"), radius).alias("_ty"))
        densest = tiles.agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 1
        # start where the densest tile holds a few times what is needed; sparse places take further rounds
        radius = max(radius * min(1.0, math.sqrt(8 * (k + 1) / densest)), extent * 1e-6)
    order = W.Window.partitionBy(*by, "query_id").orderBy("distance", "ref_id")
    left, done = cells, []
    while True:
        ranked = _within(left, points, radius, by).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
        ranked = cut_lineage(ranked)
        complete = ranked.filter(F.col("place") == k).select(*by, "query_id")
        if radius >= extent:  # every other cell has been seen
            done.append(ranked)
            break
        done.append(ranked.join(complete, [*by, "query_id"], "left_semi"))
        left = cut_lineage(left.join(complete.withColumnRenamed("query_id", "cell_id"), [*by, "cell_id"], "left_anti"))
        if left.isEmpty():
            break
        radius = min(2 * radius, extent)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(*by, F.col("query_id").alias("cell_id"), F.col("ref_id").alias("neighbour_id"), "distance", "place")


def patch_counts(transcripts: DataFrame, region: Sequence[float] | None = None, width: float = PATCH_WIDTH,
                 min_transcripts: int = MIN_PATCH_TRANSCRIPTS) -> DataFrame:
    """Molecules per square patch of the grid that starts at the region's corner; sparse patches drop out.

    ``region`` = (x_min, x_max, y_min, y_max); without one the molecules' own extent sets the corner.
    """
    if region is not None:
        x0, x1, y0, y1 = region
        transcripts = transcripts.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        left, bottom = F.lit(float(x0)), F.lit(float(y0))
    else:
        left, bottom = transcripts.agg(F.min("x")).scalar(), transcripts.agg(F.min("y")).scalar()
    return (
        transcripts.groupBy(
            F.floor((F.col("x") - left) / width).alias("patch_x"), F.floor((F.col("y") - bottom) / width).alias("patch_y")
        )
        .agg(F.count(F.lit(1)).alias("n_transcripts"))
        .filter(F.col("n_transcripts") >= min_transcripts)
    )


# --- polygons --------------------------------------------------------------------------------------------------------


def rings(boundaries: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Vertex rows to one ring per polygon; fewer than three vertices make no polygon.

    Vertices without a cell belong to no polygon and would pile up under one key, so they go first.
    """
    boundaries = boundaries.dropna(subset=list(keys))
    vertices = F.array_sort(F.collect_list(F.struct("vertex_ord", "x", "y")))
    out = boundaries.groupBy(*keys).agg(vertices.alias("_v"))
    ring = F.arrays_zip(*[F.col(f"_v.{c}").cast("array<double>").alias(c) for c in "xy"])
    return out.filter(F.size("_v") >= 3).select(*keys, ring.cast("array<struct<x: double, y: double>>").alias("ring"))


def vertices(rings_df: DataFrame, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """One ring per row back to vertex rows."""
    return rings_df.select(*keys, F.posexplode("ring").alias("vertex_ord", "v")).select(*keys, "vertex_ord", "v.x", "v.y")


def _outlines(rings_df: DataFrame) -> DataFrame:
    """Rings with their check and segments, written once, since an overlap join reads its sides several times."""
    return cut_lineage(G.with_outlines(rings_df))


def split_invalid(rings_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Simple rings, and the self-crossing ones, which have no well-defined overlap."""
    made = _outlines(rings_df)
    return tuple(made.filter(wanted).select(rings_df.columns) for wanted in (~F.col("crossing"), F.col("crossing")))


def repaired(rings_df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell_id, ring, seg, box) fit for overlaps, and the self-crossing rings. These count with the points that they wind
    around an odd number of times."""
    made = _outlines(rings_df.select("cell_id", "ring"))
    return made.filter("box IS NOT NULL").select("cell_id", "ring", "seg", "box"), made.filter("crossing").select("cell_id", "ring")


def _with_box(rings_df: DataFrame, prefix: str) -> DataFrame:
    """Segments, number of slabs and box of each ring. They are written once: the passes that size tiles and count their rows
    then read the box columns alone. What comes from ``repaired`` is written already."""
    written = "box" in rings_df.columns
    xs, ys = F.col("ring.x"), F.col("ring.y")
    box = {c: F.col(f"box.{c}") if written else f(v) for c, f, v in (("x0", F.array_min, xs), ("x1", F.array_max, xs), ("y0", F.array_min, ys), ("y1", F.array_max, ys))}
    boxed = rings_df.select(
        F.col("cell_id").alias(f"{prefix}_id"), (F.col("seg") if written else G.segments("ring")).alias(f"{prefix}_seg"),
        _n_slabs(F.size("ring")).alias(f"{prefix}_n"), *[v.alias(f"{prefix}_{c}") for c, v in box.items()],
    )
    return boxed if written else cut_lineage(boxed)


def _median_side(boxed: DataFrame, p: str) -> float:
    """Approximate median of the larger box side."""
    return boxed.agg(F.percentile_approx(_side(p), 0.5, 1000)).first()[0] or 1.0


# Outlines of very different size meet on a pyramid of square tiles: each stands on the level whose tiles are no smaller
# than itself, in four of them at most.


def _side(p: str) -> Column:
    return F.greatest(F.col(f"{p}_x1") - F.col(f"{p}_x0"), F.col(f"{p}_y1") - F.col(f"{p}_y0"))


def _with_level(boxed: DataFrame, p: str, tile: float) -> DataFrame:
    level = F.greatest(F.coalesce(F.ceil(F.log2(_side(p) / tile)), F.lit(0)), F.lit(0)).cast("int")
    return boxed.withColumn(f"{p}_level", level)


def _level_tile(v: Column, level: Column, tile: float) -> Column:
    return F.floor(v / (F.lit(float(tile)) * F.pow(F.lit(2.0), level)))


def _on_tiles(boxed: DataFrame, p: str, tile: float) -> DataFrame:
    """A row for each tile of the level ``_level`` that the box touches."""

    def span(low: str, high: str) -> Column:
        return F.sequence(*(_level_tile(F.col(f"{p}_{c}"), F.col("_level"), tile) for c in (low, high)))

    return boxed.withColumn("_tx", F.explode(span("x0", "x1"))).withColumn("_ty", F.explode(span("y0", "y1")))


def _levels(boxed: DataFrame, p: str) -> list[int]:
    """The levels in use: some tens at most, as sides double from one to the next."""
    return sorted(r[0] for r in boxed.select(f"{p}_level").distinct().collect())


def _search_levels(boxed: DataFrame, p: str, others: list[int], strictly: bool) -> DataFrame:
    """A row for each level of the other side that is at least as coarse as the box's own, or coarser."""
    own = F.col(f"{p}_level")
    wanted = F.filter(F.array(*[F.lit(v) for v in others]).cast("array<int>"), lambda v: v > own if strictly else v >= own)
    return boxed.withColumn("_level", F.explode(wanted))


def _tile_rows(q: DataFrame, r: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """Rows on which every query box meets every reference box at the coarser one's level, and on no other: in the first
    turn references stand and queries search, in the second references that are smaller search."""

    q_levels, r_levels = _levels(q, "q"), _levels(r, "r")

    def turn(df: DataFrame, n: int, p: str) -> DataFrame:
        return _on_tiles(df.withColumn("_turn", F.lit(n)), p, tile)

    q_rows, r_rows = turn(_search_levels(q, "q", r_levels, False), 0, "q"), turn(r.withColumn("_level", F.col("r_level")), 0, "r")
    if q_levels and r_levels and max(q_levels) > min(r_levels):  # else no reference is smaller than a query
        large = q.filter(F.col("q_level") > min(r_levels)).withColumn("_level", F.col("q_level"))
        q_rows = q_rows.union(turn(large, 1, "q"))
        r_rows = r_rows.union(turn(_search_levels(r, "r", q_levels, True), 1, "r"))
    return q_rows, r_rows


# Long outlines are cut into slabs of about the same number of edges, so that work goes to the edges near by.
SLAB_EDGES = 32
#: Outlines of so few edges keep them beside their box, 40 bytes each.
BOXED_EDGES = 32


def _n_slabs(n_edges: Column) -> Column:
    return F.when(n_edges <= 2 * SLAB_EDGES, 1).otherwise(F.ceil(n_edges / SLAB_EDGES)).cast("int")


def _slab(v: Column, low: Column, width: Column, n: Column) -> Column:
    """The slab of a place, 0 to n - 1."""
    return F.least(F.greatest(F.coalesce(F.floor(F.try_divide(v - low, width)), F.lit(0)), F.lit(0)), n - 1).cast("int")


def _in_slabs(parts: DataFrame, keys: Sequence[str], items: str, low: Column, high: Column, start: Column, width: Column, n: Column) -> DataFrame:
    """(keys, _slab, items): the items, from ``low`` to ``high`` each, of every slab they touch. One slab keeps its list."""
    whole = parts.filter(n == 1).select(*keys, F.lit(0).alias("_slab"), items)
    each = parts.filter(n > 1).withColumn("_item", F.explode(items))
    touched = F.sequence(_slab(low, start, width, n), _slab(high, start, width, n))
    cut = each.withColumn("_slab", F.explode(touched)).groupBy(*keys, "_slab").agg(F.collect_list("_item").alias(items))
    return whole.union(cut.select(*keys, "_slab", items))


def overlap_pairs(query: DataFrame, reference: DataFrame, tile: float | None = None, rows_per_slice: int = 2_000) -> DataFrame:
    """Overlapping polygon pairs with their common area: (query_id, ref_id, area). Inputs are (cell_id, ring) of simple
    rings, or as ``repaired`` returns them; ids are unique.

    Boxes meet on tiles, with the segments of outlines that have few. A pair can meet in several tiles; it is kept only in
    the one holding the lower left corner of the boxes' intersection, which needs no removal of duplicates. Where one of a
    pair has many segments, they are joined to the pair afterwards, slab by slab.
    """
    q_boxed, r_boxed = _with_box(query, "q"), _with_box(reference, "r")
    if tile is None:
        tile = max(2.0 * _median_side(r_boxed, "r"), 1e-6)

    def boxes(boxed: DataFrame, p: str) -> DataFrame:
        few = F.size(f"{p}_seg") <= BOXED_EDGES
        return _with_level(boxed.withColumn(f"{p}_seg", F.when(few, F.col(f"{p}_seg"))), p, tile)

    q, r = boxes(q_boxed, "q"), boxes(r_boxed, "r")
    met = sliced_join(*_tile_rows(q, r, tile), ["_turn", "_level", "_tx", "_ty"], F.col("q_id"), F.col("r_id"), rows_per_slice)
    left, bottom = F.greatest("q_x0", "r_x0"), F.greatest("q_y0", "r_y0")
    right = F.least("q_x1", "r_x1")
    touching = (left <= right) & (bottom <= F.least("q_y1", "r_y1"))
    here = (_level_tile(left, F.col("_level"), tile) == F.col("_tx")) & (_level_tile(bottom, F.col("_level"), tile) == F.col("_ty"))
    kept = met.filter(touching & here).withColumns({"_base": F.least("q_y0", "r_y0"), "_left": left, "_right": right})
    kept = kept.select("q_id", "r_id", "_base", "_left", "_right", "q_seg", "r_seg", *[f"{p}_{c}" for p in "qr" for c in ("x0", "x1", "n")])
    stretch = ["q_id", "r_id", "_base", "_left", "_right", "q_seg", "r_seg"]
    if all(b.filter(F.size(f"{p}_seg") > BOXED_EDGES).isEmpty() for p, b in (("q", q_boxed), ("r", r_boxed))):
        stretches = kept.select(*stretch)
    else:
        kept = cut_lineage(kept)
        have = F.col("q_seg").isNotNull() & F.col("r_seg").isNotNull()
        rest = _cut_to_slabs(kept.filter(~have).drop("q_seg", "r_seg"), q_boxed, r_boxed)
        stretches = kept.filter(have).select(*stretch).union(rest.select(*stretch))
    names = ("x0", "y0", "x1", "m", "s")
    e, f = {n: F.col(f"_e.{n}") for n in names}, {n: F.col(f"_f.{n}") for n in names}
    # segment pairs are rows of generated code inside the task; a partial sum leaves one row per polygon pair to shuffle
    facing = stretches.withColumn("_e", F.explode("q_seg")).drop("q_seg").withColumn("_f", F.explode("r_seg")).drop("r_seg")
    start, end = F.greatest("_left", e["x0"], f["x0"]), F.least("_right", e["x1"], f["x1"])
    facing = facing.filter(start < end)
    common = F.abs(F.sum(G.area_under_lower(e, f, F.col("_base"), start, end)))
    return facing.groupBy(F.col("q_id").alias("query_id"), F.col("r_id").alias("ref_id")).agg(common.alias("area")).filter(F.col("area") > G.TOUCH)


def _cut_to_slabs(pairs: DataFrame, q_boxed: DataFrame, r_boxed: DataFrame) -> DataFrame:
    """Pairs cut where either outline's slabs end, with the segments of both slabs."""

    def width(p: str) -> Column:
        return (F.col(f"{p}_x1") - F.col(f"{p}_x0")) / F.col(f"{p}_n")

    for p in "qr":  # a row for each of the side's slabs within the stretch, which is narrowed to the slab
        low, n, k = F.col(f"{p}_x0"), F.col(f"{p}_n"), F.col(f"{p}_slab")
        slabs = F.sequence(_slab(F.col("_left"), low, width(p), n), _slab(F.col("_right"), low, width(p), n))
        pairs = pairs.withColumn(f"{p}_slab", F.explode(slabs)).withColumns({
            "_left": F.when(k == 0, F.col("_left")).otherwise(F.greatest("_left", low + k * width(p))),
            "_right": F.when(k == n - 1, F.col("_right")).otherwise(F.least("_right", low + (k + 1) * width(p))),
        })
    pairs = pairs.select("q_id", "r_id", "q_slab", "r_slab", "_base", "_left", "_right")
    for p, boxed in (("q", q_boxed), ("r", r_boxed)):
        item, low, n = F.col("_item"), F.col(f"{p}_x0"), F.col(f"{p}_n")
        segments = _in_slabs(boxed, [f"{p}_id", f"{p}_x0", f"{p}_x1", f"{p}_n"], f"{p}_seg", item.x0, item.x1, low, width(p), n)
        pairs = pairs.join(segments.select(f"{p}_id", F.col("_slab").alias(f"{p}_slab"), f"{p}_seg"), [f"{p}_id", f"{p}_slab"])
    return pairs


def best_overlap(pairs: DataFrame) -> DataFrame:
    """The reference polygon sharing most area with each query polygon, the smallest id on a tie.

    Areas are compared at nine decimals, below which sums of doubles carry no meaning.
    """
    best = F.min_by(F.struct("ref_id", "area"), F.struct(-F.round("area", 9), F.col("ref_id")))
    return pairs.groupBy("query_id").agg(best.alias("_b")).select("query_id", "_b.ref_id", "_b.area")


def transfer_labels(query: DataFrame, reference: DataFrame, labels: DataFrame, tile: float | None = None,
                    unmatched: str = UNMATCHED) -> DataFrame:
    """Label of the best overlapping reference polygon for every query polygon: (query_cell_id, transferred_identity).

    If that polygon has no label the query cell is unmatched, even if a smaller overlap had one. Of a cell listed with
    several labels the first in text order counts.
    """
    best = best_overlap(overlap_pairs(query, reference, tile))
    by_id = labels.groupBy(F.col("cell_id").cast("string").alias("_key")).agg(F.min(F.col("label").cast("string")).alias("label"))
    named = best.join(by_id, F.col("ref_id").cast("string") == F.col("_key"), "left").select("query_id", "label")
    return query.select(F.col("cell_id").alias("query_id")).distinct().join(named, "query_id", "left").select(
        F.col("query_id").alias("query_cell_id"), F.coalesce("label", F.lit(unmatched)).alias("transferred_identity")
    )


def cells_in_rois(cells: DataFrame, rois: DataFrame, tile: float | None = None, y_sign: float = -1.0) -> DataFrame:
    """(cell_id, cls, name) for each cell strictly inside a region; regions of the same name count together.

    ``rois`` = (cls, name, ring). Regions are drawn with the y axis pointing up, so the cells' y is negated first.

    Boxes meet cells on the pyramid of tiles, a cell standing in one tile of each level that regions use. A region's edges
    are kept by slabs of y; a cell in its box is tested against the edges of one slab.
    """
    xs, ys = F.transform("ring", lambda v: v.x), F.transform("ring", lambda v: v.y)
    edges = rois.select(
        F.monotonically_increasing_id().alias("r_id"), "cls", "name", G.ring_edges("ring").alias("r_edges"), _n_slabs(F.size("ring")).alias("r_n"),
        F.array_min(xs).alias("r_x0"), F.array_max(xs).alias("r_x1"), F.array_min(ys).alias("r_y0"), F.array_max(ys).alias("r_y1"),
    )
    edges = cut_lineage(edges.filter(F.size("r_edges") > 0))
    if tile is None:
        tile = max(_median_side(edges, "r"), 1e-6)
    boxes = _with_level(edges.drop("r_edges"), "r", tile)
    levels = F.array(*[F.lit(v) for v in _levels(boxes, "r")]).cast("array<int>")
    standing = _on_tiles(boxes.withColumn("_level", F.col("r_level")), "r", tile)
    placed = cells.select("cell_id", F.col("x").alias("_x"), (F.col("y") * y_sign).alias("_y")).withColumn("_level", F.explode(levels))
    placed = placed.withColumns({c: _level_tile(F.col(v), F.col("_level"), tile) for c, v in (("_tx", "_x"), ("_ty", "_y"))})
    met = sliced_join(placed, standing, ["_level", "_tx", "_ty"], F.col("cell_id"), F.col("r_id"))
    met = met.filter(F.col("_x").between(F.col("r_x0"), F.col("r_x1")) & F.col("_y").between(F.col("r_y0"), F.col("r_y1")))
    low, n = F.col("r_y0"), F.col("r_n")
    height = (F.col("r_y1") - low) / n
    near = met.select("cell_id", "_x", "_y", "cls", "name", "r_id", _slab(F.col("_y"), low, height, n).alias("_slab"))
    item = F.col("_item")
    slabs = _in_slabs(edges, ["r_id", "r_y0", "r_y1", "r_n"], "r_edges", F.least(item.y0, item.y1), F.greatest(item.y0, item.y1), low, height, n)
    hits = near.join(slabs.select("r_id", "_slab", "r_edges"), ["r_id", "_slab"]).filter(G.strictly_inside("_x", "_y", "r_edges"))
    return hits.select("cell_id", "cls", "name").distinct()


def assign_roi(cells: DataFrame, rois: DataFrame, cls: str, name: str) -> DataFrame:
    """Add ``roi_<cls>``: ``name`` for cells inside that region, else NULL."""
    wanted = rois.filter((F.col("cls").cast("string") == str(cls)) & (F.col("name").cast("string") == str(name)))
    hits = cells_in_rois(cells, wanted).select("cell_id", F.lit(str(name)).alias(f"roi_{cls}"))
    return cells.join(hits, "cell_id", "left")


def nearest_labels(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Majority label among each cell's neighbours."""
    named = neighbours.join(labels.select(F.col("cell_id").alias("neighbour_id"), "label"), "neighbour_id")
    return majority_label(named, "cell_id")
