import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic.functions import geometry as G
from cytomosaic.operators import neighbourhood as N
from cytomosaic.operators import spatial as X


def ring_table(spark, shapes):
    data = [(name, [(float(x), float(y)) for x, y in ring]) for name, ring in shapes]
    return spark.createDataFrame(data, "cell_id string, ring array<struct<x: double, y: double>>")


def clip(subject, convex):
    """Area of a polygon cut by a convex one, edge by edge."""
    def area2(ring):
        return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True))

    if area2(convex) < 0:
        convex = convex[::-1]
    out = list(subject)
    for (ax, ay), (bx, by) in zip(convex, convex[1:] + convex[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        new = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                new.append(out[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                new.append((out[i][0] + t * (out[j][0] - out[i][0]), out[i][1] + t * (out[j][1] - out[i][1])))
        out = new
        if len(out) < 3:
            return 0.0
    return abs(area2(out)) / 2


def star(rng, cx, cy, n, low, high):
    angles = np.sort(rng.random(n)) * 2 * math.pi
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, rng.uniform(low, high, n), strict=True)]


def test_overlap_against_clipping(spark):
    rng = np.random.default_rng(3)
    queries, references = [], []
    for i in range(60):
        cx, cy = rng.uniform(8000, 8060, 2)
        queries.append((f"q{i}", star(rng, cx, cy, 9, 3, 9)))
        angles = np.sort(rng.random(6)) * 2 * math.pi
        cx, cy = rng.uniform(8000, 8060, 2)
        ring = [(cx + 7 * math.cos(a), cy + 7 * math.sin(a)) for a in angles]
        references.append((f"r{i}", ring[::-1] if i % 2 else ring))
    query = X.split_invalid(ring_table(spark, queries))[0]
    kept = {r.cell_id for r in query.collect()}
    got = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(query, ring_table(spark, references)).collect()}
    sliced = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(query, ring_table(spark, references), 11.0, rows_per_slice=2).collect()}
    for (qn, q), (rn, r) in itertools.product(queries, references):
        if qn in kept:
            want = clip(q, r)
            assert got.get((qn, rn), 0.0) == pytest.approx(want, abs=1e-7)
            assert sliced.get((qn, rn), 0.0) == pytest.approx(want, abs=1e-7)
    assert len(got) > 50


def test_touching_squares_do_not_overlap(spark):
    a = ring_table(spark, [("a", [(0, 0), (1, 0), (1, 1), (0, 1)])])
    b = ring_table(spark, [("b", [(1, 0), (2, 0), (2, 1), (1, 1)]), ("c", [(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)])])
    assert [(r.ref_id, r.area) for r in X.overlap_pairs(a, b).collect()] == [("c", pytest.approx(0.25))]


def test_large_polygon_spans_many_tiles_once(spark):
    a = ring_table(spark, [("a", [(0, 0), (100, 0), (100, 100), (0, 100)])])
    b = ring_table(spark, [("b", [(-5, -5), (105, -5), (105, 105), (-5, 105)])])
    assert [(r.area) for r in X.overlap_pairs(a, b, 7.0).collect()] == [pytest.approx(10_000)]


def test_transfer_rules(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    query = ring_table(spark, [("q1", square), ("q2", [(50, 50), (51, 50), (51, 51)]), ("q3", [(20, 0), (30, 0), (30, 10), (20, 10)])])
    reference = ring_table(spark, [
        ("r1", [(0, 0), (7, 0), (7, 10), (0, 10)]), ("r2", [(7, 0), (10, 0), (10, 10), (7, 10)]),
        ("r4", [(20, 0), (25, 0), (25, 10), (20, 10)]), ("r3", [(25, 0), (30, 0), (30, 10), (25, 10)]),
    ])
    labels = spark.createDataFrame([("r2", "B"), ("r3", "three"), ("r4", "four")], "cell_id string, label string")
    got = {r.query_cell_id: r.transferred_identity for r in X.transfer_labels(query, reference, labels).collect()}
    # the largest overlap of q1 has no label; q3 is tied, so the smaller id wins
    assert got == {"q1": "Unassigned", "q2": "Unassigned", "q3": "three"}


def test_invalid_rings_are_set_aside(spark):
    rings = ring_table(spark, [("bow", [(0, 0), (2, 2), (2, 0), (0, 2)]), ("ok", [(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)])])
    good, bad = X.split_invalid(rings)
    assert [r.cell_id for r in good.collect()] == ["ok"] and [r.cell_id for r in bad.collect()] == ["bow"]


def test_area_and_translate(spark):
    rings = ring_table(spark, [("t", [(0, 0), (4, 0), (0, 3)])])
    moved = rings.withColumn("ring", G.translate("ring", F.lit(1e6), F.lit(-1e6)))
    assert rings.select(G.polygon_area("ring").alias("a")).first().a == 6.0
    assert moved.select(G.polygon_area("ring").alias("a")).first().a == pytest.approx(6.0, abs=1e-6)


def test_two_vertices_make_no_polygon(spark):
    rows = [("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("b", 2, 0.0, 1.0), ("b", 0, 0.0, 0.0), ("b", 1, 1.0, 0.0)]
    out = X.rings(spark.createDataFrame(rows, "cell_id string, vertex_ord int, x double, y double")).collect()
    assert [(r.cell_id, [(v.x, v.y) for v in r.ring]) for r in out] == [("b", [(0, 0), (1, 0), (0, 1)])]


def test_points_on_the_edge_are_outside(spark):
    rois = spark.createDataFrame([("t", "A", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)])], "cls string, name string, ring array<struct<x: double, y: double>>")
    pts = {"in": (1, 1), "edge": (0, 2), "corner": (4, 4), "notch": (2, 3), "tip": (2, 2), "out": (5, 1), "low": (3.9, 0.1)}
    cells = spark.createDataFrame([(k, float(x), float(-y)) for k, (x, y) in pts.items()], "cell_id string, x double, y double")
    assert {r.cell_id for r in X.cells_in_rois(cells, rois).collect()} == {"in", "low"}
    assigned = {r.cell_id: r.roi_t for r in X.assign_roi(cells, rois, "t", "A").collect()}
    assert assigned["in"] == "A" and assigned["edge"] is None


def clumped(spark, rng, n=150):
    """A third of the cells sit in one spot, some exactly on top of each other, one far away."""
    pts = [(float(x), float(y)) for x, y in rng.uniform(0, 100, (n, 2))]
    pts[: n // 3] = [(50.0 + (i % 5) * 0.1, 50.0) for i in range(n // 3)]
    pts[-1] = (5000.0, 5000.0)
    kinds = [("A", "B", "C", None)[i % 4] for i in rng.integers(0, 4, n)]
    cells = [(f"c{i:03d}", x, y, k) for i, ((x, y), k) in enumerate(zip(pts, kinds, strict=True))]
    return spark.createDataFrame(cells, "cell_id string, x double, y double, cell_type string"), cells


def near_pairs(cells, r):
    return {(a[0], b[0]): math.hypot(a[1] - b[1], a[2] - b[2]) for a, b in itertools.combinations(cells, 2) if math.hypot(a[1] - b[1], a[2] - b[2]) <= r}


@pytest.mark.parametrize("per_slice", [3, 5_000])
def test_neighbours_against_all_pairs(spark, per_slice):
    df, cells = clumped(spark, np.random.default_rng(1))
    got = X.neighbour_pairs(df, 12.0, rows_per_slice=per_slice).collect()
    pairs = [tuple(sorted((r.a_cell_id, r.b_cell_id))) for r in got]
    want = near_pairs(cells, 12.0)
    assert len(pairs) == len(set(pairs)) and set(pairs) == set(want)
    assert X.neighbour_graph(df, 12.0).count() == 2 * len(want)


def test_neighbours_stay_within_a_group(spark):
    rows = [("s0", "a", 0.0, 0.0), ("s1", "b", 0.0, 1.0), ("s0", "c", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "sample string, cell_id string, x double, y double")
    got = X.neighbour_pairs(df, 5.0, by=["sample"]).collect()
    assert [(r["sample"], {r.a_cell_id, r.b_cell_id}) for r in got] == [("s0", {"a", "c"})]


def test_nearest_graph_against_sorting(spark):
    df, cells = clumped(spark, np.random.default_rng(2), 90)
    got = {}
    for r in X.nearest_graph(df, 3).orderBy("cell_id", "place").collect():
        got.setdefault(r.cell_id, []).append(r.neighbour_id)
    for a in cells:
        others = sorted((math.hypot(a[1] - b[1], a[2] - b[2]), b[0]) for b in cells if b[0] != a[0])
        assert got[a[0]] == [b for _, b in others[:3]]


def test_nearest_graph_with_too_few_cells(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "cell_id string, x double, y double")
    assert {(r.cell_id, r.neighbour_id) for r in X.nearest_graph(df, 5).collect()} == {("a", "b"), ("b", "a")}


def test_contacts_count_copies_of_a_point(spark):
    df, cells = clumped(spark, np.random.default_rng(3))
    kind = {c[0]: c[3] for c in cells}
    want = {}
    for a, b in near_pairs(cells, 10.0):
        if kind[a] and kind[b]:
            key = tuple(sorted((kind[a], kind[b])))
            want[key] = want.get(key, 0) + 1
    assert {(r.type_a, r.type_b): r.n_contacts for r in N.contact_counts(df, 10.0).collect()} == want


def test_enrichment_equals_all_permutations(spark):
    """Mean and deviation over every relabelling of seven cells."""
    pts = [(0, 0), (1, 0), (1, 0), (2, 0), (2, 1), (5, 5), (0, 1)]
    kinds = ["A", "A", "A", "B", "B", "A", "C"]
    cells = [(f"c{i}", float(x), float(y), k) for i, ((x, y), k) in enumerate(zip(pts, kinds, strict=True))]
    df = spark.createDataFrame(cells, "cell_id string, x double, y double, cell_type string")
    near = [(i, j) for i, j in itertools.combinations(range(7), 2) if math.dist(pts[i], pts[j]) <= 1.5]
    runs = {}
    for order in itertools.permutations(kinds):
        seen = {}
        for i, j in near:
            key = tuple(sorted((order[i], order[j])))
            seen[key] = seen.get(key, 0) + 1
        for key in itertools.combinations_with_replacement("ABC", 2):
            runs.setdefault(key, []).append(seen.get(key, 0))
    for r in N.neighbourhood_enrichment(df, 1.5).collect():
        values = np.array(runs[(r.type_a, r.type_b)])
        assert r.mean == pytest.approx(values.mean()) and r.sd == pytest.approx(values.std(), abs=1e-9)
        real = sum(tuple(sorted((kinds[i], kinds[j]))) == (r.type_a, r.type_b) for i, j in near)
        assert r.observed == real
        assert r.z is None if r.sd == 0 else r.z == pytest.approx((real - values.mean()) / values.std())


def test_patches(spark):
    rows = [("g", float(x), float(y), 30.0) for x, y in [(0, 0)] * 3 + [(9.9, 9.9)] * 2 + [(10, 0)] * 5 + [(200, 0)] * 9]
    df = spark.createDataFrame(rows, "gene string, x double, y double, qv double")
    got = {(r.patch_x, r.patch_y): r.n_transcripts for r in X.patch_counts(df, (0, 100, 0, 100), 10.0, 4).collect()}
    assert got == {(0, 0): 5, (1, 0): 5}


def test_paths(spark):
    ppi = spark.createDataFrame([("R", "a"), ("a", "b"), ("b", "c"), ("a", "R"), ("R", "b")], "source string, target string")
    assert {(r.node, r.hop) for r in N.reachable(ppi, "R", 2).collect()} == {("R", 0), ("a", 1), ("b", 1), ("c", 2)}
    tf = spark.createDataFrame([("b", "g1"), ("c", "zz"), ("a", "g1"), ("x", "g1")], "tf string, target string")
    panel = spark.createDataFrame([("g1",), ("c",)], "gene string")
    got = {(r.tf, r.hop, r.in_panel, r.n_panel_targets) for r in N.downstream_factors(ppi, tf, panel, "R").collect()}
    assert got == {("a", 1, False, 1), ("b", 1, False, 1), ("c", 2, True, 0)}
