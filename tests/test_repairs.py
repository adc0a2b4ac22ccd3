"""Edge cases of cuts, headers, moments, labels, slides, crossing outlines and stage folders."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic import session
from cytomosaic.functions import geometry as GEO
from cytomosaic.operators import deconvolve as D
from cytomosaic.operators import filters as P
from cytomosaic.operators import genes as G
from cytomosaic.operators import matrix as M
from cytomosaic.operators import neighbourhood as N
from cytomosaic.operators import spatial as X
from cytomosaic.operators import stats as S
from cytomosaic.sources import readers as R


def test_viewport_has_no_limit_of_its_own(spark):
    cells = spark.range(5_000).select(F.col("id").cast("string").alias("cell_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    assert P.viewport_cells(cells, 0, 2, 0, 2).count() == 5_000
    assert P.viewport_cells(cells, 0, 2, 0, 2, limit=7).count() == 7


def test_every_gene_is_a_candidate(spark):
    """The most variable gene stands last in the list."""
    genes = spark.range(2_500).select(F.concat(F.lit("g"), F.col("id")).alias("gene"), F.col("id").alias("ord"))
    expression = spark.createDataFrame([("a", "g2499", 9.0), ("b", "g3", 1.0)], "ref_cell string, gene string, value double")
    panel = genes.limit(0)
    assert G.variable_genes(genes, panel, expression, 10, top=1).first().gene == "g2499"
    assert G.variable_genes(genes, panel, expression, 10, pool=100, top=1).first().gene == "g3"


def test_permutation_modes():
    assert S.draw(3, 3, 100, 0).mode == "exact" and len(S.draw(3, 3, 100, 0).splits) == 20
    assert S.draw(3, 3, 10, 0).mode == "random"
    assert len(S.draw(3, 3, 10, 0, mode="exact").splits) == 20
    assert S.draw(3, 3, 500, 0, mode="random").splits.shape == (500, 6)
    with pytest.raises(ValueError):
        S.draw(3, 3, 10, 0, mode="some")


def test_empty_condition(spark):
    metrics = spark.createDataFrame([("s0", "a", "L-R", 0.5, 1.0), ("s1", "b", "L-R", 0.5, 1.0)], "sample string, condition string, lr_pair string, normalized_freq double, mean_attention double")
    out = S.compare_conditions(metrics, "a", "b", ["s0"], [])
    full = S.compare_conditions(metrics, "a", "b", ["s0"], ["s1"])
    assert out.count() == 0 and out.columns == full.columns


def test_edges_by_name(spark, tmp_path):
    for sample, text in (("s0", "from_cell,to_cell,ligand,receptor,attention_score\na,b,L,R,0.5\n"), ("s1", "attention_score,to_cell,from_cell,receptor,ligand\n0.25,d,c,R,L\n")):
        folder = tmp_path / "output" / sample
        folder.mkdir(parents=True)
        (folder / f"x_{sample}_allCCC.csv").write_text(text)
    got = {(r["sample"], r.from_cell, r.to_cell, r.ligand, r.receptor, r.attention_score) for r in R.read_ccc_edges(spark, str(tmp_path), ["s0", "s1"], True).collect()}
    assert got == {("s0", "a", "b", "L", "R", 0.5), ("s1", "c", "d", "L", "R", 0.25)}


def test_packed_and_empty_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"x,y\n1,2\n"))
    (tmp_path / "c.csv").write_text("y,x\n4,3\n")
    parts = R.read_csv_by_name(spark, [str(p) for p in sorted(tmp_path.iterdir())])
    assert {(r.x, r.y) for part in parts for r in part.select("x", "y").collect()} == {("1", "2"), ("3", "4")}


def test_headers_of_many_files(spark, tmp_path):
    """One scan for each kind of header; names with blanks and signs, line ends of both kinds, a file of many splits."""
    names = ["cell", "x", "y"]
    for i in range(120):
        order = names[i % 3 :] + names[: i % 3]
        values = {"cell": f"c{i}", "x": str(i), "y": str(-i)}
        end = "\r\n" if i % 2 else "\n"
        (tmp_path / f"part {i}+%.csv").write_text(end.join([",".join(order), ",".join(values[c] for c in order)]) + end, newline="")
    with (tmp_path / "zz.csv").open("w") as f:
        f.write("y,cell,x\n")
        f.writelines(f"{-k},c{k},{k}\n" for k in range(1_000, 300_000))
    parts = R.read_csv_by_name(spark, R._files(spark, [str(tmp_path)]))
    assert len(parts) == 3
    got = R._stacked(spark, [p.select(*names) for p in parts], "cell string, x string, y string")
    assert got.count() == 120 + 299_000
    assert got.filter("cell <> concat('c', x) OR cast(x AS int) <> -cast(y AS int)").count() == 0


@pytest.mark.parametrize(("value", "n"), [(3.7, 3_333), (np.log1p(1234.567), 12_345), (1e-8, 50)])
def test_constant_genes_have_no_score(spark, value, n):
    cells = spark.range(n).select(F.col("id").cast("string").alias("cell_id"))
    same = cells.select("cell_id", F.lit("same").alias("gene"), F.lit(float(value)).alias("value"))
    other = cells.limit(n // 2).select("cell_id", F.lit("other").alias("gene"), F.lit(float(value)).alias("value"))
    assert [r.gene for r in M.z_scores(same.union(other), cells).select("gene").distinct().collect()] == ["other"]


def test_variance_with_zeros(spark):
    values = [5.0, 1e6 + 1, 1e6 + 2]
    rows = spark.createDataFrame([("g", v) for v in values], "gene string, value double")
    got = G.gene_variance(rows, 10).first().variance
    assert got == pytest.approx(np.var([*values, *[0.0] * 7], ddof=1), rel=1e-12)


def test_one_label_for_each_cell(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rings = spark.createDataFrame([("a", [{"x": x, "y": y} for x, y in ring])], "cell_id string, ring array<struct<x: double, y: double>>")
    labels = spark.createDataFrame([("a", "T"), ("a", "B"), ("a", None)], "cell_id string, label string")
    assert [tuple(r) for r in X.transfer_labels(rings, rings, labels).collect()] == [("a", "B")]


def test_slides_do_not_mix(spark):
    rows = [("s1", "a", 0.0, 0.0, "T"), ("s2", "b", 1.0, 0.0, "B"), ("s2", "c", 2.0, 0.0, "T"), (None, "d", 0.5, 0.0, "T")]
    cells = spark.createDataFrame(rows, "sample string, cell_id string, x double, y double, cell_type string")
    assert [tuple(r) for r in N.contact_counts(cells.dropna(), 5.0, ["sample"]).collect()] == [("s2", "B", "T", 1)]
    assert {tuple(r)[:3] for r in X.nearest_graph(cells, 1, by=["sample"]).collect()} == {("s2", "b", "c"), ("s2", "c", "b")}
    assert N.contact_counts(cells, 5.0).agg(F.sum("n_contacts")).first()[0] == 6


def inside_share(rings, x, y):
    """For each grid point, whether an odd number of edges lie above it."""
    above = np.zeros(len(x), int)
    for (xa, ya), (xb, yb) in zip(rings, [*rings[1:], rings[0]]):
        if xa != xb:
            over = (np.minimum(xa, xb) <= x) & (x < np.maximum(xa, xb))
            above += over & (ya + (yb - ya) / (xb - xa) * (x - xa) > y)
    return above % 2 == 1


def segment_area(segments, x, y):
    total = np.zeros(len(x))
    for x0, y0, x1, m, s in segments:
        total += s * ((x0 <= x) & (x < x1) & (y0 + m * (x - x0) > y))
    return total


def pentagram(cx=0.0, cy=0.0, r=1.0):
    return [(cx + r * np.cos(a), cy + r * np.sin(a)) for a in 0.3 + np.arange(5) * 4 * np.pi / 5]


def test_even_odd_segments():
    """Segments add up to the inside at every point, for crossing, covering and touching outlines."""
    rng = np.random.default_rng(8)
    shapes = [pentagram(), [(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (6, 0), (6, 2), (4, -2), (2, 2), (0, -2)], [(0, 0), (0, 2), (2, 2), (2, 0)]]
    shapes += [[(0, 0), (4, 0), (4, 4), (0, 4)] * 2, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (1, 1), (2, 2)], [(0, 0), (0, 1), (0, 2)]]
    shapes += [rng.uniform(0, 5, (n, 2)).tolist() for n in (5, 9, 30)]
    for ring in shapes:
        ring = [(float(a), float(b)) for a, b in ring]
        x, y = rng.uniform(-2, 7, (2, 4000))
        got = segment_area(GEO.even_odd_segments(np.array(ring)), x, y)
        assert np.allclose(got, inside_share(ring, x, y))
    ring = np.array(pentagram())
    area = sum(s * (x1 - x0) * (y0 + 5 + m * (x1 - x0) / 2) for x0, y0, x1, m, s in GEO.even_odd_segments(ring))
    assert area == pytest.approx(0.7757, abs=2e-3)  # the tips without the middle


def test_pentagrams_overlap(spark):
    """Overlap of shapes that cover themselves, against points of a grid."""
    rng = np.random.default_rng(9)
    schema = "cell_id string, ring array<struct<x: double, y: double>>"
    make = lambda rows: spark.createDataFrame([(n, [{"x": float(x), "y": float(y)} for x, y in ring]) for n, ring in rows], schema)
    left = [(f"q{i}", pentagram(*rng.uniform(0, 3, 2), 1.2)) for i in range(8)] + [("qb", [(0, 0), (3, 3), (3, 0), (0, 3)])]
    right = [(f"r{i}", pentagram(*rng.uniform(0, 3, 2), 0.8)) for i in range(8)] + [("rt", [(0, 0), (3, 0), (1, 3)])]
    (query, crossing), (reference, _) = X.repaired(make(left)), X.repaired(make(right))
    assert crossing.count() == 9 and query.count() == 9
    got = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(query, reference).collect()}
    side = 700
    x, y = (v.ravel() for v in np.meshgrid(*[(np.arange(side) + 0.5) / side * 6 - 1.5] * 2))
    inside = {n: inside_share(ring, x, y) for n, ring in [*left, *right]}
    for (q, _), (r, _) in itertools.product(left, right):
        assert got.get((q, r), 0.0) == pytest.approx((inside[q] & inside[r]).mean() * 36, abs=0.012)
    assert len(got) > 20


def test_outlines_of_all_sizes(spark):
    """Sizes over five orders of magnitude on both sides: every pair once, and few rows for an outline."""
    rng = np.random.default_rng(10)
    schema = "cell_id string, ring array<struct<x: double, y: double>>"

    def squares(prefix, n):
        out = []
        for i in range(n):
            side = float(10 ** rng.uniform(-2, 3))
            x, y = rng.uniform(-500, 500, 2).tolist()
            out.append((f"{prefix}{i}", x, y, side))
        return out

    left, right = squares("q", 70), squares("r", 70)
    make = lambda rows: spark.createDataFrame([(n, [{"x": x, "y": y}, {"x": x + s, "y": y}, {"x": x + s, "y": y + s}, {"x": x, "y": y + s}]) for n, x, y, s in rows], schema)
    want = {}
    for (q, qx, qy, qs), (r, rx, ry, rs) in itertools.product(left, right):
        w, h = min(qx + qs, rx + rs) - max(qx, rx), min(qy + qs, ry + rs) - max(qy, ry)
        if w > 0 and h > 0:
            want[q, r] = w * h
    for tile in (None, 0.05, 3000.0):
        got = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(make(left), make(right), tile, rows_per_slice=20).collect()}
        assert got == {k: pytest.approx(v, rel=1e-6) for k, v in want.items()}
    huge = make([("big", 0.0, 0.0, 1e6)])
    boxed = X._with_level(X._with_box(huge, "r"), "r", 1.0)
    assert X._on_tiles(boxed.withColumn("_level", F.col("r_level")), "r", 1.0).count() <= 4


def test_long_outlines_in_slabs(spark, monkeypatch):
    """Outlines of very many edges are cut into slabs on either side; areas and points inside stay the same."""
    monkeypatch.setattr(X, "SLAB_EDGES", 4)
    monkeypatch.setattr(X, "BOXED_EDGES", 4)
    schema = "cell_id string, ring array<struct<x: double, y: double>>"

    def disc(n, cx, cy, r, wave=0.0):
        a = np.arange(n) * 2 * np.pi / n
        radius = r * (1 + wave * np.sin(9 * a))
        return list(zip((cx + radius * np.cos(a)).tolist(), (cy + radius * np.sin(a)).tolist()))

    make = lambda rows: spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in ring]) for n, ring in rows], schema)
    left = [("a", disc(400, 0, 0, 10, 0.2)), ("b", disc(5, 7, 3, 2)), ("c", disc(60, 30, 0, 4))]
    right = [("d", disc(300, 6, 0, 9)), ("e", disc(4, -6, 1, 3)), ("f", disc(90, 29, 2, 3, 0.1))]
    got = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(make(left), make(right)).collect()}
    monkeypatch.setattr(X, "SLAB_EDGES", 10_000)
    monkeypatch.setattr(X, "BOXED_EDGES", 10_000)
    want = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(make(left), make(right)).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()} and len(want) == 4


def test_points_in_a_region_of_many_edges(spark):
    """A region of 100,000 edges beside small ones: each point is tested against the few edges of its slab."""
    n = 100_000
    a = np.arange(n) * 2 * np.pi / n
    radius = 1000 * (1 + 0.1 * np.sin(50 * a))
    big = list(zip((radius * np.cos(a)).tolist(), (radius * np.sin(a)).tolist()))
    small = [(0.0, 0.0), (3.0, 0.0), (0.0, 3.0)]
    rois = spark.createDataFrame([("t", "big", big), ("t", "small", small), ("t", "none", [])], "cls string, name string, ring array<struct<x: double, y: double>>")
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.uniform(-1200, 1200, (3000, 2)), rng.uniform(-1, 4, (300, 2))])
    cells = spark.createDataFrame([(i, float(x), float(-y)) for i, (x, y) in enumerate(points)], "cell_id long, x double, y double")
    got = {(r.cell_id, r.name) for r in X.cells_in_rois(cells, rois).collect()}
    angle = np.arctan2(points[:, 1], points[:, 0])
    far = np.hypot(*points.T) - 1000 * (1 + 0.1 * np.sin(50 * angle))
    sure = np.abs(far) > 0.5
    assert {i for i, name in got if name == "big" and sure[i]} == set(np.flatnonzero((far < 0) & sure).tolist())
    x, y = points.T
    assert {i for i, name in got if name == "small"} == set(np.flatnonzero((x > 0) & (y > 0) & (x + y < 3)).tolist())
    edges = rois.filter("name = 'big'").select(F.lit(0).alias("r_id"), GEO.ring_edges("ring").alias("r_edges"), X._n_slabs(F.size("ring")).alias("n"))
    assert edges.first()["n"] > 3000


def test_crossing_outlines_overlap(spark):
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    right = [(1.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 2.0)]
    schema = "cell_id string, ring array<struct<x: double, y: double>>"
    make = lambda name, ring: spark.createDataFrame([(name, [{"x": x, "y": y} for x, y in ring])], schema)
    query, crossing = X.repaired(make("bow", bow))
    assert [r.cell_id for r in crossing.collect()] == ["bow"]
    reference, _ = X.repaired(make("right", right))
    assert [(r.query_id, r.ref_id, round(r.area, 9)) for r in X.overlap_pairs(query, reference).collect()] == [("bow", "right", 1.0)]
    assert [(round(r.area, 9)) for r in X.overlap_pairs(query, query).collect()] == [2.0]


def test_mixtures_against_all_pairs():
    rng = np.random.default_rng(3)
    profiles = rng.random((6, 4))
    g = profiles.T @ profiles
    x = np.maximum(rng.random((40, 6)) @ np.diag(rng.random(6)), 0)
    residual, a, b, wa, wb = D._best_pairs((x * x).sum(1), x @ profiles, g)
    for i in range(len(x)):
        options = []
        for p in range(4):
            for q in range(p + 1, 4):
                m = profiles[:, [p, q]]
                w = np.linalg.lstsq(m, x[i], rcond=None)[0]
                if (w <= 0).any():
                    one = [max(m[:, k] @ x[i] / (m[:, k] @ m[:, k]), 0) for k in range(2)]
                    alone = [((x[i] - one[k] * m[:, k]) ** 2).sum() for k in range(2)]
                    options.append(min(alone))
                else:
                    options.append(((x[i] - m @ w) ** 2).sum())
        assert residual[i] == pytest.approx(min(options), abs=1e-8)
        assert residual[i] == pytest.approx(((x[i] - wa[i] * profiles[:, a[i]] - wb[i] * profiles[:, b[i]]) ** 2).sum(), abs=1e-8)


def test_stage_folders_are_cleared(spark):
    df = session.cut_lineage(spark.range(10))
    assert df.count() == 10
    folder = session._made[-1]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(path)
    listed, session._made[:] = session._made[:-1], [folder]
    assert session.clear_stages(spark) == 1 and not system.exists(path)
    session._made[:] = listed


def test_blocks_rule_out_most_pairs(spark, monkeypatch):
    """Clustered vectors: the second pass goes by the distance found in the first, and the result is that of brute force."""
    from cytomosaic.operators import knn

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 6
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.3).tolist()) for i in range(2_400)]
    vectors = spark.createDataFrame(rows, "id long, features array<double>")
    sent, plain = [], knn._BlockSearch.run

    def counting(self, routed):
        sent.append(routed.count())
        return plain(self, routed)

    monkeypatch.setattr(knn._BlockSearch, "run", counting)
    queries, references = vectors.filter("id % 4 = 0"), vectors.filter("id % 4 <> 0")
    got = knn.knn_join(queries, references, 5, "euclidean", broadcast_bytes=0, block_rows=64, n_pivots=40)
    found = {(r.query_id, r.place): r.ref_id for r in got.collect()}
    points = np.array([v for _, v in rows])
    refs = np.array([i for i in range(2_400) if i % 4])
    for q in range(0, 2_400, 4):
        order = np.argsort(((points[refs] - points[q]) ** 2).sum(1), kind="stable")[:5]
        assert [found[q, p + 1] for p in range(5)] == refs[order].tolist()
    assert sum(sent) < 0.35 * 600 * 40  # of all queries and blocks


def test_outline_files_grow_in_number(spark, monkeypatch):
    """Files of outlines are sorted by one task each, so their number follows the rows; vertices keep their order."""
    from types import SimpleNamespace

    from registry import files

    rows = [(f"c{i}", kind, v, float(i + v), float(v)) for i in range(60) for kind in ("ref", "query") for v in range(4)]
    made = spark.createDataFrame(rows[::-1], "cell_id string, kind string, vertex_ord int, x double, y double")
    parts, plain = [], files.K.write_table

    def counting(df, path):
        parts.append(df.rdd.getNumPartitions())
        return plain(df, path)

    monkeypatch.setattr(files.K, "write_table", counting)
    monkeypatch.setattr(files, "FILE_ROWS", 30)
    back = files.read_boundaries(SimpleNamespace(spark=spark, boundaries=made, sf_dir=""))
    names = {"ref": "nucleus", "query": "cell"}
    assert sorted(tuple(r) for r in back.collect()) == sorted((c, names[k], v, x, y) for c, k, v, x, y in rows)
    assert parts == [8, 8]
