"""What keeps the work of the larger jobs in step with their tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic import fixtures
from cytomosaic.functions import geometry as GEO
from cytomosaic.operators import knn
from cytomosaic.operators import metrics as M
from cytomosaic.operators import spatial as X
from registry import files, learn
from registry.base import Tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("growth"))
    i = F.col("id")
    spark.range(1, 241).select(
        i.alias("o_orderkey"), (i % 37).alias("o_custkey"), (i * 1000.0).alias("o_totalprice"), F.concat(F.lit("P"), (i % 3).cast("string")).alias("o_orderpriority")
    ).write.parquet(f"{base}/orders.parquet")
    spark.range(1500).select(
        (i % 240 + 1).alias("l_orderkey"), (i * 7 % 64).alias("l_partkey"), (i % 5).alias("l_suppkey"), (i % 4 + 1).cast("int").alias("l_linenumber"),
        (i % 50 + 1).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit(0.04).alias("l_tax"), F.lit("N").alias("l_returnflag"),
    ).write.parquet(f"{base}/lineitem.parquet")
    return base


def features(spark, m):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id long, features array<double>")


def test_few_files_of_queries_make_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 6))
    m[100:250] = m[7]  # copies
    df = features(spark, m).coalesce(1)
    monkeypatch.setattr(knn, "TASK_PAIRS", 10_000)
    monkeypatch.setattr(knn, "SEARCH_ROWS", 64)
    monkeypatch.setattr(knn, "SEARCH_QUERIES", 32)
    assert knn._by_broadcast(df, df, 300, 4, "cosine", False).rdd.getNumPartitions() == 9
    got = {(r.query_id, r.place): (r.ref_id, r.distance) for r in knn.knn_join(df, df, 4).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 10)
    for q in range(300):
        for place, r in enumerate(np.lexsort((np.arange(300), d[q]))[:4]):
            assert got[q, place + 1][0] == r or abs(got[q, place + 1][1] - d[q, r]) < 1e-9
    assert [got[120, p][0] for p in (1, 2, 3, 4)] == [7, 100, 101, 102]


def test_groups_are_made_once(spark, monkeypatch):
    edges = spark.createDataFrame([("s", f"c{i % 5}", f"c{i % 3}", "L", "R", 0.5) for i in range(30)],
                                  "sample string, from_cell string, to_cell string, ligand string, receptor string, attention_score double")
    types = spark.createDataFrame([(f"c{i}", "T") for i in range(5)], "cell_id string, cell_type string")
    typed = M.annotate_endpoints(edges, types)
    assert typed.columns == ["to_cell", "from_cell", "sample", "ligand", "receptor", "attention_score", "from_type", "to_type"]
    written, plain = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    samples = spark.createDataFrame([("s", "ctrl", 5)], "sample string, condition string, n_cells long")
    (row,) = M.celltype_metrics(typed, samples).collect()
    assert len(written) == 1 and (row["n_edges"], row["normalized_freq"], row["sender_fraction"]) == (30, 1.0, 1.0)


@pytest.mark.parametrize("query", [files.merge_job, files.triplet_files, files.matrix_triplets, files.read_expression_layers, files.replace_layer])
def test_tables_are_made_once(spark, tables, monkeypatch, query):
    made, plain = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda spark, sf, name: made.append(name) or plain(spark, sf, name))
    assert query(Tables(spark, tables)).count() > 0
    assert all(made.count(name) <= 1 for name in ("expr", "genes", "boundaries"))


def test_correction_makes_counts_once(spark, tables, monkeypatch):
    made, plain = [], fixtures.table
    monkeypatch.setattr(fixtures, "table", lambda spark, sf, name: made.append(name) or plain(spark, sf, name))
    monkeypatch.setattr(learn.correction, "correct", lambda *parts, **how: parts)
    parts = learn.corrected(Tables(spark, tables))
    assert made.count("expr") == 1 and made.count("genes") == 1
    assert parts[1].count() > 0 and parts[3].count() > 0


def test_collections_follow_the_features(spark, tables, monkeypatch):
    t = Tables(spark, tables)
    monkeypatch.setattr(files, "FILE_FEATURES", 50)
    paths = []
    plain = files.folder
    monkeypatch.setattr(files, "folder", lambda t, label: paths.append(plain(t, label)) or paths[-1])
    got = files.read_geojson(t)
    columns = ["kind", "cell_id", "vertex_ord", "x", "y"]
    want = t.boundaries.select("kind", "cell_id", F.col("vertex_ord").cast("int").alias("vertex_ord"), "x", "y")
    assert sorted(got.select(*columns).collect()) == sorted(want.collect())
    lines = spark.read.text(paths[1]).filter("value LIKE '%FeatureCollection%'")
    assert lines.count() == 5


def test_seeds_are_shuffled_once(spark, monkeypatch):
    from cytomosaic.llm import chaining

    kept, plain = [], chaining.Workspace.keep
    monkeypatch.setattr(chaining.Workspace, "keep", lambda ws, df, label: kept.append(label) or plain(ws, df, label))
    passage = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, "a b c " + passage), (2, passage + " d e f"), (3, "x y z")], "doc_id long, text string")
    got = {r["doc_id"]: r["partner"] for r in chaining.repeated_passages(docs).collect()}
    assert got == {1: 2, 2: 1} and "shared" not in kept and "met" in kept


def test_outlines_are_checked_in_batches(spark, monkeypatch):
    """Rings of all sizes in one batch: checks and segments are those of the expressions, ring by ring, and are made once."""
    rng = np.random.default_rng(12)
    shapes = [rng.uniform(0, 9, (n, 2)).tolist() for n in (3, 4, 4, 5, 8, 40) for _ in range(12)]
    angles = [np.sort(rng.random(n)) * 2 * np.pi for n in (3, 4, 7, 60) for _ in range(6)]
    shapes += [np.stack([np.cos(a), np.sin(a)], 1).tolist() for a in angles]
    shapes += [[(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (2, 0)], [(1, 1)] * 4]
    shapes += [[(0, 0), (None, 1), (3, 3)], [(0, 0), (1, None), (2, 0), (2, 2)], [(0, 0), (2, 2), (2, 0), (0, 2), (None, None)], [(0, 0), (float("nan"), 1), (3, 3), (0, 3)]]
    shapes.insert(20, [])
    rows = [(i, [tuple(None if v is None else float(v) for v in p) for p in ring]) for i, ring in enumerate(shapes)]
    rings = spark.createDataFrame(rows, "cell_id long, ring array<struct<x: double, y: double>>").coalesce(1)
    want = {r.cell_id: r for r in rings.select("cell_id", "ring", GEO.self_intersecting("ring").alias("crossing"), GEO.segments("ring").alias("seg")).collect()}
    got = {r.cell_id: r for r in GEO.with_outlines(rings).collect()}
    assert {i: r.crossing for i, r in got.items()} == {i: r.crossing for i, r in want.items()}
    assert sum(r.crossing is None for r in got.values()) == 2 and sum(bool(r.crossing) for r in got.values()) > 30
    assert got[20].box is not None and got[20].box.x0 is None
    for i, r in got.items():
        if r.box is None:
            assert None in sum(shapes[i], ()) and r.seg == []
        elif r.crossing:
            alone = GEO.even_odd_segments(np.array(shapes[i]))
            assert [tuple(s) for s in r.seg] == [tuple(s) for s in alone.tolist()]
        else:
            assert repr(r.seg) == repr(want[i].seg)
    written, plain = [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    whole = rings.filter(F.col("cell_id") < len(shapes) - 4)
    (query, _), (reference, _) = X.repaired(whole), X.repaired(whole)
    area = {(r.query_id, r.ref_id): r.area for r in X.overlap_pairs(query, reference).collect()}
    assert all(area[a, b] == pytest.approx(area[b, a]) for a, b in area)
    assert sum("seg" in c for c in written) == 2 and not any("q_x0" in c and "_base" not in c for c in written)
