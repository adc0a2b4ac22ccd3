import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cytomosaic.operators import cells as C
from cytomosaic.operators import filters as P
from cytomosaic.operators import genes as G
from cytomosaic.operators import merge as MG
from cytomosaic.operators.indexing import dense_index
from cytomosaic.plans import convert
from cytomosaic.plans import merge as merging
from cytomosaic.plans.segmentation import load_segmentation
from cytomosaic.sources import readers as R
from cytomosaic.sources import writers as K


def test_dense_index_ignores_partitioning(spark):
    ids = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "cell_id string")
    for parts in (1, 7):
        got = {r.cell_id: r["index"] for r in dense_index(df.repartition(parts), "cell_id", n_ranges=6).collect()}
        assert got == {c: i for i, c in enumerate(sorted(ids))}


def test_dense_index_empty(spark):
    assert dense_index(spark.createDataFrame([], "cell_id string"), "cell_id").count() == 0


def test_bounding_box_without_coordinates(spark):
    df = spark.createDataFrame([("a", None, None)], "cell_id string, x double, y double")
    assert tuple(C.bounding_box(df).first()) == (0.0, 0.0, 0.0, 0.0)


def test_labels_match_by_text_unless_numbers_match_more(spark):
    cells = spark.createDataFrame([("1",), ("2",), ("3",)], "cell_id string")
    text = spark.createDataFrame([("1", "x"), ("02", "y")], "cell_id string, label string")
    got = {r.cell_id: r.l for r in C.align_labels(cells, text, "l").collect()}
    assert got == {"1": "x", "2": "y", "3": "Unknown"}
    mixed = spark.createDataFrame([("1", "x"), ("02", "y"), ("c9", "z")], "cell_id string, label string")
    got = {r.cell_id: r.l for r in C.align_labels(cells, mixed, "l").collect()}
    assert got == {"1": "x", "2": "Unknown", "3": "Unknown"}


def test_label_source_choice(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    files = [{"name": "l_t1_h1.parquet", "mtime": 3}, {"name": "l_t2_h1.parquet", "mtime": 2}, {"name": "l_t1_h2.parquet", "mtime": 9}]
    rows = [("l_t1_h1.parquet", "a"), ("l_t2_h1.parquet", "a"), ("l_t2_h1.parquet", "b"), ("l_t1_h2.parquet", "q")]
    labels = spark.createDataFrame(rows, "source string, cell_id string")
    assert C.pick_label_source(cells, files, labels) == "l_t2_h1.parquet"
    assert C.pick_label_source(cells, files, labels, "h1") == "l_t1_h1.parquet"
    assert C.pick_label_source(cells, files, labels, "h1", "t2") == "l_t2_h1.parquet"
    assert C.pick_label_source(cells, files, labels, "h3") is None


def test_majority_tie(spark):
    df = spark.createDataFrame([("k", "b"), ("k", "a")], "q string, label string")
    assert C.majority_label(df, "q").first().label == "a"


def test_fov_column(spark):
    rows = [(f"c{i}", i % 2, f"b{i % 3}", "only", f"h{i % 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "cell_id string, n int, batch string, one string, _hidden string")
    assert C.detect_fov_column(df) == "batch"
    assert C.detect_fov_column(df.drop("batch")) == "cell_id"  # twelve values: text comes before numbers
    assert C.detect_fov_column(df.select("n", "one", "_hidden")) == "n"
    assert C.detect_fov_column(df.select("one", "_hidden")) is None
    with pytest.raises(KeyError):
        convert.assign_fov(df, "nope")


def test_images_need_more_than_one(spark):
    meta = spark.createDataFrame([("a", "s0"), ("b", "s1")], "cell_id string, sample string")
    single = spark.createDataFrame([("a", "im", 0)], "cell_id string, image string, ord int")
    assert {r.fov for r in convert.assign_fov(meta, None, single).collect()} == {"s0", "s1"}
    two = spark.createDataFrame([("a", "i1", 0), ("a", "i2", 1), ("b", "i1", 0), ("z", "i2", 1)], "cell_id string, image string, ord int")
    assert {(r.cell_id, r.fov) for r in convert.assign_fov(meta, None, two).collect()} == {("a", "i2"), ("b", "i1")}


def test_coordinates_fall_back(spark):
    meta = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "cell_id string, centroid_x double, centroid_y double")
    all_of = spark.createDataFrame([("a", 9.0, 8.0), ("b", 7.0, 6.0)], "cell_id string, imagerow double, imagecol double")
    assert {tuple(r) for r in C.resolve_coordinates(meta, all_of).select("cell_id", "_x", "_y").collect()} == {("a", 9.0, 8.0), ("b", 7.0, 6.0)}
    some = all_of.filter("cell_id = 'a'")
    assert {r._x for r in C.resolve_coordinates(meta, some).collect()} == {1.0, 3.0}
    assert {r._x for r in C.resolve_coordinates(meta.select("cell_id"), some).collect()} == {9.0, None}
    with pytest.raises(ValueError):
        C.resolve_coordinates(meta.select("cell_id"))


def test_umap_choice(spark):
    both = spark.createDataFrame([("a", 1.0, 1.0, 2.0, 2.0)], "cell_id string, umap_1 double, umap_2 double, split_umap_1 double, split_umap_2 double")
    assert C.resolve_umap(both, True) == ("split_umap_1", "split_umap_2")
    assert C.resolve_umap(both, False) == ("umap_1", "umap_2")
    assert C.resolve_umap(both.select("cell_id", "umap_1", "umap_2"), True) == ("umap_1", "umap_2")
    assert C.resolve_umap(both.select("cell_id"), True) is None


def test_coercion(spark):
    df = spark.createDataFrame([(1, "2.5", "x", True), (2, None, None, False)], "i int, number string, text string, flag boolean")
    out = C.coerce_columns(df)
    assert dict(out.dtypes)["i"] == "double" and dict(out.dtypes)["number"] == "double" and dict(out.dtypes)["text"] == "string"
    assert [r.text for r in out.collect()] == ["x", ""]


def test_subset_combines_conditions(spark):
    cells = spark.createDataFrame([("a", "T", 5, 10.0), ("b", "T", 50, 10.0), ("c", "U", 50, 90.0)], "cell_id string, cell_type string, transcript_counts long, cell_area double")
    labels = spark.createDataFrame([("a", "m1", "1"), ("b", "m1", "2"), ("c", "m1", "2"), ("a", "m2", "2")], "cell_id string, method string, label string")
    e = spark.createDataFrame([("b", "g", 3.0), ("c", "g", 1.0)], "cell_id string, gene string, value double")
    ids = lambda df: sorted(r.cell_id for r in df.collect())
    assert ids(P.subset_cells(cells, labels, cluster=2)) == ["b", "c"]
    assert ids(P.subset_cells(cells, labels, cluster=[2], method="m2")) == ["a"]
    assert ids(P.subset_cells(cells, None, e, gene="g", min_expr=1.0)) == ["b"]
    assert ids(P.subset_cells(cells, None, e, gene="g", max_expr=1.0)) == ["a", "c"]
    assert ids(P.subset_cells(cells, min_transcripts=10, max_cell_area=50)) == ["b"]
    assert ids(P.subset_cells(cells, cell_type=["T", "U"])) == ["a", "b", "c"]


def test_roi_equality_reports_what_there_is(spark):
    cells = spark.createDataFrame([("a", "A"), ("b", None)], "cell_id string, roi_t string")
    assert P.roi_equals(cells, "t", "A").count() == 1
    with pytest.raises(ValueError, match="A"):
        P.roi_equals(cells, "t", "B")
    with pytest.raises(KeyError):
        P.roi_equals(cells, "other", "A")


def test_layers_without_corrected_fall_back(spark):
    e = spark.createDataFrame([("c", "g", 1.0, "raw"), ("c", "n", 2.0, "imputed")], "cell_id string, gene string, value double, layer string")
    panel = spark.createDataFrame([("g",)], "gene string")
    imputed, none = spark.createDataFrame([("n",)], "gene string"), spark.createDataFrame([], "gene string")
    out = {(r.matrix, r.gene) for r in G.assemble_layers(e, panel, imputed, none, True, True).collect()}
    assert out == {("X", "g"), ("X", "n"), ("X_raw", "g")}
    out = {(r.matrix, r.gene) for r in G.assemble_layers(e, panel, none, none, True, True).collect()}
    assert out == {("X", "g")}
    assert G.active_layer(e, "corrected").first().layer == "raw"


def test_round_half_even(spark):
    e = spark.createDataFrame([("c", str(v), v) for v in (0.4, 0.5, 1.5, 2.5, 0.9)], "cell_id string, gene string, value double")
    assert {r.gene: r.value for r in G.integer_counts(e).collect()} == {"1.5": 2.0, "2.5": 2.0, "0.9": 1.0}


def test_shared_genes_error(spark):
    a, b = spark.createDataFrame([("g",)], "gene string"), spark.createDataFrame([("h",)], "gene string")
    with pytest.raises(ValueError):
        G.shared_genes(a, b)


def test_merge_rejects_unknown_layout(spark):
    boxes = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0)], "dataset string, dataset_ord int, x_min double, y_min double, x_max double, y_max double")
    with pytest.raises(ValueError):
        MG.layout_offsets(boxes, "pile")


def test_merge_keeps_every_row_and_layer(spark):
    def dataset(names, shift):
        cells = spark.createDataFrame([(n, shift + i, 0.0) for i, n in enumerate(names)], "cell_id string, x double, y double")
        e = cells.select("cell_id", F.lit("g").alias("gene"), F.lit(1.0).alias("value"), F.lit("corrected").alias("layer"))
        genes = spark.createDataFrame([("g", 0, None), (f"only{shift}", 1, True)], "gene string, ord int, is_imputed boolean")
        return merging.Dataset(cells, e, genes)

    merged = merging.merge([dataset(["a", "b"], 5.0), dataset(["a"], 100.0)], ["p", "q"])
    assert {(r.cell_id, r.x) for r in merged.cells.collect()} == {("p_a", 0.0), ("p_b", 1.0), ("q_a", 201.0)}
    assert [(r.gene, r.ord, r.is_imputed) for r in merged.genes.orderBy("ord").collect()] == [("g", 0, False), ("only5.0", 1, True), ("only100.0", 2, True)]
    assert {(r.cell_id, r.layer) for r in merged.expression.collect()} == {("p_a", "corrected"), ("p_b", "corrected"), ("q_a", "corrected")}
    both = merging.merge([dataset(["a"], 5.0), dataset(["a"], 100.0)], genes="intersect")
    assert [r.gene for r in both.genes.collect()] == ["g"]
    with pytest.raises(ValueError):
        merging.merge([dataset(["a"], 1.0)], ["p", "q"])


# --- files -----------------------------------------------------------------------------------------------------------


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_sample_specs():
    assert R.parse_samples(["a:x", " b : y "]) == [("a", "x"), ("b", "y")]
    for bad in ("a", "a:b:c"):
        with pytest.raises(ValueError):
            R.parse_samples([bad])


def test_communication_files(spark, tmp_path, rows):
    write(tmp_path / "output/s1/tool_s1_top20percent.csv", "from_cell,to_cell,ligand,receptor,attention_score,extra\na,b,L,R,0.5,1\n")
    write(tmp_path / "metadata/s1/cell_barcode_s1.csv", "a\nb\nb\n")
    write(tmp_path / "notes/s1_annotation.csv", ",first,cell_type\na,1,T\na,1,U\n")
    write(tmp_path / "notes/s2_annotation.csv", ",first\nz,9\n")
    assert rows(R.read_ccc_edges(spark, str(tmp_path), ["s1"])) == [("s1", "a", "b", "L", "R", 0.5)]
    assert rows(R.sample_table(R.read_barcodes(spark, str(tmp_path), ["s1"]), [("s1", "k")])) == [("s1", "k", 3)]
    assert rows(R.read_annotations(spark, str(tmp_path / "notes"), ["s1", "s2", "s3"])) == [("s1", "a", "U"), ("s2", "z", "9")]
    with pytest.raises(FileNotFoundError):
        R.read_ccc_edges(spark, str(tmp_path), ["s1"], use_all=True)
    with pytest.raises(FileNotFoundError):
        R.read_barcodes(spark, str(tmp_path), ["s9"])


def test_label_files(spark, tmp_path, rows):
    path = write(tmp_path / "l.csv", "barcode,alpha,beta\na,1,2\n")
    assert rows(R.read_labels(spark, path)) == [("a", "1")]
    assert rows(R.read_labels(spark, path, "beta")) == [("a", "2")]
    with pytest.raises(KeyError, match="alpha"):
        R.read_labels(spark, path, "gamma", strict=True)


def test_matrix_market_in_one_file(spark, tmp_path, rows):
    m = write(tmp_path / "m.mtx", "%%MatrixMarket matrix coordinate real general\n% note\n2 3 3\n1 1 5\n2 3 1.5\n2 3 1\n")
    g, c = write(tmp_path / "g.txt", "g1\tname\ng2\n"), write(tmp_path / "c.txt", "a\nb\nc\n")
    assert rows(R.read_matrix_market(spark, m, g, c)) == [("a", "g1", 5.0), ("c", "g2", 2.5)]


def test_geojson(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    features = [
        {"type": "Feature", "id": "f", "properties": {"cell": 7}, "geometry": {"type": "Polygon", "coordinates": [square, [[1, 1], [1, 1.5], [1.5, 1]]]}},
        {"type": "Feature", "id": "f2", "properties": {"cell_id": "p"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "id": "f3", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[square[:3]], [square]]}},
        {"type": "Feature", "id": "f4", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [square[:2]]}},
    ]
    path = write(tmp_path / "d" / "polygons.json", json.dumps({"type": "FeatureCollection", "features": features}))
    write(tmp_path / "d" / "cell_polygons.json", "{}")
    got = {r.cell_id: len(r.ring) for r in R.read_geojson_polygons(spark, path).collect()}
    assert got == {"7": 5, "p": 5, "f3": 3}
    assert [p.rsplit("/", 1)[1] for p in R.polygon_files(spark, str(tmp_path / "d"))] == ["polygons.json"]


def layers(spark, path, rows):
    return {tuple(r) for r in spark.read.parquet(path).select("cell_id", "value", "layer").collect()} == rows


def test_a_failed_overwrite_leaves_the_old_layer(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda *rows: spark.createDataFrame(rows, "cell_id string, value double, layer string")
    old = {("a", 1.0, "raw"), ("b", 2.0, "raw"), ("a", 3.0, "corrected")}
    K.write_layer(make(*old), path)
    broken = make(("a", 9.0, "raw")).withColumn("value", F.when(F.col("cell_id") == "a", F.raise_error(F.lit("lost"))).otherwise(F.lit(0.0)).cast("double"))
    with pytest.raises(Exception, match="lost"):
        K.write_layer(broken, path)
    assert layers(spark, path, old)
    K.write_layer(spark.read.parquet(path).filter("layer = 'raw'").withColumn("value", F.col("value") * 10), path)  # a table written from itself
    assert layers(spark, path, {("a", 10.0, "raw"), ("b", 20.0, "raw"), ("a", 3.0, "corrected")})
    assert not [p.name for p in (tmp_path / "store").iterdir() if p.name.startswith(("_staged", "_old", "_planned"))]


def test_a_switch_that_broke_off_is_completed(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    make = lambda *rows: spark.createDataFrame(rows, "cell_id string, value double, layer string")
    K.write_layer(make(("a", 1.0, "one"), ("a", 1.0, "two"), ("a", 1.0, "three")), path)
    new = make(("a", 2.0, "one"), ("a", 2.0, "two"))
    for step in range(1, 5):  # the driver is lost after so many renames
        K.write_layer(make(("a", 1.0, "one"), ("a", 1.0, "two")), path)
        plain, done = K._Folder.rename, []

        def lost(self, source, target):
            if len(done) >= step:
                raise KeyboardInterrupt
            done.append(source)
            plain(self, source, target)

        with monkeypatch.context() as patch:
            patch.setattr(K._Folder, "rename", lost)
            if step < 4:
                with pytest.raises(KeyboardInterrupt):
                    K.write_layer(new, path)
            else:
                K.write_layer(new, path)
        K.recover(spark, path)
        assert layers(spark, path, {("a", 2.0, "one"), ("a", 2.0, "two"), ("a", 1.0, "three")})


def test_one_large_collection_in_many_tasks(spark, tmp_path):
    """One collection on one line is read by several tasks; layouts differ in blanks and in what follows the features."""
    features = [
        {"type": "Feature", "properties": {"cell": f"c{i}", "list": [{"a": "}],"}], "geometry": None}, "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i + 1, 0], [i, 1]]]}}
        for i in range(4_000)
    ]
    whole = {"type": "FeatureCollection", "features": features, "crs": {"type": "name", "properties": {"name": "x"}}}
    path = write(tmp_path / "a.json", json.dumps(whole))
    spread = write(tmp_path / "b.json", json.dumps(whole, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for p in (path, spread):
            got = R.read_geojson_polygons(spark, p)
            assert got.select(F.spark_partition_id()).distinct().count() > 4
            assert {(r.cell_id, r.ring[0].x) for r in got.collect()} == {(f"c{i}", float(i)) for i in range(4_000)} and got.count() == 4_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert R.read_geojson_polygons(spark, path, whole=True).count() == 4_000
    assert R.read_geojson_polygons(spark, write(tmp_path / "c.json", json.dumps({"type": "FeatureCollection", "features": []}))).count() == 0


@pytest.mark.parametrize("kind", ["type last", "nested", "cut off"])
def test_collections_in_other_layouts_are_refused(spark, tmp_path, kind):
    geometry = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1]]]}
    feature = {"type": "Feature", "properties": {"type": "Feature", "cell": "a"}, "geometry": geometry} if kind == "nested" else {"properties": {"cell": "a"}, "geometry": geometry, "type": "Feature"}
    if kind == "cut off":
        feature = {"type": "Feature", "properties": {"cell": "a"}, "geometry": geometry}
    text = json.dumps({"type": "FeatureCollection", "features": [feature, feature]})
    path = write(tmp_path / "a.json", text[: -30] if kind == "cut off" else text)
    with pytest.raises(Exception, match="does not start with its type"):
        R.read_geojson_polygons(spark, path).collect()
    if kind != "cut off":
        assert R.read_geojson_polygons(spark, path, whole=True).count() == 2


def test_segmentation_folder(spark, tmp_path, rows):
    write(tmp_path / "t1/segmentation.csv", "cell,gene,x,y\n1,g,0,0\n1,h,2,2\n,g,9,9\n")
    write(tmp_path / "t1/other.csv", "cell,gene,x,y\n5,g,0,0\n")
    write(tmp_path / "t1/polygons.json", json.dumps({"features": [{"id": "1", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}))
    genes = spark.createDataFrame([("g", 0)], "gene string, ord int")
    out = load_segmentation(spark, str(tmp_path), genes)
    assert rows(out["cells"]) == [("1", 1.0, 1.0, 2)]
    assert rows(out["expression"]) == [("1", "g", 1.0, "raw")]
    assert [r.cell_id for r in out["rings"].collect()] == ["1"]


def test_rois(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps([{"cls": "t", "name": 1, "polygon_xy": [[0, 0], [1, 0], [1, 1]]}, {"cls": "t", "name": "B", "polygon_xy": [[0, 0], [1, 0], [1, 1]]}]))
    assert R.read_rois(spark, path).count() == 2
    assert R.read_rois(spark, path, "t", "1").count() == 1
    with pytest.raises(ValueError, match="'t', 'B'"):
        R.read_rois(spark, path, "t", "C")


def test_run_parameters(spark, tmp_path, rows):
    write(tmp_path / "run1/params.json", '{"tool": "x", "n_cells": 5}')
    write(tmp_path / "run2/params.json", '{"tool": "y", "x_min": null, "param_tag": "p"}')
    got = R.read_run_params(spark, str(tmp_path)).select("run", "tool", "param_tag", "n_cells", "x_min")
    assert rows(got) == [("run1", "x", None, 5, None), ("run2", "y", "p", None, None)]


def test_gene_list(spark, tmp_path):
    path = write(tmp_path / "g.txt", " b \n\na\nb\nc\n")
    assert [r.gene for r in R.read_gene_list(spark, path, ["c"]).orderBy("ord").collect()] == ["c", "b", "a"]


def test_output_is_not_replaced_unasked(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "cell_id string")
    path = str(tmp_path / "out")
    K.write_table(df, path)
    with pytest.raises(AnalysisException):
        K.write_table(df, path)
    K.write_table(df, path, overwrite=True)


def test_annotation_without_the_column_is_skipped(spark, tmp_path):
    df = spark.createDataFrame([("a", 3.0)], "cell_id string, cluster double")
    assert K.write_annotation(df, "nope", str(tmp_path / "x")) is None
    path = K.write_annotation(df, "cluster", str(tmp_path / "y"))
    assert spark.read.csv(path, header=True).first().cell_type == "3"


def test_geometry_export(spark):
    cells = spark.createDataFrame([("a", None, 2.0)], "cell_id string, x double, y double")
    outlines = spark.createDataFrame([("a", 0), ("b", 0)], "cell_id string, vertex_ord int")
    at, kept = K.export_geometry(cells, outlines)
    assert tuple(at.first()) == ("a", 0.0, 2.0) and [r.cell_id for r in kept.collect()] == ["a"]
