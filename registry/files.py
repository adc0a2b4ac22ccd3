"""Readers, writers and conversion jobs: tables are written to the shared folder in the format in question and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomosaic.operators import cells as cells_ops
from cytomosaic.operators import genes as G
from cytomosaic.operators import metrics as M
from cytomosaic.operators import spatial as X
from cytomosaic.plans import compare as comparison
from cytomosaic.plans import convert
from cytomosaic.plans import merge as merging
from cytomosaic.plans import segmentation
from cytomosaic.session import cut_lineage, shared_folder
from cytomosaic.sources import readers as R
from cytomosaic.sources import writers as K
from registry.base import Tables, query, rounded
from registry.lr import CTRL, METRICS, SIX, TREAT, TYPED, wide_sql
from registry.space import OVERLAP, TRANSFER, overlap_of_loops
from registry.tissue import LAYERS, layered


def folder(t: Tables, label: str) -> str:
    return shared_folder(t.spark, label)


# --- tissue tables ---------------------------------------------------------------------------------------------------


@query("SELECT cell_id, x, y, cell_area, CAST(NULL AS DOUBLE) AS nucleus_area FROM cells", ("cells",))
def read_cells(t: Tables):
    path = K.write_table(t.cells.select("cell_id", F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), "cell_area"), folder(t, "cells"))
    return R.read_cells(t.spark, path).select("cell_id", "x", "y", "cell_area", "nucleus_area")


#: Vertices in one written file of outlines, about.
FILE_ROWS = 500_000
#: Features in one written collection, about.
FILE_FEATURES = 200_000


@query("SELECT cell_id, CASE kind WHEN 'ref' THEN 'nucleus' ELSE 'cell' END AS kind, CAST(vertex_ord AS INT) AS vertex_ord, x, y FROM boundaries", ("boundaries",))
def read_boundaries(t: Tables):
    """Vertices of both kinds in file order, without an order column; their order inside each cell must survive."""
    parts = []
    for kind, name in (("ref", "nucleus"), ("query", "cell")):
        rows = t.boundaries.filter(F.col("kind") == kind)
        n_files = max(4, -(-rows.count() // FILE_ROWS))  # a task sorts the rows of one file
        rows = rows.repartitionByRange(n_files, "cell_id").sortWithinPartitions("cell_id", "vertex_ord")
        path = K.write_table(rows.select("cell_id", F.col("x").alias("vertex_x"), F.col("y").alias("vertex_y")), folder(t, f"boundaries_{name}"))
        back = X.rings(R.read_boundaries(t.spark, path, name))
        parts.append(X.vertices(back).select("cell_id", F.lit(name).alias("kind"), "vertex_ord", "x", "y"))
    return parts[0].union(parts[1])


@query("SELECT cell_id, gene, x, y, qv FROM transcripts WHERE qv >= 20 AND x BETWEEN 100 AND 500", ("transcripts",))
def read_transcripts(t: Tables):
    renamed = t.transcripts.withColumnRenamed("gene", "feature_name").withColumnRenamed("x", "x_location").withColumnRenamed("y", "y_location")
    path = K.write_table(renamed, folder(t, "molecules"))
    return R.read_transcripts(t.spark, path).filter("qv >= 20 AND x BETWEEN 100 AND 500").select("cell_id", "gene", "x", "y", "qv")


@query(LAYERS + " SELECT cell_id, gene, value, layer FROM layered WHERE layer IN ('corrected', 'imputed')", ("expr",))
def read_expression_layers(t: Tables):
    # counts are made once, and not in the tasks that sort rows by layer: these then hold what one task reads from files
    path = K.write_table(layered(t, cut_lineage(t.expr)), folder(t, "expression"), partition_by=["layer"])
    return R.read_expression(t.spark, path, ["corrected", "imputed"])


@query(LAYERS + """ SELECT cell_id, gene, value, layer FROM layered WHERE layer <> 'corrected'
       UNION ALL SELECT cell_id, gene, value, 'corrected' FROM expr WHERE gene < 'G2'""", ("expr",))
def replace_layer(t: Tables):
    """A second write of one layer leaves the other layers alone."""
    expr = cut_lineage(t.expr)  # as above
    path = K.write_layer(layered(t, expr), folder(t, "store"))
    K.write_layer(expr.filter("gene < 'G2'").withColumn("layer", F.lit("corrected")), path)
    return R.read_expression(t.spark, path)


@query("SELECT cell_id, gene, value FROM expr", ("expr",))
def matrix_triplets(t: Tables):
    """Numbered entries and name lists out, names back in through the text form of the matrix."""
    expr = cut_lineage(t.expr)  # entries and both lists come from it
    out = K.write_matrix_market(expr, expr.select("cell_id"), expr.select("gene"), folder(t, "matrix"))
    return R.read_matrix_market(t.spark, out["matrix"], out["genes"], out["cells"])


@query("SELECT cell_id, sample AS method, cluster AS label FROM cells", ("cells",))
def read_clusters(t: Tables):
    """One ``clusters.csv`` per method; Spark writes it as a folder of that name, which reads the same."""
    base = folder(t, "clustering")
    for s in SIX:
        rows = t.cells.filter(F.col("sample") == s).select(F.col("cell_id").alias("Barcode"), F.col("cluster").alias("Cluster"))
        K.write_csv(rows, f"{base}/{s}/{R.CLUSTER_FILE}")
    return R.read_clusters(t.spark, base)


@query("SELECT cell_id, x AS umap_1, y AS umap_2 FROM cells", ("cells",))
def read_projection(t: Tables):
    return R.read_projection(t.spark, K.write_csv(t.cells.select(F.col("cell_id").alias("Barcode"), "x", "y"), folder(t, "umap")))


# --- labels and lists ------------------------------------------------------------------------------------------------


@query("SELECT cell_id, cell_type AS label FROM cells WHERE cell_type IS NOT NULL", ("cells",))
def read_labels(t: Tables):
    path = K.write_csv(t.cells.dropna(subset=["cell_type"]).select("cell_id", "cluster", F.col("cell_type").alias("label")), folder(t, "labels"))
    return R.read_labels(t.spark, path)


@query("SELECT 'd1' AS dataset, 'typed' AS method, cell_id, cluster AS label FROM cells UNION ALL SELECT 'd1', 'kmeans', cell_id, cluster FROM cells",
       ("cells",))
def label_cache(t: Tables):
    """A label cache whose second write replaces one method only."""
    def rows(method: str, column: str):
        return t.cells.select(F.lit("d1").alias("dataset"), F.lit(method).alias("method"), "cell_id", F.col(column).alias("label"))

    path = K.write_labels(rows("typed", "cell_type").union(rows("kmeans", "cluster")), folder(t, "labels"))
    K.write_labels(rows("typed", "cluster"), path)
    return t.spark.read.parquet(path).select("dataset", "method", "cell_id", "label")


@query("SELECT cell_id AS cell, CAST(CAST(cluster AS INT) AS STRING) AS cell_type FROM cells", ("cells",))
def write_annotation(t: Tables):
    """Numeric labels are written without their fraction."""
    path = K.write_annotation(t.cells.withColumn("group", F.col("cluster").cast("double")), "group", folder(t, "annotation"))
    return t.spark.read.csv(path, header=True)


@query("SELECT gene, CAST(row_number() OVER (ORDER BY gene) + 1 AS BIGINT) AS ord FROM genes WHERE gene <> 'G5' AND gene <> 'G1' UNION ALL "
       "SELECT 'G5', 0 UNION ALL SELECT 'G1', 1", ("genes",))
def read_gene_list(t: Tables):
    """Two given names, then a file of names in order; blanks and repeats drop out, so places are renumbered here."""
    path = folder(t, "genes")
    lines = t.genes.orderBy("gene").select(F.concat(F.lit(" "), "gene", F.lit(" ")).alias("value"))
    lines.write.text(path)
    return merging.gene_order(
        R.read_gene_list(t.spark, path, ["G5", "G1"]).select("gene", F.struct("ord").alias("first_seen"), F.lit(False).alias("is_imputed"))
    ).select("gene", F.col("ord").cast("long").alias("ord"))


@query("SELECT source, target FROM ppi", ("ppi",))
def read_links(t: Tables):
    path = K.write_csv(t.ppi.select(F.col("source").alias("from"), F.col("target").alias("to")).union(t.ppi), folder(t, "ppi"))
    return R.read_links(t.spark, path, "from", "to")


# --- regions and outlines --------------------------------------------------------------------------------------------


@query("SELECT cell_id, CASE WHEN x > 600 THEN 'B' ELSE 'A' END AS roi_tissue FROM cells", ("cells",))
def read_roi_assignment(t: Tables):
    path = K.write_table(t.cells.select("cell_id", F.when(F.col("x") > 600, "B").otherwise("A").alias("roi_tissue")), folder(t, "roi"))
    return R.read_roi_assignment(t.spark, path, "tissue")


@query("SELECT kind, cell_id, CAST(vertex_ord AS INT) AS vertex_ord, x, y FROM boundaries", ("boundaries",))
def read_geojson(t: Tables):
    """Outlines of both kinds as feature collections, written by Spark and read back: of the one kind a single collection,
    or one for each so many features, of the other one per thousand cells. Ids sit in the properties, or in the feature itself."""
    ring = cut_lineage(X.rings(t.boundaries, ["kind", "cell_id"]))
    number = F.substring("cell_id", 2, 20).cast("long")
    even = number % 2 == 0
    feature = F.struct(
        F.lit("Feature").alias("type"), F.when(~even, F.col("cell_id")).alias("id"),
        F.struct(F.when(even, F.col("cell_id")).alias("cell")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda v: F.array(v.x, v.y))).alias("coordinates")).alias("geometry"),
    )
    tiles = ring.filter("kind = 'query'").groupBy(F.floor(number / 1000).alias("g")).agg(F.collect_list(feature).alias("features"))
    by_line, single = folder(t, "polygons"), folder(t, "collection")
    tiles.select(F.to_json(F.struct("features")).alias("value")).write.text(by_line, lineSep="\n")
    # a collection is head, features and tail; Spark writes them in this order, and a task sorts a bounded number of them
    listed = ring.filter("kind = 'ref'")
    n_files = max(1, -(-listed.count() // FILE_FEATURES))
    of = F.pmod(F.xxhash64("cell_id"), F.lit(n_files)).cast("int").alias("file")
    body = listed.select(of, F.lit(1).alias("at"), F.concat(F.to_json(feature), F.lit(",")).alias("value"))
    empty = '{"type":"Feature","geometry":null}'
    ends = t.spark.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, empty + "]}")], "at int, value string")
    ends = ends.select(F.explode(F.sequence(F.lit(0), F.lit(n_files - 1))).alias("file"), "at", "value")
    body.union(ends).repartitionByRange(n_files, "file").sortWithinPartitions("file", "at").select("value").write.text(single)
    parts = [("query", R.read_geojson_polygons(t.spark, by_line, lines=True)), ("ref", R.read_geojson_polygons(t.spark, single))]
    back = [X.vertices(rings.withColumn("kind", F.lit(kind)), ["kind", "cell_id"]) for kind, rings in parts]
    return back[0].union(back[1])


# --- communication ---------------------------------------------------------------------------------------------------


def written_edges(t: Tables) -> tuple[str, str]:
    """Edge, barcode and annotation files laid out the way the communication tool leaves them."""
    root, notes = folder(t, "ccc"), folder(t, "notes")
    for s in SIX:
        of = t.edges.filter(F.col("sample") == s).select("from_cell", "to_cell", "ligand", "receptor", "attention_score")
        of.write.option("header", True).csv(f"{root}/output/{s}/run_{s}_allCCC.csv")
        cells = t.cells.filter(F.col("sample") == s)
        cells.select("cell_id").write.csv(f"{root}/metadata/{s}/cell_barcode_{s}.csv")
        K.write_annotation(cells.dropna(subset=["cell_type"]), "cell_type", f"{notes}/{s}_annotation.csv")
    return root, notes


@query(METRICS + """ SELECT sample, condition, lr_pair, n_edges, normalized_freq, round(mean_attention, 6) AS mean_attention,
       sender_fraction FROM metrics""", ("edges", "samples"))
def metrics_from_files(t: Tables):
    root, _ = written_edges(t)
    listed = R.parse_samples([f"{s}:ctrl" for s in CTRL] + [f" {s} : treat " for s in TREAT])
    names = [s for s, _ in listed]
    samples = R.sample_table(R.read_barcodes(t.spark, root, names), listed)
    out = M.sample_metrics(R.read_ccc_edges(t.spark, root, names, use_all=True), samples).drop("presence")
    return rounded(out, "mean_attention")


@query("SELECT sample, from_cell, to_cell, ligand, receptor, round(attention_score, 6) AS attention_score FROM edges", ("edges",))
def edges_mixed_headers(t: Tables):
    """Edge files whose columns stand in another order for every other sample."""
    root = folder(t, "ccc")
    columns = ["from_cell", "to_cell", "ligand", "receptor", "attention_score"]
    for i, s in enumerate(SIX):
        order = columns if i % 2 else ["to_cell", "attention_score", "from_cell", "receptor", "ligand"]
        t.edges.filter(F.col("sample") == s).select(*order).write.option("header", True).csv(f"{root}/output/{s}/run_{s}_allCCC.csv")
    return rounded(R.read_ccc_edges(t.spark, root, SIX, use_all=True), "attention_score")


@query(TYPED + """ SELECT sample, condition, lr_pair, sender_type, receiver_type, n_edges, normalized_freq, round(mean_attention, 6) AS mean_attention
       FROM metrics""", ("edges", "samples", "cells"))
def celltype_metrics_from_files(t: Tables):
    root, notes = written_edges(t)
    types = R.read_annotations(t.spark, notes, SIX)
    typed = M.annotate_endpoints(R.read_ccc_edges(t.spark, root, SIX, use_all=True), types, ["sample"])
    return rounded(M.celltype_metrics(typed, t.samples).drop("sender_fraction", "presence"), "mean_attention")


@query(METRICS + " SELECT sample, lr_pair, n_edges FROM metrics", ("edges", "samples"))
def comparison_job(t: Tables):
    """The whole comparison with its result tables written; the metrics table read back."""
    done = comparison.compare(t.edges, t.samples, t.cells.select("cell_id", "cell_type"))
    base = folder(t, "results")
    K.write_comparison(done, base)
    K.write_stacked(done.pairs, f"{base}/stacked")
    back = t.spark.read.schema(done.sample_metrics.schema).csv(f"{base}/sample_metrics.csv", header=True)
    return back.select("sample", "lr_pair", "n_edges")


# --- jobs ------------------------------------------------------------------------------------------------------------


@query("""--more
seg AS (SELECT cell_id, gene, x, y FROM transcripts WHERE cell_id IS NOT NULL)
SELECT cell_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS transcript_counts,
       count(*) FILTER (WHERE gene IN (SELECT gene FROM genes WHERE ord < 40)) AS n_known FROM seg GROUP BY cell_id""", ("transcripts", "genes"))
def segmentation_job(t: Tables):
    """Molecule files in nested folders to cells and counts of known genes."""
    base = folder(t, "segmentation")
    out = t.transcripts.select(F.col("cell_id").alias("cell"), "gene", F.col("x").alias("x_location"), F.col("y").alias("y_location"))
    for part in range(2):
        out.filter(F.pmod(F.xxhash64("gene"), F.lit(2)) == part).write.option("header", True).csv(f"{base}/tile{part}/segmentation")
    tables = segmentation.load_segmentation(t.spark, base, t.genes.filter("ord < 40"), name="*.csv")
    known = tables["expression"].groupBy("cell_id").agg(F.sum("value").cast("long").alias("n_known"))
    out = tables["cells"].join(known, "cell_id", "left").withColumn("n_known", F.coalesce("n_known", F.lit(0)))
    return rounded(out, "x", "y")


@query("SELECT cell_id, CASE WHEN CAST(substr(gene, 2) AS INT) % 3 <> 2 THEN gene END AS gene, round(x, 6) AS x, round(y, 6) AS y FROM transcripts "
       "WHERE cell_id IS NOT NULL", ("transcripts",))
def segmentation_mixed(t: Tables):
    """Molecule files of three layouts: two names of the coordinates, and one file without genes."""
    base = folder(t, "segmentation")
    layouts = [["cell", "gene", "x", "y"], ["y_location", "x_location", "gene", "cell"], ["x", "y", "cell"]]
    rows = t.transcripts.select(F.col("cell_id").alias("cell"), "gene", "x", "y", F.col("x").alias("x_location"), F.col("y").alias("y_location"))
    for i, layout in enumerate(layouts):
        part = rows.filter(F.substring("gene", 2, 9).cast("int") % 3 == i).select(*layout)
        part.write.option("header", True).csv(f"{base}/tile{i}/deep/segmentation")
    return rounded(R.read_segmentation(t.spark, base, name="*.csv"), "x", "y")


@query("""--more
boxes AS (SELECT sample, CAST(substr(sample, 2) AS INT) AS o, min(x) AS x0, max(x) AS x1, min(y) AS y0 FROM cells GROUP BY sample),
offsets AS (SELECT sample, coalesce(sum(x1 - x0 + 200) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - x0 AS dx, 0 - y0 AS dy FROM boxes),
placed AS (SELECT o.sample AS dataset, o.sample || '_' || cell_id AS cell_id, x + dx AS x, y + dy AS y FROM cells c JOIN offsets o ON o.sample = c.sample),
total AS (SELECT c.sample || '_' || e.cell_id AS cell_id, sum(value) AS total FROM expr e JOIN cells c ON c.cell_id = e.cell_id GROUP BY ALL),
outline AS (SELECT o.sample || '_' || b.cell_id AS cell_id, min(b.x + dx) AS left_edge FROM boundaries b JOIN cells c ON c.cell_id = b.cell_id
            JOIN offsets o ON o.sample = c.sample GROUP BY ALL)
SELECT p.*, CAST(row_number() OVER (ORDER BY p.cell_id) - 1 AS BIGINT) AS instance_id, coalesce(total, 0) AS total, left_edge
FROM placed p LEFT JOIN total t ON t.cell_id = p.cell_id JOIN outline l ON l.cell_id = p.cell_id""", ("cells", "expr", "boundaries"))
def merge_job(t: Tables):
    """All six samples with both kinds of outlines."""
    # each table meets the cells once and is written with their samples; a sample's part is then read from there
    of = t.cells.select("cell_id", "sample").distinct()
    expr, outlines = (cut_lineage(df.join(of, "cell_id")) for df in (t.expr, t.boundaries))
    genes = cut_lineage(t.genes)
    parts = []
    for s in SIX:
        cells = t.cells.filter(F.col("sample") == s).select("cell_id", "x", "y")
        own = F.col("sample") == s
        parts.append(merging.Dataset(
            cells, expr.filter(own).drop("sample").withColumn("layer", F.lit("raw")), genes, outlines.filter(own).drop("sample"),
        ))
    merged = merging.merge(parts, SIX)
    totals = merged.expression.groupBy("cell_id").agg(F.sum("value").alias("total"))
    left = merged.boundaries.groupBy("cell_id").agg(F.min("x").alias("left_edge"))
    return (
        merged.cells.join(totals, "cell_id", "left").join(left, "cell_id")
        .select("dataset", "cell_id", "x", "y", "instance_id", F.coalesce("total", F.lit(0.0)).alias("total"), "left_edge")
    )


@query(LAYERS + " SELECT 'X' AS matrix, cell_id, gene, value FROM layered WHERE layer IN ('corrected', 'corr_imputed') UNION ALL "
       "SELECT 'X_raw', cell_id, gene, value FROM layered WHERE layer = 'raw'", ("expr",))
def communication_export(t: Tables):
    written = convert.to_communication_input(
        t.cells, layered(t), t.genes, t.genes.filter("ord BETWEEN 56 AND 59"), t.genes.filter("ord >= 60"), folder(t, "export"),
        use_corrected=True, include_imputed=True, cell_type_col="cell_type",
    )
    return t.spark.read.parquet(written["expression"]).select("matrix", "cell_id", "gene", "value")


@query("""--more
inside AS (SELECT cell_id, cell_area, cell_type FROM cells WHERE x BETWEEN 710 AND 790 AND y BETWEEN 60 AND 200)
SELECT i.cell_id, cell_area, coalesce(sum(e.value), 0) AS "nCount_RNA", count(e.gene) AS "nFeature_RNA", coalesce(any_value(cell_type), 'Unknown') AS typed
FROM inside i LEFT JOIN (SELECT * FROM expr WHERE gene IN (SELECT gene FROM genes WHERE NOT is_imputed)) e ON e.cell_id = i.cell_id
GROUP BY i.cell_id, cell_area""", ("cells", "expr", "genes"))
def object_export(t: Tables):
    """Metadata of the cells in one region, with totals and a label column."""
    region = t.spark.createDataFrame(
        [("tissue", "box", [(709.5, -200.5), (790.5, -200.5), (790.5, -59.5), (709.5, -59.5)])],
        "cls string, name string, ring array<struct<x: double, y: double>>",
    )
    labels = t.cells.dropna(subset=["cell_type"]).select("cell_id", F.col("cell_type").alias("label"))
    tables = convert.to_object_tables(
        t.cells.select("cell_id", "x", "y", F.col("cell_area").alias("volume")), t.expr.withColumn("layer", F.lit(G.RAW)), t.genes, t.boundaries,
        region, ("tissue", "box"), {"typed": labels},
    )
    return tables["meta"].select("cell_id", "cell_area", "nCount_RNA", "nFeature_RNA", "typed")


@query("""--more
imputed AS (SELECT cell_id, gene, round_even(value * 0.75, 0) AS value FROM expr WHERE gene IN (SELECT gene FROM genes WHERE is_imputed))
SELECT cell_id, gene, value FROM expr WHERE gene IN (SELECT gene FROM genes WHERE NOT is_imputed)
UNION ALL SELECT * FROM imputed WHERE value >= 1""", ("expr", "genes"))
def merged_assays(t: Tables):
    """Imputed values join the counts as whole numbers."""
    number = F.substring("gene", 2, 9).cast("int") >= 56
    layers = t.expr.withColumn("layer", F.when(number, G.IMPUTED).otherwise(G.RAW)).withColumn(
        "value", F.when(number, F.col("value") * 0.75).otherwise(F.col("value"))
    )
    return convert.to_object_tables(t.cells, layers, t.genes, include_imputed=True, merge_assays=True)["counts"]


@query("SELECT cell_id, x AS _x, y AS _y, replace(replace('slide ' || sample || '/a', '/', '_'), ' ', '_') AS fov FROM cells", ("cells",))
def per_fov_export(t: Tables):
    """The field-of-view column is found by its name; one folder each."""
    meta = t.cells.select("cell_id", "x", "y", F.concat(F.lit("slide "), "sample", F.lit("/a")).alias("sample"), "cell_type")
    written = convert.per_fov_tables(meta, t.expr, folder(t, "fov"), "slide", cell_type_col="cell_type")
    return t.spark.read.parquet(written["coordinates"]).select("cell_id", "_x", "_y", "fov")


@query("SELECT c.cell_id, cluster AS kmeans, cell_type AS typed FROM cells c", ("cells",))
def save_analysis(t: Tables):
    labels = t.cells.select("cell_id", F.lit("kmeans").alias("method"), F.col("cluster").alias("label")).union(
        t.cells.select("cell_id", F.lit("typed"), "cell_type")
    )
    paths = convert.save_analysis(
        t.cells, t.expr.withColumn("layer", F.lit(G.RAW)), t.genes, t.boundaries, labels, ["kmeans", "typed"],
        t.cells.select("cell_id", "cell_type"), folder(t, "snapshot"),
    )
    return t.spark.read.parquet(paths[4]).select("cell_id", "kmeans", "typed")


def two_sides(t: Tables):
    """Query outlines, reference outlines, and the reference cells' labels."""
    return t.boundaries.filter("kind = 'query'"), t.boundaries.filter("kind = 'ref'"), t.cells.select("cell_id", F.col("cell_type").alias("label"))


@query(f"{OVERLAP}, named AS ({TRANSFER}) SELECT transferred_identity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM named GROUP BY 1",
       ("boundaries", "cells"))
def transfer_job(t: Tables):
    """The whole job between two segmentations: shares of the transferred identities."""
    identities, shares, _ = convert.transfer_identities(*two_sides(t))
    K.write_transferred(identities, folder(t, "identities"))
    return rounded(shares, "percent")


#: Two loops of each outline that ``transfer_crossing_outlines`` turns: the middle with two vertices each.
TURNED = """m AS (SELECT *, CAST(substr(cell_id, 2) AS BIGINT) % 3 = CASE kind WHEN 'query' THEN 0 ELSE 1 END AS turned FROM boundaries),
middle AS (SELECT kind, cell_id, avg(x) AS x, avg(y) AS y FROM m WHERE turned GROUP BY kind, cell_id),
shapes AS (SELECT kind, cell_id, 0 AS loop, vertex_ord, x, y FROM m WHERE NOT turned
           UNION ALL SELECT kind, cell_id, 1, 3 - vertex_ord, x, y FROM m WHERE turned AND vertex_ord IN (1, 2) UNION ALL SELECT kind, cell_id, 1, 0, x, y FROM middle
           UNION ALL SELECT kind, cell_id, 2, CASE vertex_ord WHEN 3 THEN 1 ELSE 2 END, x, y FROM m WHERE turned AND vertex_ord IN (0, 3)
           UNION ALL SELECT kind, cell_id, 2, 0, x, y FROM middle)"""


@query(lambda: overlap_of_loops(TURNED) + TRANSFER, ("boundaries", "cells"))
def transfer_crossing_outlines(t: Tables):
    """Every third outline of either side is made to cross itself, each side its own; overlaps are those of the loops."""
    third = F.substring("cell_id", 2, 20).cast("long") % 3 == F.when(F.col("kind") == "query", 0).otherwise(1)
    swapped = F.when(third & F.col("vertex_ord").isin(1, 2), 3 - F.col("vertex_ord")).otherwise(F.col("vertex_ord"))
    query_side, reference, labels = two_sides(t)
    return convert.transfer_identities(*[b.withColumn("vertex_ord", swapped) for b in (query_side, reference)], labels)[0]


@query(OVERLAP + TRANSFER, ("boundaries", "cells"))
def transferred_identities(t: Tables):
    """The identities transferred between two segmentations, written and read back."""
    path = K.write_transferred(convert.transfer_identities(*two_sides(t))[0], folder(t, "identities"))
    return t.spark.read.csv(path, header=True)


@query("""SELECT cls, name, CAST(i - 1 AS INT) AS vertex_ord, x, y FROM (
       SELECT 'tissue' AS cls, sample AS name, [x0, x1, x1, x0] AS xs, [y0, y0, y1, y1] AS ys FROM
       (SELECT sample, min(x) AS x0, max(x) AS x1, -max(y) AS y0, -min(y) AS y1 FROM cells GROUP BY sample)) r,
       (SELECT unnest(range(1, 5)) AS i) v, LATERAL (SELECT xs[i] AS x, ys[i] AS y) p""", ("cells",))
def read_rois(t: Tables):
    """A region around each sample's cells, written as JSON and read back."""
    box = t.cells.groupBy("sample").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), (-F.max("y")).alias("y0"), (-F.min("y")).alias("y1"))
    corners = F.array(F.array("x0", "y0"), F.array("x1", "y0"), F.array("x1", "y1"), F.array("x0", "y1"))
    path = folder(t, "rois")
    listed = F.collect_list(F.struct(F.lit("tissue").alias("cls"), F.col("sample").alias("name"), corners.alias("polygon_xy")))
    box.agg(F.to_json(listed).alias("value")).write.text(path)  # one array, as a drawing tool saves it
    rois = R.read_rois(t.spark, path)
    return rois.select("cls", "name", F.posexplode("ring").alias("vertex_ord", "v")).select("cls", "name", "vertex_ord", "v.x", "v.y")


@query("SELECT sample AS run, 'seg' AS tool, 'p' || sample AS param_tag, CAST(NULL AS VARCHAR) AS dataset_hash, count(*) AS n_cells, min(x) AS x_min, "
       "max(x) AS x_max, min(y) AS y_min, CAST(NULL AS DOUBLE) AS y_max FROM cells GROUP BY sample", ("cells",))
def read_run_params(t: Tables):
    """One parameter file for each sample's run; fields that it lacks are null."""
    runs = t.cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n_cells"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"))
    base = folder(t, "runs")
    said = F.to_json(F.struct(F.lit("seg").alias("tool"), F.concat(F.lit("p"), "sample").alias("param_tag"), "n_cells", "x_min", "x_max", "y_min"))
    for s in SIX:
        runs.filter(F.col("sample") == s).select(said.alias("value")).coalesce(1).write.text(f"{base}/{s}/{R.RUN_FILE}")
    return R.read_run_params(t.spark, base)


@query("SELECT true AS refused, count(*) AS n, count(*) FILTER (WHERE cell_area < 100) AS n_after FROM cells", ("cells",))
def overwrite_guard(t: Tables):
    """A second write is refused and leaves the first; with leave to overwrite it replaces it."""
    path = K.write_table(t.cells, folder(t, "guarded"))
    try:
        K.write_table(t.cells.limit(0), path)
        refused = False
    except Exception as error:
        refused = "ALREADY_EXISTS" in str(error).upper() or "already exists" in str(error)
    n = t.spark.read.parquet(path).count()
    K.write_table(t.cells.filter("cell_area < 100"), path, overwrite=True)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_after")).select(F.lit(refused).alias("refused"), F.lit(n).cast("long").alias("n"), "n_after")


@query(METRICS + wide_sql() + """ SELECT 'sample_metrics' AS name, count(*) AS n, round(sum(normalized_freq), 6) AS total FROM metrics
UNION ALL SELECT 'pairs', count(*), round(sum(mean_a), 6) FROM kept""", ("edges", "samples"))
def comparison_job_tables(t: Tables):
    """The written metrics and the written comparison, read back: rows and a sum of each."""
    done = comparison.compare(t.edges, t.samples, t.cells.select("cell_id", "cell_type"))
    base = folder(t, "results")
    K.write_comparison(done, base)
    pairs = t.spark.read.csv(f"{base}/ctrl_vs_treat_freq.csv", header=True, inferSchema=True)
    metrics = t.spark.read.schema(done.sample_metrics.schema).csv(f"{base}/sample_metrics.csv", header=True)
    parts = [metrics.agg(F.lit("sample_metrics").alias("name"), F.count(F.lit(1)).alias("n"), F.sum("normalized_freq").alias("total")),
             pairs.agg(F.lit("pairs").alias("name"), F.count(F.lit(1)).alias("n"), F.sum("mean_ctrl").alias("total"))]
    return rounded(parts[0].union(parts[1]), "total")


@query("""SELECT 'boundaries' AS name, count(*) AS n, round(sum(x + 2 * y + vertex_ord), 3) AS total FROM boundaries
       UNION ALL SELECT 'cells', count(*), round(sum(x + 2 * y + 3 * cell_area), 3) FROM cells
       UNION ALL SELECT 'expression', count(*), round(sum(value * CAST(substr(gene, 2) AS INT)), 3) FROM expr
       UNION ALL SELECT 'genes', count(*), round(sum(ord * CASE WHEN is_imputed THEN 2.0 ELSE 1.0 END), 3) FROM genes
       UNION ALL SELECT 'clusters', count(*), round(sum(CAST(cluster AS DOUBLE) * CAST(substr(cell_id, 2) AS DOUBLE)), 3) FROM cells
       UNION ALL SELECT 'annotations', count(*), round(sum(length(cell_type) * CAST(substr(cell_id, 2) AS DOUBLE)), 3) FROM cells""",
       ("cells", "boundaries", "expr", "genes"))
def save_analysis_tables(t: Tables):
    """All six tables of the snapshot, read back: rows, and a sum over the columns of each."""
    labels = t.cells.select("cell_id", F.lit("kmeans").alias("method"), F.col("cluster").alias("label"))
    paths = convert.save_analysis(
        t.cells, t.expr.withColumn("layer", F.lit(G.RAW)), t.genes, t.boundaries, labels, ["kmeans"], t.cells.select("cell_id", "cell_type"),
        folder(t, "snapshot"),
    )
    number = "CAST(substr(cell_id, 2) AS DOUBLE)"
    sums = {
        "boundaries": "x + 2 * y + vertex_ord", "cells": "x + 2 * y + 3 * cell_area", "expression": "value * CAST(substr(gene, 2) AS INT)",
        "genes": "ord * CASE WHEN is_imputed THEN 2.0D ELSE 1.0D END", "clusters": f"CAST(kmeans AS DOUBLE) * {number}", "annotations": f"length(cell_type) * {number}",
    }
    parts = []
    for path in paths:
        name = path.rsplit("/", 1)[1]
        total = F.expr(f"CAST(sum({sums[name]}) AS DOUBLE)").alias("total")
        parts.append(t.spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), total))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return rounded(out, "total", digits=3)


@query("SELECT cell_id, x AS _x, y AS _y, cell_type FROM cells", ("cells",))
def communication_export_cells(t: Tables):
    """The written coordinates and annotation, read back side by side."""
    written = convert.to_communication_input(
        t.cells, layered(t), t.genes, t.genes.filter("ord BETWEEN 56 AND 59"), t.genes.filter("ord >= 60"), folder(t, "export"),
        use_corrected=True, include_imputed=True, cell_type_col="cell_type",
    )
    named = t.spark.read.csv(written["annotation"], header=True).select(F.col("cell").alias("cell_id"), "cell_type")
    return t.spark.read.parquet(written["coordinates"]).join(named, "cell_id").select("cell_id", "_x", "_y", "cell_type")


@query("SELECT gene FROM genes WHERE NOT is_imputed", ("genes",))
def panel_file(t: Tables):
    """The panel written with one name per line and read back."""
    path = K.write_names(G.panel_genes(t.genes).orderBy("gene"), "gene", folder(t, "panel"))
    return R.read_gene_list(t.spark, path).select("gene")


@query("SELECT cell_id, gene, value FROM expr", ("expr",))
def triplet_files(t: Tables):
    """Numbered entries with their lists of names as tables; names come back by their numbers."""
    expr = cut_lineage(t.expr)  # entries and both lists come from it
    out = K.write_triplets(expr, expr.select("cell_id"), expr.select("gene"), folder(t, "triplets"))
    entries = t.spark.read.schema("row long, column long, value double").csv(out["matrix"], header=True)
    genes = t.spark.read.schema("row long, gene string").csv(out["genes"], header=True)
    cells = t.spark.read.schema("column long, cell_id string").csv(out["cells"], header=True)
    return entries.join(genes, "row").join(cells, "column").select("cell_id", "gene", "value")


@query("SELECT 'labels_' || max(sample) || '_abc.parquet' AS name FROM cells", ("cells",))
def label_source_choice(t: Tables):
    """Of label files of one dataset the newest is chosen: files are written one after another."""
    base = folder(t, "sources")
    for s in SIX:
        K.write_table(t.cells.filter(F.col("sample") == s).select("cell_id", "cell_type"), f"{base}/labels_{s}_abc.parquet")
    found = R.list_label_files(t.spark, base, "labels_")
    listed = [{**f, "mtime": i} for i, f in enumerate(sorted(found, key=lambda f: (f["mtime"], f["name"])))]
    name = cells_ops.pick_label_source(t.cells, listed, t.cells, "abc")
    return t.cells.agg(F.lit(name).alias("name"))


@query("""--more
kept AS (SELECT * FROM cells WHERE cell_area < 100 OR cell_type IS NOT NULL)
SELECT cell_id, 'centre' AS kind, 0 AS vertex_ord, round(coalesce(x, 0), 6) AS x, round(coalesce(y, 0), 6) AS y FROM kept
UNION ALL SELECT cell_id, kind, CAST(vertex_ord AS INT), round(x, 6), round(y, 6) FROM boundaries WHERE cell_id IN (SELECT cell_id FROM kept)""", ("cells", "boundaries"))
def export_geometry(t: Tables):
    """Centres and outlines of the cells that are small or have a type."""
    at, outlines = K.export_geometry(t.cells.filter("cell_area < 100 OR cell_type IS NOT NULL"), t.boundaries)
    centres = at.select("cell_id", F.lit("centre").alias("kind"), F.lit(0).alias("vertex_ord"), "x", "y")
    return rounded(centres.union(outlines.select("cell_id", "kind", F.col("vertex_ord").cast("int"), "x", "y")), "x", "y")
