"""Cells, molecules, genes, layers and the merge of datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytomosaic.functions import scalar as C
from cytomosaic.operators import cells as cells_ops
from cytomosaic.operators import filters as P
from cytomosaic.operators import genes as G
from cytomosaic.operators import merge as MG
from cytomosaic.operators import metrics as M
from cytomosaic.operators import spatial as X
from cytomosaic.operators.indexing import dense_index
from registry.base import Tables, query, rounded

# --- aggregates ------------------------------------------------------------------------------------------------------


@query("""SELECT sample, min(x) AS x_min, min(y) AS y_min, max(x) AS x_max, max(y) AS y_max FROM cells GROUP BY sample""", ("cells",))
def cells_bbox(t: Tables):
    return cells_ops.bounding_box(t.cells, ["sample"])


@query("""SELECT cell_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(x) AS transcript_counts
       FROM transcripts WHERE cell_id IS NOT NULL GROUP BY cell_id""", ("transcripts",))
def transcripts_to_cells(t: Tables):
    return rounded(cells_ops.molecules_to_cells(t.transcripts), "x", "y")


@query("SELECT * FROM expr", ("expr",))
def expr_counts(t: Tables):
    return cells_ops.molecules_to_counts(P.quality_filter(t.transcripts, 20))


@query("""SELECT cell_id, gene, CAST(count(*) AS DOUBLE) AS value FROM transcripts WHERE cell_id IS NOT NULL
       AND gene IN (SELECT gene FROM genes WHERE NOT is_imputed)
       AND cell_id IN (SELECT cell_id FROM cells WHERE cell_area > 100) GROUP BY cell_id, gene""", ("transcripts", "genes", "cells"))
def molecules_of_known_cells(t: Tables):
    return cells_ops.molecules_to_counts(t.transcripts, G.panel_genes(t.genes), t.cells.filter("cell_area > 100"))


@query("""SELECT cell_id, sum(value) AS n_count, count(*) FILTER (WHERE value > 0) AS n_feature FROM expr GROUP BY cell_id""", ("expr",))
def cell_totals(t: Tables):
    return P.cell_totals(t.expr)


@query("""SELECT c.cell_id, coalesce(sum(value), 0) AS "nCount_RNA", count(gene) AS "nFeature_RNA"
       FROM cells c LEFT JOIN expr e ON e.cell_id = c.cell_id GROUP BY c.cell_id""", ("cells", "expr"))
def cells_with_totals(t: Tables):
    return P.with_totals(t.cells, t.expr, "RNA").select("cell_id", "nCount_RNA", "nFeature_RNA")


@query("""SELECT cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM cells GROUP BY cell_type""",
       ("cells",))
def type_proportions(t: Tables):
    return rounded(cells_ops.value_shares(t.cells, "cell_type"), "percent")


@query("""SELECT sample, cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY sample), 6) AS percent
       FROM cells GROUP BY sample, cell_type""", ("cells",))
def type_proportions_by_sample(t: Tables):
    return rounded(cells_ops.value_shares(t.cells, "cell_type", ["sample"]), "percent")


@query("""SELECT (SELECT count(*) FROM cells) AS n_cells, (SELECT count(*) FROM transcripts) AS n_transcripts,
       (SELECT count(DISTINCT gene) FROM genes WHERE NOT is_imputed) AS n_panel_genes""", ("cells", "transcripts", "genes"))
def dataset_summary(t: Tables):
    return cells_ops.dataset_summary(t.cells, t.transcripts, G.panel_genes(t.genes))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE cell_id IN (SELECT cell_id FROM expr)) AS n_matched,
       round(100.0 * count(*) FILTER (WHERE cell_id IN (SELECT cell_id FROM expr)) / count(*), 6) AS percent FROM cells""",
       ("cells", "expr"))
def match_report(t: Tables):
    return rounded(cells_ops.match_report(t.cells, t.expr, "cell_id"), "percent")


PROFILED = ("sample", "cell_type", "cluster")


@query("""--more
long AS (SELECT 'sample' AS "column", sample AS v FROM cells UNION ALL SELECT 'cell_type', cell_type FROM cells
         UNION ALL SELECT 'cluster', cluster FROM cells),
d AS (SELECT DISTINCT "column", v, dense_rank() OVER (PARTITION BY "column" ORDER BY v) AS p FROM long WHERE v IS NOT NULL)
SELECT "column", 'string' AS dtype, count(v) AS n_values, count(DISTINCT v) AS n_distinct,
       (SELECT string_agg(v, ',' ORDER BY v) FROM d WHERE d."column" = long."column" AND p <= 3) AS samples
FROM long GROUP BY "column\"""", ("cells",))
def column_profile(t: Tables):
    return cells_ops.column_profile(t.cells.select(*PROFILED))


@query("""--more
num AS (SELECT *, CAST(substr(cell_id, 2) AS BIGINT) AS k FROM cells)
SELECT cell_id, CASE WHEN k % 3 = 0 THEN coalesce(cell_type, 'Unknown') ELSE 'Unknown' END AS label FROM num""", ("cells",))
def align_labels(t: Tables):
    """Ids such as 0012 match 12 as numbers only, so the number match wins."""
    number = F.substring("cell_id", 2, 20)
    cells = t.cells.select(number.alias("cell_id"))
    labels = t.cells.filter(F.substring("cell_id", 2, 20).cast("long") % 3 == 0).select(
        F.concat(F.lit("000"), number).alias("cell_id"), F.col("cell_type").alias("label")
    )
    out = cells_ops.align_labels(cells, labels, "label")
    return out.select(F.concat(F.lit("c"), "cell_id").alias("cell_id"), "label")


@query("""SELECT cell_id, coalesce(label, '') AS label FROM cells c LEFT JOIN
       (SELECT cell_id AS k, cluster AS label FROM cells WHERE cell_area < 100) l ON l.k = c.cell_id""", ("cells",))
def align_column(t: Tables):
    labels = t.cells.filter("cell_area < 100").select("cell_id", F.col("cluster").alias("label"))
    return cells_ops.align_column(t.cells.select("cell_id"), labels, "cell_id", "label", "")


@query("""SELECT source, count(DISTINCT cell_id) AS n_matched FROM (
       SELECT sample AS source, 'c' || CAST(CAST(substr(cell_id, 2) AS BIGINT) * 2 AS STRING) AS cell_id FROM cells) l
       WHERE cell_id IN (SELECT cell_id FROM cells) GROUP BY source""", ("cells",))
def label_source_overlap(t: Tables):
    doubled = F.concat(F.lit("c"), (F.substring("cell_id", 2, 20).cast("long") * 2).cast("string"))
    labels = t.cells.select(F.col("sample").alias("source"), doubled.alias("cell_id"))
    return cells_ops.source_overlap(t.cells, labels)


@query("""--more
m AS (SELECT cell_id, 'im' || CAST(CAST(floor(x / 100) AS BIGINT) % 7 AS STRING) AS image, 1 AS ord FROM cells WHERE cell_area > 100
      UNION ALL SELECT cell_id, 'im' || CAST(CAST(floor(y / 100) AS BIGINT) % 7 AS STRING), 2 FROM cells WHERE cell_area > 300)
SELECT cell_id, arg_max(image, ord) AS fov FROM m GROUP BY cell_id""", ("cells",))
def fov_from_images(t: Tables):
    def listed(axis: str, area: int, at: int):
        image = F.concat(F.lit("im"), (F.floor(F.col(axis) / 100) % 7).cast("string"))
        return t.cells.filter(F.col("cell_area") > area).select("cell_id", image.alias("image"), F.lit(at).alias("ord"))

    return cells_ops.fov_from_images(t.cells.select("cell_id"), listed("x", 100, 1).union(listed("y", 300, 2)))


@query("""SELECT cell_id, CASE WHEN cell_area > 400 THEN NULL ELSE x END AS x, cell_area AS volume,
       CAST(substr(cell_id, 2) AS DOUBLE) AS number, coalesce(cell_type, '') AS cell_type FROM cells""", ("cells",))
def coerced_columns(t: Tables):
    x = F.when(F.col("cell_area") <= 400, F.col("x"))
    raw = t.cells.select("cell_id", x.alias("x"), F.col("cell_area").alias("volume"), F.substring("cell_id", 2, 20).alias("number"), "cell_type")
    return cells_ops.coerce_columns(raw)


@query("SELECT cell_id, cell_area, x AS _x, y AS _y FROM cells", ("cells",))
def resolved_columns(t: Tables):
    """A table that names its centroids and area differently."""
    meta = t.cells.select("cell_id", F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"), F.col("cell_area").alias("volume"))
    return cells_ops.resolve_coordinates(cells_ops.resolve_cell_area(meta)).select("cell_id", "cell_area", "_x", "_y")


@query("SELECT cell_id, cluster, x AS _x, y AS _y FROM cells", ("cells",))
def coordinates_from_embedding(t: Tables):
    """A table without coordinates, tissue coordinates of some cells only, and a spatial embedding of all."""
    embedding = t.cells.select("cell_id", F.col("x").alias("spatial_1"), F.col("y").alias("spatial_2"), F.lit(0.0).alias("spatial_3"))
    some = t.cells.filter("cell_area < 100").select("cell_id", F.col("x").alias("imagerow"), F.col("y").alias("imagecol"))
    return cells_ops.resolve_coordinates(t.cells.select("cell_id", "cluster"), some, embedding)


@query("SELECT cell_id, x AS umap_1, y AS umap_2 FROM cells", ("cells",))
def umap_pair(t: Tables):
    """The corrected pair of columns where it is wanted and there, else the plain one."""
    both = t.cells.select("cell_id", F.lit(0.0).alias("umap_1"), F.lit(0.0).alias("umap_2"), F.col("x").alias("split_umap_1"), F.col("y").alias("split_umap_2"))
    wanted = cells_ops.resolve_umap(both, True)
    plain = cells_ops.resolve_umap(both.drop("split_umap_1"), True)
    missing = cells_ops.resolve_umap(t.cells, False)
    right = plain == ("umap_1", "umap_2") and missing is None
    return both.filter(F.lit(right)).select("cell_id", F.col(wanted[0]).alias("umap_1"), F.col(wanted[1]).alias("umap_2"))


@query("SELECT sample, from_cell AS barcode, arg_max(receptor, (to_cell, ligand, receptor, attention_score)) AS cell_type FROM edges GROUP BY ALL", ("edges",))
def last_labels(t: Tables):
    """A barcode listed with several labels has the one that comes last."""
    place = F.struct("to_cell", "ligand", "receptor", "attention_score")
    listed = t.edges.select(F.concat_ws("|", "sample", "from_cell").alias("barcode"), F.col("receptor").alias("cell_type"), place.alias("file_ord"))
    named = M.last_label(listed)
    return named.select(F.split("barcode", r"\|")[0].alias("sample"), F.split("barcode", r"\|")[1].alias("barcode"), "cell_type")


@query("SELECT cell_id, cluster AS kmeans, cell_type AS typed FROM cells", ("cells",))
def labels_side_by_side(t: Tables):
    labels = t.cells.select("cell_id", F.lit("kmeans").alias("method"), F.col("cluster").alias("label")).union(
        t.cells.select("cell_id", F.lit("typed"), "cell_type")
    )
    return cells_ops.labels_wide(labels, ["kmeans", "typed"])


# --- selections ------------------------------------------------------------------------------------------------------


@query("SELECT * FROM transcripts WHERE qv >= 20", ("transcripts",))
def quality_filter(t: Tables):
    return P.quality_filter(t.transcripts)


@query("""SELECT c.cell_id, c.cell_type, c.cell_area, c.cluster FROM cells c JOIN expr e ON e.cell_id = c.cell_id AND e.gene = 'G3'
       JOIN (SELECT cell_id, count(*) AS n FROM transcripts WHERE cell_id IS NOT NULL GROUP BY cell_id) m ON m.cell_id = c.cell_id
       WHERE ln(1 + e.value) BETWEEN 0.5 AND 3 AND c.cell_type IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND c.cluster IN ('2', '3', '5', '7')
       AND c.cell_area <= 400 AND m.n >= 2""", ("cells", "expr", "transcripts"))
def subset_cells(t: Tables):
    counted = t.cells.join(cells_ops.molecules_to_cells(t.transcripts).select("cell_id", "transcript_counts"), "cell_id")
    labels = t.cells.select("cell_id", F.lit("clusters").alias("method"), F.col("cluster").alias("label"))
    return P.subset_cells(
        counted, labels, t.expr, cluster=[2, 3, 5, 7], cell_type=["1-URGENT", "2-HIGH", "3-MEDIUM"], gene="G3",
        min_expr=0.5, max_expr=3.0, min_transcripts=2, max_cell_area=400,
    ).select("cell_id", "cell_type", "cell_area", "cluster")


@query("""SELECT cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM expr WHERE gene = 'G3' AND ln(1 + value) > 1)""",
       ("cells", "expr"))
def subset_low_expression(t: Tables):
    """An upper limit only: cells without the gene count as zero and stay."""
    return P.subset_cells(t.cells, None, t.expr, gene="G3", max_expr=1.0).select("cell_id")


@query("""SELECT b.* FROM boundaries b WHERE cell_id IN (SELECT cell_id FROM cells WHERE x BETWEEN 100 AND 700 AND y BETWEEN 50 AND 400)""",
       ("cells", "boundaries"))
def viewport(t: Tables):
    return P.viewport_boundaries(t.cells, t.boundaries, 100, 700, 50, 400)


@query("SELECT b.* FROM boundaries b WHERE cell_id IN (SELECT cell_id FROM cells WHERE x >= 0 AND y >= 0)", ("cells", "boundaries"))
def viewport_whole(t: Tables):
    """A viewport that holds every cell."""
    return P.viewport_boundaries(t.cells, t.boundaries, 0, 1e9, 0, 1e9)


@query("""SELECT cell_id FROM cells WHERE cell_id IN (SELECT cell_id FROM expr WHERE gene < 'G3' GROUP BY cell_id HAVING sum(value) > 0)""",
       ("cells", "expr"))
def nonempty_cells(t: Tables):
    return P.drop_empty_cells(t.cells, t.expr.filter("gene < 'G3'")).select("cell_id")


@query("SELECT * FROM expr WHERE cell_id IN (SELECT cell_id FROM expr GROUP BY cell_id HAVING sum(value) >= 3)", ("expr",))
def min_umi(t: Tables):
    return P.min_umi_cells(t.expr, 3)


@query("""SELECT cell_id, gene, x, y, qv FROM transcripts WHERE cell_id IN (SELECT cell_id FROM transcripts WHERE cell_id IS NOT NULL
       GROUP BY cell_id HAVING count(*) >= 4)""", ("transcripts",))
def min_transcripts_per_cell(t: Tables):
    return P.min_transcript_cells(t.transcripts, 4).select("cell_id", "gene", "x", "y", "qv")


@query("SELECT cell_id, sample, x, y, cell_area, cluster FROM cells WHERE cell_id = 'c77'", ("cells",))
def one_cell(t: Tables):
    labels = t.cells.select("cell_id", F.lit("clusters").alias("method"), F.col("cluster").alias("label"))
    return P.one_cell(t.cells, "c77", labels).select("cell_id", "sample", "x", "y", "cell_area", F.col("labels")["clusters"].alias("cluster"))


@query("""SELECT 'c5' AS cell_a, 'c900' AS cell_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance
       FROM cells a JOIN cells b ON a.cell_id = 'c5' AND b.cell_id = 'c900'""", ("cells",))
def cell_distance(t: Tables):
    return rounded(P.cell_distance(t.cells, "c5", "c900"), "distance")


@query("""SELECT e.*, ligand || '-' || receptor AS lr_pair, a.cell_type AS from_type, b.cell_type AS to_type FROM edges e
       JOIN cells a ON a.cell_id = from_cell JOIN cells b ON b.cell_id = to_cell
       WHERE ligand IN ('L1', 'L2', 'L3') AND receptor IN ('R0', 'R2') AND ligand || '-' || receptor IN ('L1-R0', 'L2-R2', 'L9-R9')
       AND a.cell_type IN ('1-URGENT', '5-LOW') AND b.cell_type = '2-HIGH'""", ("edges", "cells"))
def ccc_filter(t: Tables):
    typed = M.annotate_endpoints(M.with_lr_pair(t.edges), t.cells.select("cell_id", "cell_type"))
    return P.ccc_filter(typed, ["L1-R0", "L2-R2", "L9-R9"], ["L1", "L2", "L3"], ["R0", "R2"], ["1-URGENT", "5-LOW"], ["2-HIGH"])


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("""SELECT cell_id, regexp_replace(cell_id || '_4', '_4$', '') AS plain, 's0_' || cell_id AS named,
       replace(replace(cell_type || '/a b', '/', '_'), ' ', '_') AS fov, substr(md5(cell_id), 1, 8) AS tag,
       least(greatest(cell_area, 50), 300) AS shown, CAST(CAST(cluster AS INT) + 1 AS STRING) AS next_label,
       greatest(cell_area - 200, 0) AS clipped, round(ln(1 + cell_area), 9) AS level,
       CASE WHEN round_even(cell_area / 100, 0) < 1 THEN 0 ELSE round_even(cell_area / 100, 0) END AS whole,
       coalesce(substr(cell_type, 1, 200), '') AS text, cluster || ' [imp]' AS tagged, cluster || ' [corr+imp]' AS tagged_corrected
       FROM cells""", ("cells",))
def scalar_functions(t: Tables):
    area = F.col("cell_area")
    out = t.cells.select(
        "cell_id",
        C.strip_suffix(F.concat("cell_id", F.lit("_4"))).alias("plain"),
        C.prefixed(F.lit("s0"), "cell_id").alias("named"),
        C.clean_fov(F.concat("cell_type", F.lit("/a b"))).alias("fov"),
        C.md5_tag("cell_id").alias("tag"),
        C.clamp(area, 50, 300).alias("shown"),
        C.cluster_label("cluster").alias("next_label"),
        C.clip_negative(area - 200).alias("clipped"),
        C.log1p_value(area).alias("level"),
        C.whole_counts(area / 100).alias("whole"),
        C.short_text("cell_type").alias("text"),
        C.tag_gene("cluster", False).alias("tagged"),
        C.tag_gene("cluster", True).alias("tagged_corrected"),
    )
    return rounded(out, "level", digits=9)


@query("""SELECT cell_id, CAST(row_number() OVER (ORDER BY cell_id) - 1 AS BIGINT) AS index FROM cells""", ("cells",))
def dense_index_of_cells(t: Tables):
    return dense_index(t.cells.select("cell_id"), "cell_id")


# --- genes and layers ------------------------------------------------------------------------------------------------

# two datasets: even and odd gene numbers below 40, shifted; both have G10..G19
GENE_SETS = """--more
listed AS (
  SELECT 0 AS dataset_ord, gene, CAST(63 - ord AS INT) AS ord, CASE WHEN ord < 5 THEN NULL ELSE is_imputed END AS is_imputed
  FROM genes WHERE ord % 2 = 0 OR ord BETWEEN 10 AND 19
  UNION ALL
  SELECT 1, gene, ord, CASE WHEN ord = 12 THEN NULL ELSE ord % 5 = 0 END FROM genes WHERE ord % 2 = 1 OR ord BETWEEN 10 AND 19),
flags AS (SELECT gene, arg_max(is_imputed, dataset_ord) AS is_imputed FROM listed WHERE is_imputed IS NOT NULL GROUP BY gene)"""


def two_gene_sets(t: Tables):
    shared = F.col("ord").between(10, 19)
    first = t.genes.filter((F.col("ord") % 2 == 0) | shared).select(
        F.lit(0).alias("dataset_ord"), "gene", (63 - F.col("ord")).alias("ord"), F.when(F.col("ord") >= 5, F.col("is_imputed")).alias("is_imputed")
    )
    second = t.genes.filter((F.col("ord") % 2 == 1) | shared).select(
        F.lit(1).alias("dataset_ord"), "gene", "ord", F.when(F.col("ord") != 12, F.col("ord") % 5 == 0).alias("is_imputed")
    )
    return first.union(second)


@query(GENE_SETS + """ SELECT l.gene, CAST(row_number() OVER (ORDER BY min((dataset_ord, ord))) - 1 AS INT) AS ord,
       coalesce(any_value(f.is_imputed), false) AS is_imputed FROM listed l LEFT JOIN flags f ON f.gene = l.gene GROUP BY l.gene""",
       ("genes",))
def gene_union(t: Tables):
    from cytomosaic.plans.merge import gene_order

    return gene_order(G.union_genes(two_gene_sets(t)))


@query(GENE_SETS + """ SELECT l.gene, CAST(row_number() OVER (ORDER BY min((dataset_ord, ord))) - 1 AS INT) AS ord,
       coalesce(any_value(f.is_imputed), false) AS is_imputed FROM listed l LEFT JOIN flags f ON f.gene = l.gene GROUP BY l.gene
       HAVING count(DISTINCT dataset_ord) = 2""", ("genes",))
def gene_intersect(t: Tables):
    from cytomosaic.plans.merge import gene_order

    return gene_order(G.intersect_genes(two_gene_sets(t), 2))


@query("SELECT gene, ord FROM genes WHERE NOT is_imputed AND ord NOT BETWEEN 50 AND 52 AND ord <> 54", ("genes",))
def panel_genes(t: Tables):
    return G.panel_genes(t.genes, t.genes.filter("ord BETWEEN 50 AND 52"), t.genes.filter("ord = 54")).select("gene", "ord")


@query("""SELECT gene, ord, CASE WHEN ord < 56 THEN 'in_panel' WHEN ord >= 62 THEN 'missing' ELSE 'impute' END AS status
       FROM genes WHERE ord >= 50""", ("genes",))
def requested_genes(t: Tables):
    return G.requested_genes(t.genes.filter("ord >= 50"), t.genes.filter("ord < 62"), G.panel_genes(t.genes))


@query("SELECT gene FROM genes WHERE ord BETWEEN 8 AND 55", ("genes",))
def shared_genes(t: Tables):
    return G.shared_genes(G.panel_genes(t.genes), t.genes.filter("ord >= 8"))


LAYERS = """--more
layered AS (
  SELECT cell_id, gene, value, CASE WHEN CAST(substr(gene, 2) AS INT) >= 60 THEN 'corr_imputed'
         WHEN CAST(substr(gene, 2) AS INT) >= 56 THEN 'imputed' ELSE 'raw' END AS layer FROM expr
  UNION ALL SELECT cell_id, gene, value * 0.5, 'corrected' FROM expr WHERE CAST(substr(gene, 2) AS INT) < 56 AND value > 1)"""


def layered(t: Tables, expr=None):
    expr = t.expr if expr is None else expr
    number = F.substring("gene", 2, 9).cast("int")
    layer = F.when(number >= 60, "corr_imputed").when(number >= 56, "imputed").otherwise("raw")
    corrected = expr.filter((number < 56) & (F.col("value") > 1)).select("cell_id", "gene", (F.col("value") * 0.5).alias("value"), F.lit("corrected"))
    return expr.withColumn("layer", layer).union(corrected)


def assembled(t: Tables, use_corrected: bool, include_imputed: bool):
    return G.assemble_layers(
        layered(t), G.panel_genes(t.genes), t.genes.filter("ord BETWEEN 56 AND 59"), t.genes.filter("ord >= 60"), use_corrected, include_imputed
    )


@query(LAYERS + """ SELECT 'X' AS matrix, cell_id, gene, value FROM layered WHERE layer IN ('corrected', 'corr_imputed')
       UNION ALL SELECT 'X_raw', cell_id, gene, value FROM layered WHERE layer = 'raw'""", ("expr",))
def layer_assemble(t: Tables):
    return assembled(t, True, True)


@query(LAYERS + " SELECT 'X' AS matrix, cell_id, gene, value FROM layered WHERE layer = 'raw'", ("expr",))
def layer_assemble_raw(t: Tables):
    return assembled(t, False, False)


@query(LAYERS + """ SELECT 'X' AS matrix, cell_id, gene, value FROM layered WHERE layer IN ('raw', 'imputed')
       UNION ALL SELECT 'X_raw', cell_id, gene, value FROM layered WHERE layer = 'raw'""", ("expr",))
def layer_assemble_imputed(t: Tables):
    return assembled(t, False, True)


@query("SELECT gene FROM genes WHERE ord BETWEEN 56 AND 59", ("genes",))
def active_imputed(t: Tables):
    """No corrected list, so the raw one is active."""
    return G.active_imputed(t.genes.filter("ord BETWEEN 56 AND 59"), t.genes.filter("ord > 99"), True)


@query(LAYERS + " SELECT CASE WHEN count(*) > 0 THEN 'corrected' ELSE 'raw' END AS layer FROM layered WHERE layer = 'corrected'", ("expr",))
def active_layer(t: Tables):
    return G.active_layer(layered(t), "corrected")


@query("""SELECT cell_id, gene, round_even(value * 0.75, 0) AS value FROM expr WHERE round_even(value * 0.75, 0) >= 1""", ("expr",))
def integer_counts(t: Tables):
    return G.integer_counts(t.expr.withColumn("value", F.col("value") * 0.75))


@query("""SELECT cell_id, gene, value, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene)
       AS place FROM expr) WHERE place <= 12""", ("expr",))
def top_genes(t: Tables):
    return G.top_expressed(t.expr)


# --- merge -----------------------------------------------------------------------------------------------------------

BOXES = """--more
boxes AS (SELECT sample AS dataset, CAST(substr(sample, 2) AS INT) AS dataset_ord, min(x) AS x_min, max(x) AS x_max,
                 min(y) AS y_min, max(y) AS y_max FROM cells GROUP BY sample)"""
ROW_OFFSETS = """,
offsets AS (SELECT dataset, dataset_ord, coalesce(sum(x_max - x_min + 200) OVER (ORDER BY dataset_ord ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0) - x_min AS dx, 0 - y_min AS dy FROM boxes)"""


def datasets(t: Tables):
    return t.cells.withColumn("dataset", F.col("sample")).withColumn("dataset_ord", F.substring("sample", 2, 9).cast("int"))


@query(BOXES + ROW_OFFSETS + " SELECT * FROM offsets", ("cells",))
def merge_offsets(t: Tables):
    return MG.layout_offsets(MG.dataset_boxes(datasets(t)), "row")


@query(BOXES + """ SELECT dataset, dataset_ord, 0 - x_min AS dx, coalesce(sum(y_max - y_min + 50) OVER (ORDER BY dataset_ord
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - y_min AS dy FROM boxes""", ("cells",))
def merge_offsets_column(t: Tables):
    return MG.layout_offsets(MG.dataset_boxes(datasets(t)), "column", 50.0)


@query(BOXES + """ SELECT dataset, dataset_ord,
       (dataset_ord % CAST(ceil(sqrt((SELECT count(*) FROM boxes))) AS INT)) * ((SELECT max(x_max - x_min) FROM boxes) + 200) - x_min AS dx,
       floor(dataset_ord / CAST(ceil(sqrt((SELECT count(*) FROM boxes))) AS INT)) * ((SELECT max(y_max - y_min) FROM boxes) + 200) - y_min AS dy
       FROM boxes""", ("cells",))
def merge_offsets_grid(t: Tables):
    return MG.layout_offsets(MG.dataset_boxes(datasets(t)), "grid")


@query(BOXES + ROW_OFFSETS + """ SELECT o.dataset, o.dataset || '_' || cell_id AS cell_id, x + dx AS x, y + dy AS y, cell_area
       FROM cells c JOIN offsets o ON o.dataset = c.sample""", ("cells",))
def merged_cells(t: Tables):
    cells = datasets(t)
    return MG.place(cells, MG.layout_offsets(MG.dataset_boxes(cells))).select("dataset", "cell_id", "x", "y", "cell_area")


@query("""SELECT cell_id, 'a' AS dataset, 0 AS dataset_ord, x, CAST(NULL AS STRING) AS cluster FROM cells UNION ALL
       SELECT cell_id, 'b', 1, NULL, cluster FROM cells""", ("cells",))
def stacked_tables(t: Tables):
    return MG.stack([t.cells.select("cell_id", "x"), t.cells.select("cell_id", "cluster")], ["a", "b"])


# --- positions -------------------------------------------------------------------------------------------------------


@query("""--more
kept AS (SELECT * FROM transcripts WHERE qv >= 20),
corner AS (SELECT min(x) AS x0, min(y) AS y0 FROM kept)
SELECT CAST(floor((x - (SELECT x0 FROM corner)) / 300.0) AS BIGINT) AS patch_x, CAST(floor((y - (SELECT y0 FROM corner)) / 300.0) AS BIGINT) AS patch_y,
       count(*) AS n_transcripts FROM kept GROUP BY ALL HAVING count(*) >= 10""", ("transcripts",))
def patch_counts(t: Tables):
    return X.patch_counts(P.quality_filter(t.transcripts), width=300.0)
