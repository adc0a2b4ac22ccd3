"""Conversion jobs: tables for communication inference, for object-style analysis tools, and a snapshot of everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.operators import cells as C
from cytomosaic.operators import filters as P
from cytomosaic.operators import genes as G
from cytomosaic.operators import spatial as X
from cytomosaic.session import cut_lineage
from cytomosaic.sources import writers as K


def to_communication_input(
    cells: DataFrame, expression: DataFrame, genes: DataFrame, raw_imputed: DataFrame, corr_imputed: DataFrame, folder: str,
    use_corrected: bool = False, include_imputed: bool = False, cell_type_col: str | None = None, overwrite: bool = False,
) -> dict[str, str | None]:
    """Expression, coordinates and annotation as the communication tool's input."""
    folder = folder.rstrip("/")
    panel = G.panel_genes(genes, raw_imputed, corr_imputed)
    matrices = G.assemble_layers(expression, panel, raw_imputed, corr_imputed, use_corrected, include_imputed)
    placed = C.resolve_coordinates(cells.withColumnRenamed("x", "x_centroid").withColumnRenamed("y", "y_centroid"))
    return {
        "expression": K.write_table(matrices, f"{folder}/expression", overwrite, ["matrix"]),
        "coordinates": K.write_table(placed.select("cell_id", "_x", "_y"), f"{folder}/coordinates", overwrite),
        "annotation": K.write_annotation(cells, cell_type_col, f"{folder}/annotation.csv", overwrite) if cell_type_col else None,
    }


def to_object_tables(
    cells: DataFrame, expression: DataFrame, genes: DataFrame, boundaries: DataFrame | None = None,
    rois: DataFrame | None = None, roi: tuple[str, str] | None = None, labels: dict[str, DataFrame] | None = None,
    use_corrected: bool = False, include_imputed: bool = False, merge_assays: bool = False, assay: str = "RNA",
) -> dict[str, DataFrame]:
    """Tables of one analysis object: metadata, counts, imputed values, centroids, outlines and embedding.

    ``roi`` = (cls, name) keeps the cells of one region: from ``rois`` if given, else from the table's own column.
    Corrected counts, if wanted and present, drop cells without any. Imputed values form their own table, or join the
    counts as whole numbers with ``merge_assays``; a cell without imputed values has zeros.
    """
    if roi is not None:
        cells = P.roi_equals(cells if rois is None else X.assign_roi(cells, rois, *roi), *roi)
    has_corrected = use_corrected and not expression.filter(F.col("layer") == G.CORRECTED).isEmpty()
    panel = G.panel_genes(genes)
    chosen = expression.filter(F.col("layer") == (G.CORRECTED if has_corrected else G.RAW))
    counts = chosen.join(panel.select("gene"), "gene", "left_semi").select("cell_id", "gene", "value")
    if has_corrected:
        cells = P.drop_empty_cells(cells, counts)
    counts = counts.join(cells.select("cell_id"), "cell_id", "left_semi")
    out: dict[str, DataFrame] = {}
    if include_imputed:
        wanted = G.CORR_IMPUTED if has_corrected else G.IMPUTED
        imputed = expression.filter(F.col("layer") == wanted).select("cell_id", "gene", "value")
        imputed = imputed.join(cells.select("cell_id"), "cell_id", "left_semi")
        if merge_assays:
            counts = counts.unionByName(G.integer_counts(imputed))
        else:
            out["imputed"] = imputed
    meta = P.with_totals(C.resolve_cell_area(cells), counts, assay)
    for column, source in (labels or {}).items():
        if column not in meta.columns:
            meta = C.align_labels(meta, source, column)
    pair = C.resolve_umap(cells, has_corrected)
    if pair is not None:
        out["umap"] = cells.select("cell_id", F.col(pair[0]).alias("umap_1"), F.col(pair[1]).alias("umap_2"))
    centroids, outlines = K.export_geometry(cells, boundaries)
    out |= {"meta": meta, "counts": counts, "centroids": centroids}
    if outlines is not None:
        out["boundaries"] = outlines
    return out


def assign_fov(meta: DataFrame, column: str | None = None, membership: DataFrame | None = None) -> DataFrame:
    """Add ``fov``: the named column, else from image membership if there is more than one image, else a detected column."""
    if column is not None:
        if column not in meta.columns:
            raise KeyError(f"column {column!r} not found; available: {meta.columns}")
        return meta.withColumn("fov", F.col(column).cast("string"))
    if membership is not None:
        assigned = C.fov_from_images(meta, membership)
        if len(assigned.select("fov").distinct().limit(2).collect()) > 1:
            return assigned
    found = C.detect_fov_column(meta)
    if found is None:
        raise ValueError("no column tells fields of view apart; name one or combine all")
    return meta.withColumn("fov", F.col(f"`{found}`").cast("string"))


def per_fov_tables(
    meta: DataFrame, counts: DataFrame, folder: str, name: str, column: str | None = None, membership: DataFrame | None = None,
    tissue: DataFrame | None = None, cell_type_col: str | None = None, combine: bool = False, overwrite: bool = False,
) -> dict[str, str]:
    """Counts, coordinates and annotation, one folder per field of view, or all in one with ``combine``."""
    base = f"{folder.rstrip('/')}/{name}"
    placed = C.resolve_coordinates(meta, tissue)
    if combine:
        cells, keys, write = placed, [], K.write_table
    else:
        cells, keys, write = assign_fov(placed, column, membership), ["fov"], K.write_per_fov
    of_cell = cells.select("cell_id", *keys)
    out = {
        "counts": write(counts.join(of_cell, "cell_id"), f"{base}/counts", overwrite),
        "coordinates": write(cells.select("cell_id", *keys, "_x", "_y"), f"{base}/coordinates", overwrite),
    }
    if cell_type_col and cell_type_col in cells.columns:
        label = K.label_text(cell_type_col, dict(cells.dtypes)[cell_type_col]).alias("cell_type")
        out["annotation"] = write(cells.select("cell_id", *keys, label), f"{base}/annotation", overwrite)
    return out


def save_analysis(
    cells: DataFrame, expression: DataFrame, genes: DataFrame, boundaries: DataFrame, labels: DataFrame, methods: Sequence[str],
    annotations: DataFrame | None, folder: str, overwrite: bool = False,
) -> list[str]:
    """Everything in one folder: outlines, cells, expression by layer, genes, all clusterings side by side, annotations."""
    folder = folder.rstrip("/")
    out = [
        K.write_table(boundaries, f"{folder}/boundaries", overwrite, ["kind"]),
        K.write_table(cells, f"{folder}/cells", overwrite),
        K.write_table(expression, f"{folder}/expression", overwrite, ["layer"]),
        K.write_table(genes, f"{folder}/genes", overwrite),
        K.write_table(C.labels_wide(labels, methods), f"{folder}/clusters", overwrite),
    ]
    if annotations is not None:
        out.append(K.write_table(annotations, f"{folder}/annotations", overwrite))
    return out


def transfer_identities(
    query_boundaries: DataFrame, reference_boundaries: DataFrame, labels: DataFrame, tile: float | None = None,
    unmatched: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Transferred identities, their shares, and the outlines that cross themselves, which count by the even-odd rule."""
    query, bad_query = X.repaired(X.rings(query_boundaries))
    reference, bad_reference = X.repaired(X.rings(reference_boundaries))
    identities = X.transfer_labels(query, reference, labels, tile, unmatched or X.UNMATCHED)
    identities = cut_lineage(identities)  # written, counted and handed on: the overlap is computed once
    invalid = bad_query.select(F.lit("query").alias("side"), "cell_id").union(bad_reference.select(F.lit("reference"), "cell_id"))
    return identities, C.value_shares(identities, "transferred_identity"), invalid
