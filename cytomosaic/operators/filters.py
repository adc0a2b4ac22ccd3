"""Row selection on cells, molecules, genes and communication edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import log1p_value

# fixed values
MIN_QUALITY = 20
MIN_TRANSCRIPTS = 10
MIN_UMI = 10


def _listed(value) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def quality_filter(transcripts: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    return transcripts.filter(F.col("qv") >= min_quality)


def in_region(df: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float) -> DataFrame:
    return df.filter(F.col("x").between(x_min, x_max) & F.col("y").between(y_min, y_max))


def viewport_cells(cells: DataFrame, x_min: float, x_max: float, y_min: float, y_max: float, limit: int | None = None) -> DataFrame:
    """Cells whose outlines are drawn in a viewport: all, or the first ``limit`` by id for a drawing that asks for so many."""
    found = in_region(cells, x_min, x_max, y_min, y_max)
    return found if limit is None else found.orderBy("cell_id").limit(limit)


def viewport_boundaries(cells: DataFrame, boundaries: DataFrame, *region: float, limit: int | None = None) -> DataFrame:
    return boundaries.join(viewport_cells(cells, *region, limit=limit).select("cell_id"), "cell_id", "left_semi")


def subset_cells(
    cells: DataFrame,
    labels: DataFrame | None = None,
    expression: DataFrame | None = None,
    *,
    cluster=None,
    method: str | None = None,
    cell_type=None,
    gene: str | None = None,
    min_expr: float | None = None,
    max_expr: float | None = None,
    min_transcripts: int | None = None,
    max_cell_area: float | None = None,
) -> DataFrame:
    """Cells meeting every given condition.

    ``labels`` (cell_id, method, label) serves ``cluster``; without a method, the first in name order is used.
    ``expression`` (cell_id, gene, value) serves ``gene``, compared on log1p, a missing row counting as zero.
    """
    out = cells
    if cell_type is not None:
        out = out.filter(F.col("cell_type").isin(_listed(cell_type)))
    if min_transcripts is not None:
        out = out.filter(F.col("transcript_counts") >= min_transcripts)
    if max_cell_area is not None:
        out = out.filter(F.col("cell_area") <= max_cell_area)
    if cluster is not None:
        if labels is None:
            raise ValueError("cluster needs labels")
        wanted = labels.filter(F.col("label").isin([str(c) for c in _listed(cluster)]))
        first = labels.agg(F.min("method")).scalar()
        wanted = wanted.filter(F.col("method") == (F.lit(method) if method is not None else first))
        out = out.join(wanted, "cell_id", "left_semi")
    if gene is not None and (min_expr is not None or max_expr is not None):
        if expression is None:
            raise ValueError("gene needs expression")
        of_gene = expression.filter(F.col("gene") == gene).select("cell_id", log1p_value("value").alias("_level"))
        low, high = float("-inf") if min_expr is None else min_expr, float("inf") if max_expr is None else max_expr
        if low > 0:  # zero cannot pass, so only cells with a row can
            out = out.join(of_gene.filter(F.col("_level").between(low, high)), "cell_id", "left_semi")
        else:
            out = out.join(of_gene, "cell_id", "left").filter(F.coalesce("_level", F.lit(0.0)).between(low, high)).drop("_level")
    return out


def cell_totals(expression: DataFrame, by: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Total count and number of genes above zero per cell."""
    return expression.groupBy(*by).agg(
        F.sum("value").alias("n_count"), F.count_if(F.col("value") > 0).alias("n_feature")
    )


def with_totals(cells: DataFrame, expression: DataFrame, assay: str) -> DataFrame:
    """Add ``nCount_<assay>`` and ``nFeature_<assay>`` where the table lacks them; cells without counts get zero."""
    count_name, feature_name = f"nCount_{assay}", f"nFeature_{assay}"
    missing = [c for c in (count_name, feature_name) if c not in cells.columns]
    if not missing:
        return cells
    totals = cell_totals(expression)
    out = cells.join(totals, "cell_id", "left")
    if count_name in missing:
        out = out.withColumn(count_name, F.coalesce("n_count", F.lit(0.0)))
    if feature_name in missing:
        out = out.withColumn(feature_name, F.coalesce("n_feature", F.lit(0)))
    return out.drop("n_count", "n_feature")


def drop_empty_cells(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Cells with a positive total in the given layer."""
    kept = cell_totals(expression).filter(F.col("n_count") > 0).select("cell_id")
    return cells.join(kept, "cell_id", "left_semi")


def min_umi_cells(expression: DataFrame, min_umi: int = MIN_UMI) -> DataFrame:
    """Counts of the cells whose total reaches ``min_umi``."""
    kept = cell_totals(expression).filter(F.col("n_count") >= min_umi).select("cell_id")
    return expression.join(kept, "cell_id", "left_semi")


def min_transcript_cells(transcripts: DataFrame, min_transcripts: int = MIN_TRANSCRIPTS) -> DataFrame:
    """Assigned molecules of cells that have at least ``min_transcripts`` of them."""
    assigned = transcripts.filter(F.col("cell_id").isNotNull())
    kept = assigned.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_transcripts)
    return assigned.join(kept.select("cell_id"), "cell_id", "left_semi")


def ccc_filter(
    edges: DataFrame,
    lr_pairs: Sequence[str] | None = None,
    ligands: Sequence[str] | None = None,
    receptors: Sequence[str] | None = None,
    senders: Sequence[str] | None = None,
    receivers: Sequence[str] | None = None,
) -> DataFrame:
    """Edges matching every non-empty selection; sender and receiver are cell types."""
    chosen = {
        "lr_pair": lr_pairs,
        "ligand": ligands,
        "receptor": receptors,
        "from_type": senders,
        "to_type": receivers,
    }
    for column, values in chosen.items():
        if values:
            edges = edges.filter(F.col(column).isin(list(values)))
    return edges


def roi_equals(cells: DataFrame, cls: str, name: str) -> DataFrame:
    """Cells assigned to one region; an error if there are none."""
    column = f"roi_{cls}"
    if column not in cells.columns:
        raise KeyError(f"column {column} not found; available: {cells.columns}")
    kept = cells.filter(F.col(column).cast("string") == str(name))
    if kept.isEmpty():
        seen = [r[0] for r in cells.select(column).dropna().distinct().orderBy(column).limit(50).collect()]
        raise ValueError(f"no cells with {column} == {name!r}; available: {seen}")
    return kept


def one_cell(cells: DataFrame, cell_id: str, labels: DataFrame | None = None) -> DataFrame:
    """The row of one cell, with one column per clustering method if labels are given."""
    row = cells.filter(F.col("cell_id") == cell_id)
    if labels is None:
        return row
    own = labels.filter(F.col("cell_id") == cell_id)
    methods = own.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("method", "label"))).alias("labels"))
    return row.join(methods, "cell_id", "left")


def cell_distance(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Straight-line distance between two cells."""
    both = cells.filter(F.col("cell_id").isin(first, second))
    at = {n: F.max(F.when(F.col("cell_id") == c, F.struct("x", "y"))) for n, c in (("a", first), ("b", second))}
    return both.agg(at["a"].alias("a"), at["b"].alias("b")).select(
        F.lit(first).alias("cell_a"),
        F.lit(second).alias("cell_b"),
        F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("distance"),
    )
