"""Merge of several datasets into one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import prefixed
from cytomosaic.operators import genes as G
from cytomosaic.operators import merge as M
from cytomosaic.operators.indexing import dense_index


@dataclass
class Dataset:
    cells: DataFrame
    expression: DataFrame
    genes: DataFrame
    boundaries: DataFrame | None = None


def merge(
    datasets: Sequence[Dataset], labels: Sequence[str] | None = None, layout: str = "row", gap: float = M.GAP,
    genes: str = "union", region: str = "cell_boundaries",
) -> Dataset:
    """One dataset with prefixed ids, shifted coordinates and a combined gene list.

    All layers are carried. With outlines, cells also get ``region`` and a dense ``instance_id`` in id order.
    """
    if genes not in ("union", "intersect"):
        raise ValueError(f"unknown gene rule {genes!r}")
    labels = list(labels) if labels is not None else [f"s{i}" for i in range(len(datasets))]
    cells = M.stack([d.cells for d in datasets], labels)
    offsets = M.layout_offsets(M.dataset_boxes(cells), layout, gap)
    placed = M.place(cells, offsets)

    listed = M.stack([d.genes for d in datasets], labels)
    if "is_imputed" not in listed.columns:
        listed = listed.withColumn("is_imputed", F.lit(None).cast("boolean"))
    chosen = G.union_genes(listed) if genes == "union" else G.intersect_genes(listed, len(datasets))
    ordered = gene_order(chosen)

    expression = M.stack([d.expression for d in datasets], labels).join(ordered.select("gene"), "gene", "left_semi")
    expression = expression.withColumn("cell_id", prefixed("dataset", "cell_id")).drop("dataset_ord")
    outlines = None
    parts = [(d.boundaries, label) for d, label in zip(datasets, labels, strict=True) if d.boundaries is not None]
    if parts:
        outlines = M.place(M.stack([b for b, _ in parts], [label for _, label in parts]), offsets).drop("dataset_ord")
        placed = dense_index(placed, "cell_id", "instance_id").withColumn("region", F.lit(region))
    return Dataset(placed.drop("dataset_ord"), expression, ordered, outlines)


def gene_order(chosen: DataFrame) -> DataFrame:
    """Genes with ``ord`` 0, 1, ... by first appearance. A gene list is panel-sized, so one window numbers it."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("first_seen")) - 1
    return chosen.select("gene", place.alias("ord"), "is_imputed")
