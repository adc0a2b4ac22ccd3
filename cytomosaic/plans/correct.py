"""Ambient-signal removal from raw counts to corrected counts with clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.operators import deconvolve as D
from cytomosaic.operators import genes as G
from cytomosaic.operators import matrix as M
from cytomosaic.operators.filters import MIN_UMI, min_umi_cells
from cytomosaic.session import cut_lineage


def correct(
    cells: DataFrame, expression: DataFrame, genes: DataFrame, reference_expression: DataFrame, reference_labels: DataFrame,
    min_umi: int = MIN_UMI, purify_singlets: bool = True, n_clusters: int = M.N_CLUSTERS,
) -> tuple[DataFrame, DataFrame]:
    """The expression table with a new corrected layer, and the clusters of the corrected counts.

    Mixtures are fitted on the genes shared with the reference; removal covers the whole panel. Cells below ``min_umi``
    have no corrected counts and no cluster.
    """
    panel = G.panel_genes(genes)
    shared = G.shared_genes(panel, reference_expression.select("gene").distinct(), G.MIN_SHARED_FOR_CORRECTION)
    raw = expression.filter(F.col("layer") == G.RAW).join(panel.select("gene"), "gene", "left_semi").select("cell_id", "gene", "value")
    on_shared = min_umi_cells(raw.join(shared, "gene", "left_semi"), min_umi)
    profiles = cut_lineage(D.reference_profiles(reference_expression.join(shared, "gene", "left_semi"), reference_labels))
    fit = cut_lineage(D.doublet_fit(on_shared, profiles))
    corrected = cut_lineage(D.remove_ambient(raw, fit, profiles, purify_singlets))
    names = [r.gene for r in panel.orderBy("ord").select("gene").collect()]  # one panel
    clusters = M.correct_and_cluster(corrected, names, cells, n_clusters)
    others = expression.filter(F.col("layer") != G.CORRECTED)
    return others.unionByName(corrected.withColumn("layer", F.lit(G.CORRECTED))), clusters
