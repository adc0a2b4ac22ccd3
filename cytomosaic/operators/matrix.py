"""Normalisation of long count tables, components, principal vectors and clusters.

Components come from ``subspace``: of a table, the driver has blocks of genes x wanted components at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import cluster_label, log1p_per_total, log1p_value
from cytomosaic.operators.genes import present_moments, squares_with_zeros
from cytomosaic.operators.subspace import columns, leading, project
from cytomosaic.session import cut_lineage

# fixed values
MAX_COMPONENTS = 50
N_CLUSTERS = 10
SEED = 42
N_PRINCIPAL_VECTORS = 30
MIN_COSINE = 0.3

#: Genes up to which their list is sent to every task (some 30 bytes each), and which a dense product may have.
SENT_GENES, MAX_GENES = 500_000, 20_000
#: Standard deviation over mean below which values are the same but for rounding.
SAME = 1e-9


def log_normalise(expression: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """log1p of counts per 10,000, the total taken over the given genes only."""
    used = expression if genes is None else expression.join(genes.select("gene"), "gene", "left_semi")
    totals = used.groupBy("cell_id").agg(F.sum("value").alias("_total"))
    return used.join(totals, "cell_id").select("cell_id", "gene", log1p_per_total("value", "_total").alias("value"))


def l2_normalise(expression: DataFrame) -> DataFrame:
    norms = expression.groupBy("cell_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    return expression.join(norms, "cell_id").select(
        "cell_id", "gene", F.when(F.col("_norm") == 0, F.col("value")).otherwise(F.col("value") / F.col("_norm")).alias("value")
    )


def gene_moments(expression: DataFrame, n_cells) -> DataFrame:
    """Mean and population standard deviation per gene over ``n_cells`` cells, absent values counting as zero."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    spread = expression.groupBy("gene").agg(*present_moments())
    return spread.select("gene", (F.col("_mean") * F.col("_n") / n).alias("mean"), F.sqrt(squares_with_zeros(n) / n).alias("sd"))


def z_scores(expression: DataFrame, cells: DataFrame) -> DataFrame:
    """Z-score of every present value, and the score an absent value has, per gene: (cell_id, gene, value, zero_score).

    Genes that do not vary are dropped, since they have no score.
    """
    n = cells.agg(F.count(F.lit(1))).scalar()
    moments = gene_moments(expression, n).filter(F.col("sd") > SAME * F.abs("mean"))
    return expression.join(moments, "gene").select(
        "cell_id", "gene", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("value"), (-F.col("mean") / F.col("sd")).alias("zero_score")
    )


def gene_rows(expression: DataFrame, genes: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """(cell_id, at, value): a sparse row for each cell, ``at`` being places in ``genes``; cells without counts only if
    ``cells`` is given.

    Counts have one row per cell and gene, so a cell's rows are at most as many as there are genes.
    """
    places = expression.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, _i int")
    held = expression.join(F.broadcast(places) if len(genes) <= SENT_GENES else places, "gene")
    held = held.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("_i", "value"))).alias("_held"))
    if cells is not None:
        held = cells.select("cell_id").join(held, "cell_id", "left").withColumn("_held", F.coalesce("_held", F.array()))
    return held.select("cell_id", F.transform("_held", lambda s: s._i).alias("at"), F.transform("_held", lambda s: s.value).alias("value"))


def gene_vectors(expression: DataFrame, genes: Sequence[str], cells: DataFrame | None = None) -> DataFrame:
    """One dense array per cell, in the order of ``genes``, zeros filled in, for a few genes."""
    if len(genes) > MAX_GENES:
        raise ValueError(f"{len(genes)} genes; dense vectors are limited to {MAX_GENES}")
    rows = gene_rows(expression, genes, cells)
    zeros = F.array_repeat(F.lit(0.0), len(genes))
    entries = F.map_from_arrays("at", "value")
    return rows.select("cell_id", F.transform(zeros, lambda z, i: F.coalesce(F.try_element_at(entries, i), z)).alias("features"))


def product_table(vectors: DataFrame, width: int) -> DataFrame:
    """(i, j, v) with v the sum over rows of x_i * x_j; index ``width`` stands for a column of ones.

    Each task adds up its own product matrix, then entries are summed by position.
    """
    if width > MAX_GENES:
        raise ValueError(f"width {width} exceeds {MAX_GENES}")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        seen = False
        for batch in batches:
            if len(batch):
                x = np.stack(batch["features"].to_numpy())
                x = np.hstack([x, np.ones((len(x), 1))])  # the extra column yields sums and the row count
                total += x.T @ x
                seen = True
        if seen:
            for i, row in enumerate(total):
                yield pd.DataFrame({"i": [i], "row": [row]})

    parts = vectors.select("features").mapInPandas(partial, "i int, row array<double>")
    return parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def pca(rows: DataFrame, width: int, n_components: int = MAX_COMPONENTS, centred: bool = True) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scores, loadings and explained variances of sparse or dense rows; without centring this is a truncated SVD."""
    found = columns(rows, width)
    k = max(1, min(n_components, found.n - 1, width - 1))
    shift = found.mean if centred else None
    values, loadings = leading(rows, width, k, shift)
    return project(rows, loadings, shift), loadings, values / max(found.n, 1)


def fit_clusters(scores: DataFrame, k: int = N_CLUSTERS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """KMeans: (cell_id, label) with labels 1..k as text, and (label, centre)."""
    # KMeans reads its input once per iteration
    rows = cut_lineage(scores.select("cell_id", "features")).select("cell_id", array_to_vector("features").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="_cluster").fit(rows)
    centres = [(str(i + 1), [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    labels = model.transform(rows).select("cell_id", cluster_label("_cluster").alias("label"))
    return labels, scores.sparkSession.createDataFrame(centres, "label string, centre array<double>")


def cluster(scores: DataFrame, k: int = N_CLUSTERS, seed: int = SEED) -> DataFrame:
    """KMeans labels 1..k as text."""
    return fit_clusters(scores, k, seed)[0]


def misplaced(rows: DataFrame, labels: DataFrame, centres: DataFrame) -> DataFrame:
    """(n_cells, n_misplaced, few_groups): cells nearer to another centre than to their own label's, and whether every label
    has a centre. Centres are as many as groups, whose number is an argument."""
    listed = centres.agg(F.collect_list(F.struct("label", "centre"))).scalar()

    def apart(centre) -> Column:
        return F.aggregate(F.zip_with("features", centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    far = F.transform(F.col("_centres"), lambda g: F.struct(apart(g.centre).alias("d"), g.label.alias("label")))
    own = F.get(F.filter("_far", lambda g: g.label == F.col("label")), F.lit(0)).d
    least = F.array_min(F.transform("_far", lambda g: g.d))
    checked = rows.select("cell_id", "features").join(labels, "cell_id").withColumn("_centres", listed).withColumn("_far", far)
    return checked.agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(own > least * (1 + 1e-9) + 1e-12).alias("n_misplaced"), F.coalesce(F.every(own.isNotNull()), F.lit(True)).alias("few_groups")
    )


def correct_and_cluster(expression: DataFrame, genes: Sequence[str], all_cells: DataFrame, k: int = N_CLUSTERS) -> DataFrame:
    """Clusters of corrected counts: log, unit length, uncentred components, KMeans. Cells without a row get NULL."""
    logged = expression.withColumn("value", log1p_value("value"))
    rows = cut_lineage(gene_rows(l2_normalise(logged), genes))  # read once in each pass
    scores, _, _ = pca(rows, len(genes), MAX_COMPONENTS, centred=False)
    labels = cluster(scores, k).withColumnRenamed("label", f"cluster_split_{k}")
    return all_cells.select("cell_id").join(labels, "cell_id", "left")


@dataclass(frozen=True)
class Alignment:
    """Common directions of two datasets: loadings of the first set's principal vectors and their cosines."""

    loadings: np.ndarray
    cosines: np.ndarray


def principal_vectors(source: np.ndarray, target: np.ndarray, min_cosine: float = MIN_COSINE) -> Alignment:
    """Principal vectors between the leading components of two sets over the same genes, given as columns.

    The singular vectors of Ps·Ptᵀ rotate each set's components so that they pair up; the singular values are the
    cosines of the pairs. Pairs above ``min_cosine`` are kept, one at least.
    """
    u, cosines, _ = np.linalg.svd(source.T @ target)
    kept = max(1, int((cosines > min_cosine).sum()))
    return Alignment((source @ u)[:, :kept], cosines)
