"""Gene lists, expression layers and their combination.

``genes`` = (gene, ord, is_imputed); ``expression`` = (cell_id, gene, value) with zeros left out; a ``layer`` column
takes the values raw, corrected, imputed and corr_imputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import tag_gene, whole_counts

# fixed values
HVG_TOP = 200
MIN_SHARED_FOR_CORRECTION = 10
RAW, CORRECTED, IMPUTED, CORR_IMPUTED = "raw", "corrected", "imputed", "corr_imputed"


def panel_genes(genes: DataFrame, raw_imputed: DataFrame | None = None, corr_imputed: DataFrame | None = None) -> DataFrame:
    """Measured genes: not flagged as imputed and in neither list of imputed names."""
    out = genes.filter(~F.coalesce("is_imputed", F.lit(False))) if "is_imputed" in genes.columns else genes
    for listed in (raw_imputed, corr_imputed):
        if listed is not None:
            out = out.join(listed.select("gene"), "gene", "left_anti")
    return out


def active_imputed(raw_imputed: DataFrame, corr_imputed: DataFrame, use_corrected: bool) -> DataFrame:
    """The corrected list if asked for and not empty, else the raw list."""
    if not use_corrected:
        return raw_imputed.select("gene")
    has_corrected = corr_imputed.agg(F.count(F.lit(1)) > 0).scalar()
    return corr_imputed.select("gene").union(raw_imputed.select("gene").filter(~has_corrected))


def assemble_layers(
    expression: DataFrame,
    panel: DataFrame,
    raw_imputed: DataFrame,
    corr_imputed: DataFrame,
    use_corrected: bool,
    include_imputed: bool,
) -> DataFrame:
    """The main matrix and its parallel raw layer, as rows of (matrix, cell_id, gene, value).

    Main matrix ``X``: the panel in the corrected layer if asked for and present, else in the raw layer, followed by
    the active imputed genes if asked for. ``X_raw`` holds the raw panel (imputed genes are zero there, so absent) and
    exists only if the main matrix differs from the raw panel.
    """
    has_corrected = expression.agg(F.coalesce(F.max(F.col("layer") == CORRECTED), F.lit(False))).scalar() if use_corrected else F.lit(False)
    marked = expression.join(panel.select("gene", F.lit(True).alias("_panel")).distinct(), "gene", "left")
    differs, of_imputed = F.lit(use_corrected) & has_corrected, F.lit(False)
    if include_imputed:
        names = active_imputed(raw_imputed, corr_imputed, use_corrected)
        differs = differs | names.agg(F.count(F.lit(1)) > 0).scalar()
        marked = marked.join(names.select("gene", F.lit(True).alias("_imputed")).distinct(), "gene", "left")
        of_imputed = F.coalesce("_imputed", F.lit(False)) & F.col("layer").isin(IMPUTED, CORR_IMPUTED)
    of_panel = F.coalesce("_panel", F.lit(False))
    in_main = (of_panel & (F.col("layer") == F.when(has_corrected, CORRECTED).otherwise(RAW))) | of_imputed
    in_parallel = of_panel & (F.col("layer") == RAW) & differs
    # one pass over the counts: each row goes to neither, one or both matrices
    matrices = F.array_compact(F.array(F.when(in_main, F.lit("X")), F.when(in_parallel, F.lit("X_raw"))))
    return marked.select(F.explode(matrices).alias("matrix"), "cell_id", "gene", "value")


def active_layer(expression: DataFrame, wanted: str) -> DataFrame:
    """One row: ``wanted`` if that layer has rows, else raw."""
    found = F.coalesce(F.max(F.col("layer") == wanted), F.lit(False))
    return expression.agg(F.when(found, F.lit(wanted)).otherwise(F.lit(RAW)).alias("layer"))


def shared_genes(panel: DataFrame, reference: DataFrame, at_least: int = 1) -> DataFrame:
    """Genes in both tables, in name order; an error if there are fewer than ``at_least``."""
    both = panel.select("gene").intersect(reference.select("gene")).orderBy("gene")
    n = both.count()
    if n < at_least:
        raise ValueError(f"{n} shared genes, {at_least} needed")
    return both


def requested_genes(requested: DataFrame, reference: DataFrame, panel: DataFrame) -> DataFrame:
    """Status of each requested gene: already in the panel, missing from the reference, or to be imputed."""
    ref = reference.select("gene", F.lit(True).alias("_ref")).distinct()
    own = panel.select("gene", F.lit(True).alias("_own")).distinct()
    status = (
        F.when(F.col("_own"), F.lit("in_panel")).when(F.col("_ref").isNull(), F.lit("missing")).otherwise(F.lit("impute"))
    )
    return (
        requested.groupBy("gene")
        .agg(F.min("ord").alias("ord"))
        .join(ref, "gene", "left")
        .join(own, "gene", "left")
        .select("gene", "ord", status.alias("status"))
    )


def gene_variance(reference_expression: DataFrame, n_cells) -> DataFrame:
    """Sample variance per gene over ``n_cells`` cells, absent values counting as zero."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    spread = reference_expression.groupBy("gene").agg(*present_moments())
    return spread.select("gene", F.coalesce(F.try_divide(squares_with_zeros(n), n - 1), F.lit(0.0)).alias("variance"))


def present_moments() -> list[Column]:
    """Number, mean and squared deviations of the present values, for ``squares_with_zeros``."""
    n = F.count("value")
    return [n.alias("_n"), F.avg("value").alias("_mean"), (F.var_pop("value") * n).alias("_squares")]


def squares_with_zeros(n: Column) -> Column:
    """Squared deviations once the absent values join as zeros, up to ``n`` values in all.

    The two parts are merged by their means, which keeps the digits that a difference of large sums would lose.
    """
    return F.col("_squares") + F.col("_mean") * F.col("_mean") * F.col("_n") * (n - F.col("_n")) / n


def variable_genes(
    reference_genes: DataFrame, panel: DataFrame, reference_expression: DataFrame, n_cells,
    pool: int | None = None, top: int = HVG_TOP,
) -> DataFrame:
    """The ``top`` most variable non-panel genes; ``pool`` limits the candidates to so many in reference order."""
    candidates = reference_genes.join(panel.select("gene"), "gene", "left_anti").select("gene", "ord")
    if pool is not None:
        candidates = candidates.orderBy("ord").limit(pool)
    spread = gene_variance(reference_expression.join(candidates.select("gene"), "gene", "left_semi"), n_cells)
    return (
        candidates.join(spread, "gene", "left")
        .select("gene", "ord", F.coalesce("variance", F.lit(0.0)).alias("variance"))
        .orderBy(F.col("variance").desc(), "ord")
        .limit(top)
    )


def union_genes(genes: DataFrame) -> DataFrame:
    """Distinct genes of several datasets (dataset_ord, gene, ord, is_imputed), ranked by first appearance.

    The flag comes from the last dataset that has one, false if none has.
    """
    return genes.groupBy("gene").agg(
        F.min(F.struct("dataset_ord", "ord")).alias("first_seen"),
        F.coalesce(
            F.max_by("is_imputed", F.when(F.col("is_imputed").isNotNull(), F.col("dataset_ord"))), F.lit(False)
        ).alias("is_imputed"),
    )


def intersect_genes(genes: DataFrame, n_datasets: int) -> DataFrame:
    """Genes present in all datasets, ranked by their place in the first one."""
    return (
        genes.groupBy("gene")
        .agg(
            F.countDistinct("dataset_ord").alias("_n"),
            F.min(F.struct("dataset_ord", "ord")).alias("first_seen"),
            F.coalesce(
                F.max_by("is_imputed", F.when(F.col("is_imputed").isNotNull(), F.col("dataset_ord"))), F.lit(False)
            ).alias("is_imputed"),
        )
        .filter(F.col("_n") == n_datasets)
        .drop("_n")
    )


def append_imputed(
    expression: DataFrame, genes: DataFrame, imputed: DataFrame, targets: Sequence[str], corrected: bool
) -> tuple[DataFrame, DataFrame]:
    """Add imputed values under tagged gene names, as their own layer, and extend the gene list after its last place."""
    layer = CORR_IMPUTED if corrected else IMPUTED
    added = imputed.select("cell_id", tag_gene("gene", corrected).alias("gene"), "value", F.lit(layer).alias("layer"))
    last = genes.agg(F.coalesce(F.max("ord"), F.lit(-1))).scalar()
    spark = genes.sparkSession
    names = spark.createDataFrame([(g, i + 1) for i, g in enumerate(targets)], "gene string, _i int")
    extra = names.select(
        tag_gene("gene", corrected).alias("gene"), (last + F.col("_i")).cast("int").alias("ord"), F.lit(True).alias("is_imputed")
    )
    return expression.unionByName(added), genes.select("gene", "ord", "is_imputed").unionByName(extra)


def integer_counts(imputed: DataFrame) -> DataFrame:
    """Imputed values as whole counts: rounded half to even, below one dropped."""
    return imputed.withColumn("value", whole_counts("value")).filter(F.col("value") > 0)


def top_expressed(expression: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` highest genes of each cell, ties by name."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("value").desc(), "gene"))
    return expression.withColumn("place", place).filter(F.col("place") <= n)
