"""Writers. ``overwrite=False`` refuses to touch an existing output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import clean_fov, label_text
from cytomosaic.operators.indexing import dense_index
from cytomosaic.operators.stats import stack_results
from cytomosaic.session import cut_lineage


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_table(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(_mode(overwrite))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_csv(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode(_mode(overwrite)).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
    return path


def write_comparison(comparison, folder: str, overwrite: bool = False) -> list[str]:
    """Result tables of a comparison: metrics, one table per pair of conditions, and the significant rows of all."""
    folder = folder.rstrip("/")
    out = [write_csv(comparison.sample_metrics, f"{folder}/sample_metrics.csv", overwrite)]
    if comparison.celltype_metrics is not None and not comparison.celltype_metrics.isEmpty():
        out.append(write_csv(comparison.celltype_metrics, f"{folder}/celltype_metrics.csv", overwrite))
    for pairs, kind in ((comparison.pairs, "freq"), (comparison.celltype_pairs, "celltype")):
        for (a, b), df in pairs.items():
            if not df.isEmpty():
                out.append(write_csv(df.orderBy("perm_pval"), f"{folder}/{a}_vs_{b}_{kind}.csv", overwrite))
    if comparison.summary is not None and not comparison.summary.isEmpty():
        out.append(write_csv(comparison.summary, f"{folder}/summary.csv", overwrite))
    return out


def write_stacked(results: dict, path: str, overwrite: bool = False) -> str:
    """All comparisons in one parquet table, a folder per comparison."""
    return write_table(stack_results(results), path, overwrite, ["comparison"])


def write_annotation(cells: DataFrame, column: str, path: str, overwrite: bool = False) -> str | None:
    """(cell id, cell_type) as CSV; numeric labels lose their fraction. Without the column nothing is written."""
    if column not in cells.columns:
        return None
    text = label_text(column, dict(cells.dtypes)[column])
    return write_csv(cells.select(F.col("cell_id").alias("cell"), text.alias("cell_type")), path, overwrite)


def write_transferred(identities: DataFrame, path: str, overwrite: bool = False) -> str:
    return write_csv(identities.select("query_cell_id", "transferred_identity"), path, overwrite)


def indexed_triplets(expression: DataFrame, cells: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One-based (row, column, value) with the gene and cell lists that give the positions; genes are rows."""
    # the numbers go both into the entries and into the lists, so each list is made once
    cell_list = cut_lineage(dense_index(cells.select("cell_id").distinct(), "cell_id", "column", start=1))
    gene_list = cut_lineage(dense_index(genes.select("gene").distinct(), "gene", "row", start=1))
    triplets = expression.join(gene_list, "gene").join(cell_list, "cell_id").select("row", "column", "value")
    return triplets, gene_list, cell_list


def write_triplets(expression: DataFrame, cells: DataFrame, genes: DataFrame, folder: str, overwrite: bool = False) -> dict[str, str]:
    """A matrix as three text tables: entries ordered by column and row, gene names and cell names ordered by position."""
    folder = folder.rstrip("/")
    triplets, gene_list, cell_list = indexed_triplets(expression, cells, genes)
    return {
        "matrix": write_csv(triplets.orderBy("column", "row"), f"{folder}/matrix", overwrite),
        "genes": write_csv(gene_list.orderBy("row").select("row", "gene"), f"{folder}/genes", overwrite),
        "cells": write_csv(cell_list.orderBy("column").select("column", "cell_id"), f"{folder}/cells", overwrite),
    }


def write_matrix_market(expression: DataFrame, cells: DataFrame, genes: DataFrame, folder: str) -> dict[str, object]:
    """The text form of a matrix, genes as rows: a head, entries in part files, and the two name lists in order."""
    folder = folder.rstrip("/")
    triplets, gene_list, cell_list = indexed_triplets(expression, cells, genes)
    triplets = cut_lineage(triplets)  # counted for the head, and written
    parts = [F.col(c).cast("string") for c in ("row", "column", "value")]
    sizes = [gene_list.agg(F.count(F.lit(1))).scalar(), cell_list.agg(F.count(F.lit(1))).scalar(), F.count(F.lit(1))]
    size_line = triplets.agg(F.concat_ws(" ", *[n.cast("string") for n in sizes]).alias("value"))
    banner = expression.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",)], "value string")
    out = {"matrix": [f"{folder}/matrix/1-head", f"{folder}/matrix/2-entries"], "genes": f"{folder}/genes", "cells": f"{folder}/cells"}
    banner.union(size_line).coalesce(1).write.text(out["matrix"][0])  # two lines
    triplets.select(F.concat_ws(" ", *parts).alias("value")).write.text(out["matrix"][1])
    gene_list.orderBy("row").select("gene").write.text(out["genes"])
    cell_list.orderBy("column").select("cell_id").write.text(out["cells"])
    return out


def export_geometry(cells: DataFrame, boundaries: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Centroids (0 where absent) and outline vertices of the kept cells only."""
    zero = F.lit(0.0)
    at = cells.select("cell_id", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    kept = None if boundaries is None else boundaries.join(cells.select("cell_id"), "cell_id", "left_semi")
    return at, kept


STAGED, PLANNED, OLD = "_staged-", "_planned-", "_old-"  # names with an underscore are no data to Spark's readers


class _Folder:
    """A table's folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._path(self.root)):
            return []
        found = [f.getPath().getName() for f in self.fs.listStatus(self._path(self.root))]
        return sorted(n for n in found if n.startswith(prefix))

    def leaves(self, name: str, depth: int) -> list[str]:
        """Partition folders so many levels below, as their places in the table."""
        level = [""]
        for _ in range(depth):
            listed = [(p, f) for p in level for f in self.fs.listStatus(self._path(f"{self.root}/{name}/{p}"))]
            level = [f"{p}/{f.getPath().getName()}".lstrip("/") for p, f in listed if f.isDirectory()]
        return sorted(level)

    def rename(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"{source} could not become {target} in {self.root}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def recover(spark: SparkSession, path: str, depth: int = 1) -> None:
    """Brings a table's folder to rest after a publish that broke off: a planned switch is completed, a staged write without
    a plan is dropped. Nothing happens to a folder at rest."""
    folder = _Folder(spark, path)
    for plan in folder.names(PLANNED):
        tag = plan.removeprefix(PLANNED)
        staged = f"{STAGED}{tag}"
        for leaf in folder.leaves(staged, depth) if folder.fs.exists(folder.at(staged)) else []:
            if folder.fs.exists(folder.at(leaf)):
                folder.rename(leaf, f"{OLD}{tag}/{leaf}")
            folder.rename(f"{staged}/{leaf}", leaf)
        folder.delete(plan)
    for prefix in (STAGED, OLD):
        for name in folder.names(prefix):
            folder.delete(name)


def publish(df: DataFrame, path: str, keys: list[str]) -> str:
    """Replace the partitions by ``keys`` that are present in ``df`` and leave all others as they are, in two phases.

    Everything is written beside the table first, so a job that fails leaves the table as it was, and ``df`` may read from
    it. Then a plan is put down, which is the moment of the switch: from there on ``recover`` (or the next publish) completes
    what a lost driver left undone. One writer at a time is taken for granted.
    """
    spark = df.sparkSession
    recover(spark, path, len(keys))
    folder, tag = _Folder(spark, path), uuid.uuid4().hex[:12]
    df.write.partitionBy(*keys).parquet(f"{folder.root}/{STAGED}{tag}")
    folder.fs.mkdirs(folder.at(f"{PLANNED}{tag}"))
    recover(spark, path, len(keys))
    return path


def write_layer(expression: DataFrame, path: str) -> str:
    """Replace the layers present in ``expression`` and leave all others as they are."""
    return publish(expression, path, ["layer"])


def write_labels(labels: DataFrame, path: str) -> str:
    """Label cache: replaces the (dataset, method) pairs present in ``labels`` only."""
    return publish(labels, path, ["dataset", "method"])


def write_per_fov(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """One folder per field of view, its name cleaned; rows without one are left out."""
    named = df.filter(F.col("fov").isNotNull()).withColumn("fov", clean_fov("fov"))
    return write_table(named, path, overwrite, ["fov"])


def write_names(df: DataFrame, column: str, path: str, overwrite: bool = False) -> str:
    """One name per line."""
    df.select(F.col(column).cast("string")).write.mode(_mode(overwrite)).text(path)
    return path
