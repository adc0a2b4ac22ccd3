"""Segmentation output to cells, counts and outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytomosaic.operators.cells import molecules_to_cells, molecules_to_counts
from cytomosaic.sources import readers as R


def load_segmentation(spark: SparkSession, folder: str, genes: DataFrame, name: str = R.SEGMENTATION_FILE) -> dict[str, DataFrame]:
    """Tables ``cells``, ``expression``, ``genes`` and, if polygons were written, ``rings``."""
    molecules = R.read_segmentation(spark, folder, name)
    out = {
        "cells": molecules_to_cells(molecules),
        "expression": molecules_to_counts(molecules, genes).withColumn("layer", F.lit("raw")),
        "genes": genes.select("gene", "ord").withColumn("is_imputed", F.lit(False)),
    }
    files = R.polygon_files(spark, folder)
    if files:
        # a cell in several files keeps the outline of the file that comes last
        parts = [R.read_geojson_polygons(spark, f).withColumn("_file", F.lit(i)) for i, f in enumerate(files)]
        rings = parts[0]
        for part in parts[1:]:
            rings = rings.union(part)
        out["rings"] = rings.groupBy("cell_id").agg(F.max_by("ring", "_file").alias("ring"))
    return out
