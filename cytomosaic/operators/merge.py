"""Several datasets on one canvas: offsets, prefixed ids, combined gene lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.functions.scalar import prefixed
from cytomosaic.operators.cells import bounding_box

# fixed values
GAP = 200.0
LAYOUTS = ("row", "column", "grid")


def layout_offsets(boxes: DataFrame, layout: str = "row", gap: float = GAP) -> DataFrame:
    """Shift of each dataset so that none overlap; ``boxes`` = (dataset, dataset_ord, extent), one row per dataset."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}; choose one of {LAYOUTS}")
    width, height = F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")
    # these windows run over one row per dataset
    before = W.Window.orderBy("dataset_ord").rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy(F.lit(0))
    if layout == "grid":
        place = F.row_number().over(W.Window.orderBy("dataset_ord")) - 1
        columns = F.ceil(F.sqrt(F.count(F.lit(1)).over(whole)))
        left = (place % columns) * (F.max(width).over(whole) + gap)
        top = F.floor(place / columns) * (F.max(height).over(whole) + gap)
    else:
        side = width if layout == "row" else height
        start = F.coalesce(F.sum(side + gap).over(before), F.lit(0.0))
        left, top = (start, F.lit(0.0)) if layout == "row" else (F.lit(0.0), start)
    return boxes.select("dataset", "dataset_ord", (left - F.col("x_min")).alias("dx"), (top - F.col("y_min")).alias("dy"))


def dataset_boxes(cells: DataFrame) -> DataFrame:
    return bounding_box(cells, ["dataset", "dataset_ord"])


def place(df: DataFrame, offsets: DataFrame, ids: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Shift ``x`` and ``y`` by the dataset's offset and prefix the id columns with the dataset's label.

    ``offsets`` has one row per input dataset, a list the caller typed in.
    """
    out = df.join(F.broadcast(offsets.select("dataset", "dx", "dy")), "dataset")
    if "x" in df.columns:
        out = out.withColumn("x", F.col("x") + F.col("dx")).withColumn("y", F.col("y") + F.col("dy"))
    for c in ids:
        out = out.withColumn(c, prefixed("dataset", c))
    return out.drop("dx", "dy")


def stack(tables: Sequence[DataFrame], labels: Sequence[str]) -> DataFrame:
    """Tables one after another with ``dataset`` and ``dataset_ord``; columns a table lacks are NULL."""
    if len(tables) != len(labels):
        raise ValueError("one label per dataset is needed")
    tagged = [
        t.withColumn("dataset", F.lit(label)).withColumn("dataset_ord", F.lit(i))
        for i, (t, label) in enumerate(zip(tables, labels, strict=True))
    ]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
