"""Per-sample ligand-receptor metrics from a cell-to-cell communication edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytomosaic.functions.scalar import lr_pair
from cytomosaic.session import cut_lineage

METRIC_COLUMNS = ["n_edges", "normalized_freq", "mean_attention", "sender_fraction", "presence"]


def attention_filter(edges: DataFrame, threshold: float | None) -> DataFrame:
    """Keep edges scoring at least ``threshold``; no threshold, or one that is not positive, keeps all."""
    if threshold is None or threshold <= 0:
        return edges
    return edges.filter(F.col("attention_score") >= threshold)


def with_lr_pair(edges: DataFrame) -> DataFrame:
    return edges.withColumn("lr_pair", lr_pair("ligand", "receptor"))


def last_label(annotations: DataFrame, key: str = "barcode", label: str = "cell_type", order: str = "file_ord") -> DataFrame:
    """One label per barcode: the one that comes last in the file."""
    return annotations.groupBy(key).agg(F.max_by(label, order).alias(label))


def annotate_endpoints(edges: DataFrame, types: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Add ``from_type`` and ``to_type``; ``types`` holds one row per ``cell_id`` (and per column in ``on``)."""
    on = on or []
    names = edges.columns
    for end in ("from", "to"):  # the order of columns of both joins
        names = [*on, f"{end}_cell", *[c for c in names if c not in (*on, f"{end}_cell")], f"{end}_type"]
    for end in ("to", "from"):  # by senders last: rows then stand as they are wanted when distinct senders are counted
        side = types.select(*on, F.col("cell_id").alias(f"{end}_cell"), F.col("cell_type").alias(f"{end}_type"))
        edges = edges.join(side, [*on, f"{end}_cell"], "left")
    return edges.select(*names)


def drop_untyped(edges: DataFrame) -> DataFrame:
    return edges.dropna(subset=["from_type", "to_type"])


def totals_per_sample(counts: DataFrame) -> DataFrame:
    """Edge totals from already grouped counts; edges without a pair name still count."""
    return counts.groupBy("sample").agg(F.sum("n_edges").alias("total_edges"))


def _grouped(edges: DataFrame, features: list[str]) -> DataFrame:
    score = F.nanvl("attention_score", F.lit(None).cast("double"))
    return edges.groupBy("sample", *features).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.avg(score).alias("mean_attention"),
        F.countDistinct("from_cell").alias("n_unique_senders"),
    )


def _with_totals(edges: DataFrame, features: list[str], written: bool) -> DataFrame:
    """Groups and the edges of their sample, made once: a row for each sample and feature, against all edges."""
    grouped = _grouped(edges, features)
    if not written:  # a sample's groups stand together, as many as it has features
        total = F.sum("n_edges").over(Window.partitionBy("sample"))
        return grouped.filter("sample IS NOT NULL").withColumn("total_edges", total)
    grouped = cut_lineage(grouped)
    return grouped.join(totals_per_sample(grouped), "sample")


def _metrics(edges: DataFrame, samples: DataFrame, features: list[str], min_edges: int, written: bool = True) -> DataFrame:
    # one row per sample in these lookups: adaptive execution broadcasts them by measured size
    return (
        _with_totals(edges, features, written)
        .dropna(subset=features)
        .filter(F.col("n_edges") >= min_edges)
        .join(samples, "sample", "left")
        .select(
            "sample",
            "condition",
            *features,
            "n_edges",
            (F.col("n_edges") / F.col("total_edges")).alias("normalized_freq"),
            "mean_attention",
            F.try_divide("n_unique_senders", "n_cells").alias("sender_fraction"),
            F.lit(1).alias("presence"),
        )
    )


def sample_metrics(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per (sample, lr_pair). ``samples`` = (sample, condition, n_cells)."""
    return _metrics(with_lr_pair(edges), samples, ["lr_pair"], 1, written=False)


def celltype_metrics(typed_edges: DataFrame, samples: DataFrame, min_edges: int = 10) -> DataFrame:
    """One row per (sample, lr_pair, sender_type, receiver_type) with at least ``min_edges`` edges.

    The frequency's denominator counts all typed edges of the sample, before the minimum is applied.
    """
    named = (
        drop_untyped(with_lr_pair(typed_edges))
        .withColumnRenamed("from_type", "sender_type")
        .withColumnRenamed("to_type", "receiver_type")
    )
    return _metrics(named, samples, ["lr_pair", "sender_type", "receiver_type"], min_edges)


def sample_roster(samples: DataFrame) -> DataFrame:
    """Samples of each condition, in name order."""
    return samples.groupBy("condition").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.array_join(F.array_sort(F.collect_list("sample")), ",").alias("sample_names"),
    )
