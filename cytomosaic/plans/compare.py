"""Comparison of communication between conditions, from edge lists to result tables."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cytomosaic.operators import metrics as M
from cytomosaic.operators import stats as S
from cytomosaic.session import cut_lineage

TRIPLET = ("lr_pair", "sender_type", "receiver_type")


@dataclass
class Comparison:
    sample_metrics: DataFrame
    celltype_metrics: DataFrame | None = None
    pairs: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    celltype_pairs: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    stacked: DataFrame | None = None
    summary: DataFrame | None = None


def compare(
    edges: DataFrame,
    samples: DataFrame,
    types: DataFrame | None = None,
    attention_threshold: float | None = None,
    n_perm: int = 10_000,
    n_boot: int = 2_000,
    fdr_alpha: float = 0.05,
    min_presence: int = 2,
    min_edges: int = 10,
) -> Comparison:
    """All pairwise comparisons of conditions; with one condition only the metrics.

    ``samples`` = (sample, condition, n_cells); ``types`` = (cell_id, cell_type) and, where ids repeat between samples,
    a ``sample`` column.
    """
    strong = M.attention_filter(edges, attention_threshold)
    # each metrics table is read once per comparison, so it is written once; it has one row per sample and feature
    out = Comparison(cut_lineage(M.sample_metrics(strong, samples)))
    if types is not None:
        typed = M.annotate_endpoints(strong, types, [c for c in ("sample",) if c in types.columns])
        out.celltype_metrics = cut_lineage(M.celltype_metrics(typed, samples, min_edges))
    groups = S.samples_by_condition(out.sample_metrics)
    settings = dict(n_perm=n_perm, n_boot=n_boot, fdr_alpha=fdr_alpha, min_presence=min_presence)
    for a, b in itertools.combinations(groups, 2):
        out.pairs[a, b] = S.compare_conditions(out.sample_metrics, a, b, groups[a], groups[b], **settings)
    if out.celltype_metrics is not None:
        typed_groups = S.samples_by_condition(out.celltype_metrics)
        for a, b in itertools.combinations(typed_groups, 2):
            out.celltype_pairs[a, b] = S.compare_conditions(
                out.celltype_metrics, a, b, typed_groups[a], typed_groups[b], features=TRIPLET, **settings
            )
    if out.pairs:
        out.stacked = S.combined_fdr(out.pairs)
        out.summary = S.significant_summary(out.stacked)
    return out
