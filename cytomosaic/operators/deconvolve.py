"""Cell-type mixtures per cell by least squares, removal of the second type's share, and labels from weights.

The mixture is found by non-negative least squares on one or two types; it is this package's own definition and not a
likelihood model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.functions.scalar import clip_negative

# fixed values
MODES = ("full", "doublet", "multi")
MIN_SECOND_SHARE = 0.2

MAX_TYPES = 500
BROADCAST_BYTES = 64 << 20


def reference_profiles(reference_expression: DataFrame, reference_labels: DataFrame) -> DataFrame:
    """(label, gene, mu): mean over the type's cells of count / cell total, cells without the gene counting as zero."""
    totals = reference_expression.groupBy("ref_cell").agg(F.sum("value").alias("_total")).filter(F.col("_total") > 0)
    sizes = reference_labels.groupBy("label").agg(F.count(F.lit(1)).alias("_cells"))
    shares = reference_expression.join(totals, "ref_cell").join(reference_labels, "ref_cell")
    sums = shares.groupBy("label", "gene").agg(F.sum(F.col("value") / F.col("_total")).alias("_sum"))
    return sums.join(sizes, "label").select("label", "gene", (F.col("_sum") / F.col("_cells")).alias("mu"))


def profile_table(profiles: DataFrame) -> tuple[list[str], DataFrame, np.ndarray]:
    """Type names, one array of type means per gene, and the types' products G = MᵀM.

    Panel genes x types numbers reach the driver; the number of types is checked.
    """
    types = [r.label for r in profiles.select("label").distinct().orderBy("label").limit(MAX_TYPES + 1).collect()]
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types")
    wide = profiles.groupBy("gene").pivot("label", types).agg(F.first("mu")).fillna(0.0)
    table = wide.select("gene", F.array(*[F.col(f"`{t}`") for t in types]).alias("mu"))
    rows = np.array([r.mu for r in table.select("mu").collect()]).reshape(-1, len(types))
    return types, table, rows.T @ rows


def type_products(expression: DataFrame, table: DataFrame, n_types: int) -> DataFrame:
    """Per cell: x·mu for every type, and x·x, over the genes that have a profile."""
    value = F.col("value")
    sums = [F.sum(value * F.get("mu", F.lit(i))).alias(f"_{i}") for i in range(n_types)]
    out = expression.join(table, "gene").groupBy("cell_id").agg(F.sum(value * value).alias("xx"), *sums)
    return out.select("cell_id", "xx", F.array(*[F.col(f"_{i}") for i in range(n_types)]).alias("d"))


def _best_pairs(xx: np.ndarray, d: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """Residual, types and weights of the best mixture of at most two types, for each row of type products ``d``.

    Weights are those of non-negative least squares; residuals are compared at nine decimals, the first pair on a tie.
    """
    n, rows = len(g), len(d)
    best = np.full(rows, np.inf)
    kept = {name: np.zeros(rows, dtype=int if name in "ab" else float) for name in ("a", "b", "wa", "wb")}
    at = np.arange(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a in range(n):
            others = np.arange(a + (n > 1), n)
            if not len(others):
                break
            gaa, gab, gbb = g[a, a], g[a, others], g[others, others]
            da, db = d[:, a : a + 1], d[:, others]
            det = gaa * gbb - gab * gab
            solvable = (others != a) & (det > 1e-12 * gaa * gbb)
            wa, wb = (da * gbb - db * gab) / det, (db * gaa - da * gab) / det
            only_a = da / gaa if gaa else np.zeros_like(da)
            only_b = np.where(gbb != 0, db / gbb, 0.0)
            both = solvable & (wa > 0) & (wb > 0)
            a_alone = (others == a) | (only_a * da >= only_b * db)
            wa = np.where(both, wa, np.where(a_alone, only_a, 0.0))
            wb = np.where(both, wb, np.where(a_alone, 0.0, only_b))
            residual = np.round(xx[:, None] - wa * da - wb * db, 9)
            least = residual.argmin(axis=1)
            value = residual[at, least]
            better = value < best
            best[better] = value[better]
            for name, found in (("a", np.full(rows, a)), ("b", others[least]), ("wa", wa[at, least]), ("wb", wb[at, least])):
                kept[name][better] = found[better]
    return best, kept["a"], kept["b"], kept["wa"], kept["wb"]


#: Cells whose pairs of types are tried side by side.
CELLS_AT_ONCE = 1_000


def doublet_fit(expression: DataFrame, profiles: DataFrame) -> DataFrame:
    """Best mixture of at most two types per cell.

    (cell_id, first_type, second_type, first_weight, second_weight, residual); ``second_type`` is NULL if its weight is 0.
    Ties go to the pair first in name order. All pairs of types are tried in batches of cells, without a further shuffle;
    the types' products, checked in number, go to every task once.
    """
    types, table, g = profile_table(profiles)
    fitted = type_products(expression, table, len(types))
    shipped = expression.sparkSession.sparkContext.broadcast((types, g))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, products = shipped.value
        listed = np.array([*names, None], dtype=object)
        for batch in batches:
            for start in range(0, len(batch), CELLS_AT_ONCE):
                part = batch.iloc[start : start + CELLS_AT_ONCE]
                residual, a, b, wa, wb = _best_pairs(part["xx"].to_numpy(), np.stack(part["d"].to_numpy()), products)
                first, light = np.where(wa >= wb, a, b), np.minimum(wa, wb)
                second = np.where(light > 0, np.where(wa >= wb, b, a), len(names))
                yield pd.DataFrame({
                    "cell_id": part["cell_id"], "first_type": listed[first], "second_type": listed[second],
                    "first_weight": np.maximum(wa, wb), "second_weight": light, "residual": residual,
                })

    kind = dict(fitted.dtypes)["cell_id"]
    return fitted.mapInPandas(
        run, f"cell_id {kind}, first_type string, second_type string, first_weight double, second_weight double, residual double"
    )


def second_share() -> Column:
    return F.coalesce(F.try_divide("second_weight", F.col("first_weight") + F.col("second_weight")), F.lit(0.0))


def remove_ambient(
    expression: DataFrame, fit: DataFrame, profiles: DataFrame, purify_singlets: bool = True,
    min_second_share: float = MIN_SECOND_SHARE,
) -> DataFrame:
    """Counts reduced to the first type's share w1·mu1 / (w1·mu1 + w2·mu2), never below zero; zeros are left out.

    Cells whose second type has less than ``min_second_share`` of the weight are singlets and change only if asked.
    Genes without a profile stay as they are.
    """
    mixed = F.col("second_type").isNotNull()
    if not purify_singlets:
        mixed = mixed & (second_share() >= min_second_share)

    # an unmixed cell has no second weight left, so its share is one
    parts = fit.select(
        "cell_id", "first_type", "second_type", F.when(mixed, F.col("first_weight")).alias("first_weight"), F.when(mixed, F.col("second_weight")).alias("second_weight")
    )
    types, table, _ = profile_table(profiles)
    # one row for each gene with the means of all types: genes and types are counted, so it is sent if it is small
    small = table.count() * len(types) * 8 <= BROADCAST_BYTES
    rows = expression.join(parts, "cell_id").join(F.broadcast(table) if small else table, "gene", "left")
    names = F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")

    def mean_of(which: str) -> Column:
        return F.coalesce(F.get("mu", F.array_position(names, F.col(which)).cast("int") - 1), F.lit(0.0))

    own = F.col("first_weight") * mean_of("first_type")
    other = F.col("second_weight") * mean_of("second_type")
    share = F.coalesce(F.try_divide(own, own + other), F.lit(1.0))
    return rows.select("cell_id", "gene", clip_negative(F.col("value") * share).alias("value")).filter(F.col("value") > 0)


def linear_annotate(cells: DataFrame, expression: DataFrame, coefficients: DataFrame, intercepts: dict[str, float]) -> DataFrame:
    """Class with the highest linear score per cell, ties by name: (cell_id, label, score).

    ``coefficients`` = (gene, class, weight); ``intercepts`` names the classes. A cell without any listed gene is scored
    by the intercepts.
    """
    classes = sorted(intercepts)
    wide = coefficients.groupBy("gene").pivot("class", classes).agg(F.sum("weight")).fillna(0.0)
    table = wide.select("gene", F.array(*[F.col(f"`{c}`") for c in classes]).alias("w"))
    sums = [F.sum(F.col("value") * F.get("w", F.lit(i))).alias(f"_{i}") for i in range(len(classes))]
    scored = cells.select("cell_id").join(expression.join(table, "gene").groupBy("cell_id").agg(*sums), "cell_id", "left")
    options = [
        F.struct((-F.round(F.coalesce(f"_{i}", F.lit(0.0)) + F.lit(float(intercepts[c])), 9)).alias("loss"), F.lit(c).alias("label"))
        for i, c in enumerate(classes)
    ]
    return scored.select("cell_id", F.array_min(F.array(*options)).alias("_b")).select(
        "cell_id", "_b.label", (-F.col("_b.loss")).alias("score")
    )


def label_from_weights(weights: DataFrame, mode: str = "full", min_weight: float = 0.1) -> DataFrame:
    """Labels from (cell_id, cell_type, weight).

    ``full``: the heaviest type. ``doublet``: the heaviest and the second one. ``multi``: all types above ``min_weight``,
    heaviest first.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose one of {MODES}")
    if mode == "full":
        best = F.min_by("cell_type", F.struct(-F.col("weight"), "cell_type"))
        return weights.groupBy("cell_id").agg(best.alias("label"))
    place = F.row_number().over(W.Window.partitionBy("cell_id").orderBy(F.col("weight").desc(), "cell_type"))
    ranked = weights.withColumn("_p", place)
    if mode == "doublet":
        return ranked.filter(F.col("_p") <= 2).groupBy("cell_id").agg(
            F.max(F.when(F.col("_p") == 1, F.col("cell_type"))).alias("label"),
            F.max(F.when(F.col("_p") == 2, F.col("cell_type"))).alias("second_label"),
        )
    kept = ranked.filter(F.col("weight") > min_weight)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_p", "cell_type"))), lambda s: s.cell_type)
    return kept.groupBy("cell_id").agg(F.array_join(listed, ",").alias("label"))

