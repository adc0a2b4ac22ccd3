"""Comparison of features (ligand-receptor pairs, optionally with cell types) between two groups of samples."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from cytomosaic.functions.scalar import log2_fold_change, neg_log10
from cytomosaic.session import cut_lineage

# fixed values
SEED = 42
SIGNIFICANT_FDR = 0.05
EPS_WITHOUT_DATA = 1e-10


# --- wide form -------------------------------------------------------------------------------------------------------


def wide_columns(metrics: DataFrame, features: list[str], samples: Sequence[str], metric: str) -> DataFrame:
    """One row per feature and one column per sample, in the given order; mean on duplicates, 0 where absent."""
    wide = metrics.groupBy(*features).pivot("sample", list(samples)).agg(F.avg(metric))
    return wide.fillna(0.0, subset=list(samples))


def wide_values(
    metrics: DataFrame, features: list[str], samples_a: Sequence[str], samples_b: Sequence[str], metric: str
) -> DataFrame:
    """Features with two arrays, ``va`` and ``vb``, holding each group's samples in order."""
    used = metrics.filter(F.col("sample").isin([*samples_a, *samples_b]))
    wide = wide_columns(used, features, [*samples_a, *samples_b], metric)

    def pack(names: Sequence[str]) -> Column:
        return F.array(*[F.col(f"`{n}`") for n in names])

    return wide.select(*features, pack(samples_a).alias("va"), pack(samples_b).alias("vb"))


def n_present(values: Column | str) -> Column:
    return F.size(F.filter(values, lambda v: v > 0))


def presence_filter(wide: DataFrame, n_a: int, n_b: int, min_presence: int = 2) -> DataFrame:
    """Features non-zero in at least ``min_presence`` samples of each group, or in all of a smaller group."""
    return wide.filter((n_present("va") >= min(min_presence, n_a)) & (n_present("vb") >= min(min_presence, n_b)))


def array_mean(values: Column | str) -> Column:
    values = F.col(values) if isinstance(values, str) else values
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


# --- resampling tests ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Resampling:
    """Index draws shared by all features; they depend only on the group sizes and the seed."""

    mode: str  # exact or random
    splits: np.ndarray  # one relabelling of all samples per row, group A's places first
    boot_a: np.ndarray
    boot_b: np.ndarray

    @property
    def exact(self) -> bool:
        return self.mode == "exact"


def draw(n_a: int, n_b: int, n_perm: int, n_boot: int, seed: int = SEED, mode: str = "auto") -> Resampling:
    """The relabellings, then the bootstrap draws.

    ``mode``: ``exact`` takes all ways to split, ``random`` takes ``n_perm`` random ones, and ``auto`` is exact if there are
    at most ``n_perm`` ways, else random. The result's ``mode`` says which it was.
    """
    if mode not in ("exact", "random", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    rng = np.random.default_rng(seed)
    n = n_a + n_b
    if mode == "auto":
        mode = "exact" if math.comb(n, n_a) <= n_perm else "random"
    if mode == "exact":
        chosen = itertools.combinations(range(n), n_a)
        splits = np.array([[*c, *sorted(set(range(n)).difference(c))] for c in chosen])
    else:
        splits = np.array([rng.permutation(n) for _ in range(n_perm)])
    boots = [(rng.choice(n_a, n_a, replace=True), rng.choice(n_b, n_b, replace=True)) for _ in range(n_boot)]
    boot_a = np.array([a for a, _ in boots], dtype=int).reshape(n_boot, n_a)
    boot_b = np.array([b for _, b in boots], dtype=int).reshape(n_boot, n_b)
    return Resampling(mode, splits, boot_a, boot_b)


def _mean_gap(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.mean(axis=1) - right.mean(axis=1)


def resampling_tests(wide: DataFrame, draws: Resampling, alpha: float = 0.05) -> DataFrame:
    """Add ``obs_diff`` (mean A - mean B), ``perm_pval`` and the bootstrap interval of the difference.

    Features are independent. What travels to the tasks is the draws: (permutations + bootstraps) x samples integers, set
    by the arguments and not by the data. A row costs as many means as there are draws, so the few partitions that a pivot
    leaves are dealt out over all tasks first.
    """
    spark = wide.sparkSession
    wide = wide.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    shipped = wide.sparkSession.sparkContext.broadcast((draws.mode == "exact", draws.splits, draws.boot_a, draws.boot_b))
    n_boot = len(draws.boot_a)
    added = [T.StructField("obs_diff", T.DoubleType()), T.StructField("perm_pval", T.DoubleType())]
    if n_boot:
        added += [T.StructField("bootstrap_ci_lo", T.DoubleType()), T.StructField("bootstrap_ci_hi", T.DoubleType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact, splits, boot_a, boot_b = shipped.value
        for batch in batches:
            if batch.empty:
                continue
            a, b = np.stack(batch["va"].to_numpy()), np.stack(batch["vb"].to_numpy())
            both, n_a = np.hstack([a, b]), a.shape[1]
            observed = _mean_gap(a, b)
            extreme = np.zeros(len(batch), dtype=np.int64)
            for places in splits:
                # same summing order as the observed difference, so that ties stay ties
                gap = _mean_gap(both[:, places[:n_a]], both[:, places[n_a:]])
                extreme += np.abs(gap) >= np.abs(observed)
            p = np.maximum(extreme, 1) / len(splits) if exact else (extreme + 1) / (len(splits) + 1)
            out = batch.assign(obs_diff=observed, perm_pval=p)
            if n_boot:
                gaps = np.empty((len(batch), n_boot))
                for i in range(n_boot):
                    gaps[:, i] = _mean_gap(a[:, boot_a[i]], b[:, boot_b[i]])
                lo, hi = np.percentile(gaps, [50 * alpha, 100 - 50 * alpha], axis=1)
                out = out.assign(bootstrap_ci_lo=lo, bootstrap_ci_hi=hi)
            yield out

    return wide.mapInPandas(run, T.StructType([*wide.schema.fields, *added]))


# --- rank sum --------------------------------------------------------------------------------------------------------


def rank_sum(va: Column | str, vb: Column | str) -> Column:
    """Sum of group A's average ranks among all values."""
    va = F.col(va) if isinstance(va, str) else va
    everything = F.concat(va, vb)

    def rank(v: Column) -> Column:
        below = F.size(F.filter(everything, lambda t: t < v))
        equal = F.size(F.filter(everything, lambda t: t == v))
        return below + (equal + F.lit(1)) / F.lit(2.0)

    return F.aggregate(va, F.lit(0.0), lambda s, v: s + rank(v))


def rank_sum_test(wide: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """Two-sided rank-sum test by the normal approximation, without tie or continuity correction.

    A rank sum is a multiple of one half between two bounds, so its p-value comes from a table of
    2 * n_a * n_b + 1 entries keyed by twice the rank sum: its size depends on the number of samples only.
    """
    n = n_a + n_b
    centre, scale = n_a * (n + 1) / 2, math.sqrt(n_a * n_b * (n + 1) / 12)
    lowest = n_a * (n_a + 1)
    table = [(t, math.erfc(abs(t / 2 - centre) / scale / math.sqrt(2))) for t in range(lowest, lowest + 2 * n_a * n_b + 1)]
    p_of = wide.sparkSession.createDataFrame(table, "_twice int, wilcox_pval double")
    return (
        wide.withColumn("_twice", F.round(rank_sum("va", "vb") * 2).cast("int")).join(p_of, "_twice").drop("_twice")
    )


# --- false discovery rate --------------------------------------------------------------------------------------------


def bh_fdr(df: DataFrame, p: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the Benjamini-Hochberg rate of column ``p`` within each group of ``by`` columns."""
    return df.join(bh_rates(df, p, out, by), [*by, p], "left")


def bh_rates(df: DataFrame, p: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """The Benjamini-Hochberg rate of every distinct value of ``p`` within each group of ``by`` columns.

    Ties share the largest rank, so the work is on distinct p-values with their counts. Running totals go through
    buckets of about 1 % relative width, which keeps any window small however many distinct p-values there are:
    totals per bucket first, then inside each bucket, shifted by what came before.
    """
    by = list(by)
    step = F.when(F.col(p) <= 0, F.lit(-100_000)).otherwise(F.floor(F.log2(p) * 64).cast("int"))
    distinct = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    distinct = distinct.withColumn("_bucket", step)

    def ordered(*keys: str) -> W.WindowSpec:
        return W.Window.partitionBy(*(by or [F.lit(0)])).orderBy(*keys)

    before = ordered("_bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    everything = W.Window.partitionBy(*(by or [F.lit(0)]))
    # at most ~70,000 buckets exist for a double in (0, 1], whatever the data
    buckets = (
        distinct.groupBy(*by, "_bucket")
        .agg(F.sum("_n").alias("_in_bucket"))
        .withColumn("_offset", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_in_bucket").over(everything))
        .drop("_in_bucket")
    )
    inside = W.Window.partitionBy(*by, "_bucket")
    up_to = inside.orderBy(p).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    from_top = inside.orderBy(F.col(p).desc()).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    ranked = (
        distinct.join(buckets, [*by, "_bucket"])
        .withColumn("_rank", F.col("_offset") + F.sum("_n").over(up_to))
        .withColumn("_raw", F.col(p) * F.col("_total") / F.col("_rank"))
        .withColumn("_tail", F.min("_raw").over(from_top))
    )
    after = ordered(F.col("_bucket").desc()).rowsBetween(W.Window.unboundedPreceding, -1)
    lowest_after = (
        ranked.groupBy(*by, "_bucket")
        .agg(F.min("_raw").alias("_low"))
        .withColumn("_later", F.min("_low").over(after))
        .drop("_low")
    )
    return ranked.join(lowest_after, [*by, "_bucket"]).select(
        *by, p, F.greatest(F.least("_tail", F.coalesce("_later", F.lit(1.0)), F.lit(1.0)), F.lit(0.0)).alias(out)
    )


# --- comparisons -----------------------------------------------------------------------------------------------------


def condition_pairs(conditions: DataFrame) -> DataFrame:
    """All unordered pairs of distinct conditions, each in name order."""
    names = conditions.select("condition").dropna().distinct().agg(F.array_sort(F.collect_set("condition")).alias("names"))
    return names.select(F.posexplode("names").alias("i", "cond_a"), "names").select(
        "cond_a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("cond_b")
    )


def samples_by_condition(metrics: DataFrame) -> dict[str, list[str]]:
    """Sample names per condition; as many rows reach the driver as there are samples."""
    groups: dict[str, list[str]] = {}
    for row in metrics.select("condition", "sample").dropna().distinct().collect():
        groups.setdefault(row.condition, []).append(row["sample"])
    return {c: sorted(groups[c]) for c in sorted(groups)}


def smallest_mean_eps(means: DataFrame, *columns: str) -> Column:
    """A tenth of the smallest positive mean over all rows and the given columns, as a scalar subquery."""
    smallest = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in columns])
    return means.select(F.coalesce(F.min(smallest) / 10, F.lit(EPS_WITHOUT_DATA))).scalar()


def compare_conditions(
    metrics: DataFrame,
    cond_a: str,
    cond_b: str,
    samples_a: Sequence[str],
    samples_b: Sequence[str],
    metric: str = "normalized_freq",
    features: Sequence[str] = ("lr_pair",),
    n_perm: int = 10_000,
    n_boot: int = 2_000,
    fdr_alpha: float = 0.05,
    min_presence: int = 2,
    perm_mode: str = "auto",
) -> DataFrame:
    """Every feature present in both conditions, with effect size, permutation and rank-sum tests and their FDRs.

    ``fdr_alpha`` sets the level of the bootstrap interval, ``perm_mode`` how relabellings are chosen (see ``draw``); the
    column ``perm_mode`` tells which way was taken. A condition without samples gives an empty result.
    """
    features, n_a, n_b = list(features), len(samples_a), len(samples_b)
    interval = ["bootstrap_ci_lo", "bootstrap_ci_hi"] if n_boot else []
    if not n_a or not n_b:
        types = dict(metrics.dtypes)
        doubles = [f"mean_{cond_a}", f"mean_{cond_b}", "log2FC", "obs_diff", "perm_pval", "perm_FDR", *interval, "wilcox_pval", "wilcox_FDR"]
        columns = [f"`{c}` {types[c]}" for c in features] + [f"`{c}` double" for c in doubles]
        columns += ["perm_mode string", f"`presence_{cond_a}` int", f"`presence_{cond_b}` int"]
        return metrics.sparkSession.createDataFrame([], ", ".join(columns))
    draws = draw(n_a, n_b, n_perm, n_boot, mode=perm_mode)
    kept = presence_filter(wide_values(metrics, features, samples_a, samples_b, metric), n_a, n_b, min_presence)
    means = kept.withColumn("mean_a", array_mean("va")).withColumn("mean_b", array_mean("vb"))
    tested = resampling_tests(rank_sum_test(means, n_a, n_b), draws, fdr_alpha)
    # the rates below read this table several times: write it once, one row per feature
    tested = cut_lineage(tested)
    # both kinds of p-value are rated in one pass, each as a group of its own
    both = tested.select(
        *features, F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_pval").alias("p")) for kind in ("perm", "wilcox")]))
    )
    rates = bh_rates(both, "p", "rate", ["kind"])
    rated = tested
    for kind in ("perm", "wilcox"):
        of_kind = rates.filter(F.col("kind") == kind).select(F.col("p").alias(f"{kind}_pval"), F.col("rate").alias(f"{kind}_FDR"))
        rated = rated.join(of_kind, f"{kind}_pval", "left")
    return rated.select(
        *features,
        F.col("mean_a").alias(f"mean_{cond_a}"),
        F.col("mean_b").alias(f"mean_{cond_b}"),
        log2_fold_change("mean_a", "mean_b", smallest_mean_eps(tested, "mean_a", "mean_b")).alias("log2FC"),
        "obs_diff",
        "perm_pval",
        "perm_FDR",
        *interval,
        "wilcox_pval",
        "wilcox_FDR",
        F.lit(draws.mode).alias("perm_mode"),
        n_present("va").alias(f"presence_{cond_a}"),
        n_present("vb").alias(f"presence_{cond_b}"),
    )


def combined_fdr(results: dict[tuple[str, str], DataFrame], features: Sequence[str] = ("lr_pair",)) -> DataFrame:
    """All comparisons in one table with the FDR over their pooled permutation p-values (more than one pair only)."""
    stacked = stack_results(results, features)
    return bh_fdr(stacked, "perm_pval", "combined_FDR") if len(results) > 1 else stacked


def stack_results(results: dict[tuple[str, str], DataFrame], features: Sequence[str] = ("lr_pair",)) -> DataFrame:
    """Comparisons under common column names, tagged ``A_vs_B``."""
    parts = []
    for (a, b), df in results.items():
        common = [c for c in df.columns if c not in {*features, f"mean_{a}", f"mean_{b}", f"presence_{a}", f"presence_{b}"}]
        parts.append(
            df.select(
                F.lit(f"{a}_vs_{b}").alias("comparison"),
                *features,
                F.col(f"mean_{a}").alias("mean_a"),
                F.col(f"mean_{b}").alias("mean_b"),
                *common,
                F.col(f"presence_{a}").alias("presence_a"),
                F.col(f"presence_{b}").alias("presence_b"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def significant_summary(stacked: DataFrame) -> DataFrame:
    return stacked.filter(F.col("perm_FDR") < SIGNIFICANT_FDR)


def significant_counts(stacked: DataFrame) -> DataFrame:
    return stacked.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_tested"), F.count_if(F.col("perm_FDR") < SIGNIFICANT_FDR).alias("n_significant")
    )


# --- report tables ---------------------------------------------------------------------------------------------------


def volcano_table(result: DataFrame, key: str = "lr_pair", n_labels: int = 15) -> DataFrame:
    """Effect size against -log10 p; the ``n_labels`` smallest p-values (ties by name) are marked for labelling."""
    labelled = result.orderBy("perm_pval", key).limit(n_labels).select(key, F.lit(True).alias("labelled"))
    return result.join(labelled, key, "left").select(
        key,
        "log2FC",
        neg_log10("perm_pval").alias("neg_log10_p"),
        (F.col("perm_FDR") < SIGNIFICANT_FDR).alias("significant"),
        F.coalesce("labelled", F.lit(False)).alias("labelled"),
    )


def array_variance(values: Column) -> Column:
    """Sample variance (ddof 1) of an array; zeros are values like any other."""
    centre = array_mean(values)
    squares = F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - centre) * (v - centre))
    return F.try_divide(squares, F.size(values) - F.lit(1))


def variance_over_samples(metrics: DataFrame, samples: Sequence[str], metric: str = "normalized_freq") -> DataFrame:
    """Variance of each pair over all samples, absent ones counting as zero."""
    wide = wide_columns(metrics, ["lr_pair"], samples, metric)
    return wide.select("lr_pair", array_variance(F.array(*[F.col(f"`{s}`") for s in samples])).alias("variance"))


def variance_where_present(metrics: DataFrame, metric: str = "normalized_freq") -> DataFrame:
    """Variance of each pair over the samples that have it."""
    return metrics.groupBy("lr_pair").agg(F.var_samp(metric).alias("variance"))


def heatmap_table(metrics: DataFrame, samples: Sequence[tuple[str, str]], top_n: int = 30) -> DataFrame:
    """The most variable pairs x samples as long rows. ``samples`` = (name, condition); column order = (condition, name)."""
    order = sorted(samples, key=lambda s: (s[1], s[0]))
    spread = variance_over_samples(metrics, [s for s, _ in order])
    top = spread.orderBy(F.col("variance").desc(), "lr_pair").limit(top_n)
    wide = wide_columns(metrics.join(top, "lr_pair", "left_semi"), ["lr_pair"], [s for s, _ in order], "normalized_freq")
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("column_ord"),
                F.lit(s).alias("sample"),
                F.lit(c).alias("condition"),
                F.col(f"`{s}`").alias("value"),
            )
            for i, (s, c) in enumerate(order)
        ]
    )
    return wide.select("lr_pair", F.inline(cells))


def condition_means(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("lr_pair", "condition").agg(
        F.avg("normalized_freq").alias("mean_freq"), F.avg("mean_attention").alias("mean_attn")
    )


def dotplot_table(metrics: DataFrame, stacked: DataFrame | None, top_n: int = 30) -> DataFrame:
    """Condition means of the significant pairs, or of the most variable ones when none is significant.

    The pairs with the largest condition mean are kept, ``top_n`` of them.
    """
    fallback = variance_where_present(metrics).orderBy(F.col("variance").desc_nulls_last(), "lr_pair").limit(top_n)
    chosen = fallback.select("lr_pair")
    if stacked is not None:
        significant = significant_summary(stacked).select("lr_pair").distinct()
        none_found = significant.agg(F.count(F.lit(1)) == 0).scalar()
        chosen = significant.union(chosen.filter(none_found))
    means = condition_means(metrics.join(chosen, "lr_pair", "left_semi"))
    top = means.groupBy("lr_pair").agg(F.max("mean_freq").alias("peak")).orderBy(F.col("peak").desc(), "lr_pair").limit(top_n)
    return means.join(top.select("lr_pair"), "lr_pair", "left_semi")


def top_hits_table(metrics: DataFrame, stacked: DataFrame, conditions: Sequence[str], top_n: int = 15) -> DataFrame:
    """Bars and replicates of the pairs behind the ``top_n`` smallest significant p-values; absent means are 0."""
    top = significant_summary(stacked).orderBy("perm_pval", "lr_pair", "comparison").limit(top_n).select("lr_pair").distinct()
    grid = top.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
    bars = (
        metrics.join(top, "lr_pair", "left_semi")
        .groupBy("lr_pair", "condition")
        .agg(
            F.avg("normalized_freq").alias("mean_freq"),
            F.array_sort(F.collect_list("normalized_freq")).alias("replicates"),  # one entry per sample
        )
    )
    return grid.join(bars, ["lr_pair", "condition"], "left").select(
        "lr_pair",
        "condition",
        F.coalesce("mean_freq", F.lit(0.0)).alias("mean_freq"),
        F.coalesce(F.size("replicates"), F.lit(0)).alias("n_replicates"),
        F.coalesce("replicates", F.array().cast("array<double>")).alias("replicates"),
    )
