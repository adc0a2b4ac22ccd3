"""Ligand-receptor metrics and their comparison between conditions."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from cytomosaic.operators import metrics as M
from cytomosaic.operators import stats as S
from cytomosaic.session import cut_lineage
from registry.base import Tables, query, rounded

CTRL, TREAT = ["s0", "s1", "s2"], ["s3", "s4", "s5"]
SIX = CTRL + TREAT

# --- SQL pieces (each continues a WITH clause) -----------------------------------------------------------------------

def metrics_sql(edges: str = "edges", samples: str = "samples") -> str:
    return f"""--more
named AS (SELECT *, ligand || '-' || receptor AS lr_pair FROM {edges}),
totals AS (SELECT sample, count(*) AS total FROM named GROUP BY sample),
metrics AS (
  SELECT n.sample, s.condition, n.lr_pair, count(*) AS n_edges, count(*) / any_value(t.total) AS normalized_freq,
         avg(attention_score) AS mean_attention, count(DISTINCT from_cell) / any_value(s.n_cells) AS sender_fraction,
         CAST(1 AS INTEGER) AS presence
  FROM named n JOIN totals t ON t.sample = n.sample JOIN {samples} s ON s.sample = n.sample
  WHERE lr_pair IS NOT NULL GROUP BY n.sample, s.condition, n.lr_pair)"""


METRICS = metrics_sql()

TYPED = """--more
named AS (SELECT e.*, ligand || '-' || receptor AS lr_pair, a.cell_type AS from_type, b.cell_type AS to_type
          FROM edges e LEFT JOIN cells a ON a.cell_id = e.from_cell LEFT JOIN cells b ON b.cell_id = e.to_cell),
typed AS (SELECT * FROM named WHERE from_type IS NOT NULL AND to_type IS NOT NULL),
totals AS (SELECT sample, count(*) AS total FROM typed GROUP BY sample),
metrics AS (
  SELECT n.sample, s.condition, n.lr_pair, from_type AS sender_type, to_type AS receiver_type,
         count(*) AS n_edges, count(*) / any_value(t.total) AS normalized_freq,
         avg(attention_score) AS mean_attention, count(DISTINCT from_cell) / any_value(s.n_cells) AS sender_fraction,
         CAST(1 AS INTEGER) AS presence
  FROM typed n JOIN totals t ON t.sample = n.sample JOIN samples s ON s.sample = n.sample
  GROUP BY n.sample, s.condition, n.lr_pair, from_type, to_type HAVING count(*) >= 10)"""


def wide_sql(keys: str = "lr_pair", a: list[str] = CTRL, b: list[str] = TREAT) -> str:
    columns = ", ".join(f"coalesce(avg(normalized_freq) FILTER (WHERE sample = '{s}'), 0) AS {s}" for s in a + b)
    present_a = " + ".join(f"CAST({s} > 0 AS INT)" for s in a)
    present_b = " + ".join(f"CAST({s} > 0 AS INT)" for s in b)
    return f""",
wide AS (SELECT {keys}, {columns} FROM metrics GROUP BY {keys}),
kept AS (SELECT *, ({' + '.join(a)}) / {len(a)} AS mean_a, ({' + '.join(b)}) / {len(b)} AS mean_b,
                {present_a} AS presence_a, {present_b} AS presence_b
         FROM wide WHERE {present_a} >= 2 AND {present_b} >= 2)"""


def exact_p_sql(a: list[str] = CTRL, b: list[str] = TREAT) -> str:
    terms = []
    for chosen in itertools.combinations(a + b, len(a)):
        rest = [s for s in a + b if s not in chosen]
        terms.append(f"CAST(abs(({' + '.join(chosen)}) / {len(a)} - ({' + '.join(rest)}) / {len(b)}) >= abs(mean_a - mean_b) AS INT)")
    return f""",
perm AS (SELECT *, mean_a - mean_b AS obs_diff, greatest({' + '.join(terms)}, 1) / {len(terms)} AS perm_pval FROM kept)"""


def bh_sql(source: str, p: str, out: str, name: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f""",
{name}_raw AS (
  SELECT *, {p} * count(*) OVER ({part}) / count(*) OVER ({part} ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS raw
  FROM {source}),
{name} AS (SELECT * EXCLUDE (raw), least(min(raw) OVER ({part} ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING), 1) AS "{out}"
           FROM {name}_raw)"""


def rank_sum_sql(source: str = "perm", a: list[str] = CTRL, b: list[str] = TREAT) -> str:
    def rank(s: str) -> str:
        below = " + ".join(f"CAST({t} < {s} AS INT)" for t in a + b)
        equal = " + ".join(f"CAST({t} = {s} AS INT)" for t in a + b)
        return f"({below} + ({equal} + 1) / 2.0)"

    return f""",
ranked AS (SELECT *, {' + '.join(rank(s) for s in a)} AS rank_sum FROM {source})"""


def erfc_sql(n_a: int = 3, n_b: int = 3) -> str:
    """p-values of the possible rank sums, computed here rather than by the engine."""
    import math

    rows, n = [], n_a + n_b
    for twice in range(n_a * (n_a + 1), n_a * (n_a + 1) + 2 * n_a * n_b + 1):
        z = (twice / 2 - n_a * (n + 1) / 2) / math.sqrt(n_a * n_b * (n + 1) / 12)
        rows.append(f"({twice / 2}, {math.erfc(abs(z) / math.sqrt(2))!r}::DOUBLE)")
    return f""",
p_table(rs, wilcox_pval) AS (VALUES {', '.join(rows)}),
wilcox AS (SELECT r.*, t.wilcox_pval FROM ranked r JOIN p_table t ON t.rs = r.rank_sum)"""


def interval_sql(keys: str = "lr_pair", a: list[str] = CTRL, b: list[str] = TREAT) -> str:
    """The bootstrap interval of every kept feature, from the same draws."""
    d = S.draw(len(a), len(b), 10_000, 2_000)
    rows = ", ".join(f"([{', '.join(str(v + 1) for v in i)}], [{', '.join(str(v + 1) for v in j)}])" for i, j in zip(d.boot_a, d.boot_b, strict=True))
    mean_a = "(" + " + ".join(f"va[i[{k + 1}]]" for k in range(len(a))) + f") / {len(a)}"
    mean_b = "(" + " + ".join(f"vb[j[{k + 1}]]" for k in range(len(b))) + f") / {len(b)}"
    return f""",
draws(i, j) AS (VALUES {rows}),
gaps AS (SELECT {keys}, {mean_a} - {mean_b} AS gap
         FROM (SELECT {keys}, [{', '.join(a)}] AS va, [{', '.join(b)}] AS vb FROM kept) k CROSS JOIN draws),
bands AS (SELECT {keys}, round(quantile_cont(gap, 0.025), 9) AS bootstrap_ci_lo, round(quantile_cont(gap, 0.975), 9) AS bootstrap_ci_hi
          FROM gaps GROUP BY {keys})"""


def compared_sql(metrics: str, a: list[str] = CTRL, b: list[str] = TREAT) -> str:
    return metrics + wide_sql("lr_pair", a, b) + exact_p_sql(a, b) + rank_sum_sql("perm", a, b) + erfc_sql(len(a), len(b)) \
        + bh_sql("wilcox", "perm_pval", "perm_FDR", "fdr1") + bh_sql("fdr1", "wilcox_pval", "wilcox_FDR", "fdr2") + """,
eps AS (SELECT coalesce(min(v) / 10, 1e-10) AS eps FROM
        (SELECT mean_a AS v FROM kept UNION ALL SELECT mean_b FROM kept) WHERE v > 0),
result AS (SELECT f.*, log2((mean_b + eps) / (mean_a + eps)) AS "log2FC" FROM fdr2 f CROSS JOIN eps)"""


# --- Spark side ------------------------------------------------------------------------------------------------------


def lr_metrics(t: Tables):
    return M.sample_metrics(t.edges, t.samples)


def typed_edges(t: Tables):
    return M.annotate_endpoints(t.edges, t.cells.select("cell_id", "cell_type"))


def kept_features(t: Tables):
    return S.presence_filter(S.wide_values(lr_metrics(t), ["lr_pair"], CTRL, TREAT, "normalized_freq"), 3, 3, 2)


def lr_comparison(t: Tables):
    return S.compare_conditions(lr_metrics(t), "ctrl", "treat", CTRL, TREAT)


@query(METRICS + """ SELECT sample, condition, lr_pair, n_edges, normalized_freq, round(mean_attention, 6) AS mean_attention,
       sender_fraction, presence FROM metrics""", ("edges", "samples"))
def sample_lr_metrics(t: Tables):
    return rounded(lr_metrics(t), "mean_attention")


@query(TYPED + """ SELECT sample, condition, lr_pair, sender_type, receiver_type, n_edges, normalized_freq,
       round(mean_attention, 6) AS mean_attention, sender_fraction, presence FROM metrics""", ("edges", "samples", "cells"))
def celltype_metrics(t: Tables):
    return rounded(M.celltype_metrics(typed_edges(t), t.samples), "mean_attention")


@query("""SELECT e.sample, count(*) AS total_edges, count(DISTINCT ligand || '-' || receptor) AS n_pairs,
       count(*) FILTER (WHERE attention_score >= 0.5) AS n_strong FROM edges e GROUP BY e.sample""", ("edges",))
def edge_totals(t: Tables):
    edges = M.with_lr_pair(t.edges)
    strong = M.attention_filter(t.edges, 0.5).groupBy("sample").agg(F.count(F.lit(1)).alias("n_strong"))
    return (
        edges.groupBy("sample")
        .agg(F.count(F.lit(1)).alias("total_edges"), F.countDistinct("lr_pair").alias("n_pairs"))
        .join(strong, "sample", "left")
        .select("sample", "total_edges", "n_pairs", F.coalesce("n_strong", F.lit(0)).alias("n_strong"))
    )


@query("""SELECT sample, from_cell, to_cell, ligand, receptor, attention_score, a.cell_type AS from_type,
       b.cell_type AS to_type FROM edges e LEFT JOIN (SELECT cell_id, cell_type FROM cells) a ON a.cell_id = from_cell
       LEFT JOIN (SELECT cell_id, cell_type FROM cells) b ON b.cell_id = to_cell""", ("edges", "cells"))
def annotated_edges(t: Tables):
    return typed_edges(t)


@query("SELECT condition, count(*) AS n_samples, string_agg(sample, ',' ORDER BY sample) AS sample_names "
       "FROM samples GROUP BY condition", ("samples",))
def sample_roster(t: Tables):
    return M.sample_roster(t.samples)


@query("SELECT 'ctrl' AS cond_a, 'treat' AS cond_b FROM samples HAVING count(DISTINCT condition) = 2", ("samples",))
def condition_pairs(t: Tables):
    return S.condition_pairs(t.samples)


@query(METRICS + wide_sql() + " SELECT lr_pair, s0, s1, s2, s3, s4, s5 FROM wide", ("edges", "samples"))
def lr_wide(t: Tables):
    return S.wide_columns(lr_metrics(t), ["lr_pair"], SIX, "normalized_freq")


@query(METRICS + wide_sql() + " SELECT lr_pair, presence_a, presence_b FROM kept", ("edges", "samples"))
def lr_presence_filter(t: Tables):
    return kept_features(t).select(
        "lr_pair", S.n_present("va").alias("presence_a"), S.n_present("vb").alias("presence_b")
    )


@query(METRICS + wide_sql() + exact_p_sql() + " SELECT lr_pair, obs_diff, perm_pval FROM perm", ("edges", "samples"))
def perm_exact(t: Tables):
    return S.resampling_tests(kept_features(t), S.draw(3, 3, 10_000, 0)).select("lr_pair", "obs_diff", "perm_pval")


def monte_carlo_sql() -> str:
    counted = []
    for places in S.draw(3, 3, 999, 0, mode="random").splits:
        a, b = [SIX[i] for i in places[:3]], [SIX[i] for i in places[3:]]
        counted.append(f"CAST(abs(({' + '.join(a)}) / 3 - ({' + '.join(b)}) / 3) >= abs(mean_a - mean_b) AS INT)")
    return METRICS + wide_sql() + f" SELECT lr_pair, (list_sum([{', '.join(counted)}]) + 1) / 1000 AS perm_pval FROM kept"


@query(monte_carlo_sql, ("edges", "samples"))
def perm_monte_carlo(t: Tables):
    """Random relabellings, asked for although all splits would be few."""
    return S.resampling_tests(kept_features(t), S.draw(3, 3, 999, 0, mode="random")).select("lr_pair", "perm_pval")


def bootstrap_sql() -> str:
    d = S.draw(3, 3, 10_000, 2_000)
    rows = ", ".join(f"({', '.join(str(v + 1) for v in [*a, *b])})" for a, b in zip(d.boot_a, d.boot_b, strict=True))
    picked_a = " + ".join(f"va[i{i}]" for i in range(3))
    picked_b = " + ".join(f"vb[j{i}]" for i in range(3))
    return METRICS + wide_sql() + f""",
draws(i0, i1, i2, j0, j1, j2) AS (VALUES {rows}),
gaps AS (SELECT lr_pair, ({picked_a}) / 3 - ({picked_b}) / 3 AS gap
         FROM (SELECT lr_pair, [s0, s1, s2] AS va, [s3, s4, s5] AS vb FROM kept) k CROSS JOIN draws)
SELECT lr_pair, round(quantile_cont(gap, 0.025), 9) AS ci_lo, round(quantile_cont(gap, 0.975), 9) AS ci_hi
FROM gaps GROUP BY lr_pair"""


@query(bootstrap_sql, ("edges", "samples"))
def bootstrap_ci(t: Tables):
    out = S.resampling_tests(kept_features(t), S.draw(3, 3, 10_000, 2_000)).select(
        "lr_pair", F.col("bootstrap_ci_lo").alias("ci_lo"), F.col("bootstrap_ci_hi").alias("ci_hi")
    )
    return rounded(out, "ci_lo", "ci_hi", digits=9)


@query(METRICS + wide_sql() + exact_p_sql() + rank_sum_sql() + " SELECT lr_pair, rank_sum FROM ranked", ("edges", "samples"))
def rank_sum_stat(t: Tables):
    return kept_features(t).select("lr_pair", S.rank_sum("va", "vb").alias("rank_sum"))


@query(METRICS + wide_sql() + exact_p_sql() + rank_sum_sql() + erfc_sql()
       + " SELECT lr_pair, round(wilcox_pval, 9) AS wilcox_pval FROM wilcox", ("edges", "samples"))
def rank_sum_p(t: Tables):
    return rounded(S.rank_sum_test(kept_features(t), 3, 3).select("lr_pair", "wilcox_pval"), "wilcox_pval", digits=9)


@query(METRICS + wide_sql() + exact_p_sql() + bh_sql("perm", "perm_pval", "perm_FDR", "fdr")
       + ' SELECT lr_pair, round("perm_FDR", 9) AS "perm_FDR" FROM fdr', ("edges", "samples"))
def bh_fdr(t: Tables):
    tested = cut_lineage(S.resampling_tests(kept_features(t), S.draw(3, 3, 10_000, 0)))
    return rounded(S.bh_fdr(tested, "perm_pval", "perm_FDR").select("lr_pair", "perm_FDR"), "perm_FDR", digits=9)


COMPARED = compared_sql(METRICS)


@query(lambda: COMPARED + interval_sql() + """ SELECT lr_pair, mean_a AS mean_ctrl, mean_b AS mean_treat, round("log2FC", 6) AS "log2FC", obs_diff,
       perm_pval, round("perm_FDR", 9) AS "perm_FDR", bootstrap_ci_lo, bootstrap_ci_hi, round(wilcox_pval, 9) AS wilcox_pval,
       round("wilcox_FDR", 9) AS "wilcox_FDR", 'exact' AS perm_mode, presence_a AS presence_ctrl, presence_b AS presence_treat
       FROM result JOIN bands USING (lr_pair)""", ("edges", "samples"))
def lr_compare(t: Tables):
    out = rounded(lr_comparison(t), "log2FC")
    return rounded(out, "perm_FDR", "bootstrap_ci_lo", "bootstrap_ci_hi", "wilcox_pval", "wilcox_FDR", digits=9)


@query("""SELECT CAST(NULL AS VARCHAR) AS lr_pair, 0 AS n_compared, (SELECT count(*) FROM samples) AS n_samples""", ("samples",))
def compare_empty_condition(t: Tables):
    """A condition without samples: an empty result with the usual columns, and the samples are all there."""
    out = S.compare_conditions(lr_metrics(t), "ctrl", "gone", CTRL, [])
    n = t.samples.agg(F.count(F.lit(1))).scalar()
    return out.agg(F.max("lr_pair").alias("lr_pair"), F.count("perm_FDR").cast("int").alias("n_compared")).withColumn("n_samples", n)


TYPED_KEYS = "lr_pair, sender_type, receiver_type"


@query(lambda: TYPED + wide_sql(TYPED_KEYS) + exact_p_sql() + bh_sql("perm", "perm_pval", "perm_FDR", "fdr") + interval_sql(TYPED_KEYS)
       + f' SELECT {TYPED_KEYS}, mean_a AS mean_ctrl, mean_b AS mean_treat, perm_pval, round("perm_FDR", 9) AS "perm_FDR", '
       f"bootstrap_ci_lo, bootstrap_ci_hi FROM fdr JOIN bands USING ({TYPED_KEYS})", ("edges", "samples", "cells"))
def celltype_compare(t: Tables):
    metrics = M.celltype_metrics(typed_edges(t), t.samples)
    out = S.compare_conditions(
        metrics, "ctrl", "treat", CTRL, TREAT, features=("lr_pair", "sender_type", "receiver_type")
    )
    return rounded(
        out.select(
            "lr_pair", "sender_type", "receiver_type", "mean_ctrl", "mean_treat", "perm_pval", "perm_FDR", "bootstrap_ci_lo", "bootstrap_ci_hi"
        ),
        "perm_FDR",
        "bootstrap_ci_lo",
        "bootstrap_ci_hi",
        digits=9,
    )


@query(COMPARED + """ SELECT 'ctrl_vs_treat' AS comparison, count(*) AS n_tested,
       count(*) FILTER (WHERE "perm_FDR" < 0.05) AS n_significant FROM result""", ("edges", "samples"))
def significant_counts(t: Tables):
    return S.significant_counts(S.stack_results({("ctrl", "treat"): lr_comparison(t)}))


# Three conditions, s0+s1 / s2+s3 / s4+s5: the FDR over the pooled p-values of the three comparisons.
THREE = {"a": ["s0", "s1"], "b": ["s2", "s3"], "c": ["s4", "s5"]}


def pooled_sql() -> str:
    parts = []
    for a, b in itertools.combinations(sorted(THREE), 2):
        names = THREE[a] + THREE[b]
        observed = f"abs(({' + '.join(THREE[a])}) / 2 - ({' + '.join(THREE[b])}) / 2)"
        terms = []
        for chosen in itertools.combinations(names, 2):
            rest = [s for s in names if s not in chosen]
            terms.append(f"CAST(abs(({' + '.join(chosen)}) / 2 - ({' + '.join(rest)}) / 2) >= {observed} AS INT)")
        present = " AND ".join(f"{s} > 0" for s in names)
        parts.append(
            f"SELECT '{a}_vs_{b}' AS comparison, lr_pair, greatest({' + '.join(terms)}, 1) / 6 AS perm_pval "
            f"FROM wide WHERE {present}"
        )
    return METRICS + wide_sql() + ", pooled AS (" + " UNION ALL ".join(parts) + ")" \
        + bh_sql("pooled", "perm_pval", "combined_FDR", "fdr") \
        + ' SELECT comparison, lr_pair, perm_pval, round("combined_FDR", 9) AS "combined_FDR" FROM fdr'


@query(pooled_sql, ("edges", "samples"))
def combined_fdr(t: Tables):
    of = F.create_map(*[F.lit(v) for c, names in THREE.items() for s in names for v in (s, c)])
    metrics = cut_lineage(lr_metrics(t).withColumn("condition", of[F.col("sample")]))
    results = {
        (a, b): S.compare_conditions(metrics, a, b, THREE[a], THREE[b])
        for a, b in itertools.combinations(sorted(THREE), 2)
    }
    out = S.combined_fdr(results).select("comparison", "lr_pair", "perm_pval", "combined_FDR")
    return rounded(out, "combined_FDR", digits=9)


@query(COMPARED + """ SELECT lr_pair, round("log2FC", 6) AS "log2FC", round(-log10(greatest(perm_pval, 1e-300)), 6) AS neg_log10_p,
       "perm_FDR" < 0.05 AS significant, row_number() OVER (ORDER BY perm_pval, lr_pair) <= 15 AS labelled
       FROM result""", ("edges", "samples"))
def volcano(t: Tables):
    return rounded(S.volcano_table(lr_comparison(t)), "log2FC", "neg_log10_p")


VARIANCE = wide_sql() + """,
spread AS (SELECT lr_pair, list_aggregate([s0, s1, s2, s3, s4, s5], 'var_samp') AS variance FROM wide),
top AS (SELECT * FROM spread ORDER BY round(variance, 12) DESC, lr_pair LIMIT 30)"""


@query(METRICS + VARIANCE + " SELECT lr_pair, round(variance, 12) AS variance FROM spread", ("edges", "samples"))
def lr_variance(t: Tables):
    return rounded(S.variance_over_samples(lr_metrics(t), SIX), "variance", digits=12)


@query(METRICS + " SELECT lr_pair, round(var_samp(normalized_freq), 12) AS variance FROM metrics GROUP BY lr_pair",
       ("edges", "samples"))
def lr_variance_present(t: Tables):
    return rounded(S.variance_where_present(lr_metrics(t)), "variance", digits=12)


@query(METRICS + VARIANCE + """
SELECT lr_pair, CAST(substr(u.sample, 2) AS INT) AS column_ord, u.sample,
       CASE WHEN u.sample < 's3' THEN 'ctrl' ELSE 'treat' END AS condition, u.value
FROM (UNPIVOT (SELECT * FROM wide WHERE lr_pair IN (SELECT lr_pair FROM top)) ON s0, s1, s2, s3, s4, s5
      INTO NAME sample VALUE value) u""", ("edges", "samples"))
def heatmap_top_var(t: Tables):
    order = [(s, "ctrl") for s in CTRL] + [(s, "treat") for s in TREAT]
    return S.heatmap_table(lr_metrics(t), order)


@query(METRICS + """, means AS (SELECT lr_pair, condition, avg(normalized_freq) AS mean_freq, avg(mean_attention) AS mean_attn
       FROM metrics GROUP BY lr_pair, condition) SELECT lr_pair, condition, round(mean_freq, 9) AS mean_freq,
       round(mean_attn, 6) AS mean_attn FROM means""", ("edges", "samples"))
def condition_means(t: Tables):
    return rounded(rounded(S.condition_means(lr_metrics(t)), "mean_attn"), "mean_freq", digits=9)


@query(COMPARED + """,
fallback AS (SELECT lr_pair FROM (SELECT lr_pair, var_samp(normalized_freq) AS v FROM metrics GROUP BY lr_pair)
             ORDER BY round(v, 15) DESC NULLS LAST, lr_pair LIMIT 30),
hits AS (SELECT DISTINCT lr_pair FROM result WHERE "perm_FDR" < 0.05),
chosen AS (SELECT * FROM hits UNION ALL SELECT * FROM fallback WHERE NOT EXISTS (SELECT 1 FROM hits)),
means AS (SELECT lr_pair, condition, avg(normalized_freq) AS mean_freq, avg(mean_attention) AS mean_attn
          FROM metrics WHERE lr_pair IN (SELECT lr_pair FROM chosen) GROUP BY lr_pair, condition),
best AS (SELECT lr_pair FROM means GROUP BY lr_pair ORDER BY max(mean_freq) DESC, lr_pair LIMIT 30)
SELECT lr_pair, condition, round(mean_freq, 9) AS mean_freq, round(mean_attn, 6) AS mean_attn
FROM means WHERE lr_pair IN (SELECT lr_pair FROM best)""", ("edges", "samples"))
def dotplot(t: Tables):
    metrics = lr_metrics(t)
    out = S.dotplot_table(metrics, S.stack_results({("ctrl", "treat"): lr_comparison(t)}))
    return rounded(rounded(out, "mean_attn"), "mean_freq", digits=9)


# --- a cohort of five against five samples with planted differences, where results are significant ---------------------

FIVE, OTHER_FIVE = [f"t{i}" for i in range(5)], [f"t{i}" for i in range(5, 10)]


def cohort_metrics(t: Tables):
    return M.sample_metrics(t.cohort_edges, t.cohort_samples)


def cohort_results(t: Tables):
    return S.stack_results({("ctrl", "treat"): S.compare_conditions(cohort_metrics(t), "ctrl", "treat", FIVE, OTHER_FIVE)})


def cohort_sql() -> str:
    return compared_sql(metrics_sql("cohort_edges", "cohort_samples"), FIVE, OTHER_FIVE)


COHORT = ("cohort_edges", "cohort_samples")


@query(lambda: cohort_sql() + interval_sql("lr_pair", FIVE, OTHER_FIVE) + """ SELECT 'ctrl_vs_treat' AS comparison, lr_pair, round(mean_a, 12) AS mean_a,
       round(mean_b, 12) AS mean_b, round("log2FC", 6) AS "log2FC", round(obs_diff, 12) AS obs_diff, perm_pval, round("perm_FDR", 9) AS "perm_FDR",
       bootstrap_ci_lo, bootstrap_ci_hi, round(wilcox_pval, 9) AS wilcox_pval, round("wilcox_FDR", 9) AS "wilcox_FDR", 'exact' AS perm_mode,
       presence_a, presence_b FROM result JOIN bands USING (lr_pair) WHERE "perm_FDR" < 0.05""", COHORT)
def significant_summary(t: Tables):
    out = rounded(rounded(S.significant_summary(cohort_results(t)), "log2FC"), "mean_a", "mean_b", "obs_diff", digits=12)
    return rounded(out, "perm_FDR", "bootstrap_ci_lo", "bootstrap_ci_hi", "wilcox_pval", "wilcox_FDR", digits=9)


@query(lambda: cohort_sql() + """ SELECT 'ctrl_vs_treat' AS comparison, count(*) AS n_tested,
       count(*) FILTER (WHERE "perm_FDR" < 0.05) AS n_significant FROM result""", COHORT)
def significant_counts_cohort(t: Tables):
    return S.significant_counts(cohort_results(t))


DOTS = """,
hits AS (SELECT DISTINCT lr_pair FROM result WHERE "perm_FDR" < 0.05),
means AS (SELECT lr_pair, condition, avg(normalized_freq) AS mean_freq, avg(mean_attention) AS mean_attn
          FROM metrics WHERE lr_pair IN (SELECT lr_pair FROM hits) GROUP BY lr_pair, condition),
best AS (SELECT lr_pair FROM means GROUP BY lr_pair ORDER BY round(max(mean_freq), 12) DESC, lr_pair LIMIT 30)
SELECT lr_pair, condition, round(mean_freq, 9) AS mean_freq, round(mean_attn, 6) AS mean_attn
FROM means WHERE lr_pair IN (SELECT lr_pair FROM best)"""


@query(lambda: cohort_sql() + DOTS, COHORT)
def dotplot_significant(t: Tables):
    """The branch with significant pairs."""
    return rounded(rounded(S.dotplot_table(cohort_metrics(t), cohort_results(t)), "mean_attn"), "mean_freq", digits=9)


@query(lambda: cohort_sql() + """,
top AS (SELECT lr_pair FROM result WHERE "perm_FDR" < 0.05 ORDER BY perm_pval, lr_pair LIMIT 15),
grid AS (SELECT lr_pair, condition FROM top CROSS JOIN (VALUES ('ctrl'), ('treat')) v(condition))
SELECT g.lr_pair, g.condition, round(coalesce(avg(m.normalized_freq), 0), 9) AS mean_freq, CAST(count(m.lr_pair) AS INT) AS n_replicates
FROM grid g LEFT JOIN metrics m ON m.lr_pair = g.lr_pair AND m.condition = g.condition
GROUP BY g.lr_pair, g.condition""", COHORT)
def top_hits_bars(t: Tables):
    table = S.top_hits_table(cohort_metrics(t), cohort_results(t), ["ctrl", "treat"])
    return rounded(table.drop("replicates"), "mean_freq", digits=9)
