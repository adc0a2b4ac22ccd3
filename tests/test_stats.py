import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic.operators import metrics as M
from cytomosaic.operators import stats as S
from cytomosaic.plans.compare import compare


def bh(p):
    """Reference definition on a list: p * n / (largest rank of the value), then the minimum from above."""
    p = np.asarray(p, dtype=float)
    raw = np.array([v * len(p) / (p <= v).sum() for v in p])
    return np.array([min(1.0, raw[p >= v].min()) for v in p])


@pytest.mark.parametrize(
    "p",
    [
        [0.5],
        [0.01, 0.01, 0.2, 1.0, 1.0],
        list(np.random.default_rng(1).random(300)),
        list(np.round(np.random.default_rng(2).random(300), 1)),
        list(10.0 ** -np.random.default_rng(3).uniform(0, 300, 200)) + [0.0],
    ],
)
def test_bh_matches_definition(spark, p):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = {r.i: r.q for r in S.bh_fdr(df, "p", "q").collect()}
    want = bh(p)
    assert len(got) == len(p)
    assert np.allclose([got[i] for i in range(len(p))], want, rtol=1e-12, atol=0)
    assert all(got[i] >= min(v, 1) - 1e-15 for i, v in enumerate(p))


def test_bh_by_group_and_null(spark):
    rows = [("a", 0.01), ("a", 0.04), ("b", 0.04), ("b", None)]
    df = spark.createDataFrame(rows, "g string, p double")
    got = {(r.g, r.p): r.q for r in S.bh_fdr(df, "p", "q", ["g"]).collect()}
    assert got[("a", 0.01)] == pytest.approx(0.02)
    assert got[("a", 0.04)] == pytest.approx(0.04)
    assert got[("b", 0.04)] == pytest.approx(0.04)
    assert got[("b", None)] is None


def wide(spark, a, b):
    data = [(i, list(map(float, x)), list(map(float, y))) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    return spark.createDataFrame(data, "f int, va array<double>, vb array<double>")


def test_exact_permutation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (40, 3)) / 8, rng.integers(0, 4, (40, 4)) / 8
    got = {r.f: r for r in S.resampling_tests(wide(spark, a, b), S.draw(3, 4, 100, 0)).collect()}
    for i in range(40):
        both = [*a[i], *b[i]]
        seen = abs(np.mean(a[i]) - np.mean(b[i]))
        gaps = []
        for c in itertools.combinations(range(7), 3):
            rest = [both[j] for j in range(7) if j not in c]
            gaps.append(abs(np.mean([both[j] for j in c]) - np.mean(rest)))
        assert got[i].perm_pval == max(sum(g >= seen for g in gaps), 1) / 35
        assert got[i].obs_diff == pytest.approx(np.mean(a[i]) - np.mean(b[i]))


def test_exact_permutation_is_symmetric(spark):
    rng = np.random.default_rng(4)
    a, b = rng.random((20, 3)), rng.random((20, 3))
    one = {r.f: r.perm_pval for r in S.resampling_tests(wide(spark, a, b), S.draw(3, 3, 100, 0)).collect()}
    two = {r.f: r.perm_pval for r in S.resampling_tests(wide(spark, b, a), S.draw(3, 3, 100, 0)).collect()}
    assert one == two


def test_monte_carlo_and_bootstrap_follow_one_generator(spark):
    """Draws in the order: all permutations, then per bootstrap one choice for A and one for B."""
    a, b = np.random.default_rng(5).random((2, 7, 4))
    draws = S.draw(4, 4, 50, 30)
    rng = np.random.default_rng(42)
    both = np.hstack([a, b])
    observed = a.mean(axis=1) - b.mean(axis=1)
    hits = np.zeros(7)
    for _ in range(50):
        p = rng.permutation(8)
        hits += abs(both[:, p[:4]].mean(axis=1) - both[:, p[4:]].mean(axis=1)) >= abs(observed)
    gaps = []
    for _ in range(30):
        i, j = rng.choice(4, size=4, replace=True), rng.choice(4, size=4, replace=True)
        gaps.append(a[:, i].mean(axis=1) - b[:, j].mean(axis=1))
    got = {r.f: r for r in S.resampling_tests(wide(spark, a, b), draws, 0.1).collect()}
    assert not draws.exact
    for i in range(7):
        assert got[i].perm_pval == (hits[i] + 1) / 51
        assert got[i].bootstrap_ci_lo == pytest.approx(np.percentile([g[i] for g in gaps], 5))
        assert got[i].bootstrap_ci_hi == pytest.approx(np.percentile([g[i] for g in gaps], 95))


def test_rank_sum(spark):
    a, b = [[1, 2, 2], [0, 0, 0], [5, 6, 7]], [[2, 3, 4, 9], [0, 0, 0, 0], [1, 2, 3, 4]]
    got = {r.f: r.wilcox_pval for r in S.rank_sum_test(wide(spark, a, b), 3, 4).collect()}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        both = x + y
        ranks = [sum(t < v for t in both) + (sum(t == v for t in both) + 1) / 2 for v in x]
        z = (sum(ranks) - 3 * 8 / 2) / math.sqrt(3 * 4 * 8 / 12)
        assert got[i] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert got[1] == 1.0


def test_presence_filter_uses_all_of_a_small_group(spark):
    df = wide(spark, [[1], [0], [1]], [[1, 1, 0], [1, 1, 1], [1, 0, 0]])
    assert [r.f for r in S.presence_filter(df, 1, 3, 2).collect()] == [0]


def edges(spark, rows):
    return spark.createDataFrame(rows, "sample string, from_cell string, to_cell string, ligand string, receptor string, attention_score double")


def samples(spark, names, n=10):
    return spark.createDataFrame([(s, c, n) for s, c in names], "sample string, condition string, n_cells long")


def test_metrics_count_unnamed_edges_in_the_total(spark):
    df = edges(spark, [
        ("s", "a", "b", "L", "R", 1.0), ("s", "a", "c", "L", "R", 3.0), ("s", "x", "c", "L", "R", float("nan")),
        ("s", "b", "b", None, "R", 1.0),
    ])
    row = M.sample_metrics(df, samples(spark, [("s", "k")])).collect()
    assert len(row) == 1
    r = row[0]
    assert (r.lr_pair, r.n_edges, r.normalized_freq, r.mean_attention, r.sender_fraction, r.presence) == ("L-R", 3, 0.75, 2.0, 0.2, 1)


def test_celltype_metrics_minimum_comes_after_the_total(spark):
    rows = [("s", f"a{i}", "b", "L", "R", 1.0) for i in range(4)] + [("s", "c", "b", "L", "R", 1.0)]
    types = spark.createDataFrame([(f"a{i}", "A") for i in range(4)] + [("b", "B"), ("c", "C")], "cell_id string, cell_type string")
    typed = M.annotate_endpoints(edges(spark, rows), types)
    got = M.celltype_metrics(typed, samples(spark, [("s", "k")]), min_edges=2).collect()
    assert [(r.sender_type, r.receiver_type, r.n_edges, r.normalized_freq) for r in got] == [("A", "B", 4, 0.8)]


def test_attention_threshold(spark):
    df = edges(spark, [("s", "a", "b", "L", "R", v) for v in (-1.0, 0.2, 0.5)])
    assert M.attention_filter(df, 0.5).count() == 1
    assert M.attention_filter(df, 0).count() == 3
    assert M.attention_filter(df, None).count() == 3


def test_last_label(spark):
    df = spark.createDataFrame([("b", "x", 0), ("b", "y", 1), ("c", "z", 2)], "barcode string, cell_type string, file_ord int")
    assert {(r.barcode, r.cell_type) for r in M.last_label(df).collect()} == {("b", "y"), ("c", "z")}


def test_single_condition_gives_metrics_only(spark):
    df = edges(spark, [(s, "a", "b", "L", "R", 1.0) for s in ("s0", "s1")])
    out = compare(df, samples(spark, [("s0", "k"), ("s1", "k")]), n_boot=10)
    assert out.sample_metrics.count() == 2 and not out.pairs and out.summary is None


def test_no_feature_passes(spark):
    df = edges(spark, [("s0", "a", "b", "L", "R", 1.0), ("s1", "a", "b", "L", "Q", 1.0)])
    out = compare(df, samples(spark, [("s0", "k"), ("s1", "m")]), n_boot=10)
    assert out.pairs[("k", "m")].count() == 0
    assert "perm_FDR" in out.pairs[("k", "m")].columns


def test_fold_change_uses_smallest_mean(spark):
    rows = []
    for s, n in (("a0", 1), ("a1", 1), ("b0", 3), ("b1", 3)):
        rows += [(s, f"c{i}", "d", "L", "R", 1.0) for i in range(n)] + [(s, f"c{i}", "d", "M", "R", 1.0) for i in range(4 - n)]
    conditions = samples(spark, [("a0", "a"), ("a1", "a"), ("b0", "b"), ("b1", "b")])
    out = compare(edges(spark, rows), conditions, n_boot=10).pairs[("a", "b")]
    eps = 0.25 / 10
    got = {r.lr_pair: r.log2FC for r in out.collect()}
    assert got["L-R"] == pytest.approx(math.log2((0.75 + eps) / (0.25 + eps)))
    assert got["M-R"] == pytest.approx(-got["L-R"])


def test_results_do_not_depend_on_partitioning(spark, rows):
    rng = np.random.default_rng(9)
    data = [(f"s{i % 4}", f"c{rng.integers(20)}", f"c{rng.integers(20)}", f"L{rng.integers(5)}", "R", float(rng.random())) for i in range(400)]
    conditions = samples(spark, [("s0", "a"), ("s1", "a"), ("s2", "b"), ("s3", "b")])
    df = edges(spark, data).withColumn("attention_score", F.round("attention_score", 3))
    keep = ["lr_pair", "perm_pval", "perm_FDR", "wilcox_pval", "presence_a", "presence_b"]
    one = compare(df.repartition(1), conditions, n_boot=0).pairs[("a", "b")].select(*keep)
    many = compare(df.repartition(8), conditions, n_boot=0).pairs[("a", "b")].select(*keep)
    assert rows(one) == rows(many)
