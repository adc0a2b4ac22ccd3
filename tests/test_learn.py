import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytomosaic.operators import deconvolve as D
from cytomosaic.operators import genes as G
from cytomosaic.operators import matrix as M
from cytomosaic.operators import subspace as S
from cytomosaic.operators import knn
from cytomosaic.operators.knn import knn_join
from cytomosaic.plans import correct as correction
from cytomosaic.plans import impute as I


def vectors(spark, prefix, m):
    return spark.createDataFrame([(f"{prefix}{i:04d}", [float(v) for v in row]) for i, row in enumerate(m)], "id string, features array<double>")


def brute(q, r, k, metric, not_self=False):
    if metric == "cosine":
        unit = lambda m: m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) == 0, 1, n)
        d = 1 - unit(q) @ unit(r).T
    else:
        d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(2))
    d = np.round(d, 12)
    out = []
    for i, row in enumerate(d):
        order = [j for j in np.lexsort((np.arange(len(row)), row)) if not (not_self and i == j)]
        out.append([(j, row[j]) for j in order[:k]])
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("shape", ["spread", "copies"])
def test_knn_paths_agree_with_sorting(spark, metric, shape):
    rng = np.random.default_rng(1)
    r = rng.normal(size=(240, 6)) + rng.integers(0, 4, (240, 1)) * 3
    q = rng.normal(size=(50, 6)) + rng.integers(0, 4, (50, 1)) * 3
    if shape == "copies":  # a third of all references is one and the same vector
        r[::3] = r[0]
        q[::3] = r[0]
    qd, rd = vectors(spark, "q", q), vectors(spark, "r", r)
    want = brute(q, r, 7, metric)
    for how in ({}, {"broadcast_bytes": 0, "block_rows": 16, "n_pivots": 9}):
        got = {}
        for row in knn_join(qd, rd, 7, metric, **how).orderBy("query_id", "place").collect():
            got.setdefault(row.query_id, []).append((int(row.ref_id[1:]), row.distance))
        assert len(got) == 50
        for i, near in enumerate(want):
            mine = got[f"q{i:04d}"]
            assert [d for _, d in mine] == pytest.approx([d for _, d in near], abs=1e-9)
            if shape == "copies" and i % 3 == 0 and metric == "euclidean":
                assert [j for j, _ in mine] == [j for j, _ in near]


def test_knn_without_self_and_with_few_references(spark):
    m = np.array([[0.0, 0], [1, 0], [5, 0], [0, 0]])
    df = vectors(spark, "v", m)
    for how in ({}, {"broadcast_bytes": 0, "block_rows": 2, "n_pivots": 2}):
        got = knn_join(df, df, 10, "euclidean", not_self=True, **how).collect()
        assert len(got) == 12 and all(r.query_id != r.ref_id for r in got)
        first = {r.query_id: r.ref_id for r in got if r.place == 1}
        assert first["v0000"] == "v0003" and first["v0002"] == "v0001"


def test_knn_empty(spark):
    df = vectors(spark, "v", np.ones((3, 2)))
    assert knn_join(df.limit(0), df, 2).count() == 0
    assert knn_join(df, df.limit(0), 2).count() == 0


def expression(spark, rows):
    return spark.createDataFrame([(c, g, float(v)) for c, g, v in rows], "cell_id string, gene string, value double")


def test_normalisation(spark):
    e = expression(spark, [("a", "g", 1), ("a", "h", 3), ("b", "h", 5), ("c", "x", 9)])
    genes = spark.createDataFrame([("g",), ("h",)], "gene string")
    got = {(r.cell_id, r.gene): r.value for r in M.log_normalise(e, genes).collect()}
    assert got == {("a", "g"): pytest.approx(np.log1p(2500)), ("a", "h"): pytest.approx(np.log1p(7500)), ("b", "h"): pytest.approx(np.log1p(10000))}
    cells = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cell_id string")
    z = {(r.cell_id, r.gene): (r.value, r.zero_score) for r in M.z_scores(e, cells).collect()}
    h = np.array([3, 5, 0, 0])
    assert z[("a", "h")] == (pytest.approx((3 - h.mean()) / h.std()), pytest.approx(-h.mean() / h.std()))


def test_constant_gene_has_no_score(spark):
    e = expression(spark, [("a", "g", 2), ("b", "g", 2), ("a", "h", 1)])
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    assert {r.gene for r in M.z_scores(e, cells).collect()} == {"h"}


def test_variance_counts_absent_values(spark):
    e = expression(spark, [("a", "g", 2), ("b", "g", 4), ("a", "h", 1)])
    got = {r.gene: r.variance for r in G.gene_variance(e, 5).collect()}
    assert got == {"g": pytest.approx(np.var([2, 4, 0, 0, 0], ddof=1)), "h": pytest.approx(np.var([1, 0, 0, 0, 0], ddof=1))}


def test_components_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 3
    df = vectors(spark, "c", x).withColumnRenamed("id", "cell_id").repartition(5)
    scores, loadings, values = M.pca(df, 5, 3)
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(values, want[1][:3] ** 2 / 200)
    assert np.allclose(np.abs(loadings.T @ want[2][:3].T), np.eye(3), atol=1e-8)
    got = np.array([r.features for r in scores.orderBy("cell_id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ loadings)
    assert all(loadings[np.abs(loadings[:, j]).argmax(), j] > 0 for j in range(3))
    _, raw, _ = M.pca(df, 5, 2, centred=False)
    assert np.allclose(np.abs(raw.T @ np.linalg.svd(x, full_matrices=False)[2][:2].T), np.eye(2), atol=1e-8)


def sparse(spark, m, parts=5):
    rows = [(f"r{i:04d}", [int(j) for j in np.flatnonzero(row)], [float(v) for v in row[row != 0]]) for i, row in enumerate(m)]
    return spark.createDataFrame(rows, "id string, at array<int>, value array<double>").repartition(parts)


@pytest.mark.parametrize("most", [480, 40])
def test_leading_vectors_of_sparse_rows(spark, monkeypatch, most):
    """Wider than one block, so the span grows over passes, and is cut back where it may not grow; with shift and scale."""
    monkeypatch.setattr(S, "MOST_VECTORS", most)
    monkeypatch.setattr(S, "ENTRIES_AT_ONCE", 37)
    rng = np.random.default_rng(2)
    m = np.where(rng.random((150, 90)) < 0.15, rng.gamma(2, 1, (150, 90)) * rng.random(90) ** 3, 0) + rng.random((150, 1)) * (rng.random(90) < 0.1)
    df = sparse(spark, m)
    found = M.columns(df, 90)
    assert found.n == 150 and np.allclose(found.mean, m.mean(0)) and np.allclose(found.rms, np.sqrt((m * m).mean(0)))
    for shift, scale in ((None, None), (found.mean, found.scale)):
        a = m if shift is None else (m - shift) * scale
        values, vectors = S.leading(df, 90, 5, shift, scale)
        want = np.linalg.svd(a, full_matrices=False)
        assert np.allclose(values, want[1][:5] ** 2, rtol=1e-9)
        assert np.allclose(np.abs(vectors.T @ want[2][:5].T), np.eye(5), atol=1e-6)
        got = np.array([r.features for r in M.project(df, vectors, shift, ["id"]).orderBy("id").collect()])
        assert np.allclose(got, (m - (0 if shift is None else shift)) @ vectors)


def test_leading_vectors_of_odd_rows(spark):
    """Few directions, equal values, no rows, empty rows, and columns that do not vary."""
    rng = np.random.default_rng(4)
    low = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 30))
    values, vectors = S.leading(sparse(spark, low), 30, 6)
    assert np.allclose(values[2:], 0, atol=1e-8 * values[0]) and np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-8)
    values, vectors = S.leading(sparse(spark, np.eye(30)), 30, 4)
    assert np.allclose(values, 1) and np.allclose(vectors.T @ vectors, np.eye(4))
    none = sparse(spark, np.zeros((3, 30)))
    assert np.allclose(S.leading(none, 30, 4)[0], 0) and np.allclose(S.leading(none.limit(0), 30, 4)[0], 0)
    constant = np.hstack([rng.random((9, 2)), np.full((9, 1), 3.7)])
    assert M.columns(sparse(spark, constant), 3).scale[2] == 0.0
    rows = M.project(none, np.ones((30, 2)), np.ones(30), ["id"]).collect()
    assert [r.features for r in rows] == [[-30.0, -30.0]] * 3


def test_principal_vectors_with_known_angles(spark):
    """Two sets in planes of a random space, at planted angles; more vectors asked for than kept."""
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.normal(size=(40, 8)))[0]
    cosines = np.array([0.95, 0.5, 0.1])
    other = axes[:, :3] * cosines + axes[:, 3:6] * np.sqrt(1 - cosines**2)
    r, q = rng.normal(size=(80, 3)) @ axes[:, :3].T, rng.normal(size=(60, 3)) @ other.T
    own, theirs = (S.leading(sparse(spark, m), 40, 3)[1] for m in (q, r))
    found = M.principal_vectors(theirs, own)
    assert np.allclose(found.cosines, cosines)
    assert np.allclose(np.abs(axes[:, :2].T @ found.loadings), np.eye(2), atol=1e-7)


def reference_imputation(q, r, y, n_pv, k):
    """The method on dense arrays: z-scores, principal vectors, cosine neighbours, weights."""
    zq, zr = (q - q.mean(0)) / q.std(0), (r - r.mean(0)) / r.std(0)
    pcs = lambda m: np.linalg.svd(m - m.mean(0), full_matrices=False)[2][:n_pv].T
    ps, pt = pcs(zr), pcs(zq)
    u, c, _ = np.linalg.svd(ps.T @ pt)
    keep = max(1, int((c > 0.3).sum()))
    s = (ps @ u)[:, :keep]
    out = np.zeros((len(q), y.shape[1]))
    for i, near in enumerate(brute(zq @ s, zr @ s, k, "cosine")):
        valid = [(j, d) for j, d in near if d < 1]
        total = sum(d for _, d in valid) or 1.0
        for j, d in valid:
            out[i] += (1 - d / total) / max(len(valid) - 1, 1) * y[j]
    return out


def test_imputation_matches_dense_arrays(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(3, 8))
    q, r = (rng.normal(size=(n, 3)) @ mix + 0.3 * rng.normal(size=(n, 8)) for n in (25, 60))
    y = np.abs(rng.normal(size=(60, 2)))
    targets = [(f"r{i:04d}", f"t{j}", float(y[i, j])) for i in range(60) for j in range(2)]
    values = I.impute_vectors(
        vectors(spark, "q", q), vectors(spark, "r", r), 8, spark.createDataFrame(targets, "ref_cell string, gene string, value double"), 4, 10
    )
    want = reference_imputation(q, r, y, 4, 10)
    got = {(x.cell_id, x.gene): x.value for x in values.collect()}
    for i, j in itertools.product(range(25), range(2)):
        assert got[(f"q{i:04d}", f"t{j}")] == pytest.approx(want[i, j], abs=1e-6)


@pytest.mark.parametrize("slices", [200_000, 40])
def test_blocked_product(spark, monkeypatch, slices):
    """Weights times values in small blocks, with a hub, unknown neighbours and genes that only some have."""
    for name, value in (("BLOCK_REFS", 16), ("BLOCK_GENES", 8), ("SLICE_WEIGHTS", slices), ("BLOCK_QUERIES", 7), ("WEIGHTS_AT_ONCE", 11)):
        monkeypatch.setattr(I, name, value)
    rng = np.random.default_rng(12)
    y = np.where(rng.random((60, 30)) < 0.3, rng.normal(size=(60, 30)), np.nan)
    w = [(f"q{i}", f"r{j}", float(rng.random())) for i in range(90) for j in {0, *rng.integers(0, 66, 5).tolist()}]
    values = [(f"r{i}", f"g{j}", float(y[i, j])) for i in range(60) for j in range(30) if not np.isnan(y[i, j])]
    weights = spark.createDataFrame(w, "query_id string, ref_id string, weight double")
    reference = spark.createDataFrame(values, "ref_cell string, gene string, value double")
    want = {}
    for q, r, weight in w:
        i = int(r[1:])
        for j in np.flatnonzero(~np.isnan(y[i])) if i < 60 else ():
            want[q, f"g{j}"] = want.get((q, f"g{j}"), 0.0) + weight * y[i, j]
    out = I.weighted_values(weights, reference, broadcast_bytes=0)
    got = {(r.cell_id, r.gene): r.value for r in out.collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    assert I.weighted_values(weights.limit(0), reference, broadcast_bytes=0).count() == 0


def test_one_valid_neighbour_weighs_nothing(spark):
    near = spark.createDataFrame([("q", "a", 0.4), ("q", "b", 1.2), ("p", "a", 0.0), ("p", "b", 0.0)], "query_id string, ref_id string, distance double")
    got = {(r.query_id, r.ref_id): r.weight for r in I.neighbour_weights(near).collect()}
    assert got == {("q", "a"): 0.0, ("p", "a"): 1.0, ("p", "b"): 1.0}


def test_imputation_job(spark):
    rng = np.random.default_rng(3)
    counts = rng.poisson(3, (30, 6))
    names = [f"g{i}" for i in range(6)]
    cells = spark.createDataFrame([(f"c{i}",) for i in range(30)], "cell_id string")
    layered = expression(spark, [(f"c{i}", names[j], counts[i, j]) for i in range(30) for j in range(6) if counts[i, j]]).withColumn("layer", F.lit("raw"))
    genes = spark.createDataFrame([(g, i, False) for i, g in enumerate(names)], "gene string, ord int, is_imputed boolean")
    ref = [(f"r{i}", g, float(v)) for i in range(40) for g, v in zip([*names, "new", "flat"], [*rng.random(7), 0.5], strict=True)]
    reference = spark.createDataFrame(ref, "ref_cell string, gene string, value double")
    ref_cells = reference.select("ref_cell").distinct()
    ref_genes = spark.createDataFrame([(g, i) for i, g in enumerate([*names, "new", "flat"])], "gene string, ord int")
    out, extended = I.impute(cells, layered, genes, ref_cells, ref_genes, reference, n_vectors=4, k=5)
    assert [(r.gene, r.ord, r.is_imputed) for r in extended.filter("is_imputed").orderBy("ord").collect()] == [("new [imp]", 6, True), ("flat [imp]", 7, True)]
    imputed = out.filter("layer = 'imputed'")
    assert {r.gene for r in imputed.select("gene").distinct().collect()} == {"new [imp]", "flat [imp]"}
    assert out.filter("layer = 'raw'").count() == layered.count()
    dense = reference.groupBy("ref_cell").pivot("gene", [*names, "new", "flat"]).agg(F.first("value")).orderBy("ref_cell").toPandas()
    r, y = dense[names].to_numpy(), dense[["new", "flat"]].to_numpy()
    q = np.log1p(counts / counts.sum(1, keepdims=True) * 10_000)
    want = reference_imputation(q, r, y, 4, 5)
    got = {(x.cell_id, x.gene): x.value for x in imputed.collect()}
    for i, j in itertools.product(range(30), range(2)):
        assert got.get((f"c{i}", ["new [imp]", "flat [imp]"][j]), 0.0) == pytest.approx(want[i, j], abs=1e-6)
    wanted = spark.createDataFrame([("new", 0), ("g1", 1), ("nowhere", 2)], "gene string, ord int")
    _, few = I.impute(cells, layered, genes, ref_cells, ref_genes, reference, wanted, 4, 5)
    assert [r.gene for r in few.filter("is_imputed").collect()] == ["new [imp]"]
    with pytest.raises(ValueError, match="no gene to impute"):
        I.impute(cells, layered, genes, ref_cells, ref_genes, reference, wanted.filter("gene = 'g1'"))
    with pytest.raises(ValueError, match="no corrected layer"):
        I.impute(cells, layered, genes, ref_cells, ref_genes, reference, wanted, use_corrected=True)


def test_label_transfer_finds_groups(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(2, 6)) * 6
    q, r = (np.vstack([rng.normal(size=(n, 6)) + c for c in centre]) for n in (10, 30))
    labels = spark.createDataFrame([(f"r{i:04d}", "A" if i < 30 else "B") for i in range(60)], "ref_cell string, label string")
    got = {x.cell_id: x.label for x in I.vote(vectors(spark, "q", q), vectors(spark, "r", r), labels, 6, 3, 9).collect()}
    assert got == {f"q{i:04d}": "A" if i < 10 else "B" for i in range(20)}


def best_pair(x, mu):
    """Least squares with non-negative weights on every pair of columns, by trying the possible supports."""
    best = None
    for a, b in itertools.combinations(range(mu.shape[1]), 2):
        options = []
        w = np.linalg.lstsq(mu[:, [a, b]], x, rcond=None)[0]
        if (w > 0).all():
            options.append(w)
        else:
            for i, t in enumerate((a, b)):
                one = np.zeros(2)
                one[i] = max(mu[:, t] @ x, 0) / (mu[:, t] @ mu[:, t])
                options.append(one)
        for w in options:
            res = ((x - mu[:, [a, b]] @ w) ** 2).sum()
            if best is None or res < best[0] - 1e-10:
                best = (res, {a: w[0], b: w[1]})
    return best


def test_doublet_fit_against_search(spark):
    rng = np.random.default_rng(11)
    mu = rng.random((8, 4))
    profiles = spark.createDataFrame([(f"T{t}", f"g{g}", float(mu[g, t])) for g in range(8) for t in range(4)], "label string, gene string, mu double")
    x = rng.poisson(2, (25, 8)).astype(float) + 0.5
    e = expression(spark, [(f"c{i}", f"g{g}", x[i, g]) for i in range(25) for g in range(8)])
    for r in D.doublet_fit(e, profiles).collect():
        res, weights = best_pair(x[int(r.cell_id[1:])], mu)
        assert r.residual == pytest.approx(res, abs=1e-6)
        ordered = sorted(weights.items(), key=lambda kv: -kv[1])
        assert r.first_type == f"T{ordered[0][0]}" and r.first_weight == pytest.approx(ordered[0][1])
        assert r.second_weight == pytest.approx(ordered[1][1], abs=1e-9)


def test_single_type_reference(spark):
    profiles = spark.createDataFrame([("T", "g", 0.5), ("T", "h", 0.5)], "label string, gene string, mu double")
    r = D.doublet_fit(expression(spark, [("c", "g", 2), ("c", "h", 2)]), profiles).collect()
    assert [(x.first_type, x.second_type, x.first_weight, x.residual) for x in r] == [("T", None, 4.0, 0.0)]


def test_ambient_removal_rules(spark):
    profiles = spark.createDataFrame([("A", "g", 0.6), ("B", "g", 0.3), ("B", "h", 0.5)], "label string, gene string, mu double")
    fit = spark.createDataFrame(
        [("c", "A", "B", 2.0, 1.0), ("d", "A", None, 2.0, 0.0), ("e", "A", "B", 9.0, 1.0)],
        "cell_id string, first_type string, second_type string, first_weight double, second_weight double",
    )
    e = expression(spark, [(c, g, 10) for c in "cdez" for g in ("g", "h", "other")])
    got = {(r.cell_id, r.gene): r.value for r in D.remove_ambient(e, fit, profiles).collect()}
    assert got[("c", "g")] == pytest.approx(8.0) and got[("c", "other")] == 10.0 and ("c", "h") not in got
    assert got[("d", "h")] == 10.0 and ("z", "g") not in got and got[("e", "g")] == pytest.approx(10 * 5.4 / 5.7)
    kept = {(r.cell_id, r.gene): r.value for r in D.remove_ambient(e, fit, profiles, purify_singlets=False).collect()}
    assert kept[("e", "g")] == 10.0 and kept[("c", "g")] == pytest.approx(8.0)


def test_profiles_count_cells_without_the_gene(spark):
    e = spark.createDataFrame([("r1", "g", 1.0), ("r1", "h", 3.0), ("r2", "h", 2.0), ("r3", "g", 4.0)], "ref_cell string, gene string, value double")
    labels = spark.createDataFrame([("r1", "A"), ("r2", "A"), ("r3", "B")], "ref_cell string, label string")
    got = {(r.label, r.gene): r.mu for r in D.reference_profiles(e, labels).collect()}
    assert got == {("A", "g"): 0.125, ("A", "h"): 0.875, ("B", "g"): 1.0}


def test_correction_needs_shared_genes(spark):
    e = expression(spark, [("c", "g", 2)]).withColumn("layer", F.lit("raw"))
    genes = spark.createDataFrame([("g", 0, False)], "gene string, ord int, is_imputed boolean")
    ref = spark.createDataFrame([("r", "g", 1.0)], "ref_cell string, gene string, value double")
    labels = spark.createDataFrame([("r", "A")], "ref_cell string, label string")
    with pytest.raises(ValueError, match="shared genes"):
        correction.correct(e.select("cell_id"), e, genes, ref, labels)


def test_linear_scores(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    e = expression(spark, [("a", "g", 2)])
    coef = spark.createDataFrame([("g", "X", 1.0), ("g", "Y", -1.0)], "gene string, class string, weight double")
    got = {r.cell_id: (r.label, r.score) for r in D.linear_annotate(cells, e, coef, {"X": 0.0, "Y": 1.0}).collect()}
    assert got == {"a": ("X", 2.0), "b": ("Y", 1.0)}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_queries_go_to_groups_not_to_blocks(spark, monkeypatch, metric):
    """Vectors without clusters, where each block is possible: what is written stays a few rows for each query and reference."""
    from cytomosaic.operators import knn

    rng = np.random.default_rng(2)
    m = rng.normal(size=(700, 12))
    m[600:] = m[0]  # copies: ties go to the smaller id
    df = vectors(spark, "v", m)
    written, plain = [], knn.cut_lineage

    def counting(rows):
        out = plain(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(knn, "cut_lineage", counting)
    want = brute(m, m, 5, metric, True)
    for group_rows in (knn.GROUP_ROWS, 150):
        monkeypatch.setattr(knn, "GROUP_ROWS", group_rows)
        written.clear()
        got = {}
        for row in knn_join(df, df, 5, metric, not_self=True, broadcast_bytes=0, block_rows=8, n_pivots=60).orderBy("query_id", "place").collect():
            got.setdefault(row.query_id, []).append((int(row.ref_id[1:]), row.distance))
        assert sum(written) < 12 * 700
        for i, near in enumerate(want):
            assert [d for _, d in got[f"v{i:04d}"]] == pytest.approx([d for _, d in near], abs=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_within_bounds(metric):
    from cytomosaic.operators import knn

    rng = np.random.default_rng(5)
    q, r = rng.normal(size=(40, 20)), rng.normal(size=(300, 20))
    r[50:90] = r[3]
    if metric == "cosine":
        q, r = knn._unit(q), knn._unit(r)
    every = knn._distances(q, r, metric)
    r[299] = np.nan
    every[:, 299] = np.inf
    for bound in (np.full(40, np.inf), np.sort(every, axis=1)[:, 9]):
        row, col, value = knn._nearest_within(q, r, bound, 7, metric, None, None)
        assert len(row) == 280
        assert value.reshape(40, 7) == pytest.approx(np.sort(every, axis=1)[:, :7], abs=1e-9)
        assert np.abs(every[row, col] - value).max() < 1e-9


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("limit", [0, 4_000])
def test_equal_vectors_are_searched_once(spark, monkeypatch, metric, limit):
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, 4, (30, 5)).astype(float)
    kinds[0] = 0
    q, r = kinds[rng.integers(0, 30, 400)], kinds[rng.integers(0, 30, 300)]
    ids = [i // 2 if i % 40 == 0 else i for i in range(400)]  # some ids repeat
    qd = spark.createDataFrame([(i, row.tolist()) for i, row in zip(ids, q, strict=True)], "id long, features array<double>")
    rd = spark.createDataFrame([(None if i == 7 else i, row.tolist()) for i, row in enumerate(r)], "id long, features array<double>")
    how = {"broadcast_bytes": limit, "block_rows": 8, "n_pivots": 5}
    seen, plain = [], knn._search

    def counting(queries, references, *args, **kwargs):
        seen.append((queries.count(), references.count()))
        return plain(queries, references, *args, **kwargs)

    monkeypatch.setattr(knn, "_search", counting)
    got = sorted(map(tuple, knn_join(qd, rd, 9, metric, **how).collect()), key=str)
    assert len(seen) == 1 and max(seen[0]) <= 30
    monkeypatch.setattr(knn, "MOST_DIFFERENT", -1.0)  # one by one
    assert got == sorted(map(tuple, knn_join(qd, rd, 9, metric, **how).collect()), key=str)
    assert seen[1] == (400, 300)
    unique = {i for i in ids if ids.count(i) == 1}
    want = brute(q, r, 9, metric)
    for i, query in enumerate(ids):
        if query in unique:
            mine = sorted((place, d) for owner, _, d, place in got if owner == query)
            assert [d for _, d in mine] == pytest.approx([d for _, d in want[i]], abs=1e-9)
