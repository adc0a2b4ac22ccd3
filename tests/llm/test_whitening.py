"""Whitening against a dense eigenvalue solver, the solver's parts, and odd inputs."""

import math
from fractions import Fraction

import numpy as np
import pytest

from cytomosaic.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string, n int, component int"


@pytest.fixture
def make(spark):
    return lambda rows, parts=3: spark.createDataFrame([(i, v, 1, "x", "k", 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def random_rows(n, d, seed=0):
    source = np.random.default_rng(seed)
    mix = source.standard_normal((d, d)) * np.logspace(0, -2, d)
    return [(i, [float(v) for v in np.float32(row)]) for i, row in enumerate(source.standard_normal((n, d)) @ mix + 3)]


def brute(rows, k=4):
    """{(id, component): (n, deviation, |whitened|, explained)} by a dense solver."""
    sound = [(i, v) for i, v in rows if v and all(e is not None and math.isfinite(e) for e in v)]
    grid = {i: [math.floor(256 * e) for e in v] for i, v in sound}
    fit = sorted({tuple(v) for v in grid.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in grid.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(min(k, len(sums))):
            z = (np.array(x) - mean) @ axes[:, -1 - c] / math.sqrt(values[-1 - c])
            out[i, c + 1] = (n, deviation, abs(z), values[-1 - c] / values.sum())
    return out


def check(df, want):
    got = df.collect()
    assert len(got) == len(want)
    for r in got:
        n, deviation, z, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(z, rel=1e-8, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_brute(spark, make):
    rows = random_rows(300, 12)
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    bad = [(2000, None), (2001, [None] * 12), (2002, [math.nan, *[0.0] * 11]), (2003, [math.inf, *[0.0] * 11]), (2004, [])]
    check(W.whiten(make(rows + bad, 9)), brute(rows))


def test_small_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 5)
    monkeypatch.setattr(W, "FAN", 2)
    rows = random_rows(200, 6, 3)
    check(W.whiten(make(rows, 13)), brute(rows))


def test_signs(spark, make):
    """One direction has one sign in all rows: whitened components are uncorrelated with unit variance."""
    rows = random_rows(250, 8, 5)
    z = np.zeros((250, 4))
    for r in W.whiten(make(rows)).collect():
        z[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(z.T @ z / 250 - np.eye(4)).max() < 1e-9 and np.abs(z.mean(axis=0)).max() < 1e-9


def test_odd(spark, make):
    assert W.whiten(make([])).count() == 0
    assert W.whiten(make([(1, None), (None, None)])).count() == 0
    assert W.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector
    rows = W.whiten(make([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (2, [2.0, 2.0]), (None, [4.0, 2.0]), (5, [1.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == [(0, 1), (1, 1), (2, 1), (2, 1)]
    assert {r["explained"] for r in rows} == {1.0} and {r["n"] for r in rows} == {3}


def test_deviations():
    x = np.array([[1, -(2**40)], [2**62, 0], [3, 5]])
    sums, n = np.array([7, 11]), 1000
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert W.deviations(x, n, sums) == [v if v < 2**63 else None for v in want]


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "pairs", "flat", "split", "one"])
def test_solver(kind):
    source = np.random.default_rng(1)
    m = source.standard_normal((80, 20))
    u, _, v = np.linalg.svd(m, full_matrices=False)
    spread = {
        "random": None, "graded": np.logspace(0, -12, 20), "equal": np.ones(20), "pairs": np.repeat(np.arange(10, 0, -1.0), 2),
        "flat": np.r_[np.ones(3), np.zeros(17)], "split": None, "one": np.r_[1.0, np.zeros(19)],
    }[kind]
    m = m if spread is None else u * spread @ v
    if kind == "split":
        m = np.diag(np.arange(20, 0, -1.0))
    r = W.triangle(m)
    values, axes = W.directions(r)
    want = np.linalg.svd(m, compute_uv=False)
    assert np.allclose(np.sqrt(values), want, rtol=1e-12, atol=1e-14 * want[0])
    k = axes.shape[1]
    assert k == min(4, int((want > 1e-6 * want[0]).sum()))
    z = m @ axes / np.sqrt(values[:k])
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-10 and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-10


def test_dqds_keeps_small_values():
    """Values over 24 orders of magnitude, each to full relative accuracy."""
    a = 10.0 ** -np.arange(0, 13)
    b = 0.3 * a[:-1]
    exact = sorted((float(v) for v in _squares(a, b)), reverse=True)
    assert np.allclose(W.dqds(a, b), exact, rtol=1e-12)


def _squares(a, b):
    """Squared singular values by bisection, counting those below a bound in exact fractions."""
    q, e = [Fraction(float(v)) ** 2 for v in a], [Fraction(float(v)) ** 2 for v in b]

    def below(bound):
        d, count = q[0] - bound, 0
        for i in range(len(e)):
            pivot = d + e[i]
            count += pivot < 0
            d = d * q[i + 1] / pivot - bound
        return count + (d < 0)

    for k in range(len(a)):
        low, high = 1e-40, 4.0
        for _ in range(120):
            middle = math.sqrt(low * high)
            low, high = (low, middle) if below(Fraction(middle)) > k else (middle, high)
        yield high
