"""Pair counts by tiles against listing all pairs, and the walk's size."""

import math
import random
from collections import Counter

import pytest

from cytomosaic.operators import neighbourhood as N
from cytomosaic.operators import pyramid as P

SCHEMA = "cell_id string, slide string, x double, y double, cell_type string"


def scattered(seed, n, slides=2, side=40.0, grid=None):
    source = random.Random(seed)

    def at():
        v = source.uniform(-side, side)
        return v if grid is None else round(v / grid) * grid

    return [(f"c{i}", f"s{source.randrange(slides)}", at(), at(), source.choice("ABC")) for i in range(n)]


def listed(rows, radii):
    found = Counter()
    for i, (_, s, x, y, t) in enumerate(rows):
        for _, s2, x2, y2, t2 in rows[:i]:
            d = math.hypot(x - x2, y - y2)
            if s == s2 and d <= radii[-1]:
                found[s, min(t, t2), max(t, t2), next(k for k, r in enumerate(radii, 1) if d <= r)] += 1
    return found


@pytest.mark.parametrize("radii, leaf, grid", [([30.0], 1.0, None), ([4.0, 9.0, 25.0], 2.0, None), ([5.0, 10.0, 13.0], 0.5, 1.0), ([3.0], 4.0, 0.5)])
def test_pairs_by_tiles(spark, radii, leaf, grid):
    """On a grid many distances equal a radius, many cells share a place, and many stand on a tile's edge."""
    rows = scattered(len(radii), 400, grid=grid)
    cells = spark.createDataFrame([*rows, ("n1", "s0", None, 1.0, "A"), ("n2", "s0", 1.0, 1.0, None)], SCHEMA)
    got = N.binned_pairs(cells, radii, ["slide"], leaf=leaf).collect()
    assert {tuple(r)[:-1]: r["n"] for r in got} == listed(rows, radii)


def test_chosen_ways_agree(spark):
    rows = scattered(9, 2500, slides=1, side=10.0)
    cells = spark.createDataFrame(rows, SCHEMA)
    points = N.typed_points(cells)
    assert P.leaf_size(points, 8.0) is not None and P.leaf_size(points, 0.5) is None
    assert P.leaf_size(points.limit(0), 8.0) is None
    for radius in (0.5, 8.0):
        want = Counter()
        for (_, a, b, _), n in listed(rows, [radius]).items():
            want[a, b] += n
        assert {tuple(r)[:-1]: r["n_contacts"] for r in N.contact_counts(cells, radius).collect()} == want


def test_work_is_linear_in_the_radius():
    """Offsets looked at by a lowest tile and its ancestors, against the square of the radius for a listing."""
    def size(radius):
        plan = P.walk([radius], 1.0)
        return len(plan.listed) + sum(len(level) / 4 ** (1 + i) for i, level in enumerate(plan.levels))

    assert size(160.0) < 12 * size(16.0)
    assert len(P.walk([160.0], 1.0).listed) < 0.06 * math.pi * 160.0**2


def test_walk_covers_each_pair_once():
    plan = P.walk([6.0, 11.0], 1.0)
    seen = Counter()
    for ax in range(4):
        for ay in range(4):
            for dx in range(-14, 15):
                for dy in range(-14, 15):
                    ways = sum(d == (dx, dy) for d in plan.listed)
                    for level, settled in enumerate(plan.levels):
                        x, y = ax >> level, ay >> level
                        lead = ((ax + dx) >> level) - x, ((ay + dy) >> level) - y
                        ways += sum(p[:2] == (x & 1, y & 1) and p[2:4] == lead for p in settled)
                    seen[ax, ay, dx, dy] = ways
    for (ax, ay, dx, dy), ways in seen.items():
        back = seen.get((ax + dx, ay + dy, -dx, -dy))
        if back is not None:
            near = math.hypot(max(abs(dx) - 1, 0), max(abs(dy) - 1, 0))
            both = ways if (dx, dy) == (0, 0) else ways + back
            assert both <= 2 and (near > 11 or both >= 1)


def test_tiles_meet_in_blocks(spark, monkeypatch):
    """Neither tiles nor points become a row for each offset: no join is left, and a crowded block is met by slices."""
    rows = scattered(4, 1200, side=30.0, grid=0.25)
    cells = spark.createDataFrame([*rows, *[(f"d{i}", None, 1.0, 1.0, "A") for i in range(3)]], SCHEMA)
    for most in (P.BLOCK_ROWS, 100):
        monkeypatch.setattr(P, "BLOCK_ROWS", most)
        found = N.binned_pairs(cells, [2.0, 16.0], ["slide"], leaf=0.5)
        if most > 100:
            assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {tuple(r)[:-1]: r["n"] for r in found.collect()} == listed(rows, [2.0, 16.0])


def test_runs_hold_each_offset_once():
    plan = P.walk([6.0, 11.0], 1.0)
    settled = [((px, py), dx, dy, step) for px, py, dx, dy, step in plan.levels[0]]
    got = Counter((r.place, r.dx, dy, r.step) for r in P.runs(settled) for dy in range(r.low, r.high + 1))
    assert got == Counter(settled)


def test_counts_by_many_types(spark, monkeypatch):
    """More types than are summed beforehand, more than fit a table of counts, and many cells at a place."""
    source = random.Random(3)
    rows = [(f"c{i}", "s", source.randrange(12) / 2, source.randrange(12) / 2, f"t{source.randrange(6)}") for i in range(500)]
    want = listed(rows, [1.5, 4.0])
    for summed, dense in ((64, 10**6), (2, 10**6), (2, 5)):
        monkeypatch.setattr(P, "SUMMED_TYPES", summed)
        monkeypatch.setattr(P, "DENSE_COUNTS", dense)
        monkeypatch.setattr(P, "PAIRS_AT_ONCE", 1000)
        plan = P.walk([1.5, 4.0], 0.5)
        points = N.typed_points(spark.createDataFrame(rows, SCHEMA), ["slide"])
        got = P.binned_pairs(points, [1.5, 4.0], plan.leaf, ["slide"]).collect()
        assert {tuple(r)[:-1]: r["n"] for r in got} == want
