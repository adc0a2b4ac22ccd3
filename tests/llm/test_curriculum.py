"""Mixes against a plain restatement, schedules, and odd inputs."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from cytomosaic.llm import curriculum as C
from tests.llm.conftest import odd_rows, words

SOURCES = ["b", "a", None, "é", "a", "c", ""]


def shares(sizes, weights, most):
    """Targets by the rule itself: share, stop at the limit, share the excess again."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = float(sum(sizes.values()))
    while open_:
        total = sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * left / total > most * sizes[s]}
        if not above:
            return target | {s: weights[s] * left / total for s in open_}
        target |= {s: float(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return target


def brute(rows, most=3, seed=1):
    """(doc_id, size, source_size, target, taken, first position) of each row."""
    full = [(i, s, t or "", len(re.findall(C.WORD, t or ""))) for i, t, s in rows]
    named = sorted({s for _, s, _, _ in full}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, o, _, n in full if o == s) for s in named}
    target = shares(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(named)}, most)
    total, out = sum(sizes.values()), []
    for k, s in enumerate(named):
        order = sorted((hashlib.md5(f"{seed}:{'' if i is None else i}:{t}".encode()).hexdigest(), repr(i), n, i) for i, o, t, n in full if o == s)
        at = 0
        for *_, n, i in order:
            words = [max(min(math.floor(target[s]) - v * sizes[s] - at, n), 0) for v in range(most)]
            first = None
            if words[0]:
                low, high = 0.0, 1.0
                for _ in range(60):  # the schedule's integral, inverted by halving
                    middle = (low + high) / 2
                    low, high = (middle, high) if area(C.CYCLE[k % 3], middle) / (5, 2, 1)[k % 3] < at / target[s] else (low, middle)
                first = low * total
            out.append((i, n, sizes[s], target[s], sum(words), first))
            at += n
    return out


def area(schedule, until):
    total = 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        end = min(max(until, t0), t1)
        total += (end - t0) * (w0 + (w0 + (w1 - w0) * (end - t0) / (t1 - t0))) / 2
    return total


def taken(df):
    words = F.aggregate("visits", F.lit(0).cast("long"), lambda n, v: n + v["words"])
    return [tuple(r) for r in df.select("doc_id", "size", "source_size", "target", words, F.get("visits", F.lit(0))["position"]).collect()]


def check(got, want):
    def plain(rows):
        return sorted([tuple(-1 if v is None else v for v in r) for r in rows])

    got, want = plain(got), plain(want)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[4] == b[4]
        assert a[3] == pytest.approx(b[3]) and a[5] == pytest.approx(b[5], abs=1e-6)


def test_brute(spark, make):
    rows = [(i, t, None, SOURCES[k % len(SOURCES)]) for k, (i, t) in enumerate(odd_rows())]
    rows += [(100 + i, words(i, 3 + i % 40), None, SOURCES[i % 3]) for i in range(200)]
    rows += [(500, "same row here", None, "a")] * 7
    check(taken(C.curriculum(make(rows))), brute([(i, t, s) for i, t, _, s in rows]))


def test_hot_source(spark, make, monkeypatch):
    """Many buckets, and groups of equal rows larger than what stays together."""
    monkeypatch.setattr(C, "BUCKET_ROWS", 20)
    monkeypatch.setattr(C, "TOGETHER", 3)
    rows = [(i, words(i, 1 + i % 9), None, "hot" if i % 3 else f"s{i % 7}") for i in range(400)] + [(7, "x y", None, "hot")] * 20
    check(taken(C.curriculum(make(rows))), brute([(i, t, s) for i, t, _, s in rows]))


def test_limits(spark, make):
    """A source too small for its share stops at three visits of each document; totals are kept."""
    rows = [(1, words(1, 10), None, "a"), (2, words(2, 5), None, "a"), (3, words(3, 4000), None, "b"), (4, words(4, 100), None, "c")]
    got = {r[0]: r for r in taken(C.curriculum(make(rows)))}
    assert [got[i][4] for i in (1, 2)] == [30, 15] and got[1][3] == 45.0
    assert sum(r[4] for r in got.values()) in (4114, 4115)


def test_order(spark, make):
    rows = [(i, words(i, 20), None, f"s{i % 3}") for i in range(120)]
    mixed = C.curriculum(make(rows))
    order = C.training_order(mixed).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert sum(r["words"] for r in order) == pytest.approx(2400, abs=3)
    first = [r["doc_id"] for r in C.in_order(mixed).collect()]
    seen = list(dict.fromkeys(r["doc_id"] for r in order))
    assert first[: len(seen)] == seen
    # the first source's weight falls from 6 to 4 of 8, so more of it comes early
    early = [r["source"] for r in order if r["position"] < 800]
    late = [r["source"] for r in order if r["position"] >= 1600]
    assert early.count("s0") / len(early) > late.count("s0") / len(late)


def test_schedules(spark):
    cycle = [[(0.25, 0.0), (0.5, 4.0), (0.75, 0.0)], [(0.0, 3.0)], [(0.0, 0.0), (1.0, 2.0)]]
    assert [C.integral(s) for s in cycle] == [1.0, 3.0, 1.0]
    for schedule in cycle:
        times = [i / 16 for i in range(17)]
        full = [(0.0, schedule[0][1]), *schedule, (1.0, schedule[-1][1])]
        full = [p for i, p in enumerate(full) if i == 0 or p[0] > full[i - 1][0]]
        df = spark.createDataFrame([(t, area(full, t)) for t in times], "t double, a double")
        for t, found, a in df.select("t", C.time_of(F.col("a"), schedule), "a").collect():
            assert area(full, found) == pytest.approx(a)
    with pytest.raises(ValueError):
        C.segments([(0.0, -1.0)])


def test_empty(spark, make):
    assert C.curriculum(make([])).count() == 0
    assert sorted(taken(C.curriculum(make([(1, None), (2, "  ", None, "a")])))) == [(1, 0, 0, 0.0, 0, None), (2, 0, 0, 0.0, 0, None)]


def test_repeatable(spark, make):
    rows = [(i, words(i % 50, 5 + i % 7), None, f"s{i % 5}") for i in range(150)]
    one, two = (C.curriculum(make(r).repartition(n)).select("doc_id", "visits") for r, n in ((rows, 2), (rows[::-1], 5)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
