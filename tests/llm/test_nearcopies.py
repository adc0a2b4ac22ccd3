"""Near copies against all pairs, hot groups, and odd inputs."""

import re

import pytest

from cytomosaic.llm import nearcopies, queries
from cytomosaic.llm.common import Workspace
from cytomosaic.llm.components import components
from tests.llm.conftest import edited, odd_rows, words


def brute(rows, k, percent):
    def shingles(text):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if len(own) >= k else ({tuple(own)} if own else set())

    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


def found(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in rows)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=repr)


@pytest.mark.parametrize(("k", "percent", "rows"), [(3, 85, 8), (5, 80, 7)])
def test_against_all_pairs(make, monkeypatch, k, percent, rows):
    """A large family around the limit, cut into many blocks, other families, and odd rows."""
    monkeypatch.setattr(nearcopies, "SLICE_SIGNATURES", 16)
    monkeypatch.setattr(nearcopies, "SLICE_TEXTS", 8)
    base = words(11, 150)
    docs = [(100 + i, edited(base, i, 0.004 * (i % 12))) for i in range(70)]
    docs += [(300 + i, edited(words(12 + i % 3, 90), i, 0.01 * (i % 4))) for i in range(24)]
    docs += [*odd_rows()]
    got = found(nearcopies.near_copies(make(docs), k=k, percent=percent, rows=rows))
    assert got == brute(docs, k, percent)


def test_ids_with_several_texts(make):
    """An id's texts are one document: they tie together what each is linked with."""
    a, b = words(21, 80), words(22, 80)
    docs = [(5, a), (5, b), (3, a), (4, b + " end"), (9, words(23, 80))]
    got = nearcopies.near_copies(make(docs), k=3, percent=85, rows=8).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_empty(make):
    assert nearcopies.near_copies(make([])).count() == 0


def test_sequential_limits():
    """Later batches ask for more matches in all, and no batch asks for more than the limit's own rate."""
    steps = nearcopies.least_matches(296, 85)
    assert [n for n, _ in steps] == [*range(32, 296, 32), 296]
    assert all(m / n < 0.85 for n, m in steps)
    assert [m for _, m in steps] == sorted(m for _, m in steps)
    assert (1 - 0.85**8) ** nearcopies.bands_for(85, 8) <= nearcopies.MISS_BANDS


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(500 + i, 500) for i in range(1, 60)] + [(900, 901), (None, 5), (7, 7)]
    got = components(spark.createDataFrame(chain, "a long, b long"), Workspace(spark, "test")).collect()
    want = {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 560), 500), 900: 900, 901: 900}
    assert {r["node"]: r["label"] for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_query(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found(queries.op10_near_copies(spark, small)) == brute(docs, 3, 85)
