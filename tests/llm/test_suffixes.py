"""Exact substring removal against all windows, and odd inputs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cytomosaic.llm import queries, suffixes
from tests.llm.conftest import odd_rows, words


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        covered = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                covered[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(b for b, c in zip(t, covered, strict=False) if not c)
        out.append((i, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), r["kept_sha256"]) for r in df.collect()), key=repr)


def tangled():
    """Copies of passages at all places, texts that repeat themselves, and runs of one letter."""
    source = random.Random(3)
    passages = [words(30 + i, 20) for i in range(4)]
    rows = []
    for i in range(60):
        parts = [words(1000 + i, source.randint(0, 20))]
        for _ in range(source.randint(0, 3)):
            cut = source.choice(passages)
            parts += [cut[source.randint(0, 30) : len(cut) - source.randint(0, 30)], words(2000 + source.randint(0, 10**6), 5)]
        rows.append((i, " ".join(parts)))
    rows += [(70, "abcab" * 80), (71, "x" * 500), (72, "yz" * 26), (73, "é" * 70 + words(5, 3)), (74, passages[0][:63]), (75, passages[0])]
    return rows


@pytest.mark.parametrize("wide", [20_000, 2])
def test_against_all_windows(make, wide):
    """Short windows; with the second limit nearly every open anchor is compared across buckets."""
    rows = [*tangled(), *[(i, t and t[:900]) for i, t in odd_rows()]]
    got = found(suffixes.deduplicate(make(rows), length=64, anchor=12, contexts_in_bucket=wide))
    assert got == brute(rows, 64)


def test_strides(make, monkeypatch):
    """Texts longer than a stride are found like others."""
    monkeypatch.setattr(suffixes, "STRIDE", 256)
    rows = [(1, words(1, 300)), (2, words(2, 40) + words(1, 300)[321:1500]), (3, words(3, 200))]
    assert found(suffixes.deduplicate(make(rows), length=64, anchor=12)) == brute(rows, 64)


def test_sorting_characters():
    source = random.Random(1)
    data = bytes(source.choice(b"ab") for _ in range(600))
    starts = np.array(range(0, 560))
    groups = starts % 3
    got = suffixes.repeated_suffixes(np.frombuffer(data, np.uint8), starts, groups, 13)
    seen = Counter((g, data[s : s + 13]) for s, g in zip(starts.tolist(), groups.tolist(), strict=True))
    assert got.tolist() == [seen[g, data[s : s + 13]] > 1 for s, g in zip(starts.tolist(), groups.tolist(), strict=True)]


def test_empty(make):
    assert suffixes.deduplicate(make([])).count() == 0


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.op4_suffix_dedup(spark, small).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == brute(rows, 200)
