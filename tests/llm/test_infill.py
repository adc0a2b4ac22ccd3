"""Cuts against regular expressions, Fenwick descent against plain counting, and odd inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cytomosaic.llm import infill as I
from tests.llm.conftest import odd_rows

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(key, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (key, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return (key, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (key, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def mess(seed, n):
    source = random.Random(seed)
    return "".join(source.choice(["a", "Z", "abc", " ", "\n", "é", "日", "😀", "1", "́", "ß", "<", "S", ">"]) for _ in range(n))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64, 1024])
def test_tree(block, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 50)
    for text in (mess(block, 200), "", "x", "é", "a" * 300, "日" * 50, "1a" * 40 + "b" * 100 + "é"):
        tree = I.BlockTree(text.encode(), block)
        units = UNIT.findall(text)
        assert (tree.n_units, tree.n_points) == (len(units), len(text))
        for i in range(len(units) + 1):
            before = "".join(units[:i])
            assert tree.find(i) == (len(before.encode()), len(before))


def test_brute(spark, make):
    rows = [*odd_rows(), *((100 + i, mess(i, i * 3)) for i in range(150)), (20, "a<S>b c d"), (21, "<M>"), (22, "a <P"), (23, "ab" * 5000 + "é" * 3000)]
    out = I.infill(make(rows), block=16)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", I.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_columns(spark, make):
    docs = make([(1, "some text here")]).withColumn("form", F.lit("x")).withColumn("n", F.lit(5))
    assert I.infill(docs, keep=["doc_id", "lang", "_id"]).columns == ["doc_id", "lang", "_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    with pytest.raises(ValueError):
        I.infill(docs, keep=["form"])
    assert I.infill(make([])).count() == 0
