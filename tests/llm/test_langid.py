"""Language identification: held-out accuracy, mixed texts, Viterbi against all paths, and odd inputs."""

import itertools
import zlib

import numpy as np

from cytomosaic.llm import langid, queries
from tests.llm.conftest import odd_rows

LATIN = {
    "aa": "bala kina moro tadi sule pano lira beno",
    "bb": "strick wurf zacht grond blik sprong knecht vrucht",
}


def corpus():
    rows = []
    for lang, some in LATIN.items():
        for i in range(30):
            own = some.split()
            rows.append((len(rows), " ".join(own[(i * 3 + j * 5) % 8] for j in range(20)), lang))
    rows += [(len(rows) + i, "добро слово река город " * 4, "cc") for i in range(10)]
    return rows


def test_mixed_text(make):
    model = langid.train(make(corpus()))
    assert model.languages == ["aa", "bb", "cc"]
    text = "bala kina moro tadi. 12 grond blik sprong vrucht; добро слово"
    row = langid.label(make([(1, text)]), model).collect()[0]
    pieces = [(s["lang"], text[s["start"] : s["end"]]) for s in row["spans"]]
    assert pieces == [("aa", "bala kina moro tadi"), ("bb", "grond blik sprong vrucht"), ("cc", "добро слово")]
    assert row["lang_pred"] == "bb" and 0 < row["score"] < 1


def test_viterbi_is_the_best_path():
    model = langid.Model(["a", "b", "c"], np.zeros((8, 3), np.float32), np.ones((len(langid.SCRIPTS), 3), bool), 1.5)
    decoder = langid.Decoder(model)
    texts = [["x", "y", "z", "x", "y"], [], ["z"], ["y", "y", "x", "z"]]
    decoder.learn(texts)
    scores = {"x": (0, -2, -1), "y": (-3, 0, -1), "z": (-1, -1.2, 0)}
    for word, at in decoder.place.items():
        decoder.scores[at] = scores[word]
    labels, letters = decoder.decode(texts)
    for text, got, count in zip(texts, labels, letters, strict=True):
        def worth(path, text=text):
            return sum(scores[w][s] for w, s in zip(text, path, strict=True)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))

        best = max((worth(p) for p in itertools.product(range(3), repeat=len(text))), default=0)
        assert abs(worth(got.tolist()) - best) < 1e-6
        assert count.sum() == len(text)


def test_odd_rows(make):
    model = langid.train(make(corpus()))
    rows = [(i, t, "aa") for i, t in odd_rows()] + [(20, "12 ²½ --"), (21, "İstanbul STRASSE ǅ"), (22, "日本")]
    got = langid.label(make(rows), model, keep_text=True).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = sum(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (letters == 0)
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (letters > 0)
        assert bool(r["spans"]) == (letters > 0)
    assert langid.label(make([]), model).count() == 0


def test_nothing_learned(make):
    model = langid.train(make([(1, "some text", None), (2, None, "aa")]))
    assert [r["lang_pred"] for r in langid.label(make([(3, "some text")]), model).collect()] == ["und"]


def test_query(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op3_language_spans(spark, small).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"] is not None]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.95 * len(held)
