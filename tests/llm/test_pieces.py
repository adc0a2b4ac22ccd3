"""Piece encoding against the library, normalisation against its compiled maps, and odd inputs."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from cytomosaic.llm import pieces, queries
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
ALPHABET = [*"ab  \n\t▁é日😀<s>0x41 　́‍", "</s>", "<0x41>", " the", "   "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(MODEL)


def samples():
    source = random.Random(5)
    made = ["".join(source.choice(ALPHABET) for _ in range(source.randint(0, 25))) for _ in range(1500)]
    return [*made, "a" * 3000 + " " * 900 + "b", " lead", "trail ", "▁", "", "abc" * 30 + "é"]


def test_ids_and_spans(library, own):
    texts = samples()
    for text, (ids, starts, ends) in zip(texts, own.encode_all([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == library.encode(text), text
        want = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want, text


def test_both_ways_of_merging_agree(own):
    for text in samples():
        chunk = "▁" + text.replace(" ", "▁")
        ids, sizes = own.pieces_of(chunk[:20])
        assert sum(sizes) == len(chunk[:20].encode())
        left = own.merge_many([chunk[:20]])
        if not left:
            turns = np.frombuffer(own.known[chunk[:20]], np.int32).reshape(-1, 2)
            assert turns[:, 0].tolist() == ids


def test_decoding_any_ids(library, own):
    source = random.Random(6)
    some = [0, 1, 2, 3, 100, 200, 250, 258, 259, 260, 263, 300, 29871]
    for _ in range(3000):
        ids = [source.choice([*some, source.randrange(32000)]) for _ in range(source.randint(0, 6))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_longest_prefix_normalisation(own, rule):
    """Against the library's normaliser with the same compiled map."""
    from sentencepiece import sentencepiece_model_pb2

    normaliser = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(normaliser.serialized_normalizer_spec())
    for trim in (True, False):
        mapped = pieces.Pieces(MODEL)
        mapped.chars = pieces.CharacterMap(spec.precompiled_charsmap)
        mapped.dummy_prefix, mapped.trim, mapped.plain = False, trim, False
        exact = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=trim, add_dummy_prefix=False, escape_whitespaces=True)
        for text in [*samples()[:600], "ｶﾞ１２ ㈱ ﬁ ½ Ⅷ", "  Å  Å ", "①　②"]:
            norm, source = mapped.normalise(text.encode())
            assert norm.decode() == exact.normalize(text), (text, trim)
            assert len(source) == len(norm) + 1 and (np.diff(source) >= 0).all()
            assert norm == b"" or source[-1] <= len(text.encode())


def test_odd_rows(make, library):
    rows = odd_rows()
    got = {}
    for row in pieces.decode(pieces.encode(make(rows), MODEL), MODEL).collect():
        got.setdefault(row["doc_id"], []).append((row["ids"], row["decoded"]))
    for doc_id, text in rows:
        ids = library.encode(text or "")
        assert (ids, library.decode(ids)) in got[doc_id]
    assert sum(map(len, got.values())) == len(rows)
    assert pieces.encode(make([]), MODEL).count() == 0


def test_query(spark, small, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries.op9_sentencepiece_offsets(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc["text"] or "")
        row = got[doc["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), digest(",".join(map(str, ids))))
        assert row["decoded_sha256"] == digest(library.decode(ids))
        assert row["n_bytes"] == len((doc["text"] or "").encode())


def test_query_on_null_and_empty_texts(spark, make, library, tmp_path):
    rows = odd_rows()
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_bytes"]) for r in queries.op9_sentencepiece_offsets(spark, str(tmp_path)).collect()]
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        want.append((doc_id, len(ids), *digests, len((text or "").encode())))
    assert sorted(got, key=str) == sorted(want, key=str)


BROKEN = [b"ab\xff\xfecd", b"\xed\xa0\x80x y", b"abc\xe2\x96", b"\xf4\x90\x80\x80", b"a \xc0\x80 b", b"\xe2\x96\x81\xff the"]


def test_bytes_of_no_character_are_taken_as_the_library_takes_them(spark, library, own):
    for raw, (ids, starts, ends) in zip(BROKEN, own.encode_all(BROKEN), strict=True):
        assert ids.tolist() == library.encode(raw)
        assert own.decode(ids) == library.decode(ids.tolist())
        assert ends[-1] == len(raw) and (starts <= ends).all()
    rows = spark.createDataFrame([(i, bytearray(raw)) for i, raw in enumerate(BROKEN)], "doc_id long, raw binary")
    got = pieces.encode(rows.selectExpr("doc_id", "CAST(raw AS STRING) AS text"), MODEL).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [library.encode(raw) for raw in BROKEN]


def test_long_texts_are_encoded_and_remembered_a_bounded_part_at_once(library, monkeypatch):
    import pyarrow as pa

    from cytomosaic.llm.common import small_batches

    texts = ["word " * n for n in (1, 400, 3, 2, 900, 1)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(small_batches(iter([batch]), 256, 2_000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.nbytes <= 2_000 for p in parts) and len(parts) > 2
    monkeypatch.setattr(pieces, "REMEMBERED_CHARS", 2_000)
    fresh = pieces.Pieces(MODEL)
    for n in range(40):  # without spaces a text is one chunk
        (ids, _, _), = fresh.encode_all([(chr(0x4E00 + n) * 300).encode()])
        assert ids.tolist() == library.encode(chr(0x4E00 + n) * 300)
        assert sum(map(len, fresh.known)) <= 2_000
