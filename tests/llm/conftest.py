import os
import random

import pytest

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id int, _text string, kept string, score string, label string, node int"


def documents(spark, rows, schema=DOCS):
    """Documents with extra columns whose names operators use themselves; rows are (doc_id, text[, lang[, source]])."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, *(None, None))[:4]
        full.append((doc_id, text, lang, source, len(text) if text else 0, 7, "x", "k", "s", "l", 3))
    return spark.createDataFrame(full, schema)


@pytest.fixture
def make(spark):
    return lambda rows: documents(spark, rows)


def words(seed, n, vocabulary=4000):
    """A text of ``n`` made-up words in lines."""
    source = random.Random(seed)
    return "".join(f"w{source.randrange(vocabulary)}x" + ("\n" if i % 12 == 11 else " ") for i in range(n)).strip()


def edited(text, seed, share):
    """The text with a share of its words replaced."""
    source = random.Random(seed)
    return " ".join(f"z{source.randrange(9999)}" if source.random() < share else w for w in text.split())


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


def odd_rows():
    """Null and empty texts and ids, one very long text, repeated rows and copies."""
    long = words(1, 30_000)
    near = words(2, 120)
    return [
        (None, None),
        (None, near),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, "one two"),
        (6, long),
        (7, long + " more"),
        (8, near),
        (8, near),
        (9, near),
        (10, edited(near, 3, 0.02)),
        (11, edited(near, 4, 0.5)),
        (12, "é日😀 ▁ \x85\xa0 x"),
    ]
