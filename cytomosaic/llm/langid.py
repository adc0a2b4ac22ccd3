"""Language identification of mixed text.

Letter trigrams of all labelled training texts are counted per language. A word's score in a language is the sum of its
trigrams' log shares there; the script of its first letter narrows the languages that are considered. Viterbi decoding
over the words, with a penalty for each switch, labels every word; runs of one label are the spans, and the language with
most letters is the document's.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import binaries, map_batches, mixed, small_batches

UNDETERMINED = "und"
#: Runs of letters (and letter-like numerals, which carry no letters and no score).
WORD = re.compile(r"[^\W\d_]+")
#: First code point and script, in order; a script holds up to the next row's first code point (fixed values).
SCRIPT_RANGES = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2C60, "latin"),
    (0x2C80, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xA640, "cyrillic"),
    (0xA6A0, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFE00, "other"),
    (0xFF21, "latin"),
    (0xFF66, "kana"),
    (0x10000, "other"),
    (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
STARTS = [first for first, _ in SCRIPT_RANGES]
SCRIPT_OF_RANGE = [SCRIPTS.index(name) for _, name in SCRIPT_RANGES]

#: Hash buckets of trigrams; a model has this many numbers for each language.
BUCKETS = 1 << 15
#: Cost of a change of language between two words, in nats.
SWITCH = 12.0
#: Share of a language's training words in a script from which it is a candidate there.
LEAST_SHARE = 0.01
#: Cost of a word in a language that does not use its script.
FOREIGN = 200.0
#: Distinct words a task remembers, and texts that are decoded side by side.
REMEMBERED_WORDS, TEXTS_AT_ONCE = 150_000, 1024


def script_of(letter: str) -> int:
    return SCRIPT_OF_RANGE[bisect_right(STARTS, ord(letter)) - 1]


def words_of(text: bytes | None) -> list[str]:
    """The words in lower case, one for each run of letters of the text as it stands."""
    if not text:
        return []
    chars = text.decode()
    lowered = chars.lower()
    if len(lowered) == len(chars):
        return WORD.findall(lowered)
    return [w.lower() for w in WORD.findall(chars)]  # a letter whose lower case is two code points


def trigrams(words: list[str], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' letter trigrams, with a mark at either end of a word, and the number of each word's."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words])
    p = np.uint64(0x100000001B3)
    grams = mixed((codes[:-2] * p + codes[1:-1]) * p + codes[2:]) % np.uint64(n_buckets)
    ends = np.cumsum(sizes + 2)
    inside = np.ones(len(codes), bool)
    inside[ends - 1] = inside[ends - 2] = False  # a trigram starts at each mark and letter but the last
    return grams[inside[: len(grams)]].astype(np.int64), sizes


@dataclass(frozen=True)
class Model:
    """``ratios``: (bucket, language) log shares; ``allowed``: (script, language)."""

    languages: list[str]
    ratios: np.ndarray
    allowed: np.ndarray
    switch: float = SWITCH


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", n_buckets: int = BUCKETS, switch: float = SWITCH) -> Model:
    """Count all rows with a language. The driver receives languages x (buckets + scripts) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter[str]] = {}
        totals: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, counter in counters.items():
                words = [w for w in counter if any(map(str.isalpha, w))]
                if not words:
                    continue
                times = np.array([counter[w] for w in words])
                grams, sizes = trigrams(words, n_buckets)
                total = totals.setdefault(lang, np.zeros(n_buckets + len(SCRIPTS), np.int64))
                total[:n_buckets] += np.bincount(grams, np.repeat(times, sizes), n_buckets).astype(np.int64)
                scripts = [script_of(w[0]) for w in words]
                total[n_buckets:] += np.bincount(scripts, times, len(SCRIPTS)).astype(np.int64)
            counters.clear()

        for batch in small_batches(batches):
            langs = batch.column(1).to_pylist()
            for text, lang in zip(binaries(batch, "_text"), langs, strict=True):
                counters.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counters.values())) > REMEMBERED_WORDS:
                settle()
        settle()
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "place": at.astype(np.int32), "n": total[at]})

    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    counted = known.mapInArrow(run, "lang string, place int, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((n_buckets + len(SCRIPTS), len(languages)))
    table[rows["place"].to_numpy(int), np.searchsorted(languages, rows["lang"])] = rows["n"]
    grams, scripts = table[:n_buckets] + 0.5, table[n_buckets:]
    allowed = scripts >= LEAST_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language uses tells nothing
    return Model(languages, (np.log(grams) - np.log(grams.sum(0))).astype(np.float32), allowed, switch)


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.size = len(model.languages)
        self.scores = np.empty((REMEMBERED_WORDS, self.size), np.float32)
        self.letters = np.empty(REMEMBERED_WORDS, np.int32)

    def learn(self, texts: list[list[str]]) -> None:
        """Scores of the words that are new."""
        every = set().union(*texts)
        new = every.difference(self.place)
        if len(self.place) + len(new) > len(self.scores):
            self.place.clear()
            new = every
            if len(new) > len(self.scores):
                self.scores = np.empty((len(new), self.size), np.float32)
                self.letters = np.empty(len(new), np.int32)
        words = sorted(new)  # sums must not depend on the order of a set
        if not words:
            return
        base = len(self.place)
        self.place.update(zip(words, range(base, base + len(words)), strict=True))
        grams, sizes = trigrams(words, len(self.model.ratios))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        scores = np.add.reduceat(self.model.ratios[grams], starts, axis=0)
        scripts = np.array([script_of(w[0]) for w in words])
        scores -= np.where(self.model.allowed[scripts], 0, FOREIGN).astype(np.float32)
        letters = sizes.copy()
        for i, word in enumerate(words):
            if not word.isalpha():  # letter-like numerals
                letters[i] = sum(map(str.isalpha, word))
        scores[letters == 0] = 0
        self.scores[base : base + len(words)] = scores
        self.letters[base : base + len(words)] = letters

    def decode(self, texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each text's label of every word, and letters by language. All texts advance together, word by word."""
        self.learn(texts)
        n = len(texts)
        order = sorted(range(n), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order])
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        place = np.fromiter((p for i in order for p in map(self.place.__getitem__, texts[i])), np.int64, int(sizes.sum()))
        scores = self.scores[place]
        longest = int(sizes[0]) if n else 0
        # sizes fall: at word t the texts before active[t] are still going
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        best = np.zeros((n, self.size), np.float32)
        stay = np.ones((len(place), self.size), bool)
        top = np.zeros(len(place), np.int16)
        penalty = np.float32(self.model.switch)
        for t in range(longest):
            k = active[t]
            at = firsts[:k] + t
            before = best[:k]
            lead = before.argmax(1)
            switched = before[np.arange(k), lead][:, None] - penalty
            if t:
                stay[at] = before >= switched
                top[at] = lead
                best[:k] = np.maximum(before, switched) + scores[at]
            else:
                best[:k] = scores[at]
        labels = np.empty(len(place), np.int16)
        state = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at = firsts[:k] + t
            labels[at] = state[:k]
            state[:k] = np.where(stay[at, state[:k]], state[:k], top[at])
        letters = self.letters[place]
        by_text, by_letters = [None] * n, [None] * n
        for rank, i in enumerate(order):
            own = slice(firsts[rank], firsts[rank] + sizes[rank])
            by_text[i] = labels[own]
            by_letters[i] = np.bincount(labels[own], letters[own], self.size)
        return by_text, by_letters


def spans_of(text: bytes, labels: np.ndarray, languages: list[str]) -> list[dict[str, object]]:
    """Runs of one language: from its first word's start to its last word's end, in code points."""
    if not len(labels):
        return []
    found = [m.span() for m in WORD.finditer(text.decode())]
    cuts = np.flatnonzero(np.diff(labels)) + 1
    firsts, lasts = [0, *cuts.tolist()], [*(cuts - 1).tolist(), len(labels) - 1]
    return [{"start": found[a][0], "end": found[b][1], "lang": languages[labels[a]]} for a, b in zip(firsts, lasts, strict=True)]


SPANS = "array<struct<start: int, end: int, lang: string>>"
SPANS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def label(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    out: tuple[str, str, str] = ("lang_pred", "score", "spans"),
    keep_text: bool = False,
) -> DataFrame:
    """All columns, the text's only if asked for, with the text's language, its share of the letters, and the language spans.

    A null text, one without letters, or a model without languages gives ``und``, 0 and no spans. Equal shares go to the
    first language by name. Only the text is looked at, so repeated rows get the same result. Columns named like the
    results are replaced.
    """
    fields = [f for f in docs.schema.fields if f.name not in (*out, text_col)]

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        decoder = Decoder(model)
        languages = model.languages

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            raw = binaries(batch, text_col)
            words = [words_of(t) if languages else [] for t in raw]
            labels, letters = decoder.decode(words) if any(words) else ([[]] * len(raw), [[]] * len(raw))
            names, shares, spans = [], [], []
            for text, own, count in zip(raw, labels, letters, strict=True):
                total = float(sum(count))
                if not total:
                    names.append(UNDETERMINED)
                    shares.append(0.0)
                    spans.append([])
                    continue
                top = int(np.argmax(count))
                names.append(languages[top])
                shares.append(float(count[top]) / total)
                spans.append(spans_of(text, own, languages))
            columns = {f.name: batch.column(i) for i, f in enumerate(fields)}
            if keep_text:
                columns[text_col] = batch.column(len(fields))
            return {**columns, out[0]: names, out[1]: pa.array(shares, pa.float64()), out[2]: pa.array(spans, SPANS_ARROW)}

        return work

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    schema += [f"`{text_col}` string"] if keep_text else []
    schema += [f"`{out[0]}` string", f"`{out[1]}` double", f"`{out[2]}` {SPANS}"]
    chosen = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text_col}`"))
    return map_batches(chosen, start, ", ".join(schema), rows=TEXTS_AT_ONCE)
