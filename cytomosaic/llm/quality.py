"""Quality rules on whole texts and a hashed n-gram log-likelihood ratio.

Word n-grams of all documents are hashed into buckets and counted twice: over documents labelled as trusted, and over the
whole corpus. The number of buckets follows from the corpus: as the square root of the different n-grams, so that buckets,
and what is counted in each, grow alike. The two smoothed multinomials give each bucket a log ratio; a document's score is the mean ratio of its n-grams. Ratios are sent to
the tasks up to a stated number of buckets, and meet the n-grams in a shuffle beyond. A fifth of the labels, by a hash of
the id, takes no part in the counts and sets the threshold from its exact histogram by a stated rule, so every document
gets its verdict from the same numbers however the job was split.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import WordHashes, Workspace, binaries, map_batches, small_batches, windows

# fixed values
BLANKS = b"\x20\t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
#: Word windows: a repeated one marks its words.
REPEAT_WINDOW = 3
MOST_REPEATED_PERCENT = 50
#: Hash buckets for each unit of the square root of the different n-grams, rounded up to a power of two.
BUCKETS_PER_ROOT = 16
LEAST_BUCKETS = 1 << 15
#: Least hashes from which the number of different n-grams is told, within some 3 %.
SKETCH = 1_024
#: Ratios are sent to every task up to this many buckets (8 bytes each), and joined by a shuffle beyond.
SENT_BUCKETS = 1 << 22
#: Beyond, buckets with more than this share of all n-grams are sent all the same: fewer than its inverse, and no hot key is left.
FREQUENT = 1 / (1 << 20)
#: N-grams that a task brings together before it hands counts over.
HELD_GRAMS = 1 << 21
#: Scores are rounded to so many digits, which hides in which order they were summed.
DIGITS = 9
#: Lengths of the word n-grams.
ORDERS = (1, 2)
#: One label in so many sets the threshold and is not counted as trusted text.
HELD_OUT = 5
#: Share of trusted documents that may fall below the threshold.
MOST_LOST = 0.002
#: Histogram steps of a score, within +-LIMIT.
STEP, LIMIT = 0.01, 10.0
#: Trusted ids are sent to every task up to this many rows (8 bytes each), and joined by a shuffle beyond.
SENT_IDS = 4_000_000


def rule_counts(raw: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words within repeated windows."""
    words = raw.split()
    solid = raw.translate(None, BLANKS)
    chars = len(solid.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, again = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip(BLANKS):
            seen.add(line)
    marks = np.zeros(len(words) + 1, np.int32)
    grams = windows(hashes.of(words), REPEAT_WINDOW)
    if len(grams) > 1:
        _, place, count = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(count[place] > 1)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + REPEAT_WINDOW, -1)
    return len(words), chars, symbols, again, int((np.cumsum(marks) > 0).sum())


def grams(raw: bytes, hashes: WordHashes) -> np.ndarray:
    """The 64-bit hash of each n-gram of a text, lower-cased in A-Z."""
    numbers = hashes.of(raw.lower().split())
    return np.concatenate([windows(numbers, k) for k in ORDERS])


def buckets(raw: bytes, hashes: WordHashes, n_buckets: int) -> np.ndarray:
    return (grams(raw, hashes) % np.uint64(n_buckets)).astype(np.int64)


def distinct_grams(docs: DataFrame, size: int = SKETCH) -> int:
    """About how many different n-grams the column ``_text`` holds, exact below ``size``.

    Told from the ``size`` least hashes of all, so it does not depend on how the rows are split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, least = WordHashes(), np.empty(0, np.uint64)
        for batch in small_batches(batches):
            for raw in binaries(batch, "_text"):
                found = grams(raw, hashes) if raw else least[:0]
                if len(least) == size:
                    found = found[found < least[-1]]
                if len(found):
                    least = np.unique(np.concatenate([least, found]))[:size]
        yield pa.RecordBatch.from_pydict({"least": pa.array((least >> np.uint64(1)).astype(np.int64))})

    found = docs.select("_text").mapInArrow(run, "least bigint").distinct().orderBy("least").limit(size).collect()
    return len(found) if len(found) < size else int((size - 1) * 2.0**63 / max(found[-1]["least"], 1))


def buckets_for(n_grams: int) -> int:
    """The number of buckets for so many different n-grams."""
    return max(LEAST_BUCKETS, 1 << max(BUCKETS_PER_ROOT * math.isqrt(n_grams) - 1, 0).bit_length())


def bucket_counts(docs: DataFrame, n_buckets: int, held: int = HELD_GRAMS) -> DataFrame:
    """(bucket, trusted, raw): n-grams of documents with ``_trusted``, and of all; columns ``_text`` and ``_trusted``."""

    def totals(codes: list[np.ndarray]) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return pa.RecordBatch.from_pydict({"bucket": code >> 1, "trusted": np.where(code & 1, n, 0), "raw": n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, codes, size = WordHashes(), [], 0
        for batch in small_batches(batches):
            trusted = batch.column(batch.schema.get_field_index("_trusted")).to_pylist()
            for raw, kind in zip(binaries(batch, "_text"), trusted, strict=True):
                if raw:
                    codes.append(buckets(raw, hashes, n_buckets) << 1 | int(bool(kind)))
                    size += len(codes[-1])
                if size >= held:
                    yield totals(codes)
                    codes, size = [], 0
        if codes:
            yield totals(codes)

    counted = docs.select("_text", "_trusted").mapInArrow(run, "bucket bigint, trusted bigint, raw bigint")
    return counted.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, raw, ratio): log p(bucket | trusted) - log p(bucket | corpus), each with one added to every bucket.

    Without trusted text no document is told from another, and all ratios are zero.
    """
    all_trusted, all_raw = (v or 0 for v in counts.agg(F.sum("trusted"), F.sum("raw")).first())
    if not all_trusted:
        return counts.select("bucket", "raw", F.lit(0.0).alias("ratio"))
    shift = math.log(all_raw + n_buckets) - math.log(all_trusted + n_buckets)
    return counts.select("bucket", "raw", (F.log(F.col("trusted") + 1.0) - F.log(F.col("raw") + 1.0) + F.lit(shift)).alias("ratio"))


def in_memory(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in order, and their ratios; for a counted number of rows."""
    rows = ratios.select("bucket", "ratio").toArrow()
    bucket, ratio = rows.column("bucket").to_numpy(), rows.column("ratio").to_numpy()
    order = np.argsort(bucket)
    return bucket[order], ratio[order]


def joined_scores(texts: DataFrame, ratios: DataFrame, n_buckets: int, frequent: float = FREQUENT) -> DataFrame:
    """(_high, _low, score) for each different text of the columns ``_text``, ``_high`` and ``_low``, its 128-bit hash.

    N-grams of frequent buckets are summed where the text is read. The others leave as one row for a bucket of a text, meet
    their ratio, and are summed for the text. Copies of a text add alike to sum and number, so they leave the mean as it is.
    """
    total = ratios.agg(F.sum("raw")).first()[0] or 0
    often, often_ratio = in_memory(ratios.filter(F.col("raw") > frequent * total))
    sent = texts.sparkSession.sparkContext.broadcast((often, often_ratio))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (known, value) = WordHashes(), sent.value
        for batch in small_batches(batches):
            keys = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_high", "_low")]
            row, bucket, n, part = [], [], [], []
            for i, raw in enumerate(binaries(batch, "_text")):
                found, times = np.unique(buckets(raw or b"", hashes, n_buckets), return_counts=True)
                at = np.searchsorted(known, found)
                hit = at < len(known)
                hit[hit] = known[at[hit]] == found[hit]
                row.append(np.full(1 + int((~hit).sum()), i))
                bucket += [[-1], found[~hit]]
                n += [[times[hit].sum()], times[~hit]]
                part += [[(times[hit] * value[at[hit]]).sum()], np.zeros(int((~hit).sum()))]
            at = np.concatenate(row)
            yield pa.RecordBatch.from_pydict({
                "_high": keys[0][at], "_low": keys[1][at], "bucket": np.concatenate(bucket).astype(np.int64),
                "n": np.concatenate(n).astype(np.int64), "part": np.concatenate(part).astype(float),
            })

    schema = "_high bigint, _low bigint, bucket bigint, n bigint, part double"
    found = texts.select("_high", "_low", "_text").mapInArrow(run, schema)
    # rows of frequent buckets find no partner, as -1 is no bucket; they are spread by their text
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod("_high", F.lit(1 << 40)))
    met = found.withColumn("bucket", spread).join(ratios.select("bucket", "ratio"), "bucket", "left")
    sums = met.groupBy("_high", "_low").agg(
        F.sum(F.col("part") + F.coalesce(F.col("n") * F.col("ratio"), F.lit(0.0))).alias("_sum"), F.sum("n").alias("_n")
    )
    return sums.select("_high", "_low", F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)).alias("score"))


def threshold(scores: DataFrame, most_lost: float = MOST_LOST) -> float:
    """The score below which rows are not kept; ``_trusted`` is true, false, or null for rows that take no part.

    Scores are counted in steps of ``STEP``. Of the steps that leave at most ``most_lost`` of the trusted rows below, the
    one with most distrusted rows below is taken, the middle one of several. Without both kinds nothing falls below.
    """
    place = F.floor(F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) / STEP).cast("long")
    rows = scores.filter(F.col("_trusted").isNotNull()).groupBy(place.alias("place"), "_trusted").count().collect()
    size = int(LIMIT / STEP)
    tally = np.zeros((2, 2 * size + 2))
    for row in rows:
        tally[int(row["_trusted"]), row["place"] + size] += row["count"]
    if not tally.sum(1).all():
        return -LIMIT - STEP
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(tally, 1)], 1)
    allowed = np.flatnonzero(below[1] <= most_lost * tally[1].sum())
    best = allowed[below[0, allowed] == below[0, allowed].max()]
    return float((best[len(best) // 2] - size) * STEP)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_buckets: int | None = None,
    least_score: float | None = None,
    sent_buckets: int = SENT_BUCKETS,
) -> DataFrame:
    """Rule counts, ``base_failed``, ``score`` and ``kept`` of each row of ``docs``.

    ``labels`` has the id column and ``trusted`` (boolean). An id labelled both ways is not used; null ids and nulls in
    ``trusted`` neither. A null text has no words and fails the rules; a text without n-grams scores 0. Repeated rows are
    judged alike and each count in the corpus. ``least_score`` replaces the fitted threshold, ``n_buckets`` the number of
    buckets that follows from the corpus.
    """
    ws = Workspace(docs.sparkSession, "quality")
    agreed = (
        labels.filter(F.col(id_col).isNotNull() & F.col("trusted").isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min("trusted").alias("_trusted"), F.max("trusted").alias("_most"))
        .filter(F.col("_trusted") == F.col("_most"))
        .select("_id", "_trusted", (F.crc32(F.col("_id").cast("string").cast("binary")) % HELD_OUT == 0).alias("_held"))
    )
    agreed = ws.keep(agreed, "labels")
    sent = F.broadcast(agreed) if agreed.count() <= SENT_IDS else agreed
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(sent, "_id", "left")
    counted = read.withColumn("_trusted", F.coalesce(F.col("_trusted") & ~F.col("_held"), F.lit(False)))
    if n_buckets is None:
        n_buckets = buckets_for(distinct_grams(docs.select(F.col(f"`{text_col}`").alias("_text"))))
    ratios = log_ratios(ws.keep(bucket_counts(counted, n_buckets), "counts"), n_buckets)
    small = n_buckets <= sent_buckets
    known, value = in_memory(ratios) if small else (np.empty(0, np.int64), np.empty(0))
    table = np.zeros(n_buckets if small else 0)
    table[known] = value
    sent_table = docs.sparkSession.sparkContext.broadcast(table)
    read = read.withColumn("_trusted", F.when(F.col("_held"), F.col("_trusted")))

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        hashes, table = WordHashes(), sent_table.value

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            counts, scores = [], []
            for raw in binaries(batch, "_text"):
                raw = raw or b""
                counts.append(rule_counts(raw, hashes))
                found = buckets(raw, hashes, n_buckets) if len(table) else np.empty(0, np.int64)
                scores.append(float(table[found].mean()) if len(found) else 0.0)
            columns = np.array(counts, np.int64).reshape(-1, len(COUNTS))
            return {
                **{c: batch.column(batch.schema.get_field_index(c)) for c in ("_high", "_low")},
                "_id": batch.column(batch.schema.get_field_index("_id")),
                "_trusted": batch.column(batch.schema.get_field_index("_trusted")),
                **{name: columns[:, i] for i, name in enumerate(COUNTS)},
                "score": pa.array(scores, pa.float64()),
            }

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_high bigint, _low bigint, _id {kind}, _trusted boolean, {', '.join(f'{c} bigint' for c in COUNTS)}, score double"
    keyed = read.select(
        F.xxhash64("_text").alias("_high"), F.xxhash64("_text", F.lit(1)).alias("_low"), "_id", "_trusted", "_text"
    )
    judged = map_batches(keyed, start, schema)
    if not small:
        judged = judged.drop("score").join(joined_scores(keyed, ratios, n_buckets), ["_high", "_low"], "left")
    scored = ws.keep(judged.drop("_high", "_low").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), DIGITS)), "scores")
    least = threshold(scored) if least_score is None else least_score
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).select(
        F.col("_id").alias(id_col), *COUNTS, "base_failed", (~failed & (F.col("score") >= least)).alias("kept"), "score"
    )


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
