"""Benchmark decontamination by templates.

Numbers, units behind numbers, and names are replaced by typed placeholders, in the benchmark and in the documents.
Windows of the canonical tokens are joined by hash; windows that are nearly all placeholders keep their values, so they are
found word for word only. Where an item's windows are found along one alignment with a document and cover most of the item,
the values in the slots are compared place by place: each value of the item must always stand against the same value in the
document. So a question counts as found word for word, or with other numbers and names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from cytomosaic.llm.common import Workspace, binaries, lists, map_batches, mixed, windows

# fixed values: units that may follow a number
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg t ton tons tonnes oz lb lbs pound pounds ml l liter liters litre "
    "litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent "
    "degree degrees dollar dollars cent cents euro euros watt watts volt volts joule joules mph kmh hz".split()
)
#: Marks after which a capital letter says nothing; units that stand as signs.
MARKS, SIGNS = ".!?:;\"\n", "%$€£"
#: What joins digits to one number, and letters to one word.
POINTS, APOSTROPHES = ".,", "'’"
WINDOW = 5
#: Literal tokens that a window must have to be looked for.
LEAST_LITERAL = 2
#: Share of an item's tokens, in percent, that found windows must cover.
LEAST_COVER = 80
#: Tokens by which matches may drift apart within one passage.
DRIFT = 16
#: Hashes of benchmark windows sent to every task at once (8 bytes each); more are searched in blocks of this size.
SENT_WINDOWS = 2_000_000

LITERAL, NUMBER, UNIT, CAPITAL, MARK = range(5)
#: Tells hashes of values from hashes of canonical tokens.
AS_WRITTEN = np.uint64(0x5DEECE66D1234567)
PLACEHOLDERS = {kind: xxhash.xxh3_64_intdigest(f"<{name}>") for kind, name in ((NUMBER, "num"), (UNIT, "unit"), (CAPITAL, "name"))}
#: Code points that are split at once; a text is cut between them at a blank.
SPLIT_AT_ONCE = 1 << 20


class Alphabet:
    """What each code point is: a digit, a letter, or a mark, its case, and a number for its lower-case form."""

    NOTHING, DIGIT, LETTER, SIGN = range(4)

    def __init__(self, size: int = 1 << 16):
        self.size = size
        rows = [self.row(chr(c)) for c in range(size)]
        self.kind, self.upper, self.lower, folded = (np.array(column) for column in zip(*rows, strict=True))
        self.kind = self.kind.astype(np.uint8)
        self.number = mixed(folded.astype(np.uint64) + np.uint64(1))

    @classmethod
    def row(cls, c: str) -> tuple[int, bool, bool, int]:
        kind = cls.DIGIT if c.isdecimal() else cls.LETTER if c.isalpha() else cls.SIGN if c in MARKS + SIGNS else cls.NOTHING
        return kind, c.isupper(), c.islower() or c.istitle() and not c.isupper(), ord(c.lower()[0])

    def read(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        near = np.minimum(codes, self.size - 1)
        found = [table[near] for table in (self.kind, self.upper, self.lower, self.number)]
        for code in np.unique(codes[codes >= self.size]).tolist():  # rare scripts and signs
            at = codes == code
            *own, folded = self.row(chr(code))
            for column, value in zip(found, [*own, mixed(np.array([folded + 1], np.uint64))[0]], strict=True):
                column[at] = value
        return tuple(found)


@functools.cache
def alphabet() -> Alphabet:
    return Alphabet()


@functools.cache
def powers() -> np.ndarray:
    """Powers of an odd number modulo 2**64, for the places in a token; longer tokens start again."""
    return np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))


def split(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, hash without case, and kind of each token: numbers with points between digits, words with apostrophes
    between letters, and marks."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, upper, lower, number = alphabet().read(codes)
    for signs, inside in ((POINTS, Alphabet.DIGIT), (APOSTROPHES, Alphabet.LETTER)):
        for sign in signs:
            at = np.flatnonzero(codes == ord(sign))
            at = at[(at > 0) & (at < len(codes) - 1)]
            kind[at[(kind[at - 1] == inside) & (kind[at + 1] == inside)]] = inside
    begins = kind != Alphabet.NOTHING
    begins[1:] &= (kind[1:] == Alphabet.SIGN) | (kind[1:] != kind[:-1])
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.empty(0, np.uint64), np.empty(0, np.int8)
    table, units = powers(), unit_hashes()
    skipped = starts[0]
    own = slice(skipped, None)  # from the first token on
    starts, kind, lower, codes = starts - starts[0], kind[own], lower[own], codes[own]
    solid = kind != Alphabet.NOTHING
    place = np.arange(len(codes)) - starts[np.cumsum(begins[own]) - 1]
    hashes = mixed(np.add.reduceat(np.where(solid, number[own] * table[place & (len(table) - 1)], np.uint64(0)), starts))
    n_solid, n_lower = (np.add.reduceat(x, starts, dtype=np.int64) for x in (solid, lower & solid))
    first, first_kind = codes[starts], kind[starts]
    kinds = np.full(len(starts), LITERAL, np.int8)
    kinds[upper[own][starts] & (n_solid > 1) & (n_lower > 0)] = CAPITAL
    kinds[units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes] = UNIT
    kinds[first_kind == Alphabet.DIGIT] = NUMBER
    sign = first_kind == Alphabet.SIGN
    kinds[sign] = MARK
    for c in SIGNS:
        kinds[first == ord(c)] = UNIT
    return starts + skipped, hashes, kinds


@functools.cache
def unit_hashes() -> np.ndarray:
    table = powers()
    numbers = [(mixed(np.array([ord(c) + 1 for c in word], np.uint64)) * table[: len(word)]).sum() for word in UNITS]
    return np.sort(mixed(np.array(numbers, np.uint64)))


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of a bounded size, cut at blanks; a longer stretch without any stays in one part."""
    start = 0
    while len(text) - start > SPLIT_AT_ONCE:
        blank = re.compile(r"\s").search(text, start + SPLIT_AT_ONCE)
        if blank is None:
            break
        yield text[start : blank.start()]
        start = blank.start()
    yield text[start:]


def canonical(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with placeholders, the hashed value of each slot, whether a token is a slot, and the texts' first tokens
    with the end of the last, all texts one behind the other.

    A unit is a slot only next to a number; a capitalised word only where the token before is no mark. Names that follow
    one another are one slot. A line's end between the texts is a mark, so no text changes another.
    """
    found, at = [], 0
    for part in parts_of("\n".join(texts)):
        place, *rest = split(part)
        found.append((place + at, *rest))
        at += len(part)
    place, hashes, kinds = (np.concatenate(column) for column in zip(*found, strict=True))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    before = np.concatenate([np.full(min(1, len(kinds)), MARK, np.int8), kinds[:-1]])
    after = np.concatenate([kinds[1:], np.full(min(1, len(kinds)), MARK, np.int8)])
    kinds[(kinds == CAPITAL) & (before == MARK)] = LITERAL
    kinds[(kinds == UNIT) & (before != NUMBER) & (after != NUMBER)] = LITERAL
    kept = kinds != MARK
    place, hashes, kinds = place[kept], hashes[kept], kinds[kept]
    if not len(kinds):
        return hashes, hashes, np.zeros(0, bool), np.zeros(len(begins), np.int64)
    first = np.ones(len(kinds), bool)
    first[1:] = ~((kinds[1:] == CAPITAL) & (kinds[:-1] == CAPITAL))
    starts = np.flatnonzero(first)
    values = np.add.reduceat(mixed(hashes), starts)
    kinds = kinds[starts]
    out = hashes[starts]
    for kind, number in PLACEHOLDERS.items():
        out[kinds == kind] = number
    return out, values, kinds != LITERAL, np.searchsorted(place[starts], begins)


def template_windows(tokens: np.ndarray, values: np.ndarray, slots: np.ndarray, size: int, least_literal: int, whole: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows: of the canonical tokens where enough are literal, else of the values.

    Windows shorter than ``whole`` are left out if they have too few literal tokens: a few numbers alone say nothing.
    """
    hashes = windows(tokens, size)
    if not len(hashes):
        return np.empty(0, np.int64), hashes
    literal = np.concatenate([[0], np.cumsum(~slots)])
    telling = literal[size:] - literal[:-size] >= min(least_literal, size)
    if size < whole:
        at = np.flatnonzero(telling)
        return at, hashes[at] ^ np.uint64(size)
    if not telling.all():
        hashes = np.where(telling, hashes, windows(values, size) ^ AS_WRITTEN)
    return np.arange(len(hashes)), hashes ^ np.uint64(size)


ROWS = "pos array<int>, hash array<bigint>, slots array<array<struct<at: int, value: bigint>>>, n int"
SLOTS_ARROW = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())])))


def slots_of(at: np.ndarray, size: np.ndarray, values: np.ndarray, slots: np.ndarray) -> list[list[dict[str, int]]]:
    """The slots inside each window, by place in the window."""
    signed = values.view(np.int64)
    return [[{"at": i, "value": int(signed[p + i])} for i in np.flatnonzero(slots[p : p + s]).tolist()] for p, s in zip(at, size, strict=True)]


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, least_literal: int) -> DataFrame:
    """(item, n, size, pos, hash, slots) of each benchmark window; an item shorter than the window is one window of its own size."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            positions, hashes, slots, sizes, counts = [], [], [], [], []
            for raw in binaries(batch, "_text"):
                own, values, is_slot, _ = canonical([(raw or b"").decode()])
                size = min(window, len(own))
                at, found = template_windows(own, values, is_slot, size, least_literal, window) if size else (np.empty(0, np.int64), np.empty(0, np.uint64))
                positions.append(at)
                hashes.append(found.view(np.int64))
                slots.append(slots_of(at, np.full(len(at), size), values, is_slot))
                sizes.append(size)
                counts.append(len(own))
            return {
                "item": batch.column(0),
                "size": pa.array(sizes, pa.int32()),
                "pos": lists(positions, pa.int32()),
                "hash": lists(hashes, pa.int64()),
                "slots": pa.array(slots, SLOTS_ARROW),
                "n": pa.array(counts, pa.int32()),
            }

        return work

    kind = items.schema[id_col].dataType.simpleString()
    made = map_batches(items.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), start, f"item {kind}, size int, {ROWS}")
    each = F.explode(F.arrays_zip("pos", "hash", "slots")).alias("w")
    return made.filter("item IS NOT NULL").select("item", "n", "size", each).select("item", "n", "size", "w.*").distinct()


HITS = "doc_pos int, hash bigint, doc_slots array<struct<at: int, value: bigint>>"


def document_hits(docs: DataFrame, sizes: list[int], wanted: np.ndarray, least_literal: int, key: str, window: int = WINDOW) -> DataFrame:
    """(key, doc_pos, hash, doc_slots) of the documents' windows whose hash is among ``wanted`` (sorted)."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            own, values, is_slot, bounds = canonical([(raw or b"").decode() for raw in binaries(batch, "_text")])
            texts, at, found, slots = [], [], [], []
            for size in sizes:
                p, h = template_windows(own, values, is_slot, size, least_literal, window)
                hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                p, h = p[hit], h[hit]
                text = np.searchsorted(bounds, p, "right") - 1
                whole = p + size <= bounds[text + 1]  # not from one text into the next
                texts.append(text[whole])
                at.append(p[whole] - bounds[text[whole]])
                found.append(h[whole])
                slots += slots_of(p[whole], np.full(int(whole.sum()), size), values, is_slot)
            return {
                key: batch.column(0).take(pa.array(np.concatenate(texts))),
                "doc_pos": pa.array(np.concatenate(at), pa.int32()),
                "hash": pa.array(np.concatenate(found).view(np.int64)),
                "doc_slots": pa.array(slots, SLOTS_ARROW.value_type),
            }

        return work

    return map_batches(docs.select(F.col(f"`{key}`"), F.col("_text")), start, f"`{key}` {docs.schema[key].dataType.simpleString()}, {HITS}")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    least_literal: int = LEAST_LITERAL,
    least_cover: int = LEAST_COVER,
) -> DataFrame:
    """One row for each document key and item found in it.

    Columns: the key, ``item`` , ``cover`` (percent of the item's tokens), ``n_slots`` (slots compared), ``n_changed``
    (distinct values that differ), ``first_token`` and ``last_token`` of the passage in the document's canonical tokens.
    An item that stands in a document word for word is always found. Items without text or id, and items shorter than a
    window with too few literal tokens, are never found; null texts contain nothing, and empty tables give no rows. Rows that share a key are taken together. Repeated items count once. All windows of the benchmark are
    searched, in blocks if there are many.
    """
    ws = Workspace(docs.sparkSession, "templates")
    sought = ws.keep(item_windows(items, item_col, item_text_col, window, least_literal), "items")
    sizes = sorted(r["size"] for r in sought.select("size").distinct().collect())  # at most as many as the window is long
    read = docs.select(F.col(f"`{key}`"), F.col(f"`{text_col}`").alias("_text"))
    distinct = sought.select("hash").distinct()
    n_blocks = max(1, -(-distinct.count() // SENT_WINDOWS))
    hits = None
    for block in range(n_blocks):
        own = distinct.filter(F.pmod(F.col("hash"), F.lit(n_blocks)) == block).toPandas()["hash"].to_numpy(np.int64)
        wanted = np.sort(own.view(np.uint64))
        if len(wanted):
            found = document_hits(read, sizes, wanted, least_literal, key, window)
            hits = found if hits is None else hits.union(found)
    if hits is None:  # a benchmark without windows
        hits = docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, {HITS}")
    met = ws.keep(hits.join(sought, "hash"), "hits")

    # alignments: windows of one item at exactly the same offset, or at about the same (two shifted grids, so none is cut)
    apart = F.col("doc_pos") - F.col("pos")
    grids = F.array(
        F.struct(F.lit(0).alias("kind"), apart.alias("cell")),
        F.struct(F.lit(1).alias("kind"), F.floor(apart / (2 * DRIFT)).cast("int").alias("cell")),
        F.struct(F.lit(2).alias("kind"), F.floor((apart + DRIFT) / (2 * DRIFT)).cast("int").alias("cell")),
    )
    own = [key, "item", "grid"]
    placed = met.withColumn("apart", apart).withColumn("grid", F.explode(grids))
    # a cell's offsets by support, so that a window counts where most of the cell's windows stand
    support = W.Window.partitionBy(*own, "apart")
    placed = placed.withColumn("support", F.count(F.lit(1)).over(support))
    best = F.struct("support", -F.abs("apart"), -F.col("apart"))
    aligned = placed.groupBy(*own, "pos").agg(F.max(F.struct(best.alias("rank"), "doc_pos", "size", "n", "slots", "doc_slots")).alias("w")).select(*own, "pos", "w.*")
    aligned = ws.keep(aligned, "aligned")

    covered = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("size") - 1)))))  # within one item
    passages = aligned.groupBy(*own).agg(
        F.floor(100 * covered / F.max("n")).cast("int").alias("cover"),
        F.min("doc_pos").alias("first_token"),
        (F.max(F.col("doc_pos") + F.col("size")) - 1).alias("last_token"),
    )
    passages = passages.filter(F.col("cover") >= least_cover)
    # one value of the document for each place of the item, from the window with most support
    said = F.explode(F.arrays_zip("slots", "doc_slots")).alias("p")
    places = (
        aligned.select(*own, "pos", "rank", said)
        .groupBy(*own, (F.col("pos") + F.col("p.slots.at")).alias("place"))
        .agg(F.max(F.struct("rank", F.col("p.slots.value").alias("value"), F.col("p.doc_slots.value").alias("seen"))).alias("v"))
    )
    pairs = (
        places.groupBy(*own, F.col("v.value").alias("value"))
        .agg(F.min("v.seen").alias("low"), F.max("v.seen").alias("high"))
        .groupBy(*own)
        .agg(
            F.count(F.lit(1)).alias("n_slots"),
            F.count_if((F.col("low") != F.col("value")) | (F.col("high") != F.col("value"))).alias("n_changed"),
            F.max(F.col("low") != F.col("high")).alias("clash"),
        )
    )
    pairs = pairs.withColumnsRenamed({c: f"_{c}_2" for c in own})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_{c}_2`")) for c in own]
    checked = passages.join(pairs, same[0] & same[1] & same[2], "left").select(
        *own,
        "cover",
        F.coalesce("n_slots", F.lit(0)).cast("int").alias("n_slots"),
        F.coalesce("n_changed", F.lit(0)).cast("int").alias("n_changed"),
        F.coalesce("clash", F.lit(False)).alias("clash"),
        "first_token",
        "last_token",
    )
    chosen = F.max(F.struct(F.col("n_changed") == 0, "cover", -F.col("n_changed"), -F.col("first_token"), "n_slots", "n_changed", "first_token", "last_token"))
    return (
        checked.filter(~F.col("clash"))
        .groupBy(key, "item")
        .agg(chosen.alias("b"))
        .select(key, "item", "b.cover", "b.n_slots", "b.n_changed", "b.first_token", "b.last_token")
    )
