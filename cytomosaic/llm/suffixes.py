"""Exact substring deduplication by sorting suffixes.

A string of ``length`` bytes that occurs twice holds the same anchor both times: the place of the least hash among its
``ANCHOR``-byte windows. Windows (the strings of ``length`` bytes) that share an anchor form a context, the bytes from the
first window's start to the last one's end. So

1. every text gives its anchors with a hash of the anchor's bytes and one of the whole context;
2. contexts met twice are repeated as they stand; anchors met once repeat nothing. Both are settled by counting hashes;
3. the rest, distinct contexts around a common anchor, are fetched as bytes and range-partitioned by their leading token,
   the anchor's hash, with sampled splitters. Each bucket sorts the suffixes of its contexts by eight bytes at a time, the
   next eight only within runs of equals. Suffixes equal in ``length`` bytes are repeated. Contexts of one anchor never
   fall to two buckets, so no run of equals crosses a boundary, but for anchors with very many contexts: their suffixes are
   compared across all buckets by a 128-bit hash of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace, binaries, lists, map_batches, mixed

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, ANCHOR = 200, 48
#: Distinct contexts of one anchor that a bucket sorts; suffixes of more are compared across buckets.
CONTEXTS_IN_BUCKET = 20_000
#: Bytes of contexts sorted at a time.
BYTES_AT_ONCE = 2 << 20
#: Ids sent to every task up to this many rows, joined by a shuffle beyond.
SENT_IDS = 1_000_000
#: Bytes of a text handled at a time; longer texts are walked through with an overlap.
STRIDE = 1 << 20
#: Low bits that hold a place among a stride's windows.
PLACE = np.uint64((1 << 21) - 1)

PRIME = 0x100000001B3


def rolled(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all windows of the given sizes, by doubling."""
    hashes = {1: data.astype(np.uint64) + np.uint64(1)}
    size = 1
    while 2 * size <= max(sizes):
        h = hashes[size]
        hashes[2 * size] = h[:-size] * np.uint64(pow(PRIME, size, 1 << 64)) + h[size:]
        size *= 2
    out = {}
    for wanted in sizes:
        total, done = None, 0
        n = len(data) - wanted + 1
        for power in sorted(hashes, reverse=True):
            if wanted - done >= power:
                part = hashes[power][done : done + n]
                total = part if total is None else total * np.uint64(pow(PRIME, power, 1 << 64)) + part
                done += power
        out[wanted] = total
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    n = len(values) - (width - size)
    return np.minimum(values[:n], values[width - size : width - size + n])


def contexts_of(raw: bytes, length: int, anchor: int) -> np.ndarray:
    """Rows (anchor hash, context hash, first window, number of windows) of a text; windows of one context are neighbours.

    A window's anchor is the first place of its least hash (in the bits above ``PLACE``), so equal windows have equal anchors
    at the same distance, also in texts that repeat themselves.
    """
    found = []
    for begin in range(0, max(len(raw) - length + 1, 0), STRIDE):
        data = np.frombuffer(raw, np.uint8, min(len(raw) - begin, STRIDE + length - 1), begin)
        hashes = rolled(data, [anchor, length])
        values = mixed(hashes[anchor])
        at = sliding_least(values & ~PLACE | np.arange(len(values), dtype=np.uint64), length - anchor + 1) & PLACE
        cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        counts = np.diff(np.concatenate([cuts, [len(at)]]))
        whole = np.add.reduceat(mixed(hashes[length]), cuts)
        anchors = values[at[cuts].astype(np.int64)]
        # a run's windows in order: their sum, their number and the first and the last one's hash
        last = hashes[length][cuts + counts - 1]
        whole = mixed(whole + mixed(hashes[length][cuts]) * np.uint64(3) + mixed(last ^ counts.astype(np.uint64)))
        found.append(np.stack([anchors, whole, (cuts + begin).astype(np.uint64), counts.astype(np.uint64)], 1))
    return np.concatenate(found) if found else np.empty((0, 4), np.uint64)


def all_contexts(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """(_id, _key, n_bytes, sha, h[], c[], s[], w[]) for each row of docs (_id, _text): anchor and context hash, first window, windows."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            texts = [t or b"" for t in binaries(batch, "_text")]
            rows = [contexts_of(t, length, anchor) for t in texts]
            return {
                "_id": batch.column(0),
                "_key": [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts],
                "n_bytes": [len(t) for t in texts],
                "sha": [hashlib.sha256(t).hexdigest() for t in texts],
                **{name: lists([r[:, i].view(np.int64) for r in rows], pa.int64()) for i, name in enumerate("hc")},
                **{name: lists([r[:, i + 2].astype(np.int32) for r in rows], pa.int32()) for i, name in enumerate("sw")},
            }

        return work

    kind = docs.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _key bigint, n_bytes bigint, sha string, h array<bigint>, c array<bigint>, s array<int>, w array<int>"
    return map_batches(docs.select("_id", "_text"), start, schema)


# --- sorting ---------------------------------------------------------------------------------------------------------


def repeated_suffixes(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix agrees in its first ``length`` bytes with another suffix of its group.

    Multikey sorting with characters of eight bytes: suffixes are in runs of equals; each run is sorted by its next
    character and cut where that changes. Runs of one suffix are done; runs that agree are not moved.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.zeros(len(data), np.uint64)  # the eight bytes from each place on, as one character
    for i in range(8):
        eight = eight << np.uint64(8) | padded[i : i + len(data)]
    order = np.argsort(groups, kind="stable")
    run = groups[order]
    place = starts[order]
    for depth in range(0, length, 8):
        if not len(place):
            break
        char = eight[place + depth] >> np.uint64(8 * max(0, depth + 8 - length))
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(run)]]))
        differs = char != np.repeat(char[first], sizes)
        unlike = np.repeat(np.logical_or.reduceat(differs, first), sizes)
        if unlike.any():
            at = np.flatnonzero(unlike)
            at_sorted = at[np.lexsort((char[at], run[at]))]
            order[at], place[at], char[at], run[at] = order[at_sorted], place[at_sorted], char[at_sorted], run[at_sorted]
        new = np.concatenate([[True], (run[1:] != run[:-1]) | (char[1:] != char[:-1])])
        run = np.cumsum(new)
        alone = np.bincount(run)[run] == 1
        if alone.any():
            order, place, run = order[~alone], place[~alone], run[~alone]
    out = np.zeros(len(starts), bool)
    out[order] = True
    return out


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def sorted_bucket(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, first, last) repeated windows, counted from the context's first, of contexts (h, c, bytes) that come sorted by anchor.

    All contexts of an anchor are sorted together, and some millions of bytes of whole anchors at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int, int, bytes]] = []
        size = 0

        def settle(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
            sizes = np.array([len(t) for _, _, t in held])
            begins = np.cumsum(sizes) - sizes
            counts = sizes - length + 1
            places = np.cumsum(counts) - counts
            which = np.repeat(np.arange(len(held)), counts)
            within = np.arange(int(counts.sum())) - np.repeat(places, counts)
            _, anchors = np.unique(np.array([h for h, _, _ in held]), return_inverse=True)
            flags = repeated_suffixes(data, begins[which] + within, anchors[which], length)
            out: dict[str, list[int]] = {"h": [], "c": [], "first": [], "last": []}
            for i in np.unique(which[flags]).tolist():
                for a, b in runs_of(flags[places[i] : places[i] + counts[i]]):
                    for name, value in zip(out, (held[i][0], held[i][1], a, b - 1), strict=True):
                        out[name].append(value)
            return pa.RecordBatch.from_pydict(
                {**{n: pa.array(out[n], pa.int64()) for n in "hc"}, **{n: pa.array(out[n], pa.int32()) for n in ("first", "last")}}
            )

        for batch in batches:
            for h, c, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if size > BYTES_AT_ONCE and h != pending[-1][0]:
                    yield settle(pending)
                    pending, size = [], 0
                pending.append((h, c, raw))
                size += len(raw)
        if pending:
            yield settle(pending)

    return rows.select("h", "c", "bytes").mapInArrow(run, "h bigint, c bigint, first int, last int")


# --- the whole search ------------------------------------------------------------------------------------------------


def repeated_windows(docs: DataFrame, read: DataFrame, ws: Workspace, length: int, contexts_in_bucket: int) -> DataFrame:
    """(_rep, first, last): runs of repeated windows in each distinct row; ``read`` is the written result of ``all_contexts``."""
    rows = read.select("_rep", F.explode(F.arrays_zip("h", "c", "s", "w")).alias("x")).select("_rep", "x.*")
    # hashes are combined before the shuffle, so an anchor in very many texts is one row from each task
    shared = ws.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "shared")  # so that a skewed join can be split
    met = ws.keep(rows.join(shared, "h"), "met")
    again = met.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_rep", "s", "w")).alias("one"))
    again = ws.keep(again, "again")
    whole = met.join(again.filter("n > 1").select("h", "c"), ["h", "c"])
    whole = whole.select("_rep", F.col("s").alias("first"), (F.col("s") + F.col("w") - 1).alias("last"))

    # an anchor stays open if it has several contexts and one of them is met once
    anchors = again.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1")
    anchors = anchors.select("h", (F.col("kinds") > contexts_in_bucket).alias("wide"))
    asked = ws.keep(again.join(anchors, "h").select("h", "c", "n", "wide", "one.*"), "asked")
    per_text = asked.groupBy("_rep").agg(F.collect_list(F.struct("h", "c", "wide", "s", "w")).alias("want"))  # contexts of one text
    fetched = ws.keep(fetch(texts_of(docs, read, per_text), length), "fetched")
    spread = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fetched.filter("NOT wide").repartitionByRange(spread, "h").sortWithinPartitions("h")
    found = sorted_bucket(dealt, length).union(wide_windows(fetched.filter("wide"), length))
    # a context met once has one instance, which is told by its hashes
    single = asked.filter("n = 1").select("h", "c", "_rep", "s")
    partly = found.join(single, ["h", "c"]).select("_rep", (F.col("s") + F.col("first")).alias("first"), (F.col("s") + F.col("last")).alias("last"))
    return whole.union(partly)


def texts_of(docs: DataFrame, read: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (by _rep) with the texts. Only documents with a wanted id are shuffled."""
    keys = wanted.join(read.select("_rep", "_id", "_key").distinct(), "_rep")
    ids = keys.select(F.col("_id").alias("_wanted")).distinct()
    sent = F.broadcast(ids) if ids.count() <= SENT_IDS else ids
    texts = with_key(docs.join(sent, docs["_id"].eqNullSafe(F.col("_wanted")), "left_semi"))
    right = keys.withColumnRenamed("_id", "_id2").withColumnRenamed("_key", "_key2")
    return texts.join(right, texts["_id"].eqNullSafe(right["_id2"]) & (texts["_key"] == right["_key2"])).drop("_id2", "_key2")


def with_key(texts: DataFrame) -> DataFrame:
    """Adds the hash of the text that ``all_contexts`` gives."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            keys = [xxhash.xxh3_64_intdigest(t or b"") - (1 << 63) for t in binaries(batch, "_text")]
            return {"_id": batch.column(0), "_text": batch.column(1), "_key": pa.array(keys, pa.int64())}

        return work

    kind = texts.schema["_id"].dataType.simpleString()
    return map_batches(texts.select("_id", "_text"), start, f"_id {kind}, _text string, _key bigint")


def fetch(rows: DataFrame, length: int) -> DataFrame:
    """(h, c, wide, bytes, off) for the wanted contexts of each text."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            out: dict[str, list] = {"h": [], "c": [], "wide": [], "bytes": []}
            for raw, wanted in zip(binaries(batch, "_text"), batch.column(1).to_pylist(), strict=True):
                for x in wanted:
                    out["h"].append(x["h"])
                    out["c"].append(x["c"])
                    out["wide"].append(x["wide"])
                    out["bytes"].append(raw[x["s"] : x["s"] + x["w"] + length - 1])
            return {"h": pa.array(out["h"], pa.int64()), "c": pa.array(out["c"], pa.int64()), "wide": pa.array(out["wide"], pa.bool_()), "bytes": pa.array(out["bytes"], pa.binary())}

        return work

    return map_batches(rows.select("_text", "want"), start, "h bigint, c bigint, wide boolean, bytes binary")


def wide_windows(rows: DataFrame, length: int) -> DataFrame:
    """Like ``sorted_bucket`` for anchors with very many contexts: every suffix is a row, and equal ones are counted."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            hs, cs, at, high, low = [], [], [], [], []
            for h, c, raw in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                for i in range(len(raw) - length + 1):
                    digest = xxhash.xxh3_128_intdigest(raw[i : i + length])
                    hs.append(h)
                    cs.append(c)
                    at.append(i)
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & (1 << 64) - 1) - (1 << 63))
            return {"h": pa.array(hs, pa.int64()), "c": pa.array(cs, pa.int64()), "first": pa.array(at, pa.int32()), "high": pa.array(high, pa.int64()), "low": pa.array(low, pa.int64())}

        return work

    windows = map_batches(rows.select("h", "c", "bytes"), start, "h bigint, c bigint, first int, high bigint, low bigint")
    again = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return windows.join(again, ["high", "low"]).select("h", "c", "first", F.col("first").alias("last"))


def cut_out(raw: bytes, firsts: list[int], lasts: list[int], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that no window covers, and the maximal covered runs."""
    marks = np.zeros(len(raw) + 1, np.int32)
    np.add.at(marks, np.array(firsts, np.int64), 1)
    np.add.at(marks, np.array(lasts, np.int64) + length, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~covered].tobytes(), runs_of(covered)


REMOVED = "array<struct<start: int, end: int>>"
REMOVED_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    contexts_in_bucket: int = CONTEXTS_IN_BUCKET,
) -> DataFrame:
    """(id, n_bytes, n_removed, removed, kept_sha256) for each row of ``docs``.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in the same text or another row's,
    is removed; strings are judged on the input. ``removed`` has the maximal removed runs, by start. A null text is empty.
    Repeated rows repeat one another; null ids are ids like others. Texts shorter than ``length`` bytes stay as they are.
    """
    if not 0 < anchor <= length:
        raise ValueError("an anchor is a part of the string")
    ws = Workspace(docs.sparkSession, "suffixes")
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    read = ws.keep(all_contexts(docs, length, anchor).withColumn("_rep", F.monotonically_increasing_id()), "contexts")
    # rows that agree in id and text are represented by one of them
    repeated = read.groupBy("_id", "_key").agg(F.min("_rep").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeated.select(F.col("_id").alias("_id2"), F.col("_key").alias("_key2"), "_first")
    if not repeated.isEmpty():
        same = read["_id"].eqNullSafe(repeated["_id2"]) & (read["_key"] == repeated["_key2"])
        read = read.join(repeated, same, "left").withColumn("_rep", F.coalesce("_first", "_rep")).drop("_id2", "_key2", "_first")
    per_text = repeated_windows(docs, read, ws, length, contexts_in_bucket)
    per_text = per_text.groupBy("_rep").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts"))  # of one text
    per_text = ws.keep(per_text, "windows")

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            sizes, removed, shas = [], [], []
            at = {n: batch.schema.get_field_index(n) for n in ("firsts", "lasts")}
            for raw, a, b in zip([t or b"" for t in binaries(batch, "_text")], *[batch.column(at[n]).to_pylist() for n in ("firsts", "lasts")], strict=True):
                kept, runs = cut_out(raw, a, b, length)
                sizes.append(len(raw) - len(kept))
                removed.append([{"start": x, "end": y} for x, y in runs])
                shas.append(hashlib.sha256(kept).hexdigest())
            return {
                "_rep": batch.column(0),
                "n_removed": pa.array(sizes, pa.int64()),
                "removed": pa.array(removed, REMOVED_ARROW),
                "kept": shas,
            }

        return work

    wanted = texts_of(docs, read, per_text).select("_rep", "_text", "firsts", "lasts")
    cut = map_batches(wanted, start, f"_rep bigint, n_removed bigint, removed {REMOVED}, kept string").dropDuplicates(["_rep"])
    return read.select("_id", "_rep", "n_bytes", "sha").join(cut, "_rep", "left").select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast(REMOVED)).alias("removed"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
    )
