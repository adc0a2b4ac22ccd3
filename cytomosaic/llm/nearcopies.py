"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form a class, and one of each class goes on. Bands of the signature give candidates;
each band's bucket is tied to its least member, so buckets of any size give a number of edges that grows with their rows.
The components of those edges are searched in blocks of bounded size: signatures are compared batch by batch, and a pair
is left as soon as the posterior probability that its similarity reaches the limit falls below the chosen miss
probability. Pairs that survive every batch are verified on the full shingle sets, as long as they join what is still
apart, and blocks return only the links of a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import WordHashes, Workspace, binaries, lists, map_batches, mixed, windows
from cytomosaic.llm.components import components

#: Words in a shingle and least similarity in percent, where the caller names none.
SHINGLE, PERCENT = 5, 80
#: Probability that a pair at the limit shares no band, and that the sequential test leaves it.
MISS_BANDS, MISS_TEST = 1e-5, 1e-6
#: Signature rows compared at a time.
BATCH = 32
#: Documents in a slice; a block compares two slices.
SLICE_SIGNATURES, SLICE_TEXTS = 512, 128
#: Ids sent to every task up to this many rows (16 bytes each), joined by a shuffle beyond.
SENT_IDS = 1_000_000


def bands_for(percent: int, rows: int) -> int:
    """Bands of ``rows`` rows so that a pair at the limit shares none with probability ``MISS_BANDS`` at most."""
    return math.ceil(math.log(MISS_BANDS) / math.log1p(-((percent / 100) ** rows)))


def least_matches(n_hashes: int, percent: int) -> list[tuple[int, int]]:
    """(rows seen, least matches to go on) after each batch.

    Rows are compared in eight bits, so unequal ones agree once in 256. With a uniform prior on the rate of agreement, the
    posterior probability that it reaches the limit after m of n matches is P(Binomial(n + 1, limit) <= m).
    """
    limit = percent / 100 + (1 - percent / 100) / 256
    steps = []
    for n in range(BATCH, n_hashes + BATCH, BATCH):
        n = min(n, n_hashes)
        below, m = 0.0, -1
        while below < MISS_TEST and m < n:
            m += 1
            logs = math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
            below += math.exp(logs + m * math.log(limit) + (n + 1 - m) * math.log1p(-limit))
        steps.append((n, m))
    return steps


def shingles(raw: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z in lower case; a text with fewer words is one shingle."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    numbers = hashes.of(words)
    return np.unique(windows(numbers, k) if len(words) >= k else windows(numbers, len(words)) ^ np.uint64(len(words)))


class Signer:
    def __init__(self, n_hashes: int):
        source = np.random.default_rng(20240229)
        self.factors = source.integers(1, 1 << 32, n_hashes, np.uint64).astype(np.uint32) | np.uint32(1)
        self.shifts = source.integers(0, 1 << 32, n_hashes, np.uint64).astype(np.uint32)

    def sign(self, found: np.ndarray) -> np.ndarray:
        """Least value of each hash function over the set, in blocks that fit into the processor's cache."""
        least = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        short = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
        for at in range(0, len(short), 256):
            values = short[at : at + 256, None] * self.factors
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x2C1B3C6D)
            values += self.shifts
            np.minimum(least, values.min(0), out=least)
        return least


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, n_hashes: int, rows: int) -> DataFrame:
    """(_id, n, f1, f2, keys, sig) for each row: set size, set fingerprint, band keys and signature in eight bits."""

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        hashes, signer = WordHashes(), Signer(n_hashes)
        n_bands = n_hashes // rows
        salts = mixed(np.arange(1, n_bands + 1, dtype=np.uint64))

        def work(batch: pa.RecordBatch) -> dict[str, object]:
            sizes, first, second, keys, signs = [], [], [], [], []
            for raw in binaries(batch, "_text"):
                found = shingles(raw, k, hashes)
                sizes.append(len(found))
                if not len(found):
                    first.append(None)
                    second.append(None)
                    keys.append(np.empty(0, np.int64))
                    signs.append(None)
                    continue
                first.append(int(mixed(found).sum().view(np.int64)))
                second.append(int(np.bitwise_xor.reduce(mixed(found ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)))
                sig = signer.sign(found)
                key = salts.copy()
                for column in sig[: n_bands * rows].reshape(n_bands, rows).T.astype(np.uint64):
                    key = mixed(key ^ column) + salts
                keys.append(key.view(np.int64))
                signs.append(mixed(sig.astype(np.uint64)).astype(np.uint8).tobytes())
            return {
                "_id": batch.column(0),
                "n": pa.array(sizes, pa.int64()),
                "f1": pa.array(first, pa.int64()),
                "f2": pa.array(second, pa.int64()),
                "keys": lists(keys, pa.int64()),
                "sig": pa.array(signs, pa.binary()),
            }

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    return map_batches(read, start, f"_id {kind}, n bigint, f1 bigint, f2 bigint, keys array<bigint>, sig binary")


# --- blocks ----------------------------------------------------------------------------------------------------------


def in_blocks(members: DataFrame, per_slice: int) -> DataFrame:
    """(node, label, _own, _i, _j) for every block that a member of a group takes part in; columns node and label.

    A group is cut into slices by the hash of its nodes; every two slices, and each slice with itself, make a block with
    ``_i <= _j``. Payloads are joined to these small rows afterwards.
    """
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("_all")).filter("_all > 1")
    sizes = sizes.select("label", F.ceil(F.col("_all") / per_slice).cast("int").alias("_slices"))
    cut = members.join(sizes, "label").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_slices")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return cut.select("node", "label", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def per_block(rows: DataFrame, keys: list[str], start: Callable[[], Callable[[dict[str, list]], tuple[list, list]]], kind: str) -> DataFrame:
    """(a, b) pairs that the made function returns for each group of ``keys``; rows arrive sorted, and a group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        pending: list[pa.RecordBatch] = []
        out_a: list = []
        out_b: list = []

        def finish() -> None:
            if pending:
                a, b = work(pa.Table.from_batches(pending).to_pydict())
                out_a.extend(a)
                out_b.extend(b)
                pending.clear()

        last, node_type = None, None
        for batch in batches:
            place = batch.schema.get_field_index("node")
            node_type = batch.schema.field(place).type
            marks = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], strict=True))
            begin = 0
            for at in range(len(marks) + 1):
                if at == len(marks) or marks[at] != last:
                    if at > begin:
                        pending.append(batch.slice(begin, at - begin))
                    begin = at
                    if at < len(marks):
                        finish()
                        last = marks[at]
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, node_type), pa.array(out_b, node_type)], ["a", "b"])
                out_a.clear()
                out_b.clear()
        finish()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, node_type), pa.array(out_b, node_type)], ["a", "b"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def survivors(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of two signature tables that pass every batch, and their matches; ``same``: the tables are one."""
    found_i, found_j, found_m = [], [], []
    first, least = steps[0]
    for at in range(0, len(left), 64):
        matches = (left[at : at + 64, None, :first] == right[None, :, :first]).sum(2, dtype=np.int16)
        i, j = np.nonzero(matches >= least)
        m = matches[i, j]
        i = i + at
        if same:
            keep = i < j
            i, j, m = i[keep], j[keep], m[keep]
        seen = first
        for n, needed in steps[1:]:
            if not len(i):
                break
            m = m + (left[i, seen:n] == right[j, seen:n]).sum(1, dtype=np.int16)
            keep = m >= needed
            i, j, m = i[keep], j[keep], m[keep]
            seen = n
        found_i.append(i)
        found_j.append(j)
        found_m.append(m)
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_m)


def sides(block: dict[str, list], n_hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Signatures of a block's rows, which of them are in its first and in its second slice, and whether these are one."""
    sig = np.frombuffer(b"".join(block["sig"]), np.uint8).reshape(-1, n_hashes)
    own = np.array(block["_own"])
    i, j = block["_i"][0], block["_j"][0]
    return sig, np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def similar_signatures(steps: list[tuple[int, int]], n_hashes: int) -> Callable[[], Callable[[dict[str, list]], tuple[list, list]]]:
    """For a block: each node and the least node that its surviving pairs reach within the block."""

    def start() -> Callable[[dict[str, list]], tuple[list, list]]:
        def work(block: dict[str, list]) -> tuple[list, list]:
            sig, first, second, same = sides(block, n_hashes)
            if not len(first) or not len(second):
                return [], []
            i, j, _ = survivors(sig[first], sig[second], steps, same)
            i, j = first[i], second[j]
            label = np.arange(len(sig))
            while len(i):
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, label[i], low)
                np.minimum.at(label, label[j], low)
                label = label[label]
                apart = label[i] != label[j]
                if not apart.any() and (label == before).all():
                    break
            moved = np.flatnonzero(label != np.arange(len(sig)))
            nodes = block["node"]
            return [nodes[x] for x in moved], [nodes[label[x]] for x in moved]

        return work

    return start


def verified_links(steps: list[tuple[int, int]], n_hashes: int, k: int, percent: int) -> Callable[[], Callable[[dict[str, list]], tuple[list, list]]]:
    """For a block: links of full-set similarity that join what is apart, the likeliest pairs first."""

    def start() -> Callable[[dict[str, list]], tuple[list, list]]:
        hashes = WordHashes()

        def work(block: dict[str, list]) -> tuple[list, list]:
            sig, first, second, same = sides(block, n_hashes)
            if not len(first) or not len(second):
                return [], []
            i, j, m = survivors(sig[first], sig[second], steps, same)
            order = np.argsort(-m, kind="stable")
            sets: dict[int, set[int]] = {}

            def full(x: int) -> set[int]:
                if x not in sets:
                    sets[x] = set(shingles(block["text"][x].encode(), k, hashes).tolist())
                return sets[x]

            parent = list(range(len(sig)))

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            a, b, nodes = [], [], block["node"]
            for x, y in zip(first[i][order].tolist(), second[j][order].tolist(), strict=True):
                rx, ry = root(x), root(y)
                if rx == ry:
                    continue
                u, v = full(x), full(y)
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    continue
                common = len(u & v)
                if 100 * common >= percent * (len(u) + len(v) - common):
                    parent[rx] = ry
                    a.append(nodes[x])
                    b.append(nodes[y])
            return a, b

        return work

    return start


# --- the whole search ------------------------------------------------------------------------------------------------


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, rows: int = 7) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Two documents are linked if their sets of distinct ``k``-word shingles have 100 * intersection >= ``percent`` * union;
    ``component_id`` is the least id that can be reached, and ``kept`` says that it is the row's own. Documents without
    words have the empty set and are linked with nothing. Rows that share an id are one document with several texts: what
    one is linked with, all are. A row with a null id has a null component, is kept and links nothing.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "nearcopies")
    n_bands = bands_for(percent, rows)
    n_hashes = n_bands * rows
    steps = least_matches(n_hashes, percent)
    kind = docs.schema[id_col].dataType.simpleString()
    signed = ws.keep(signatures(docs, id_col, text_col, k, n_hashes, rows), "signatures")

    usable = signed.filter("n > 0 AND _id IS NOT NULL")
    classes = ws.keep(usable.groupBy("f1", "f2").agg(F.min("_id").alias("node")), "classes")
    heads = usable.select(F.col("_id").alias("node"), "f1", "f2", "keys", "sig").join(classes, ["f1", "f2", "node"]).dropDuplicates(["f1", "f2"])
    heads = ws.keep(heads.select("node", "f1", "f2", "keys", "sig"), "heads")

    in_bands = heads.select("node", F.explode("keys").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tied = in_bands.join(buckets, "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    candidates = components(tied, ws)

    signs = heads.select("node", "sig")
    blocks = in_blocks(candidates, SLICE_SIGNATURES).join(signs, "node")
    alike = per_block(blocks, ["label", "_i", "_j"], similar_signatures(steps, n_hashes), kind)
    families = components(alike, ws)

    ids = families.select(F.col("node").alias("_id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "_id", "left_semi").withColumnRenamed("_id", "node")
    repeated = not usable.groupBy("_id").count().filter("count > 1").isEmpty()
    if repeated:
        texts = texts.dropDuplicates(["node", "text"])
    blocks = in_blocks(families, SLICE_TEXTS).join(signs, "node").join(texts, "node")
    links = per_block(blocks, ["label", "_i", "_j"], verified_links(steps, n_hashes, k, percent), kind)
    if repeated:  # the classes that an id's texts belong to are linked through it
        sets = usable.select("_id", "f1", "f2").join(classes, ["f1", "f2"]).groupBy("_id", "node").agg(F.lit(1).alias("one"))
        first = sets.groupBy("_id").agg(F.min("node").alias("b"))
        links = links.union(sets.join(first, "_id").filter("node <> b").select(F.col("node").alias("a"), "b"))
    linked = components(links, ws)

    by_set = classes.join(linked.withColumnRenamed("label", "least"), "node", "left").select("f1", "f2", F.coalesce("least", "node").alias("found"))
    own = signed.select("_id", "n", "f1", "f2")
    out = own.join(by_set, ["f1", "f2"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("found", "_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"),
    )
