"""Secret scanning with corpus-wide ownership.

One pass over the texts finds candidates: three fixed kinds and free-standing random-looking keys. The hashes of their
values are then counted over the corpus by distinct repositories and owners. Places with the same surroundings are copies of
one text: they are one repository and have one owner, the least of theirs, so copying a document does not make its
credentials public knowledge. A value with many repositories and many owners is an example that was copied around; every
other looks like a live credential. Fixed kinds are always reported; random-looking keys unless they are examples.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import Workspace, binaries, map_batches

# fixed values: kinds in the order that breaks ties, their patterns and least lengths
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
#: A random-looking key: the added kind.
KEY = "key"
KEYS = re.compile("[A-Za-z0-9+/_-]{20,}")
#: Bits a character that such a key has at least; words and repeated characters have less.
LEAST_ENTROPY = 3.5
#: A copied example is a value with so many owners and so many repositories.
WIDE_OWNERS, WIDE_REPOSITORIES = 5, 8
#: Code points on either side of a match that are its surroundings.
AROUND = 32

FOUND = "array<struct<kind: string, start: int, end: int, value: bigint, own: boolean, around: bigint>>"


def looks_random(value: str) -> bool:
    """Upper and lower case and digits, well mixed."""
    if not (any(c.isdigit() for c in value) and value.upper() != value and value.lower() != value):
        return False
    counts, n = Counter(value).values(), len(value)
    return -sum(c / n * math.log2(c / n) for c in counts) >= LEAST_ENTROPY


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63)


def candidates(text: str) -> list[tuple[str, int, int, int, bool, int]]:
    """(kind, start, end, hash of the value, whether it is of a fixed kind, hash of the surroundings), by start and kind;
    code points, end exclusive."""
    found: list[tuple[int, int, str, int, str]] = []
    lowered = text.lower()
    if any(word in lowered for word in ("passw", "secret", "token", "api")):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((m.start(), 0, "assign", m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, "hex", m.end(), m[0]) for m in HEX.finditer(text)]
    fixed = [(start, end) for start, _, _, end, _ in found]
    for m in KEYS.finditer(text):
        if looks_random(m[0]) and not any(start < m.end() and m.start() < end for start, end in fixed):
            found.append((m.start(), 3, KEY, m.end(), m[0]))
    found.sort()
    return [
        (kind, start, end, hashed(v), rank < 3, hashed(f"{text[max(start - AROUND, 0) : start]}\0{text[end : end + AROUND]}"))
        for start, rank, kind, end, v in found
    ]


def scan(
    docs: DataFrame, keep: list[str], owner: str, text_col: str = "text", wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES
) -> DataFrame:
    """The ``keep`` columns and ``found``: all reported spans of each row, with how far each value is spread.

    ``found`` is an array of (kind, start, end, value, own, repositories, owners, live) by start, then kind; ``live`` is
    false for values with ``wide_owners`` owners and ``wide_repositories`` repositories or more. Repeated rows and copies of
    a text are one repository, whose owner is the least of theirs. A null owner is an owner, and comes after all others. A
    null or empty text has no spans. Columns not in ``keep`` are left out; a kept one must not be called ``found``.
    """
    ws = Workspace(docs.sparkSession, "secrets")

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            found = []
            for raw in binaries(batch, "_text"):
                rows = candidates(raw.decode()) if raw else []
                found.append([dict(zip(("kind", "start", "end", "value", "own", "around"), r, strict=True)) for r in rows])
            names = [n for n in batch.schema.names if n != "_text"]
            return {**{n: batch.column(batch.schema.get_field_index(n)) for n in names}, "found": pa.array(found, FOUND_ARROW)}

        return work

    read = docs.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{owner}`").alias("_owner"), F.col(f"`{text_col}`").alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields if f.name != "_text"]
    scanned = map_batches(read, start, ", ".join([*schema, f"found {FOUND}"]))
    rows = ws.keep(scanned.withColumn("_row", F.monotonically_increasing_id()), "found")

    values = rows.select("_row", "_owner", F.explode("found").alias("f")).select("_row", "_owner", "f.*")
    spread = ownership(values, "value", "around", "_owner")
    wide = (F.col("owners") >= wide_owners) & (F.col("repositories") >= wide_repositories)
    joined = values.drop("_owner", "around").join(spread, "value").withColumn("live", ~wide)
    shown = joined.filter(F.col("own") | F.col("live"))
    rank = F.when(F.col("kind") == "assign", 0).when(F.col("kind") == "access", 1).when(F.col("kind") == "hex", 2).otherwise(3)
    item = F.struct("start", rank.alias("rank"), "end", "kind", "value", "own", "repositories", "owners", "live")
    by_row = shown.groupBy("_row").agg(F.sort_array(F.collect_list(item)).alias("spans"))  # the spans of one text
    return (
        rows.drop("found", "_owner").join(by_row, "_row", "left").drop("_row").withColumn("found", F.coalesce("spans", F.array())).drop("spans")
    )


FOUND_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("own", pa.bool_()), ("around", pa.int64())])
)


def ownership(values: DataFrame, value: str, repository: str, owner: str) -> DataFrame:
    """(value, repositories, owners): a value's distinct repositories, and the distinct owners of these, each having the
    least one's. Repositories are made distinct before the shuffle, so a copied value stays small."""
    repositories = values.groupBy(value, repository).agg(F.min(owner).alias(owner))
    owners = repositories.groupBy(value, owner).agg(F.count(F.lit(1)).alias("_n"))
    return owners.groupBy(value).agg(F.sum("_n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of each row of ``scan``."""
    base = F.filter("found", lambda f: f["own"])

    def text(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    live = F.filter("found", lambda f: f["live"])
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
        text(live).alias("live_spans"),
    )
