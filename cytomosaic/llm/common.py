"""Helpers shared by the text operators: stage tables in the shared folder, words and their hashes, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cytomosaic.session import shared_folder

#: Distinct words whose hashes a task remembers; beyond that it starts afresh, so memory stays bounded.
REMEMBERED_WORDS = 150_000
#: Rows handled and returned at once inside a task.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Written intermediate tables under the shared folder that ``spark.checkpoint.dir`` names.

    Where that setting is missing, a local session uses a folder under the warehouse directory and a cluster is refused.
    ``session.clear_stages`` deletes them once a job's results are stored elsewhere.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = shared_folder(spark, label)
        self._count = 0

    def folder(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "stage") -> DataFrame:
        """Write ``df`` once and go on from the written table, so a lost executor costs no recomputation."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete stage tables that nothing will read any more."""
        for df in tables:
            remove(self.spark, df._stage_path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class WordHashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one; of the others, so many bytes at once.
LONG_WORD, BYTES_AT_ONCE = 64, 1 << 20
#: Base of the words' polynomials, an odd number, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a 64-bit number, from the zeroth on."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words (between blanks and control characters 9 to 13) of UTF-8 texts by array operations: places and 64-bit hashes.

    A word's hash is a polynomial in random numbers of its bytes, A-Z taken as a-z, with its bits spread.
    """

    def __init__(self):
        lower = np.arange(256, dtype=np.uint64)
        lower[65:91] += np.uint64(32)
        self.value = mixed(lower + np.uint64(BASE))
        self.in_word = np.ones(256, bool)
        self.in_word[[9, 10, 11, 12, 13, 32]] = False
        self.power, self.inverse = (powers(x, BYTES_AT_ONCE + 1) for x in (BASE, INVERSE))

    def places(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word."""
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = self.in_word[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2]

    def hashes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        out = np.zeros(len(starts), np.uint64)
        x = 0
        while x < len(starts):
            low = starts[x]
            y = max(x + 1, int(np.searchsorted(ends, low + BYTES_AT_ONCE, "right")))
            size = int(ends[y - 1] - low)
            if size <= BYTES_AT_ONCE:
                sums = np.zeros(size + 1, np.uint64)
                np.cumsum(self.value[data[low : low + size]] * self.power[:size], out=sums[1:])
                first = starts[x:y] - low
                out[x:y] = mixed((sums[ends[x:y] - low] - sums[first]) * self.inverse[first])
            x = y
        for x in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            out[x] = xxhash.xxh3_64_intdigest(raw[starts[x] : ends[x]].lower())
        return out

    def of(self, raw: bytes) -> np.ndarray:
        return self.hashes(raw, *self.places(raw))

    def of_all(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all texts one after another, and their bounds."""
        raw = b" ".join(raws)
        starts, ends = self.places(raw)
        sizes = np.array([len(x) + 1 for x in raws], np.int64)
        return self.hashes(raw, starts, ends), np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each window of ``k`` consecutive words; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mixed(out)


def binaries(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values in UTF-8."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE, most_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Parts of so many rows at most, and of so many bytes where a part has several rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            waiting = [batch.slice(start, rows)]
            while waiting:
                part = waiting.pop()
                half = part.num_rows // 2
                if half and most_bytes is not None and part.nbytes > most_bytes:
                    waiting += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column out of one array for each row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object]], schema: str, rows: int = ROWS_AT_ONCE, most_bytes: int | None = None
) -> DataFrame:
    """``fn`` gives the named output columns of a small batch of rows; ``fn.start()``, if there, makes it once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in small_batches(batches, rows, most_bytes):
            yield pa.RecordBatch.from_pydict(work(batch))
        del work
        pa.default_memory_pool().release_unused()  # the process goes on to other tasks

    return df.mapInArrow(run, schema)
