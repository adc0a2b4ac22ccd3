"""Fill-in-middle: a text is cut twice at unit borders and its parts change places, so that a model learns to fill gaps.

A unit is a run of letters A-Z, or any other single code point. A text's bytes are counted in blocks of fixed size: units
that start there, and code points. Two Fenwick trees hold the counts, and a binary-lifting descent finds the block where a
wanted unit starts together with the code points before it; only that block is then looked at byte by byte. So a text is
read once, in pieces, and what is held beside it is two numbers for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomosaic.llm.common import binaries, map_batches

# fixed values
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 texts, so many are left as they are, and of 100 others so many start with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of a block of the trees, and of the pieces in which they are counted (a multiple of it).
BLOCK, PIECE = 1024, 1 << 20

LETTER = np.zeros(256, bool)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1] = True


def starts(raw: bytes, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes from ``begin`` to ``end``: whether a unit starts there, and whether a code point does."""
    part = np.frombuffer(raw, np.uint8, end - begin, begin)
    point = (part & 0xC0) != 0x80
    letter = LETTER[part]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    if begin and letter[0] and LETTER[raw[begin - 1]]:
        unit[0] = False
    return unit, point


class BlockTree:
    """Fenwick trees over a text's blocks: units that start in a block, and its code points."""

    def __init__(self, raw: bytes, block: int = BLOCK):
        self.raw, self.block = raw, block
        piece = max(PIECE // block, 1) * block
        counts = []
        for begin in range(0, len(raw), piece):
            marks = starts(raw, begin, min(begin + piece, len(raw)))
            edges = np.arange(0, len(marks[0]), block)
            counts.append(np.stack([np.add.reduceat(m, edges, dtype=np.int64) for m in marks]))
        each = np.concatenate(counts, axis=1) if counts else np.empty((2, 0), np.int64)
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(each, axis=1)], axis=1)
        place = np.arange(sums.shape[1])
        self.units, self.points = (sums - sums[:, place - (place & -place)]).tolist()
        self.n_blocks = each.shape[1]
        self.n_units, self.n_points = sums[:, -1].tolist()

    def find(self, unit: int) -> tuple[int, int]:
        """Byte offset and code points before unit number ``unit`` (from 0); the text's end for the number of all."""
        if unit >= self.n_units:
            return len(self.raw), self.n_points
        at, points, step = 0, 0, 1 << (self.n_blocks.bit_length() - 1)
        while step:
            further = at + step
            if further <= self.n_blocks and self.units[further] <= unit:
                at = further
                unit -= self.units[at]
                points += self.points[at]
            step >>= 1
        begin = at * self.block
        mark, point = starts(self.raw, begin, min(begin + self.block, len(self.raw)))
        inside = int(np.flatnonzero(mark)[unit])
        return begin + inside, points + int(np.count_nonzero(point[:inside]))


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from a row's key, the same on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, third: Column, fourth: Column, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (third % 100 >= 100 - plain_percent)
    return F.when(plain, "plain").when(fourth % 100 < spm_percent, "spm").otherwise("psm")


def infill(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ("doc_id",), seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``keep`` columns and (n, form, prefix_chars, middle_chars, output) for every row, whole texts in and out.

    ``n`` counts units. The prefix ends after the smaller, the middle after the larger of two numbers of units drawn from
    ``key``; a null key draws like an empty one, rows of one key are cut alike in units. Form ``psm`` is prefix, suffix,
    middle, each behind its mark, ``spm`` suffix, prefix, middle; a ``plain`` text stays as it is, and its lengths are
    null: an empty or null text (null is taken as empty), one that contains a mark, and a drawn share. Repeated rows give
    repeated results, an empty table an empty one. Columns not in ``keep`` are left out, so their names cannot clash; a
    kept column with a result's name is an error.
    """
    results = ["n", "form", "prefix_chars", "middle_chars", "output"]
    if clash := {*keep} & {*results, "_text", "_first", "_second"}:
        raise ValueError(f"columns {sorted(clash)} clash with results")
    first, second, third, fourth = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text), F.lit(""))
    # "form" of the input, if it has one, is read by nothing here
    drawn = docs.select(*keep, whole.alias("_text"), first.alias("_first"), second.alias("_second"), form_of(whole, third, fourth).alias("form"))
    types = dict(drawn.dtypes)

    def start() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def work(batch: pa.RecordBatch) -> dict[str, object]:
            place = batch.schema.get_field_index
            forms, ones, twos = (batch.column(place(c)).to_pylist() for c in ("form", "_first", "_second"))
            n, before, between, out = [], [], [], []
            for raw, form, one, two in zip(binaries(batch, "_text"), forms, ones, twos, strict=True):
                tree = BlockTree(raw, block)
                n.append(tree.n_units)
                if form == "plain":
                    before.append(None)
                    between.append(None)
                    out.append(raw)
                    continue
                low, high = sorted(draw % (tree.n_units + 1) for draw in (one, two))
                (a, a_points), (b, b_points) = tree.find(low), tree.find(high)
                before.append(a_points)
                between.append(b_points - a_points)
                parts = [(PREFIX, raw[:a]), (SUFFIX, raw[b:])]
                parts = [*(parts if form == "psm" else parts[::-1]), (MIDDLE, raw[a:b])]
                out.append(b"".join(mark.encode() + part for mark, part in parts))
            return {
                **{c: batch.column(place(c)) for c in keep},
                "n": pa.array(n, pa.int64()),
                "form": batch.column(place("form")),
                "prefix_chars": pa.array(before, pa.int64()),
                "middle_chars": pa.array(between, pa.int64()),
                "output": pa.array(out, pa.binary()).cast(pa.string()),
            }

        return work

    kept = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return map_batches(drawn, start, f"{kept}{', ' if kept else ''}n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; no mark stands in a text that was cut, so each stands once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
